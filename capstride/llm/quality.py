"""Quality rules: a learned decision list over text statistics, natively.

Statistics of a text are DataFrame expressions over its words and lines.  Sequential covering learns an ordered list of
rules from labelled rows: each rule is a conjunction of thresholds that grows literal by literal, for the best gain of
information on the growing part, and is then pruned from its end on the other part.  Rules that reject are kept only
when they are nearly pure.  The list becomes one ordered CASE expression: the first rule that holds decides, and what no
rule covers is kept.

Learning takes at most LABELLED_ROWS labelled documents, those of the smallest hash of doc_id; their statistics come to
the driver.  Statistics and verdicts of all documents are native expressions over whole texts.

Defined cases: a null or empty text has no words and fails the base rule; null labels and labels without a document
teach nothing; without both labels the list is empty; repeated documents are judged alike; other columns stay,
but for those with the names of results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, read

LABELLED_ROWS = 20_000
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Thresholds tried for a statistic, literals of a rule, rules of a list.
CUTS, MAX_LITERALS, MAX_RULES = 24, 3, 12
#: A rejecting rule covers so many labelled rows at least, with so large a share of bad ones on both parts.
MIN_COVER, MIN_PURITY = 12, 0.95


STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct",
)


def with_statistics(docs: DataFrame, extra: bool = True) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), and for the rules some more counts.

    Columns of `docs` with these names are replaced.
    """
    docs = docs.drop(*STATISTICS)
    df = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("__w", F.filter(F.split("__t", SPACE_RE), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    # 64-bit hashes of windows; those of one text are compared, so that a chance hit is out of the question
    df = df.withColumn("__g", F.transform(starts, lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)])))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("__l", lines)
    length = lambda pattern: F.length(F.regexp_replace("__t", pattern, ""))
    new = {
        "word_chars": length(SPACE_RE),
        "n_symbols": length("[^#*$%&|<>]+"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.size(F.array_distinct("__g")) == F.size("__g"), F.lit(0)).otherwise(_repeat_words()),
    }
    if extra:
        new |= {
            "n_lines": F.size("__l"),
            "n_upper": length("[^\\p{Lu}]+"),
            "n_digits": length("[^0-9]+"),
            "n_stops": length("[^.!?]+"),
            "n_distinct": F.size(F.array_distinct("__h")),
        }
    counts = F.struct("n_words", *[v.cast("long").alias(k) for k, v in new.items()])
    # a generator of one row: filters on the counts stay above it and don't expand into the expressions below
    return df.select(*docs.columns, F.inline(F.array(counts)))


def _repeat_words() -> Column:
    """Words inside windows that a text has twice: sort (hash, place), mark equal neighbours, add up what they cover."""
    by = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    n = F.size("__g")
    near = lambda s, j: F.get(s, j)["g"]
    marked = F.transform(
        F.array(by),  # bind the sorted array once
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(near(s, j - 1) == x["g"], F.lit(False)) | F.coalesce(near(s, j + 1) == x["g"], F.lit(False))).alias("twice"))),
                    lambda x: x["twice"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-WINDOW).cast("int").alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("int").alias("n"), i.cast("int").alias("last"))
    return F.when(n > 0, F.aggregate(F.get(marked, F.lit(0)), start, step, lambda acc: acc["n"])).otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: Statistics for thresholds: each a ratio of two counts, in thousandths, or a count; whole numbers, so that they are
#: the same wherever they are computed.
FEATURES: dict[str, tuple[str, str | None]] = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "stop_rate": ("n_stops", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top)
    return F.floor(F.col(top) * 1000 / F.greatest(F.col(bottom), F.lit(1))).cast("long")


@dataclass(frozen=True)
class Literal:
    """feature >= cut, or feature < cut."""

    name: str
    above: bool
    cut: int

    def column(self) -> Column:
        return feature(self.name) >= self.cut if self.above else feature(self.name) < self.cut

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.cut if self.above else x[self.name] < self.cut


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; each rejects what it is the first to cover."""

    rules: tuple[tuple[Literal, ...], ...]

    def column(self) -> Column:
        """The verdict: true keeps."""
        out = None
        for rule in self.rules:
            when = rule[0].column()
            for literal in rule[1:]:
                when = when & literal.column()
            out = F.when(when, F.lit(False)) if out is None else out.when(when, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(True)


def _covered(rule, x, n) -> np.ndarray:
    out = np.ones(n, bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _gain(before: tuple[int, int], bad: int, good: int) -> float:
    """FOIL's gain: bad rows still covered times the bits by which their share rose."""
    if not bad:
        return 0.0
    p0, n0 = before
    return bad * (np.log2(bad / (bad + good)) - np.log2(p0 / (p0 + n0)))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, third: np.ndarray) -> DecisionList:
    """Sequential covering; `third` marks the rows that only prune and judge."""
    n = len(bad)
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="nearest")) if n else [] for k, v in x.items()}
    for k, v in x.items():  # the bad rows' own quantiles show where they part from the others
        if bad.any():
            cuts[k] = np.unique(np.concatenate([cuts[k], np.quantile(v[bad], np.linspace(0, 1, CUTS + 2)[1:-1], method="nearest")]))
    left, rules = np.ones(n, bool), []
    literals = [Literal(k, above, int(c)) for k in x for c in cuts[k] for above in (True, False)]
    masks = [literal.holds(x) for literal in literals]
    for _ in range(MAX_RULES):
        cover, rule = left & ~third, []
        while len(rule) < MAX_LITERALS:
            p0, n0 = int((cover & bad).sum()), int((cover & ~bad).sum())
            if not p0 or not n0:
                break
            scored = [(_gain((p0, n0), int((cover & m & bad).sum()), int((cover & m & ~bad).sum())), -i) for i, m in enumerate(masks)]
            gain, i = max(scored)
            if gain <= 0:
                break
            rule.append(literals[-i])
            cover &= masks[-i]

        def worth(some) -> float:
            hit = left & third & _covered(some, x, n)
            p, m = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if not rule:
            break
        hit = left & _covered(rule, x, n)
        p, m = int((hit & bad).sum()), int((hit & ~bad).sum())
        judged = hit & third
        pure = p >= MIN_PURITY * (p + m) and int((judged & bad).sum()) >= MIN_PURITY * int(judged.sum())
        if p < MIN_COVER or not pure:
            break
        rules.append(tuple(rule))
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DecisionList:
    """Learn from `labels` (doc_id, quality: 0 is bad); at most `rows` of them."""
    token = F.xxhash64("doc_id")
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = few.orderBy(token, "doc_id").limit(rows)
    known = with_statistics(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"))
    known = known.where(~base_failed()).select("doc_id", "quality", *[feature(k).alias(f"f_{k}") for k in FEATURES], F.pmod(token, F.lit(3)).alias("part"))
    got = sorted(known.drop("doc_id").collect())
    table = np.array(got, np.int64).reshape(len(got), len(FEATURES) + 2)
    x = {k: table[:, i + 1] for i, k in enumerate(FEATURES)}
    bad = table[:, 0] == 0
    if not bad.any() or bad.all():
        return DecisionList(())
    return learn(x, bad, table[:, -1] == 0)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics, base_failed and kept beside the columns of `docs`."""
    df = with_statistics(docs.drop("base_failed", "kept"))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, read(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
