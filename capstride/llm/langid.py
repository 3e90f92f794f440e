"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of characters within words: a word, lower-cased and closed by a blank, is a sequence of
characters after a start mark, and P(c | history) interpolates the discounted counts of orders ORDER down to 1 with
Kneser-Ney continuation counts.  Models are sorted arrays of 64-bit n-gram hashes with one column of log probabilities
and one of back-off weights for each language.  A document's cross-entropy under a language is its nats a character;
the lowest wins.  As models stop at word borders, a worker scores each distinct word once and sums.

Training takes at most TRAIN_DOCS documents of a language (those of the smallest hash of doc_id), the bounded sample of
labelled rows, with their whole texts: workers count their words, of which the driver gets each one once a language.
Predictions take whole texts.

The rejection threshold of a language is the REJECT quantile of the cross-entropy of its own training documents that
the counts leave out; `rejected` marks predictions above it.

Defined cases: a null text or one without a letter is `und` with score 0 and is not rejected; no training rows make
every document `und`; ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, read, stage, text_slices

ORDER = 4
TRAIN_DOCS = 400
#: Share of each language's sample that only calibrates.
CALIBRATE = 4
REJECT = 0.99
#: Distinct words whose scores a worker keeps.
CACHE_WORDS = 300_000
#: Nats a character by which scores differ e-fold.
SCALE = 0.1


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category."""
    return any(map(str.isalpha, text))


def keys(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k codes that end at each position k - 1, k, ..."""
    n = len(codes) - k + 1
    h = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        h = (h ^ codes[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after ORDER - 1 start marks and before a blank, and the offset of each word."""
    pad = "\x02" * (ORDER - 1)
    text = "".join([f"{pad}{w} " for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def predicted(codes: np.ndarray) -> np.ndarray:
    """Positions that the model predicts: all but start marks."""
    return np.flatnonzero(codes != 2)


class LanguageModels:
    """Log probabilities of all languages in shared sorted hash arrays, one pair of tables for each order."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # order k: hashes, discounted share (n x L)
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []  # history of k - 1 codes: hashes, weight (n x L)
        self.floor = np.zeros(len(languages))
        self.limits = np.full(len(languages), np.inf)

    def fit(self, samples: list) -> LanguageModels:
        """Learn from the lower-cased words of each language, or from counts of them."""
        size = len(self.languages)
        grams: list[list[tuple]] = [[] for _ in range(ORDER)]
        for sample in samples:
            weights_of = Counter(sample)
            words = sorted(weights_of)
            codes, off = word_codes(words)
            at = predicted(codes)
            at = at[at >= ORDER - 1]
            full = np.stack([codes[at - ORDER + 1 + j] for j in range(ORDER)], 1) if len(at) else np.zeros((0, ORDER), "<u4")
            rows, inverse = np.unique(full, axis=0, return_inverse=True)
            times = np.array([weights_of[w] for w in words], np.int64)[np.searchsorted(off, at, side="right") - 1]
            counts = np.bincount(inverse.reshape(-1), times, len(rows)).astype(np.int64)
            for k in range(ORDER, 0, -1):
                grams[k - 1].append((rows, counts))
                # lower orders count the distinct characters to the left: continuation counts
                rows, counts = np.unique(rows[:, 1:], axis=0, return_counts=True)
        for k in range(1, ORDER + 1):
            hashes, shares, history, weights = [], [], [], []
            for rows, counts in grams[k - 1]:
                n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
                discount = n1 / (n1 + 2 * n2) if n1 else 0.5
                h = _row_keys(rows)
                past = _row_keys(rows[:, :-1]) if k > 1 else np.zeros(len(rows), np.uint64)
                uniq, inv = np.unique(past, return_inverse=True)
                total = np.bincount(inv, counts, len(uniq)) if len(uniq) else np.zeros(0)
                types = np.bincount(inv, minlength=len(uniq)) if len(uniq) else np.zeros(0)
                hashes.append(h)
                shares.append(np.maximum(counts - discount, 0) / total[inv] if len(uniq) else np.zeros(0))
                history.append(uniq)
                weights.append(discount * types / np.maximum(total, 1))
            self.tables.append(_merge(hashes, shares, size, 0.0))
            self.backoff.append(_merge(history, weights, size, 1.0))
        alphabet = np.array([len(np.unique(rows[:, -1])) if len(rows) else 1 for rows, _ in grams[0]])
        self.floor = 1.0 / (alphabet + 1000.0)
        return self

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log probability of each word under each language, and its number of predicted characters."""
        size = len(self.languages)
        if not words:
            return np.zeros((0, size)), np.zeros(0)
        codes, off = word_codes(words)
        at = predicted(codes)
        at = at[at >= ORDER - 1]
        p = np.broadcast_to(self.floor, (len(at), size))
        for k in range(1, ORDER + 1):
            share = _look(self.tables[k - 1], keys(codes, k)[at - k + 1], 0.0)
            if k > 1:
                weight = _look(self.backoff[k - 1], keys(codes, k - 1)[at - k + 1], 1.0)
            else:
                weight = np.broadcast_to(self.backoff[0][1][0], p.shape)
            p = share + weight * p
        of = np.searchsorted(off, at, side="right") - 1
        loss = np.stack([np.bincount(of, -np.log(p[:, i]), len(words)) for i in range(size)], 1)
        return loss, np.bincount(of, minlength=len(words)).astype(float)


def _row_keys(rows: np.ndarray) -> np.ndarray:
    """The same hashes as keys() for rows of codes."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _merge(hashes: list[np.ndarray], values: list[np.ndarray], size: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    every = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    table = np.full((len(every) + 1, size), missing)  # the last row is for what is not there
    for i, (h, v) in enumerate(zip(hashes, values)):
        table[np.searchsorted(every, h), i] = v
    return every, table


def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
    every, values = table
    if not len(every):
        return np.full((len(h), values.shape[1]), missing)
    at = np.searchsorted(every, h)
    at[at == len(every)] = len(every) - 1
    return values[np.where(every[at] == h, at, len(every))]


class Scorer:
    """Cross-entropies of texts, with the scores of distinct words kept."""

    def __init__(self, models: LanguageModels):
        self.models = models
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.loss = np.zeros((0, len(self.models.languages)))
        self.chars = np.zeros(0)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats a character of each text under each language."""
        lists = [t.lower().split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self._clear()
        index, new = self.index, []
        numbers = []
        for words in lists:
            for w in words:
                n = index.get(w)
                if n is None:
                    n = index[w] = len(index)
                    new.append(w)
                numbers.append(n)
        if new:
            found = [self.models.words(new[i : i + 5000]) for i in range(0, len(new), 5000)]
            self.loss = np.concatenate([self.loss, *[f[0] for f in found]])
            self.chars = np.concatenate([self.chars, *[f[1] for f in found]])
        k = np.array(numbers, np.int64)
        of = np.repeat(np.arange(len(texts)), [len(w) for w in lists])
        chars = np.maximum(np.bincount(of, self.chars[k], len(texts)), 1)
        return np.stack([np.bincount(of, self.loss[k, i], len(texts)) / chars for i in range(self.loss.shape[1])], 1)


def held_out(doc_id="doc_id") -> F.Column:
    """Whether a document is held out: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


_COUNTS, _COUNTS_ARROW = arrow_schema("lang string, word string, n long")
_OWN, _OWN_ARROW = arrow_schema("lang string, cross_entropy double")


def fit_models(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModels:
    """Models and thresholds from rows (doc_id, text, lang); the driver gets counts of the words of at most train_docs texts a language."""
    bucket = Window.partitionBy("lang", "bin").orderBy("token", "doc_id")
    token = F.xxhash64("doc_id")
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "doc_id", "text", token.alias("token"), F.pmod(token, F.lit(64)).alias("bin"))
    # first the smallest hashes of 64 bins, then of all: no window holds a language as a whole
    ids = rows.select("lang", "doc_id", "token", "bin")
    few = ids.withColumn("n", F.row_number().over(bucket)).where(F.col("n") <= train_docs)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("token", "doc_id"))).where(F.col("n") <= train_docs)
    # train_docs * languages ids at most
    sample = stage(rows.join(F.broadcast(few.select("lang", "doc_id", "n")), ["lang", "doc_id"]).select("lang", "n", "text"), "sample")
    sizes = dict(sample.groupBy("lang").agg(F.max("n")).collect())
    languages = sorted(sizes)
    if not languages:
        return LanguageModels([])
    held = F.col("n") % CALIBRATE == 0
    few_rows = [x for x in languages if sizes[x] < CALIBRATE]
    train = sample.where(~held | F.col("lang").isin(few_rows))

    def count(batches):
        for batch in batches:
            for part in text_slices(batch):
                counts = Counter((lang, w) for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) for w in text.lower().split())
                if counts:
                    langs, words = zip(*counts)
                    yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS_ARROW)

    words: dict[str, dict[str, int]] = {x: {} for x in languages}
    for lang, word, n in train.select("lang", "text").mapInArrow(count, _COUNTS).groupBy("lang", "word").agg(F.sum("n")).collect():
        words[lang][word] = n
    models = LanguageModels(languages).fit([words[x] for x in languages])

    def own(batches):
        scorer = Scorer(models)
        for batch in batches:
            for part in text_slices(batch):
                some = [(x, t) for x, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) if has_letter(t)]
                if some:
                    loss = scorer.entropies([t for _, t in some])
                    at = [languages.index(x) for x, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some]), pa.array(loss[np.arange(len(at)), at])], schema=_OWN_ARROW)

    found: dict[str, list[float]] = {}
    for lang, e in sample.where(held).select("lang", "text").mapInArrow(own, _OWN).collect():
        found.setdefault(lang, []).append(e)
    for lang, losses in found.items():
        models.limits[languages.index(lang)] = float(np.quantile(losses, REJECT))
    return models


_OUT, _OUT_ARROW = arrow_schema("doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def predict(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of whole texts.

    The score is the winner's share of exp(-cross-entropy) among all languages, in units of SCALE nats.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches):
        scorer = Scorer(shared.value)
        names, limits = scorer.models.languages, scorer.models.limits
        for batch in batches:
            for part in text_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                some = np.array([has_letter(t) for t in texts]) & bool(names)
                langs, scores, cross, far = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), bool)
                at = np.flatnonzero(some)
                if len(at):
                    loss = scorer.entropies([texts[i] for i in at])
                    best = loss.argmin(1)
                    least = loss[np.arange(len(at)), best]
                    scores[at] = 1 / np.exp((least[:, None] - loss) / SCALE).sum(1)
                    far[at] = least > limits[best]
                    for i, b, e in zip(at.tolist(), best.tolist(), least.tolist()):
                        langs[i], cross[i] = names[b], e
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(langs), pa.array(scores), pa.array(cross, pa.float64()), pa.array(far)], schema=_OUT_ARROW
                )

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    models = fit_models(docs.where(~held_out()))
    return predict(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
