"""Near-duplicate documents by min-max hashing.

A document's set has a 64-bit hash for each distinct run of `shingle` words.  Each permutation of these hashes gives
two values, its minimum and its maximum, so that half as many evaluations make a signature; bands of ROWS values become
buckets.  Documents with equal sets form a class, which is one node.  Members of a bucket first meet those of its most popular ones
that their signatures say they are most like, so that a group of near copies soon hangs together.  Then the shingles that
only one of the remaining sets has are counted: what two sets can share at most rules out most pairs, exactly, as edits
of a copy are mostly its own.  Last, members of a bucket that are still of different components are compared in blocks of
their full sets, each two in the first bucket that they share (see buckets.py for the rounds).  Sizes, and four bits of
each value, tell most pairs that can't be similar enough.  A link counts only when the full sets agree by `similar`
percent; components of all links are the result.

What hashing can lose: a pair of similarity 0.85 shares none of the 40 buckets of 6 values with probability 6e-9, and one
of 0.8 with 6e-6; the bits of a linked pair tell against it with 3e-9 (see SLACK).

Defined cases: texts without a word, and null texts, have an empty set and are linked with nothing; a text with fewer
words than a shingle has one shingle; a null doc_id is in no component and is kept; rows with equal doc_ids and different
texts are in one component, which holds what any of the texts is linked with; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import beside, bucket_components, company, in_blocks, meeting, shared_buckets
from .common import arrow_schema, gram_hashes, mix, read, stage, text_bytes, text_slices, word_hashes, word_spans
from .graph import forest, relabel

BANDS, ROWS = 40, 6
#: Values whose lowest four bits one 64-bit word holds.
PACK = 16
WORDS = -(-BANDS * ROWS // PACK)
#: Standard deviations by which the agreement of a linked pair's values may fall short of what its similarity lets expect:
#: a binomial of 240 trials at 0.8125 or more falls that low with probability 3e-9 at most.
SLACK = 6.3
#: Members that one task compares with a copy of the leader's text.
SALT_PAIRS = 256


def shingle_sets(raw: np.ndarray, off: np.ndarray, shingle: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, in a row, and n + 1 offsets."""
    begins, ends, words = word_spans(raw, off)
    hashes = word_hashes(raw, begins, ends, fold)
    n = np.diff(words)
    doc = np.repeat(np.arange(len(n)), np.where(n >= shingle, n - shingle + 1, 0))
    if len(doc):
        first = np.cumsum(np.where(n >= shingle, n - shingle + 1, 0))
        at = np.arange(len(doc)) - np.repeat(first - np.where(n >= shingle, n - shingle + 1, 0), np.where(n >= shingle, n - shingle + 1, 0))
        grams = gram_hashes(hashes, shingle)[at + words[:-1][doc]]
    else:
        grams = np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        one = np.array([gram_hashes(hashes[words[i] : words[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, mix(one)])
    by = np.lexsort((grams, doc))
    doc, grams = doc[by], grams[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(n) + 1))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(4).integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)


def signatures(grams: np.ndarray, off: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hashes (texts x bands) and four bits of each value (texts x words of PACK).  No set is empty.

    A band has rows / 2 permutations, each with its minimum and maximum.
    """
    n = len(off) - 1
    out = np.zeros((n, bands), np.uint64)
    bits = np.zeros((n, -(-bands * rows // PACK)), np.uint64)
    multipliers = _multipliers(bands * rows // 2)
    # bounded steps of texts keep the values in the processor's cache
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(off, off[low] + 65_536, side="right")) - 1)
        x = (grams[off[low] : off[high]] >> np.uint64(32)).astype(np.uint32)
        at = off[low:high] - off[low]
        for band in range(bands):
            h = np.full(high - low, band + 1, np.uint64)
            for k in range(band * rows // 2, (band + 1) * rows // 2):
                y = x * multipliers[k]
                y ^= y >> np.uint32(15)
                for nth, extreme in ((2 * k, np.minimum), (2 * k + 1, np.maximum)):
                    v = mix(extreme.reduceat(y, at).astype(np.uint64) + np.uint64(nth))
                    h = mix(h + v)
                    bits[low:high, nth // PACK] |= (v & np.uint64(15)) << np.uint64(4 * (nth % PACK))
            out[low:high, band] = h
        low = high
    return out, bits


_SIGNED, _SIGNED_ARROW = arrow_schema("doc_id long, n_shingles long, class binary, buckets array<long>, bits array<long>")
_LINKS, _LINKS_ARROW = arrow_schema("a long, b long, linked boolean")


def sign(docs: DataFrame, shingle: int, fold: bool = True) -> DataFrame:
    """Set size, class and buckets of each document; class and buckets are null for empty sets."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                raw, off = text_bytes(part.column("text"))
                grams, at = shingle_sets(raw, off, shingle, fold)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                buckets, bits = signatures(grams, np.concatenate([at[some], at[-1:]])) if len(some) else (np.zeros((0, BANDS), np.uint64), np.zeros((0, WORDS), np.uint64))
                classes: list = [None] * len(sizes)
                for i in some.tolist():
                    classes[i] = _class(grams[at[i] : at[i + 1]].tobytes())
                upto = np.concatenate([[0], np.cumsum(sizes > 0)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto * np.int32(x.shape[1])), pa.array(x.reshape(-1).view(np.int64))) for x in (buckets, bits)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(classes, pa.binary()), *lists], schema=_SIGNED_ARROW
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNED)


_BUCKETS, _BUCKETS_ARROW = arrow_schema("bucket long, node long, n long")
_OWN, _OWN_ARROW = arrow_schema("gram long, node long, n long")
_SETS, _SETS_ARROW = arrow_schema("class binary, grams binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """Rows of company() for all buckets of rows (node, buckets)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("buckets")
            bucket = lists.flatten().to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), len(bucket) // max(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in company(bucket, node)], schema=_BUCKETS_ARROW)

    return classes.select("node", "buckets").mapInArrow(run, _BUCKETS)


def full_sets(docs: DataFrame, shingle: int, fold: bool) -> DataFrame:
    """(class, grams): the ascending hashes of each set that is not empty."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                raw, off = text_bytes(part.column("text"))
                grams, at = shingle_sets(raw, off, shingle, fold)
                own = [grams[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(np.diff(at)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in own], pa.binary()), pa.array(own, pa.binary())], schema=_SETS_ARROW)

    return docs.select("text").mapInArrow(run, _SETS)


def _class(grams: bytes) -> bytes:
    return hashlib.blake2b(grams, digest_size=16).digest()


def verify(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b) of nodes, by their full sets (node, grams).

    A leader a meets its members in tasks of about SALT_PAIRS pairs; only its set is copied.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    leaders = salts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wanted = members.withColumn("node", F.col("b")).unionByName(leaders.withColumn("node", F.col("a")))
    rows = beside(sets.select("node", "grams"), wanted, "node").select("a", "salt", "b", "grams")

    def run(batches):
        leader, own = None, None
        for batch in batches:
            found = []
            for a, b, grams in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "grams"))):
                this = np.frombuffer(grams, np.uint64)
                if b is None:
                    leader, own = a, this
                    continue
                if a != leader:
                    raise RuntimeError(f"no set of node {a}")
                both = int(np.isin(this, own, assume_unique=True).sum())
                found.append((a, b, 100 * both >= similar * (len(this) + len(own) - both)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], schema=_LINKS_ARROW)

    by = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return by.mapInArrow(run, _LINKS)


def block_links(open_: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The links that bucket_components() wants of rest(), by full sets; each two nodes meet in the first bucket they share."""

    def solve(bucket: int, parts: list[pa.RecordBatch]):
        node, q, m, may = meeting(parts)
        bits, buckets = (np.concatenate([p.column(c).flatten().to_numpy().view(np.uint64).reshape(p.num_rows, -1) for p in parts]) for c in ("bits", "buckets"))
        n, own = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("shingles", "own"))
        grams = [np.frombuffer(g, np.uint64) for p in parts for g in p.column("grams").to_pylist()]
        agree = np.full((len(q), len(m)), bits.shape[1] * PACK, np.int32)
        for i in range(bits.shape[1]):
            apart = bits[q, i][:, None] ^ bits[m, i][None, :]
            apart |= apart >> np.uint64(2)
            apart |= apart >> np.uint64(1)
            agree -= np.bitwise_count(apart & np.uint64(0x1111111111111111))
        most = np.minimum((n - own)[q][:, None], (n - own)[m][None, :])
        both = n[q][:, None] + n[m][None, :]
        may &= (agree >= least_agreement(similar)) & ((100 + similar) * most >= similar * both)
        x, y = np.nonzero(may)
        x, y = q[x], m[y]
        here = np.zeros(len(x), bool)
        for low in range(0, len(x), 1 << 16):
            i, j = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
            first = (buckets[i] == buckets[j]).argmax(1)
            here[low : low + (1 << 16)] = buckets[i, first] == np.uint64(bucket & 0xFFFFFFFFFFFFFFFF)
        x, y = x[here], y[here]
        a, b = [], []
        for i in np.unique(x).tolist():
            others = y[x == i]
            sizes = np.array([len(grams[j]) for j in others])
            same = np.add.reduceat(np.isin(np.concatenate([grams[j] for j in others]), grams[i]), np.cumsum(sizes) - sizes)
            hit = others[100 * same >= similar * (sizes + len(grams[i]) - same)]
            a += [node[i]] * len(hit)
            b += node[hit].tolist()
        return forest(np.array(a, np.int64), np.array(b, np.int64))

    return in_blocks(open_, [F.col("fact.n").alias("shingles"), F.col("fact.own").alias("own")], solve, sets)


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many shingles of each set (node, grams) no other of them has; nodes without one are left out.

    Each step sends a shingle once, with the number of sets that have it.
    """

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("grams"))) // 8
            grams = np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.int64)
            some, first, n = np.unique(grams, return_index=True, return_counts=True)
            node = np.repeat(batch.column("node").to_numpy(), sizes)[first]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(node), pa.array(n)], schema=_OWN_ARROW)

    counts = sets.select("node", "grams").mapInArrow(run, _OWN).groupBy("gram").agg(F.sum("n").alias("n"), F.min("node").alias("node"))
    return counts.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def agreement(x, y):
    """How many values of two nodes agree in their four bits."""
    total = F.lit(BANDS * ROWS)
    for i in range(WORDS):
        apart = F.get(x["bits"], F.lit(i)).bitwiseXOR(F.get(y["bits"], F.lit(i)))
        pairs = apart.bitwiseOR(F.shiftrightunsigned(apart, 2))
        each = pairs.bitwiseOR(F.shiftrightunsigned(pairs, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(each)
    return total


def least_agreement(similar: int) -> int:
    """How many values of a linked pair agree at least, but for SLACK deviations."""
    share, total = similar / 100 + (1 - similar / 100) / 16, BANDS * ROWS
    return int(total * share - SLACK * (total * share * (1 - share)) ** 0.5)


def possible(x, y, similar: int):
    """Sizes, less the shingles that no other set has, that allow the similarity, and values that agree as often as it lets
    expect, but for SLACK deviations."""
    most = F.least(x["n"] - x["own"], y["n"] - y["own"])
    return ((100 + similar) * most >= similar * (x["n"] + y["n"])) & (agreement(x, y) >= least_agreement(similar))


def near_duplicates(docs: DataFrame, shingle: int = 5, similar: int = 80, fold: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    signed = stage(sign(docs, shingle, fold), "signed")
    some = signed.where("class is not null and doc_id is not null")
    classes = some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("buckets").alias("buckets"), F.min("bits").alias("bits"), F.min("n_shingles").alias("n"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    live = stage(shared_buckets(bucket_rows(classes)), "buckets")
    # full sets of what has company in a bucket are laid aside once for all rounds
    company_of = classes.join(live.select("node").distinct(), "node").select("class", "node", "bits", "buckets", F.col("rep").alias("doc_id"))
    company_of = stage(company_of, "company")
    wanted = docs.select("doc_id", "text").join(company_of.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = full_sets(wanted, shingle, fold).join(company_of.select("class", "node", "bits", "buckets"), "class")
    sets = stage(sets.select("node", "bits", "buckets", "grams"), "sets")

    def facts(own: DataFrame | None = None) -> DataFrame:
        known = classes.withColumn("own", F.lit(0).cast("long")) if own is None else classes.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        # a set and any other share n - own shingles at most, of at least n
        return known.where(100 * (F.col("n") - F.col("own")) >= similar * F.col("n")).select("node", F.struct("n", "own", "bits").alias("fact"))

    def refine(nodes: DataFrame) -> DataFrame:
        return facts(own_shingles(sets.join(nodes, "node", "left_semi"))).join(nodes, "node", "left_semi")

    label = bucket_components(live, lambda pairs: verify(pairs, sets, similar), facts(), lambda x, y: possible(x, y, similar), agreement, refine, lambda open_: block_links(open_, sets, similar))
    label = _same_ids(some, classes, label)
    of = signed.select("doc_id", "n_shingles", "class").join(classes.select("class", "rep", "node"), "class", "left")
    if label is None:
        out = of.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))
    else:
        least = classes.join(label, "node").groupBy("component").agg(F.min("rep").alias("least"))
        out = of.join(label, "node", "left").join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_ids(signed: DataFrame, classes: DataFrame, label: DataFrame | None) -> DataFrame | None:
    """Link the classes of rows with equal doc_ids."""
    several = signed.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most")
    several = stage(several.select("doc_id", "least"), "several")
    if not several.limit(1).count():
        return label
    pairs = signed.select("doc_id", "class").join(several, "doc_id").where("class <> least").select("class", "least")
    node = classes.select("class", "node")
    links = pairs.join(node, "class").select("least", F.col("node").alias("a")).join(node.withColumnRenamed("class", "least"), "least")
    return stage(relabel(label, links.select("a", F.col("node").alias("b")).distinct()), "labels")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of documents that agree in 85 % of their 3-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, similar=85)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
