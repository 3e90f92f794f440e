"""Token files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

A token file is a folder of two Parquet tables.  `codebook` (id, length) has the code lengths; the codes follow from
them in canonical order.  `blocks` has the coded documents in ascending doc_id order: part and seq place a block,
block_start counts the ids of its part before it, doc_ids, counts and byte_sizes describe its documents, `bits` holds
their codes, each document from a byte of its own, and `marks` the bit offset of every MARK-th id of a document, so
that decoding starts at any mark and all marks of a block decode side by side.

Defined cases: a null text has only the end id; a null doc_id comes first; equal doc_ids are ordered by their coded ids;
an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, read, shared_dir, stage, text_slices
from .tokens import ENCODE_BYTES, encoder

#: Longest code; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Ids between two bit-offset checkpoints.
MARK = 256
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
END_ID = 2


def code_lengths(weights: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive weights, by package-merge."""
    n = len(weights)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = np.argsort(weights, kind="stable")
    leaves = np.asarray(weights, np.float64)[order]
    merged, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        kinds.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(kinds):
        got = int(is_leaf[:take].sum())
        lengths[:got] += 1  # the chosen leaves of a level are its lightest
        take = 2 * (take - got)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: codes count up in the order of (length, id)."""
    codes, code, last = np.zeros(len(ids), np.int64), 0, 0
    for k in np.lexsort((ids, lengths)):
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    return codes


class Codebook:
    """Code tables for ids of 16 bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        code, size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        code[self.ids], size[self.ids] = canonical(self.ids, self.lengths), self.lengths
        return code, size

    def decoding(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and code length for each value of the next MAX_BITS bits."""
        symbol, size = np.zeros(1 << MAX_BITS, np.uint16), np.zeros(1 << MAX_BITS, np.uint8)
        by = np.lexsort((self.ids, self.lengths))
        span = 1 << (MAX_BITS - self.lengths[by])
        total = int(span.sum())
        symbol[:total], size[:total] = np.repeat(self.ids[by], span), np.repeat(self.lengths[by], span)
        return symbol, size


def pack_bits(codes: np.ndarray, sizes: np.ndarray, at: np.ndarray, n_bits: int) -> np.ndarray:
    """Bytes with each code at its bit offset; offsets ascend and codes don't overlap."""
    words = np.zeros((n_bits >> 5) + 2, np.uint64)
    if len(codes):
        word = at >> 5
        value = codes << (64 - (at & 31) - sizes).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        both = np.add.reduceat(value, first)
        words[word[first]] += both >> np.uint64(32)
        words[word[first] + 1] += both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: (n_bits + 7) >> 3]


def encode_flat(ids: np.ndarray, off: np.ndarray, code: np.ndarray, size: np.ndarray):
    """Code documents (ids in a row, offsets): bytes of each and its marks."""
    sizes = size[ids]
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], ends])
    doc_bits = before[off[1:]] - before[off[:-1]]
    doc_bytes = (doc_bits + 7) >> 3
    byte_at = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = ends - sizes + np.repeat(byte_at[:-1] * 8 - before[off[:-1]], np.diff(off))
    raw = pack_bits(code[ids], sizes, at, int(byte_at[-1]) * 8).tobytes()
    for i in range(len(off) - 1):
        marks = before[off[i] : off[i + 1] : MARK] - before[off[i]]
        yield raw[byte_at[i] : byte_at[i + 1]], marks.astype("<u4").tobytes()


def decode_marks(raw: np.ndarray, bit_at: np.ndarray, counts: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decode counts[i] ids from bit offset bit_at[i] for all i side by side; the ids come in a row."""
    out = np.zeros(int(counts.sum()), np.uint16)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    by = np.argsort(-counts, kind="stable")
    pos, put, left = bit_at[by].astype(np.int64), (np.cumsum(counts) - counts)[by], counts[by]
    shift = np.uint32(32 - MAX_BITS)
    live = len(by)
    for step in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= step:
            live -= 1
        p = pos[:live]
        key = (window[p >> 3] << (p & 7).astype(np.uint32)) >> shift
        out[put[:live] + step] = symbol[key]
        p += size[key]
    return out


_STAGED, _STAGED_ARROW = arrow_schema("counts boolean, doc_id long, ids binary")
_CODED, _CODED_ARROW = arrow_schema("doc_id long, n_ids long, bits binary, marks binary")
_BLOCKS, _BLOCKS_ARROW = arrow_schema(
    "part int, seq long, block_start long, n_ids long, doc_ids array<long>, counts array<long>, byte_sizes array<long>, bits binary, marks binary"
)
_DIGEST, _DIGEST_ARROW = arrow_schema("part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
_IDS, _IDS_ARROW = arrow_schema("part int, doc_id long, in_part long, n_tokens long, ids array<int>")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(counts, doc_id, ids) of documents: ids as little-endian 16-bit integers, with the end id.

    Each task adds a row with counts true, whose ids are 65,536 counts of 64 bits.
    """

    def run(batches):
        codec = encoder(tokenizer, True)
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in text_slices(batch, limit=ENCODE_BYTES):
                flat, off = codec.encode(part.column("text"), end_id)
                total += np.bincount(flat, minlength=1 << 16)
                n, raw = part.num_rows, flat.astype("<u2").tobytes()
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * off).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), part.column("doc_id").cast(pa.int64()), ids], schema=_STAGED_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([total.astype("<i8").tobytes()])], schema=_STAGED_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _STAGED)


def count_ids(staged: DataFrame) -> Codebook:
    """The codebook for all ids of `staged`; the driver gets one count an id of the vocabulary, at most 65,536."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for counts in batch.column("ids").to_pylist():
                total += np.frombuffer(counts, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    rows = staged.where("counts").select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    ids = np.array([r[0] for r in rows], np.int64)
    return Codebook(ids, code_lengths(np.array([r[1] for r in rows], np.int64)))


def write_tokens(staged: DataFrame, path: str) -> None:
    """Write what tokenize() gives as a token file below `path`."""
    spark = staged.sparkSession
    book = count_ids(staged)

    def code(batches):
        table, size = book.encoding()
        for batch in batches:
            for part in text_slices(batch, "ids"):
                ids = [np.frombuffer(x, "<u2") for x in part.column("ids").to_pylist()]
                counts = np.array([len(x) for x in ids], np.int64)
                off = np.concatenate([[0], np.cumsum(counts)])
                coded = list(encode_flat(np.concatenate(ids), off, table, size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())],
                    schema=_CODED_ARROW,
                )

    def block(batches):
        from pyspark import TaskContext

        part, seq, start, rows, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def closed():
            return pa.RecordBatch.from_pylist(
                [{
                    "part": part, "seq": seq, "block_start": start, "n_ids": n, "doc_ids": [r[0] for r in rows], "counts": [r[1] for r in rows],
                    "byte_sizes": [len(r[2]) for r in rows], "bits": b"".join(r[2] for r in rows), "marks": b"".join(r[3] for r in rows),
                }],
                schema=_BLOCKS_ARROW,
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and n + row[1] > BLOCK_IDS:
                    yield closed()
                    seq, start, rows, n = seq + 1, start + n, [], 0
                rows.append(row)
                n += row[1]
        if rows:
            yield closed()

    coded = staged.where("not counts").select("doc_id", "ids").mapInArrow(code, _CODED)
    ordered = coded.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "bits")
    # bits do not compress any further
    ordered.mapInArrow(block, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    lengths = [(int(i), int(n)) for i, n in zip(book.ids, book.lengths)]
    spark.createDataFrame(lengths, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")


def read_tokens(spark, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a token file, or the unsigned ids_crc32 in place of ids."""
    rows = sorted(spark.read.parquet(f"{path}/codebook").collect())
    book = Codebook(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # one total for each part of the file: as many as there were partitions
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n

    def run(batches):
        symbol, size = book.decoding()
        for batch in batches:
            for b in range(batch.num_rows):
                row = {name: batch.column(name)[b] for name in ("part", "block_start", "doc_ids", "counts", "byte_sizes", "bits", "marks")}
                counts = row["counts"].values.to_numpy(zero_copy_only=False)
                n_marks = -(-counts // MARK)
                byte_sizes = row["byte_sizes"].values.to_numpy(zero_copy_only=False)
                at = np.repeat((np.cumsum(byte_sizes) - byte_sizes) * 8, n_marks) + np.frombuffer(row["marks"].as_buffer(), "<u4")
                first = np.cumsum(n_marks) - n_marks
                nth = np.arange(int(n_marks.sum())) - np.repeat(first, n_marks)
                lane = np.minimum(MARK, np.repeat(counts, n_marks) - nth * MARK)
                ids = decode_marks(np.frombuffer(row["bits"].as_buffer(), np.uint8), at, lane, symbol, size).astype("<u4")
                off = np.concatenate([[0], np.cumsum(counts)])
                n, part = len(counts), row["part"].as_py()
                columns = [pa.array([part] * n, pa.int32()), row["doc_ids"].values, pa.array(off[:-1] + row["block_start"].as_py()), pa.array(counts)]
                if digest:
                    last = pa.array([zlib.crc32(ids[off[i] : off[i + 1]]) for i in range(n)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, last], schema=_DIGEST_ARROW if digest else _IDS_ARROW)

    found = blocks.mapInArrow(run, _DIGEST if digest else _IDS)
    parts = spark.createDataFrame(starts, "part int, part_start long")
    last = "ids_crc32" if digest else "ids"
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", last)


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    """Digest of each document of `documents` as read back from its token file."""
    import public_tokenizers

    staged = stage(tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "ids")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(staged, path)
    return read_tokens(spark, path, digest=True)
