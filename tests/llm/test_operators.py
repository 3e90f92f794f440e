"""The operators against brute force on small tables, and on awkward and empty ones."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from capstride.llm import balltree, buckets, common, counts, graph, huffman, langid, lines, minhash, mixing, packing, quality, substrings
from capstride.llm import edits as within
from capstride.llm.tokens import ChunkEncoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, PIECES, SMALL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words():
    text = "ab  c\x0bd\n é f ".encode()
    raw = np.frombuffer(text + b"xy", np.uint8)
    begins, ends, upto = common.word_spans(raw, np.array([0, len(text), len(text) + 2]))
    assert [bytes(raw[a:b]).decode() for a, b in zip(begins, ends)] == ["ab", "c", "d", "é f", "xy"] and upto.tolist() == [0, 4, 5]
    assert not len(common.word_spans(raw[:0], np.array([0, 0]))[0])


def cut_windows(rows, k=13):
    first, out = {}, {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1):
            if d is not None:
                first[tuple(w[i : i + k])] = min(d, first.get(tuple(w[i : i + k]), d))
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out.setdefault(d, []).append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_op1(spark, docs, rows, awkward, nothing):
    got = by_id(substrings.op1_substring_dedup(spark, SF))
    for d, ((n, gone, text),) in cut_windows(rows).items():
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
    plain = [(r.doc_id, r.text) for r in awkward.collect()]
    found = collections.defaultdict(list)
    for r in substrings.dedup_substrings(awkward).collect():
        found[r.doc_id].append((r.n_words, r.n_removed, r.kept))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in cut_windows(plain).items()}
    assert not substrings.dedup_substrings(nothing).count()


def test_op1_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_DOCS", 2)
    phrase = " ".join(f"p{i}" for i in range(20))
    texts = [(i, f"a{i} {phrase} b{i}" if i % 3 else phrase) for i in range(12)]
    got = by_id(substrings.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {d: [(r.n_words, r.n_removed, r.kept)] for d, r in got.items()} == cut_windows(texts)


def test_op1_many_contexts(spark, monkeypatch):
    """One common anchor in a text of its own each time, some of these twice, and a common window."""
    monkeypatch.setattr(substrings, "HOT_DOCS", 5)
    monkeypatch.setattr(substrings, "AUTOMATON_CHARS", 2000)
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"x{v}" for v in rng.integers(0, 4000, n))
    texts = [(i, f"{word(14)} one two three four {word(14)}") for i in range(30)]
    texts += [(40 + i, f"{word(3)} {t[30:120]} {word(4)}") for i, (_, t) in enumerate(texts[:12])]
    texts += [(60 + i, f"{word(2)} " + " ".join(f"c{k}" for k in range(13)) + " one two three four") for i in range(15)]
    got = by_id(substrings.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)))
    assert {d: [(r.n_words, r.n_removed, r.kept)] for d, r in got.items()} == cut_windows(texts)
    assert sum(r.n_removed > 0 for r in got.values()) > 20


def test_sql(spark):
    """The operators' SQL on the smallest tables."""
    import duckdb

    from capstride.llm import queries

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        want = con.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall()), name


def test_op2(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(301, None), (302, [float("nan")] * 6), (303, [1.0, None] * 3), (None, [1.0] * 6), (350, [0.5]), (351, [0.25]), (400, [])]
    vectors += [(i, [0.5] * 6) for i in range(500, 560)]
    q = balltree.quantize(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = sorted(map(tuple, balltree.top_k(q, q.where("id % 50 = 0"), 5, 64, 16).collect()))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for i, v in whole.items():
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in whole.items() if j != i and len(w) == len(v))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert not balltree.top_k(q.limit(0), q.limit(0)).count()


def test_op2_large(spark):
    """Components and scores far beyond 2^53, and beyond what a long holds."""
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(150)]
    vectors += [(200, [1e16, 1.0, 0.0]), (201, [-1e16, 3.0, 0.0]), (250, [1e16, 2.0, 5.0]), (300, [1e300, 0.0, 1.0]), (301, [1.7e308, -1.0, 0.0]), (302, [0.0, 0.0, 0.0])]
    q = balltree.quantize(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = sorted(map(tuple, balltree.top_k(q, q.where("id % 50 = 0"), 5, 32, 4).collect()))
    from fractions import Fraction

    most = int(1.7976931348623157e308)
    whole = {i: [max(-most, min(most, (Fraction(x) * 256).__floor__())) for x in v] for i, v in vectors}
    held = lambda s: max(-(2**63) + 2, min(2**63 - 1, s))
    want = []
    for i, v in whole.items():
        if i % 50 == 0:
            best = sorted((-held(sum(a * b for a, b in zip(v, w))), j) for j, w in whole.items() if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_op2_prunes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1, (200, 4)) for c in (0, 500, -500)]).astype(np.int64)
    tree = balltree.BallTree(np.arange(600), x)
    none = np.full(1, balltree._LOW), np.full(1, np.iinfo(np.int64).max)
    s = balltree.Search(np.array([-1]), np.array([[9, 9, 9, 9]]), 3, *none)
    s.visit(tree, 0, np.array([0]), s.bounds(tree, 0, np.array([0])))
    assert s.score[0].tolist() == sorted((x @ [9, 9, 9, 9]).tolist())[:-4:-1] and s.visited < 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=60))
def test_huffman_lengths(weights):
    lengths = huffman.code_lengths(np.array(weights), 8)
    assert lengths.max() <= 8 and (len(weights) == 1 or sum(2.0**-x for x in lengths) == 1)


def test_op3(spark, rows, awkward, nothing, tmp_path):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(BYTE), 0
    got = by_id(huffman.op3_token_file(spark, SF))
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    for name, df in (("a", awkward), ("n", nothing)):
        huffman.write_tokens(huffman.tokenize(df, BYTE), str(tmp_path / name))
    back = huffman.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert not huffman.read_tokens(spark, str(tmp_path / "n")).count()
    assert [r.doc_id for r in back] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert all(r.ids == [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2] for r in back)


def test_chunk_encoder(monkeypatch):
    from tokenizers import Tokenizer

    from capstride.llm import tokens

    texts = ["a <|endoftext|> z", "<|startoftext|>b c <|endoftext|>", "<|ENDOFTEXT|> <|end", "a  b", " \n b", "\n\n c", "x \n", "", "é'll don't A.", "\x1c\xa0 　y.", "<|endoftext|> z", "  q", " J̌ ǰ", "\nA b, c. c", "a. a", "..", None]
    for path, keep in ((BYTE, True), (SMALL, False)):
        plain = Tokenizer.from_file(path)
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert 50256 in want[0] or 49407 in want[0]
        e = ChunkEncoder(path, keep)
        for _ in range(2):
            flat, off = e.encode(texts, 2)
            assert [flat[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == want
        # chunks whose hashes are equal are told apart by their bytes
        with monkeypatch.context() as m:
            m.setattr(tokens, "chunk_hashes", lambda raw, off: np.diff(off).astype(np.uint64) % np.uint64(3))
            e = ChunkEncoder(path, keep)
            for _ in range(2):
                flat, off = e.encode(texts, 2)
                assert [flat[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == want


def components_of(nodes, links):
    of = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, links):
    want = components_of({x for e in links for x in e}, links)
    for chunk in (1, 1000):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(3), chunk=chunk).collect()}
        assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}


def test_shared_buckets(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    near = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= 3
    try:
        rows = [(1, n, 0) for n in range(700)] + [(2, 5, 0), (2, 6, 7), (3, 1, 0), (3, 2, 255), (4, 9, 1)] + [(5, n, (1 << n % 60) - 1) for n in range(100)]
        rows = [rows[i] for i in np.random.default_rng(4).permutation(len(rows))]
        for size in (1, 30, 400):  # rows of a step
            for chosen in (None, near):
                steps = [np.array(rows[i : i + size], np.int64).T for i in range(0, len(rows), size)] * 2
                sent = np.concatenate([np.stack(buckets.company(*(x[:2] if chosen is None else x))) for x in steps], 1).T.tolist()
                df = spark.createDataFrame(sent, "bucket long, node long, n long" if chosen is None else "bucket long, node long, sim long, n long")
                got = buckets.shared_buckets(df, chosen).collect()
                if chosen is None:
                    assert {(r.bucket, r.node) for r in got} == {(b, n) for b, n, _ in rows if b != 4}
                    continue
                live = {(r.bucket, r.node) for r in got if r.other is None}
                pairs = {frozenset((r.node, r.other)) for r in got if r.other is not None}
                assert frozenset((5, 6)) in pairs and frozenset((1, 2)) not in pairs and live <= {(b, n) for b, n, _ in rows if b in (1, 5)}
                assert live >= {(1, n) for n in range(700)} and live >= {(5, n) for n in range(100)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bucket_components(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(b), int(n)) for b, n in zip(rng.integers(0, 6, 160), rng.integers(0, 60, 160))})
    good = lambda a, b: (a * 7 + b * 7) % 11 < 2
    linked = lambda pairs: pairs.withColumn("linked", (pairs.a * 7 + pairs.b * 7) % 11 < 2)
    facts = spark.createDataFrame([(n, (n,)) for n in {n for _, n in rows}], "node long, fact struct<n: long>")
    even = lambda x, y: (x["n"] * 7 + y["n"] * 7) % 11 < 5
    sent = np.stack(buckets.company(*np.array(rows, np.int64).T)).T.tolist()
    live = common.stage(buckets.shared_buckets(spark.createDataFrame(sent, "bucket long, node long, n long")))
    label = buckets.bucket_components(live, linked, facts, even, lambda x, y: x["n"] - y["n"])
    got = {r.node: r.component for r in label.collect()}
    links = [(a, b) for x, a in rows for y, b in rows if x == y and a < b and good(a, b)]
    want = components_of({n for _, n in rows}, links)
    assert {n: got.get(n, n) for n in want} == want


def shingles(text, k, fold=True):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize("k, similar", [(3, 85), (5, 80)])
def test_op4(docs, rows, awkward, nothing, k, similar):
    got = by_id(minhash.near_duplicates(docs, k, similar))
    sets = {d: shingles(t, k) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    for d, c in components_of(sets, links).items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), c, c == d)
    odd = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(awkward, k, similar).collect()]
    assert len(odd) == 12 and (4, 0, 4, True) in odd and (6, 1, 6, True) in odd and [o[2] for o in odd if o[0] == 8] == [7]
    assert not minhash.near_duplicates(nothing, k, similar).count()


def test_op4_repeated_ids(spark):
    """An id with two texts is linked with what either is like."""
    words = lambda seed: [f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, 120)]
    one, two = words(1), words(2)
    texts = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one[:-1], "x"])), (3, " ".join([*two[:-1], "y"])), (4, " ".join(words(3))), (4, None), (5, None)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()]
    assert sorted(got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True)]


def test_op4_filter():
    """How seldom the values of a linked pair tell against it: an exact binomial tail."""
    from math import comb

    for similar in (80, 85):
        share, n = similar / 100 + (1 - similar / 100) / 16, minhash.BANDS * minhash.ROWS
        assert sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(minhash.least_agreement(similar))) < 3e-9


def test_op4_blocks(spark, monkeypatch):
    """A large group of which most members are similar to few others, in small blocks."""
    monkeypatch.setattr(buckets, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [f"b{x}" for x in rng.integers(0, 900, 100)]
    texts = []
    for d in range(160):
        words = list(base) if d % 4 else texts[-1][1].split() if texts else list(base)
        for i in rng.integers(0, len(words), int(rng.integers(1, 7))):
            words[i] = f"c{rng.integers(40)}"
        texts.append((d, " ".join(words)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 80))
    sets = {d: shingles(t, 3) for d, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    assert 10 < len(set(want.values())) < 140
    assert {d: r.component_id for d, r in got.items()} == want


def test_op5(spark, docs, rows, awkward, nothing):
    got = by_id(mixing.op5_mixing(spark, SF))
    again = by_id(mixing.op5_mixing(spark, SF))
    assert got == again
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {d: len(WORD.findall(t)) for d, t in rows}
    total = collections.Counter()
    for d in size:
        total[source[d]] += size[d]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    full: set = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        above = {s for s in total if s not in full and level * weight[s] > 3 * total[s]}
        if not above:
            break
        full |= above
    taken = collections.Counter()
    for d, r in got.items():
        s = source[d]
        want = 3.0 * total[s] if s in full else level * weight[s]
        assert (r.size, r.source_size) == (size[d], total[s]) and abs(r.target - want) < 1e-6 * want and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - got[d].target) <= 0.02 * got[d].target + min(size.values()) for d, s in source.items())
    mixed = mixing.mix(mixing.sizes(awkward)).collect()
    assert len(mixed) == 12 and all(0 <= r.copies <= 3 for r in mixed)
    # few ids, many rows: each row has copies of its own
    rng = np.random.default_rng(6)
    repeated = [(int(rng.integers(7)), " ".join(["w"] * int(rng.integers(1, 200))), f"s{i % 2}") for i in range(60)]
    found = mixing.mix(mixing.sizes(spark.createDataFrame(repeated, "doc_id long, text string, source string"))).collect()
    assert len(found) == 60 and all(0 <= r.copies <= 3 for r in found)
    for s in ("s0", "s1"):
        own = [r for r in found if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 100
    assert not mixing.mix(mixing.sizes(nothing)).count()


def statistics(text):
    w = WORD.findall(text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(again)


def test_op6(spark, docs, rows, awkward, nothing):
    got = by_id(quality.op6_quality(spark, SF))
    for d, t in rows:
        n, *rest, again = statistics(t)
        failed = n < 10 or 100 * again > 20 * n
        assert tuple(got[d])[1:7] == (n, *rest, again, failed) and not (failed and got[d].kept)
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    clean = [d for d, q in labels.items() if q == 1 and not got[d].base_failed]
    assert sum(got[d].kept for d in clean) >= 0.98 * len(clean)
    odd = sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.with_statistics(awkward).collect())))
    assert odd == sorted(map(repr, ((r.doc_id, *statistics(r.text)) for r in awkward.collect())))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(awkward, none).rules == () and not quality.judge(nothing, quality.DecisionList(())).count()


def test_op6_learns():
    rng = np.random.default_rng(5)
    x = {"u": rng.integers(0, 1000, 3000), "v": rng.integers(0, 1000, 3000)}
    bad = (x["u"] >= 900) | (x["v"] < 100) & (x["u"] >= 500)
    rules = quality.learn(x, bad, np.arange(3000) % 3 == 0).rules
    verdict = np.zeros(3000, bool)
    for rule in rules:
        verdict |= quality._covered(rule, x, 3000)
    assert (verdict & ~bad).sum() <= 0.05 * verdict.sum() and (verdict & bad).sum() >= 0.9 * bad.sum()


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = counts.load_pieces(PIECES)
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=True))
    meta = pre_tokenizers.Metaspace(replacement=counts.MARK, prepend_scheme="always", split=False)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), meta])
    return tokenizer, counts.Counter(pieces)


def test_op7(spark, rows, awkward, nothing):
    tokenizer, counter = unigram()
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert {d: r.n_tokens for d, r in by_id(counts.op7_token_counts(spark, SF)).items()} == {d: size(t) for d, t in rows}
    texts = ["▁▁ ▁a a▁b", "<0x01> <s> <unk>\x01 \x02\x03q", "\U0001f389\U0001d11ex 麤麤", "a\x1cb c\x85d\xa0e　f​z", "", None]
    assert counter.texts(texts)[0].tolist() == [size(t) for t in texts]
    got = sorted(map(repr, ((r.doc_id, r.n_tokens) for r in counts.count_tokens(awkward, PIECES).collect())))
    assert got == sorted(map(repr, ((r.doc_id, size(r.text)) for r in awkward.collect())))
    assert not counts.count_tokens(nothing, PIECES).count()


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def keep_lines(rows):
    first: dict = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if d is not None and lines.normal_form(line):
                first.setdefault(lines.normal_form(line), (d, n))
    forms = list(first)
    sim = lines.simhashes(forms)
    near = [(i, j) for i in range(len(forms)) for j in (np.flatnonzero(np.bitwise_count(sim[i + 1 :] ^ sim[i]) <= 3) + i + 1).tolist()]
    links = [(i, j) for i, j in near if edits(forms[i], forms[j]) <= max(len(forms[i]), len(forms[j])) * 10 // 100]
    of = components_of(range(len(forms)), links)
    head: dict = {}
    for i, f in enumerate(forms):
        head[of[i]] = min(head.get(of[i], first[f]), first[f])
    at = {f: head[of[i]] for i, f in enumerate(forms)}
    out = {}
    for d, t in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if d is None or not lines.normal_form(x) or at[lines.normal_form(x)] == (d, n)]
        out[d] = "\n".join(kept)
    return out


def test_op8(spark, docs, rows, awkward, nothing):
    texts = [(d, t) for d, t in rows if len(t) < 4000]
    texts += [(1000, "The quick brown fox jumps over the lazy dog near the river bank every single morning in spring and autumn\nshort"), (1001, "The quick brown fox jumps over the lazy dog near the river bank every single morning in sprung and autumn!\nSHORT.")]
    got = by_id(lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")))
    for d, t in keep_lines(texts).items():
        assert got[d].text == t, d
    assert got[1001].n_removed >= 1
    odd = lines.dedup_lines(awkward)
    assert odd.count() == 12 and len(odd.columns) == 13
    assert {r.text for r in odd.where("doc_id = 9").collect()} == {"Line one here.\nLine two here."}
    assert not lines.dedup_lines(nothing).count()


def near_by_edits(forms):
    """All pairs within 10 % of edits, by brute force behind a bound on counts of characters."""
    import duckdb

    forms = sorted(forms, key=len)
    size = np.array([len(f) for f in forms])
    counts = np.array([np.bincount(np.frombuffer(f.encode("utf-32-le"), np.uint32) % 64, minlength=64) for f in forms])
    pairs = []
    for i in range(len(forms)):
        j = np.arange(i + 1, np.searchsorted(size, size[i] * 100 // 90 + 1, side="right"))
        more = counts[j] - counts[i]
        pairs += [(forms[i], forms[x]) for x in j[np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= size[j] // 10]]
    table = pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
    return duckdb.from_arrow(table).filter("levenshtein(a, b) <= length(b) // 10").fetchall()


def test_op8_edits_alone(spark, rows):
    """Lines a few edits apart are linked whatever their SimHashes, on the table and with one letter replaced."""
    texts = [(d, t) for d, t in rows if len(t) < 4000]
    forms = {f for _, t in texts for x in t.split("\n") if (f := lines.normal_form(x))}
    rng = np.random.default_rng(1)
    for f in sorted(f for f in forms if 10 <= len(f) < 600)[::3]:
        at = rng.choice([i for i, c in enumerate(f) if c != " "])
        texts.append((5000 + len(texts), f[:at] + ("z" if f[at] != "z" else "y") + f[at + 1 :]))
    first: dict = {}
    for d, t in texts:
        for n, x in enumerate(t.split("\n")):
            if f := lines.normal_form(x):
                first.setdefault(f, (d, n))
    links = near_by_edits(list(first))
    sims = [lines.simhashes(list(side)) for side in zip(*links)]
    assert len(links) > 200 and (np.bitwise_count(sims[0] ^ sims[1]) > 3).sum() > 100
    of = components_of(list(first), links)
    head: dict = {}
    for f, place in first.items():
        head[of[f]] = min(head.get(of[f], place), place)
    got = by_id(lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), distance=None))
    for d, t in texts:
        kept = [x for n, x in enumerate(t.split("\n")) if not (f := lines.normal_form(x)) or head[of[f]] == (d, n)]
        assert got[d].text == "\n".join(kept), d


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=2, max_size=40), st.text("abcd", min_size=2, max_size=40))
def test_op8_profiles(a, b):
    """The counts of pairs never tell against a distance that holds."""
    x, y = lines.profiles([a, b, "a"]).astype(int)[:2]
    assert np.abs(x - y).sum() <= 4 * edits(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=30), st.text("abé", max_size=30), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "zz"])), max_size=6))
def test_op8_within(a, b, changes):
    """Each way to a distance agrees with the plain table, and counts never tell against what holds."""
    changed = a
    for at, by in changes:
        changed = changed[:at] + by + changed[at + 1 :]
    for x, y in ((a, b), (a, changed), (changed, a), ("", b)):
        apart = edits(x, y)
        for most in (0, 1, 3, apart - 1, apart, apart + 1):
            if most >= 0:
                assert within.within(x, y, most) == within.by_diagonals(x, y, most) == (apart <= most)
                assert not x or not y or within.by_columns(x, y, most) == (apart <= most)
        assert within.may_be_within([x, a], [y, a], np.array([apart, 0])).all()


def test_op8_within_long():
    """Long texts, counted in bins of their own."""
    rng = np.random.default_rng(5)
    a = "".join(map(chr, rng.integers(97, 123, 3000)))
    b = list(a)
    for i in rng.choice(3000, 120, replace=False).tolist():
        b[i] = "é"
    b = "".join(b)
    assert within.within(a, b, 120) and not within.within(a, b, 119)
    assert within.may_be_within([a, a], [b, a[::-1]], np.array([120, 300])).tolist() == [True, False]


@pytest.mark.parametrize("low, high, share", [(10, 40, 0.97), (40, 100, 0.95), (100, 200, 0.9), (200, 1300, 0.9)])
def test_op8_recall(low, high, share):
    """How many pairs at the limit of edits, at random places, have a key in common and pass the sketches."""
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rng = np.random.default_rng(low)
    own = sorted({f for (t,) in texts for x in (t or "").split("\n") if low <= len(f := lines.normal_form(x)) < high})
    own = [own[i] for i in rng.permutation(len(own))[:600]]
    changed = []
    for f in own:
        f = list(f)
        for _ in range(len(f) // 10):
            i, c = int(rng.integers(len(f))), chr(97 + int(rng.integers(26)))
            f[i : i + 1] = [[c], [c, f[i]], []][int(rng.integers(3))]
        changed.append("".join(f))
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for side, forms in zip(keys, (own, changed)):
        for i, k in zip(*lines.band_rows(forms, 10)):
            side[int(i)].add(int(k))
    allowed = lines.may_link(lines.sketches(own), lines.sketches(changed), 10)
    met = [bool(keys[0][i] & keys[1][i]) and bool(allowed[i]) or own[i] == changed[i] for i in range(len(own))]
    assert sum(met) >= share * len(met), sum(met) / len(met)


def test_op9(spark, rows, awkward, nothing):
    from tokenizers import Tokenizer

    plain_tokenizer = Tokenizer.from_file(SMALL)
    for df, plain in ((packing.op9_packing(spark, SF), rows), (packing.pack(awkward, SMALL), [(r.doc_id, r.text) for r in awkward.collect()])):
        pieces = collections.defaultdict(list)
        windows = collections.defaultdict(list)
        for r in df.collect():
            pieces[r.doc_id].append(r)
            windows[r.sequence_id].append((r.offset, r.length))
        for own in windows.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
        for d, t in plain:
            ids, at = np.array([*plain_tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
            twice = [x for x, _ in plain].count(d)  # equal rows, in one piece each
            for r in sorted(pieces[d], key=lambda r: r.start)[::twice]:
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
                at += r.length
            assert at == len(ids)
        if len(windows) > 8:
            # the last windows of an input split may stay partly empty; on the whole, little is padding
            filled = sum(n for own in windows.values() for _, n in own)
            room = sum(n if (n := sum(x for _, x in own)) & (n - 1) == 0 else 4096 for own in windows.values())
            assert filled >= 0.97 * room
    assert not packing.pack(nothing, SMALL).count()


def test_op9_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(30):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 14))])
        cost = np.where(rng.random(15) < 0.5, 8.0, 0.0)
        best = [0.0] + [np.inf] * 14
        for i in range(1, 15):
            for j in range(i):
                n = int(places[i] - places[j])
                if n <= 32:
                    pad = 0 if n & (n - 1) == 0 else 32 - n
                    best[i] = min(best[i], best[j] + pad + packing.WINDOW_COST + cost[i])
        path = packing.best_windows(places, cost, 32)
        got = 0.0
        for j, i in zip(path, path[1:]):
            n = int(places[i] - places[j])
            got += (0 if n & (n - 1) == 0 else 32 - n) + packing.WINDOW_COST + cost[i]
        assert abs(got - best[14]) < 1e-9


def test_op9_stretches():
    rng = np.random.default_rng(7)
    texts = [(i, rng.integers(3, 400, int(n)).astype(np.uint16)) for i, n in enumerate(rng.integers(1, 3000, 60))] + [(60, np.arange(30_000).astype(np.uint16))]
    out = list(packing.pack_stream(iter(texts), np.zeros(1 << 16, bool), 256, 4096))
    for i, ids in texts:
        assert np.array_equal(np.concatenate([o[3] for o in out if o[0] == i]), ids)


def test_op10(spark, docs, awkward, nothing):
    got = by_id(langid.op10_language_id(spark, SF))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    out = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == lang[d] for d in out) >= 0.95 * len(out)
    models = langid.fit_models(awkward)
    odd = {(r.doc_id, r.lang_pred) for r in langid.predict(awkward, models).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "en")} <= odd
    assert langid.fit_models(nothing).languages == [] and not langid.predict(nothing, models).count()
    assert {r.lang_pred for r in langid.predict(awkward, langid.fit_models(nothing)).collect()} == {"und"}


def test_kneser_ney():
    """Probabilities of the next character sum to one over what a model has seen, plus its floor."""
    models = langid.LanguageModels(["a"]).fit([["abab", "abba", "baab", "cab"] * 3])
    for history in ("", "a", "ab", "ca"):
        total = 0.0
        for c in "abc ":
            codes, _ = langid.word_codes([history + c])
            p = models.floor[0]
            own = codes[: langid.ORDER + len(history)]
            for k in range(1, langid.ORDER + 1):
                share = langid._look(models.tables[k - 1], langid.keys(own[-k:], k), 0.0)[0, 0]
                weight = models.backoff[0][1][0, 0] if k == 1 else langid._look(models.backoff[k - 1], langid.keys(own[-k:-1], k - 1), 1.0)[0, 0]
                p = share + weight * p
            total += p
        assert 0.9 < total <= 1.0 + 1e-9
