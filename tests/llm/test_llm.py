"""The text operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import chat, components, fingerprints, langid, mixing, pieces, repeats, secrets, sharding, simhash, vectors
from matchloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, rank int, node long"
LONG = "word " * 40_000
ROWS = [
    (1, "Hello there. General text, plain.\nSecond line", "en", "a", 1, "k", "t", 1, 1),
    (1, "Hello there. General text, plain.\nSecond line", "en", "a", 1, "k", "t", 1, 1),
    (2, "", "en", None, 0, None, None, None, None),
    (None, "token = abcdef123456 é AKIA" + "A1" * 10, None, "b", 5, "k", "t", 2, 2),
    (4, None, "fr", "b", None, "k", "t", 3, 3),
    (5, LONG, "fr", "a", len(LONG), "k", "t", 3, 3),
    (6, "  \t\n ", None, None, 4, "k", "t", 3, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, KINDS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


OPS = {
    "mix": lambda d: mixing.mix(d, "doc_id", "text", "source", mixing.WEIGHTS),
    "scan": lambda d: secrets.scan(d, "doc_id", "text"),
    "redact": lambda d: secrets.redact(d, "doc_id", "text"),
    "simhash": lambda d: simhash.near_dedup(d, "doc_id", "text", 3, 2),
    "near_copies": lambda d: simhash.near_copies(d, "doc_id", "text"),
    "encode": lambda d: pieces.encode(d, "doc_id", "text", pieces.model_path()),
    "repeats": lambda d: repeats.find_repeats(d, "doc_id", "text"),
    "langid": lambda d: langid.identify(d, "doc_id", "text", langid.learn(d, "doc_id", "text", "lang")),
    "shard": lambda d: sharding.shard(d, "doc_id", "text", [1.0, 2.0, 0.0]),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_and_empty_tables(odd, name):
    assert len(OPS[name](odd).collect()) == len(ROWS)
    assert OPS[name](odd.limit(0)).count() == 0


def test_fingerprints(spark, docs, odd):
    texts = dict(docs.select("doc_id", "text").collect())
    ids = sorted(texts)
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, SF).collect()}
    for i, d in enumerate(ids):
        n = len(texts[d]) // 4
        edited = texts[d][: len(texts[d]) - n] + texts[ids[(i + 1) % len(ids)]][:n]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert len({(texts[d], got[d].fingerprint) for d in ids}) == len(set(texts.values())) == len({got[d].fingerprint for d in ids})
    assert np.mean([got[d].near_edited for d in ids]) > 0.5 > np.mean([got[d].near_next for d in ids])
    assert fingerprints.with_next(odd, "doc_id", "text").count() == len(set(ROWS))
    a, b, ab = (fingerprints.fingerprint(spark.createDataFrame([(1, x)], "id int, s string"), ["id"], "s").select(fingerprints.lanes_of(F.col("words")).alias(c)) for x, c in (("one\ntwo", "a"), ("three", "b"), ("three\ntwo\none", "ab")))
    row = a.join(b).join(ab).select(fingerprints.combine(F.col("a"), F.col("b")).alias("x"), "ab", fingerprints.combine(F.col("ab"), F.col("b"), -1).alias("y"), "a").first()
    assert row.x == row.ab and row.y == row.a


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mix(docs, "doc_id", "text", "source", mixing.WEIGHTS).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert own[0].target <= 2 * own[0].source_size and all(r.taken <= 2 * r.size for r in own)


def test_secret_spans(spark, docs):
    def base(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])

    extra = [(-1, "token=token: abcdefg é secret = 'x' API_KEY=abcdef"), (-2, "deadbeef" * 3 + " é " + "AKIA" + "B" * 16)]
    texts = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r[0]: [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "entropy"] for r in secrets.scan(texts, "doc_id", "text").collect()}
    for d, t in texts.collect():
        assert got[d] == base(t), d


def test_secrets_of_letters_and_long_base64(spark):
    rng = random.Random(5)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40)) for _ in range(100)]
    long_ = [base64.b64encode(rng.randbytes(n)).decode() for n in range(75, 300, 2)] + ["b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW"]
    digits = ["".join(rng.choice("0123456789") for _ in range(40)) for _ in range(50)]
    plain = ["InternationalizationServiceFactoryBean", "/usr/local/lib/python3/site-packages/numpy/core", "donaudampfschifffahrtsgesellschaft", "your_key_A1b2C3d4E5f6G7h8I9j0", "A" * 40]
    words = [*letters, *long_, *digits, *plain]
    got = dict(secrets.scan(spark.createDataFrame(list(enumerate(words)), "i long, t string"), "i", "t").select("i", F.size("spans")).collect())
    found = [got[i] > 0 for i in range(len(words))]
    ends = np.cumsum([len(letters), len(long_), len(digits)])
    assert np.mean(found[: ends[0]]) >= 0.95 and all(found[ends[0] : ends[1]]) and np.mean(found[ends[1] : ends[2]]) >= 0.95
    assert not any(found[ends[2] :])


def test_window_entropy(spark):
    random.seed(2)
    words = ["".join(random.choice("abcDEF0123") for _ in range(n)) for n in (5, 20, 37)] + ["a" * 30]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.windows(F.col("w"))["entropy"]).collect()
    for w, e in got:
        parts = [w[i : i + 20] for i in range(len(w) - 19)]
        want = max((-sum(p.count(c) / 20 * np.log2(p.count(c) / 20) for c in set(p)) for p in parts), default=0)
        assert e == pytest.approx(want, abs=1e-9)


def test_entropy_spans_and_gaps_by_brute_force(spark, docs):
    def windows(s):
        entropy, mixed = [0.0], [0.0]
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            e = -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))
            entropy.append(e)
            if len(re.findall("(?=[a-z][A-Z]|[A-Z][a-z])", w)) >= secrets.CHANGES:
                mixed.append(e)
        return max(entropy), max(mixed)

    def secret(s):
        if re.search(secrets.PATH, s):
            s = re.sub(secrets.STEP, " ", s)
        for gap in secrets.GAPS:
            s = re.sub(gap, " ", s)
        for p in s.split(" "):
            if len(p) >= 20 and not re.fullmatch(secrets.UUID, p):
                k = next(k for k, (_, c, _) in enumerate(secrets.CLASSES) if re.fullmatch(c, p))
                if windows(p)[k == secrets.NAMES] >= secrets.CLASSES[k][2] - 1e-9:
                    return True
        return False

    rng = random.Random(8)
    kinds = ["0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmNOPQRSTUVWXYZ", "abcdefghijklmNOPQRSTUVWXYZ0123456789+/", "abcdeABCDE_-", "aB1/"]
    made = ["".join(rng.choice(k) for _ in range(rng.choice((19, 20, 23, 40, 90)))) for k in kinds for _ in range(40)]
    words = [*made, "123e4567-e89b-12d3-a456-426614174000", "my-long-name-of-a-config-value-2024", "A" * 30, "example" + made[200], "/usr/local/lib/python3/site-packages", "/" + made[210] + "/b/c", "donaudampfschifffahrtsgesellschaft"]
    texts = [(-i, f"é {w}, {w[:25]} token={w}") for i, w in enumerate(words, 1)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    some = classes = 0
    for d, t, got in secrets.scan(every, "doc_id", "text").select("doc_id", "_text", "spans").collect():
        base = [(s.start, s.end) for s in got if s.kind != "entropy"]
        found = [m.span() for m in re.finditer(secrets.CANDIDATE, t) if secret(m[0])]
        want = [x for x in found if not any(x[0] < b and a < x[1] for a, b in base)]
        assert [(s.start, s.end) for s in got if s.kind == "entropy"] == want, d
        some += len(want)
        classes |= sum(1 << next(k for k, (_, c, _) in enumerate(secrets.CLASSES) if re.fullmatch(c, t[a:b])) for a, b in want[:1])
    assert some > 100 and classes == 2 ** len(secrets.CLASSES) - 1  # the threshold of each class can be reached


def test_redact_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["é ", "token=", "secret: ", "AKIA" + "B" * 20, "deadbeef" * 4, "abcdef9 ", "x "]) for _ in range(n)) for n in (0, 3, 40, 2_000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    spans = {r.i: r.spans for r in secrets.scan(df, "i", "t").collect()}
    for i, got in secrets.redact(df, "i", "t").select("i", "t").collect():
        out, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                out += texts[i][at : s.start] + f"[{s.kind}]"
            at = max(at, s.end)
        assert got == (texts[i] if not spans[i] else out + texts[i][at:])


def test_long_candidates_end(spark):
    rng = random.Random(3)
    texts = ["ab-" * 20_000 + "c1", "".join(rng.choice("ghijklGHIJKL0123456789") for _ in range(100_000)), "a-" * 50_000, "/usr/a_b/" * 10_000, " ".join(f"token=abcdef{i}" for i in range(5_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [n for _, n in sorted(secrets.scan(df, "i", "t").select("i", F.size("spans")).collect())] == [0, 1, 0, 0, 5_000]


def test_components_by_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    walk = rng.sample(range(300), 300)
    cases = {
        "empty": [],
        "loops and nulls": [(1, 1), (None, 2), (2, None)],
        "walk": list(zip(walk, walk[1:])),
        "short walk": list(zip(walk[:60], walk[1:60])),
        "random": [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(450)],
        "high hub": [(10**15, i) for i in range(300)],
        "repeats": [(1, 2)] * 50 + [(2, 1)] * 50 + [(3, 2)],
    }
    monkeypatch.setattr(components, "AT_ONCE", 20)  # in this process; the tasks keep theirs
    x = np.array(cases["random"])
    parts = components._forest(pa.RecordBatch.from_arrays([x[at : at + 7, 0], x[at : at + 7, 1]], names=["a", "b"]) for at in range(0, len(x), 7))
    cases["forests of parts"] = [tuple(e.values()) for b in parts for e in b.to_pylist()]
    assert len(cases["forests of parts"]) <= len(x)
    lows = {}
    for name, edges in cases.items():
        low = lows[name] = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
        moved = True
        while moved:
            moved = False
            for a, b in edges:
                if a in low and b in low and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    moved = True
        rows = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
        assert sorted(tuple(r) for r in rows) == sorted(low.items()), name
    assert lows["forests of parts"] == lows["random"]


def test_simhash_components(docs, spark):
    rows = QUERIES["op4_simhash"](spark, SF).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {r.doc_id: r.component_id for r in rows} == root


def test_near_copies_in_one_boilerplate_group(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(120)]
    texts = [common + [word() for _ in range(30)] for _ in range(400)]
    for i in range(200, 400):  # near copies of the first half, at and about 0.8
        n = random.randint(10, 24)
        texts[i] = texts[i - 200][: 150 - n] + [word() for _ in range(n)]
    sets = [set(zip(*(t[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = simhash.near_copies(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text").collect()
    got = {r.doc_id: r.component_id for r in rows}
    wrong = [i for i in got if got[i] != root[i]]
    assert len(got) == len(texts) and len(wrong) <= 2, wrong  # 3 in 1,000 pairs of 0.8 are no candidates


def test_pipeline_drops_what_simhash_links(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda common, n: " ".join(common * 40 + [word() for _ in range(n)])
    common, other = ([word() for _ in range(101)] for _ in range(2))
    texts = [text(common, 60), text(common, 60), text(other, 60)]
    fp = [simhash.fingerprint(t, 5) for t in texts]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    assert (fp[0] ^ fp[1]).bit_count() <= 3 < (fp[0] ^ fp[2]).bit_count() and len(sets[0] & sets[1]) < 0.6 * len(sets[0] | sets[1])
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 2]


def _near_pairs(fp, bits):
    return {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[np.flatnonzero(np.bitwise_count(fp ^ a) <= bits)] if a < b}


def test_index_finds_all_links(spark):
    """Every link of sf0.01 by brute force is found by the index, in one of the six orders, and each index's links are such."""
    fp = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", 3).select("fp").distinct().toPandas().fp.to_numpy().view(np.uint64)
    rng = np.random.default_rng(1)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 300), dtype=np.uint64)
    fp = np.unique(np.concatenate((fp, fp[:300] ^ flips[0] ^ flips[1], fp[:300] ^ flips[2])))
    turns, found = simhash.Turns(2), set()
    for k, top in enumerate(turns.tops):
        w = turns.turn(fp, k)
        assert (turns.turn(w, k, True) == fp).all()
        w = w[np.argsort(simhash.gray_rank(w))]
        for a, b in simhash.GrayIndex(w).links(w, 2, top):
            x, y = (turns.turn(w[i], k, True) for i in (a, b))
            assert (np.bitwise_count(x ^ y) <= 2).all()
            found |= {(min(p), max(p)) for p in zip(x.tolist(), y.tolist()) if p[0] != p[1]}
    assert found == _near_pairs(fp, 2) and len(found) >= 600


def test_near_words_of_one_block_pair_fill_many_ranges(spark, monkeypatch):
    tasks = []
    rng = np.random.default_rng(2)
    low = np.unique(rng.integers(0, 1 << 17, 30_000, dtype=np.uint64))  # all agree on 47 bits
    df = spark.createDataFrame([(int(x),) for x in low], "fp long")
    cut = simhash.cut
    monkeypatch.setattr(simhash, "partitions", lambda _: 24)
    monkeypatch.setattr(simhash, "cut", lambda d: tasks.append(cut(d)) or tasks[-1])
    rows = simhash.connected_components(simhash.near_links(df, 2)).collect()
    top = simhash.Turns(2).orders.index([2, 3, 0, 1])
    assert tasks[0].where(f"turn = {top}").select("range").distinct().count() >= 3 and tasks[0].groupBy("range").count().agg(F.max("count")).first()[0] <= len(low)
    root = {r.node: r.root for r in rows}
    every = set(low.tolist())
    for x in every:
        for i in range(17):
            for j in range(i, 17):
                if (y := x ^ (1 << i) ^ (1 << j if j > i else 0)) in every:
                    assert root[x] == root[y]


def test_pieces_equal_the_library():
    sp, table = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.ChunkTable(pieces.model_path())
    random.seed(3)
    for t in ["", " ", "  a  b ", "▁x ▁", "a\0b", "</s>[INST]", *("".join(random.choice(" ▁ab\né①") for _ in range(30)) for _ in range(300))]:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert table.encode(t) == (np.array(ids, "<u4").tobytes(), sp.decode(ids))


@pytest.mark.parametrize("group", [repeats.GROUP_ROWS, 3])  # 3: groups are divided into windows
def test_repeats_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group)
    random.seed(4)
    word = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    shared = [word(70), word(45), "x" * 90]
    texts = [(i, "".join(random.choice([word(random.randint(5, 60)), *shared]) for _ in range(6))) for i in range(40)] + [(90, None), (91, "short"), (92, shared[0]), (93, shared[0])]
    raw = {i: (t or "").encode() for i, t in texts}
    for least in (40, 41, 57, 97):
        seen = {}
        for b in raw.values():
            for p in range(len(b) - least + 1):
                seen[b[p : p + least]] = seen.get(b[p : p + least], 0) + 1
        some = 0
        for r in repeats.find_repeats(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", least).collect():
            b = raw[r.doc_id]
            gone = {q for p in range(len(b) - least + 1) if seen[b[p : p + least]] > 1 for q in range(p, p + least)}
            assert bytes(r.kept) == bytes(c for q, c in enumerate(b) if q not in gone)
            some += len(gone)
        assert some


def test_repeats_index_few_contexts_at_once(monkeypatch):
    """A task's index holds INDEX_ROWS contexts or a group, whatever its batches hold, and misses no repeat."""
    random.seed(5)
    least, rows = 40, []
    for key in sorted(random.sample(range(-10**9, 10**9), 300)) + [2 * 10**9]:
        core = [random.choice("abcd") for _ in range(60)]
        for _ in range(random.randint(1, 19) if key < 10**9 else 1_300):  # the last group is larger than an index
            text = core[:]
            text[random.randrange(15)], text[random.randrange(45, 60)] = random.choice("xyz"), random.choice("xyz")
            rows.append((key, b"%d" % len(rows), 1, "".join(text).encode(), 20, 21))
    kinds = {"key": pa.int64(), "d": pa.binary(), "copies": pa.int64(), "context": pa.binary(), "place": pa.int32(), "starts": pa.int32()}
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
    sizes, spans = [], repeats.Marker.spans
    monkeypatch.setattr(repeats.Marker, "spans", lambda self, key, *more: sizes.append((len(key), len(set(key.tolist())))) or spans(self, key, *more))
    batches = [table.slice(0, 2_501).combine_chunks(), table.slice(2_501, 0), table.slice(2_501).combine_chunks()]
    found = {}
    for b in repeats._mark(least)(x for t in batches for x in t.to_batches()):
        found |= {d: [(x["a"], x["b"]) for x in s] for d, s in zip(b["d"].to_pylist(), b["spans"].to_pylist())}
    assert sum(n for n, _ in sizes) == len(rows) and sum(g for _, g in sizes) == 301  # each row once, groups whole
    assert max(n for n, groups in sizes if groups > 1) <= repeats.INDEX_ROWS and max(sizes)[0] == 1_300 and len(sizes) < 10
    seen = {}
    for key, _, _, c, _, _ in rows:
        for p in range(21):
            seen[key, c[p : p + least]] = seen.get((key, c[p : p + least]), 0) + 1
    want = {d: repeats.runs(np.array([seen[key, c[p : p + least]] > 1 for p in range(21)])) for key, d, _, c, _, _ in rows}
    assert found == {d: s for d, s in want.items() if s} and len(found) > 1_000


def test_planted_passages_of_over_50_words(spark, tmp_path):
    """400 bytes decide, not words: such a passage goes whole from 400 bytes on and stays below them; other documents stay."""
    random.seed(6)
    words = lambda n, of: " ".join("".join(random.choice(of) for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for at, size in enumerate([384, 399, 400, 401, 500] * 4):
        passage = words(55, "abcd")
        passage += "é" * ((size - len(passage)) // 2) + "z" * ((size - len(passage)) % 2)
        assert len(passage.split()) > 50 and len(passage.encode()) == size
        for side in "uv":  # what stands beside the passage differs between its two documents
            rows.append((len(rows), f"{words(40, 'fghij')} {side}{passage}{side}{words(at, 'fghij')}"))
            want[rows[-1][0]] = (size, 1) if size >= 400 else (0, 0)
    for _ in range(40):
        rows.append((len(rows), words(random.randint(0, 300), "klmnop")))
        want[rows[-1][0]] = (0, 0)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_repeats"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got} == want
    assert {r.doc_id: r.n_bytes for r in got} == {i: len(t.encode()) for i, t in rows}  # of the input: tells nothing of repeats


def test_repeats_take_texts_in_slices():
    texts = [b"a" * n for n in (0, 5_000_000, 4_000_000, 3_000_000, 9_000_000, 1, 0)]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], names=["t", "text"])
    got = list(repeats._slices([b.slice(0, 0), b, b.slice(6)], 1))
    assert [x["t"].to_pylist() for x in got] == [[0, 1], [2, 3], [4, 5, 6], [6]] and pa.Table.from_batches(got[:3])["text"].to_pylist() == texts


def test_chat_layouts_round_trip(spark):
    hard = "</s>[INST] \\ ok\\ [/INST]\n<<SYS>>[NAME] é"
    rows = [
        ("m", '{"messages": [{"role": "tool", "content": "%s"}]}'), ("c", '{"conversations": [{"from": "human", "value": "%s"}]}'), ("p", '{"prompt": "%s", "response": "r"}'),
        ("i", '{"instruction": "%s", "input": "", "output": "o"}'), ("x", '{"other": "%s"}'), ("n", None), ("e", "not json"),
        ("0", '{"messages": []}'), ("d", '{"messages": [{"role": "user", "content": "a"}, {"from": "human", "value": "%s"}]}'), ("t", '{"messages": ["%s"]}'), ("+", '{"messages": [{"role": "user", "content": "%s"}], "id": 1}'),
    ]
    quoted = hard.replace("\\", "\\\\").replace("\n", "\\n")
    df = spark.createDataFrame([(k, v % quoted if v and "%s" in v else v) for k, v in rows], "id string, rec string")
    out = chat.format_chat(df, "id", "rec").select("id", F.transform(chat.pieces_of(F.col("formatted")), chat.parse_piece).alias("turns"))
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in out.collect()}
    assert got == {"m": [("tool", hard)], "c": [("user", hard)], "p": [("user", hard), ("assistant", "r")], "i": [("system", hard), ("user", ""), ("assistant", "o")], "x": None, "n": None, "e": None, "0": [], "d": None, "t": None, "+": None}


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    x = np.concatenate((base, base[:60] + rng.normal(scale=0.05, size=(60, 16)), base[:5], 2 * base[5:8]))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0])]
    rows += [(910, [1.0, 2.0, 3.0]), (911, [2.0, 4.0, 6.0]), (912, [-1.0, 2.0, 3.0]), (913, [1e-200, 2e-200, 3e-200, 1e-201]), (914, [1.0, 2.0, 3.0, 0.1])]  # of other lengths
    got = {r.i: r for r in vectors.near_vectors(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert near.sum() * 0.9 <= found <= near.sum()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (*range(900, 905), 912))
    assert all(got[i].n_links == 1 and got[i].component_id == 910 for i in (910, 911)) and got[913].component_id == got[914].component_id == 913


def test_vectors_of_single_precision_and_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 16)  # 625 lists
    rng = np.random.default_rng(9)
    x = rng.normal(size=(10_000, 12)).astype(np.float32)
    x[5_000:] = x[:5_000] + rng.normal(scale=0.3, size=(5_000, 12)).astype(np.float32)
    u = vectors.units(x)
    near = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<float>")
    rows = vectors.near_vectors(df, "i", "v").collect()
    assert all(r.n_links == near[r.i] for r in rows) and near.sum() > 1_000  # recall 1


def test_vectors_of_one_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 24)  # about 125 of 375 lists share the cluster
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9_000, 16))
    x[:3_000] = x[0] / np.linalg.norm(x[0]) + rng.normal(scale=0.045, size=(3_000, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    rows = vectors.near_vectors(df, "i", "v").collect()
    assert len(rows) == len(x) and all(r.n_links == near[r.i] for r in rows)


def test_language_id_held_out(spark, docs):
    langs = dict(docs.select("doc_id", "lang").collect())
    rows = [r for r in QUERIES["op9_language_id"](spark, SF).collect() if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in rows]) > 0.9


def test_shards(spark):
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} <= {1, None, 5}


def test_pipeline_keeps_rows_of_null_and_shared_ids(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    t = [text() for _ in range(5)]
    rows = [(None, t[0], None, "a", 1), (None, t[1], None, "a", 1), (7, t[2], None, "b", 1), (7, t[3], None, "b", 1), (8, t[3], None, "b", 1), (8, t[4], None, "b", 1), (8, t[4], None, "b", 1)]
    docs = spark.createDataFrame([*rows, (9, "12 34", None, "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs.where("doc_id is null or doc_id < 9"), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, t[0]), (0, t[1]), (7, t[2]), (7, t[3]), (8, t[4])])
    want = {}
    for r in mixing.mix(docs, "doc_id", "text", "source", mixing.WEIGHTS).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in want.items() if n} and None in got


def test_pipeline_without_labels(spark):
    docs = spark.createDataFrame([(1, "Hello there", None, "a", 1), (None, "été", None, "b", 1), (2, "12 34", None, "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identify_language(spark, docs, SF).collect()
    assert sorted((r.text, r.lang) for r in got) == [("Hello there", "und"), ("été", "und")]


def test_tagger_equals_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], [rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(size=(len(langid.WIDTHS) * langid.FILTERS, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    rows = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    for x, got in zip(rows, langid.Tagger(model).probabilities(rows)):
        pooled = [[max(sum(c[j, x[i + j], f] for j in range(w)) for i in range(len(x) - w + 1)) for f in range(langid.FILTERS)] for w, c in zip(langid.WIDTHS, model.conv)]
        z = np.tanh(np.concatenate(pooled)) @ model.dense + model.bias
        assert got == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), abs=1e-4)


def test_language_id_weighs_windows_by_bytes():
    class Fixed(langid.Tagger):
        def __init__(self):
            self.model = langid.Model(["a", "b"], [], np.zeros(0), np.zeros(0))

        def probabilities(self, rows):
            return np.array([[0.6, 0.4], [0.0, 1.0]], np.float32)[: len(rows)]

    said, score = Fixed().tag(["x" * 257])
    assert said == ["a"] and score[0] == pytest.approx(256 * 0.6 / 260, abs=1e-6)


def test_chat_records_of_columns_and_nested_json(spark):
    df = spark.createDataFrame([("n", '{"data": {"prompt": "[1] a", "response": "{b"}}'), ("l", '{"prompt": "[see above]", "response": 5}'), ("o", '{"prompt": {"a": 1}, "response": "x"}')], "id string, rec string")
    out = chat.format_chat(df, "id", "rec").select("id", F.transform(chat.pieces_of(F.col("formatted")), chat.parse_piece).alias("turns"))
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in out.collect()}
    assert got == {"n": [("user", "[1] a"), ("assistant", "{b")], "l": [("user", "[see above]"), ("assistant", "5")], "o": None}
    long_ = spark.range(1).select("id", F.concat(F.lit('{"prompt": "'), F.repeat(F.col("id").cast("string"), 20_100_000), F.lit('", "response": ""}')).alias("rec"))
    with pytest.raises(Exception, match="give it as columns"):
        chat.format_chat(long_, "id", "rec").select(F.length("formatted")).collect()


def test_op7_equals_its_rows(spark, tmp_path):
    texts = ["[1] what is this?", "[INST] hi", "[1, 2]", "[x", "[see above]", '{"a": 1}', '"q"', "null", "", None, "\\", "</s>", "é\n𝄞", "[" * 50]
    rows = [(i, j, r, t, "x") for i, t in enumerate(texts) for j, (r, t) in enumerate((("user", t), ("assistant", texts[-1 - i])))]
    rows += [(100, 1, "user", "tie"), (100, 1, "user", "tie"), (100, 1, "assistant", "[a"), (101, 0, "system", "[s"), (101, 1, "user", None), (101, 2, "assistant", "[r"), (102, None, None, None), (None, 0, "tool", "[t")]
    df = spark.createDataFrame([(*r, "x")[:5] for r in rows], "conv_id long, turn long, role string, text string, record string")
    long_ = spark.createDataFrame([(200, 0, "user", "record"), (200, 1, "assistant", "record")], "conv_id long, turn long, role string, record string").withColumn("text", F.concat(F.lit("["), F.when(F.col("role") == "user", F.repeat(F.concat(F.substring("role", 1, 0), F.lit("abc ")), 5_250_000)).otherwise("")))
    df.unionByName(long_).write.parquet(f"{tmp_path}/conversations.parquet")
    every = [(c, t, r or "", x or "") for c, t, r, x, *_ in rows] + [(200, i, r, "[" + "abc " * 5_250_000 * (r == "user")) for i, r in enumerate(("user", "assistant"))]
    every += [(-1, i, r, chat.HARD) for i, r in enumerate(("user", "assistant"))]
    want = {}
    for c in {r[0] for r in every}:
        own = sorted((r[1:] for r in every if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op7_chat"](spark, str(tmp_path)).collect()}
    assert got == want
