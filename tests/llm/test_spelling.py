"""Spelling variants against all pairs, with one pass and with several, and on rows that need care."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import spelling
from matchloom.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plainly(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("bound", [64 << 20, 512])
def test_variants_equal_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(spelling, "FILTER_BYTES", bound)
    monkeypatch.setattr(spelling, "CHUNK", 7)
    draw = random.Random(3)
    words = {"".join(draw.choice("aabé𝄞") for _ in range(draw.randrange(1, 7))) for _ in range(900)}
    counts = {w: draw.choice((1, 2, 5, 5, 25, 130, 700)) for w in words}
    df = spark.createDataFrame([(w, n, "x", 9) for w, n in counts.items()], "word string, n long, form string, length int")
    got = spelling.variants(df).collect()
    assert len(got) == len(counts) and {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == plainly(counts)
    assert len({r.root for r in got if r.root != r.form and r.form}) > 0  # some way has two steps
    assert spelling.variants(df.limit(0)).count() == 0


def test_query_from_texts(spark, tmp_path):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abcdeé×") for _ in range(8)) for _ in range(30)]
    texts = [" ".join(draw.choice(stems) if draw.random() < 0.9 else draw.choice(stems)[:-1] + draw.choice("xyz") for _ in range(200)) + draw.choice(("", " İĞ-ABCDEFG", "_Abcdefg9")) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[0]), (1, texts[0]), (None, texts[2]), (7, None), (8, ""), (9, "ab" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = plainly({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = QUERIES["op12_spelling"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want


def test_filters_hold_every_word_and_few_others():
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)]
    codes = spelling.codes_of(words, 9)
    h = spelling.word_hash(codes)
    blocks = -(-len(words) * spelling.BITS_A_WORD // 64)
    filled = np.zeros(blocks, np.uint64)
    block, mask = spelling.place_of(h, blocks)
    np.bitwise_or.at(filled, block.astype(np.intp), mask)
    assert ((filled[block.astype(np.intp)] & mask) == mask).all()
    others = spelling.word_hash(spelling.codes_of(["".join(draw.choice("klmnopqr") for _ in range(9)) for _ in range(20_000)], 9))
    block, mask = spelling.place_of(others, blocks)
    assert ((filled[block.astype(np.intp)] & mask) == mask).mean() < 0.03
    for i, some, hashes in spelling.deletions(codes[:200]):
        edited = [words[k][:i] + words[k][i + 1 :] for k in some]
        assert (spelling.word_hash(spelling.codes_of(edited, 8)) == hashes).all() if len(edited) else True
