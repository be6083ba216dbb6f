"""Name resolution against all pairs, at several thresholds, and what a common token costs."""

import random

import pytest

from matchloom.functions.text import token_similarity
from matchloom.operators import resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def judged(a, b):
    costs = []
    for t in a.split():
        own = [0 if t.startswith(u) or u.startswith(t) else 1 for u in b.split() if t.startswith(u) or u.startswith(t) or edits(t, u) <= 1]
        costs += [min(own)] if own else []
    return len(costs) / max(1, len(a.split())), sum(costs), edits(a, b)


def plainly(names, pool, least, short=0):
    out = set()
    for n in names:
        if n is None:
            out.add((n, None, "below_threshold", 0.0))
            continue
        a = n.lower().replace("-", " ").strip()
        same = sorted(p for p in pool if p.lower() == a)
        rank = sorted((-r, d, e, p) for p in pool for r, d, e in [judged(a, p.lower())]) if len(a) > short else []
        if same:
            out.add((n, same[0], "exact", 1.0))
        elif not rank or -rank[0][0] < least:
            out.add((n, None, "below_threshold", round(-rank[0][0] if rank else 0.0, 6) + 0.0))
        elif len(rank) > 1 and rank[0][:3] == rank[1][:3]:
            out.add((n, None, "ambiguous", round(-rank[0][0], 6)))
        else:
            out.add((n, rank[0][3], "fuzzy", round(-rank[0][0], 6)))
    return out


@pytest.mark.parametrize("least,short", [(0.5, 0), (0.75, 4), (1.0, 0), (0.01, 0)])
def test_equals_all_pairs(spark, least, short):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.choice((1, 2, 4, 6))))
    pool = sorted({" ".join(word() for _ in range(draw.randint(1, 4))) for _ in range(60)} | {"fc", "fc aaa"})
    names = sorted({" ".join(word() for _ in range(draw.randint(1, 5))) for _ in range(80)} | {"FC-AAA", "", "  fc  bb", "fc fc fc"}) + [None] + [p[:-1] for p in pool[:10]]
    got = resolve.resolve(spark.createDataFrame([(n, 1) for n in names], "source_name string, name int"), spark.createDataFrame([(p,) for p in pool], "name string"), token_similarity, least, short)
    assert {tuple(r) for r in got.collect()} == plainly(set(names), pool, least, short) and got.count() == len(set(names))


def test_distance_ranks_before_edits(spark):
    got = resolve.resolve(spark.createDataFrame([("abcd xy",)], "source_name string"), spark.createDataFrame([("abce xy",), ("abcdefghijk xyz",)], "name string"), token_similarity)
    assert [tuple(r)[:3] for r in got.collect()] == [("abcd xy", "abcdefghijk xyz", "fuzzy")]  # no distance, though more edits


def test_a_common_token_is_no_key(spark, monkeypatch):
    seen = []
    real = resolve._ranked
    monkeypatch.setattr(resolve, "_ranked", lambda pairs, s: seen.append(pairs.count()) or real(pairs, s))
    pool = spark.createDataFrame([(f"united {i:04}x",) for i in range(2_000)], "name string")
    resolve.resolve(spark.createDataFrame([(f"united {i:04}y",) for i in range(0, 2_000, 100)], "source_name string"), pool, token_similarity, least=1.0).collect()
    assert seen[0] <= 20 * 40  # not 20 * 2,000
