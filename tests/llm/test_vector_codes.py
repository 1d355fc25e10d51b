import math
import random
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import vector_codes
from tests.llm.helpers import CLASHING

OTHER = [c for c in CLASHING if c != "label"]
SCHEMA = "vec_id bigint, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in OTHER)


def table(spark, rows, parts=3):
    full = [(i, v, n, *["x"] * len(OTHER)) for i, v, n in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if full else df


def plain(rows, k=16, rounds=6):
    """The rounds one vector at a time, in Python integers."""
    kept = [(i, v, n) for i, v, n in rows if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    count = defaultdict(int)
    for _, v, _ in kept:
        count[len(v)] += 1
    d = min(count, key=lambda s: (-count[s], s)) // 8
    kept = sorted(((i, v, n) for i, v, n in kept if len(v) == 8 * d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[vector_codes.whole(x, 4096) for x in v[p * d : p * d + d]] for p in range(8)] for _, v, _ in kept]
    book = [[list(c[p]) for c in cut[:k]] for p in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(book[p])), key=lambda e: (distance(c[p], book[p][e]), e)) for p in range(8)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(8):
            for e in range(len(book[p])):
                own = [c[p] for c, a in zip(cut, codes) if a[p] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    errors = [sum(distance(c[p], book[p][a[p]]) for p in range(8)) for c, a in zip(cut, codes)]
    by = defaultdict(int)
    for (_, _, n), e in zip(kept, errors):
        by[n] += e
    top = (1 << 63) - 1
    return sorted((i if i is not None else -1, "".join(f"{x:02x}" for x in a), min(e, top), min(by[n], top)) for (i, _, n), a, e in zip(kept, codes, errors)), book


def check(spark, rows, **kw):
    out, book = vector_codes.encode(table(spark, rows), **kw)
    have = sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error) for r in out.collect())
    want, plain_book = plain(rows)
    assert have == want and book == plain_book


def vectors(rng, n, d=16, centres=5):
    heart = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    return [[x + rng.gauss(0, 0.2) for x in rng.choice(heart)] for _ in range(n)]


def hard():
    rng = random.Random(3)
    rows = [(i, v, rng.choice([None, 0, 1, 7])) for i, v in enumerate(vectors(rng, 260))]
    rows += [(None, rows[3][1], 1), (5, rows[5][1], 0), (5, rows[6][1], 0)] + [(1000 + i, rows[9][1], 1) for i in range(90)]  # a third are copies
    rows += [(2000, None, 1), (2001, [None] + [1.0] * 15, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] * 16, 0), (2004, [], 1), (2005, [1.0] * 8, 0), (2006, [1.0] * 9, 0), (2007, [-0.0] * 16, 0)]
    return rows


@pytest.mark.parametrize("block", [8192, 48])
def test_equals_brute_force(spark, block):
    check(spark, hard(), block=block)


def test_ties(spark):
    rng = random.Random(4)
    check(spark, [(i, [rng.choice([-1, 0, 1]) / 4096 for _ in range(16)], i % 2) for i in range(300)])


def test_components_beyond_64_bits(spark):
    rows = hard()[:60]
    check(spark, rows + [(500, [1e30] * 16, 1), (501, [-1e300, 1e-300] * 8, 3)])  # rows only
    check(spark, [(-1, [3e38] * 16, 1)] + rows)  # an entry too


def test_fewer_rows_than_entries(spark):
    check(spark, hard()[:5])


def test_nothing_to_code(spark):
    assert vector_codes.encode(table(spark, []))[0].count() == 0
    assert vector_codes.encode(table(spark, [(1, None, 1)]))[0].count() == 0


def test_walk_and_sums():
    rng = np.random.default_rng(5)
    for n, k, spread in ((64, 16, 5), (1024, 16, 300), (512, 11, 40), (16, 1, 9)):
        x = rng.integers(-spread, spread, (8, n, 4))
        x[:, n // 2 :] = x[:, :1] + rng.integers(-2, 3, (8, n - n // 2, 4))
        weight = (np.arange(n) < n - 3).astype(np.int64)
        tree = vector_codes.Tree(x, weight, 16)
        again = vector_codes.Tree.stored(*tree.blobs(), 8)
        book = x[:, rng.permutation(n)[:k]]
        stats = {"sums": np.zeros((8, k, 4), np.int64), "counts": np.zeros((8, k), np.int64), "weight": weight}
        code = vector_codes.walk(again, book, stats)
        diff = again.points[:, :, None] - book[:, None]
        assert (code == (diff * diff).sum(3).argmin(2)).all()
        w = weight[again.order]
        for p in range(8):
            for e in range(k):
                assert stats["counts"][p, e] == w[p][code[p] == e].sum()
                assert (stats["sums"][p, e] == (again.points[p] * w[p][:, None])[code[p] == e].sum(0)).all()
