import random

import numpy as np

from spanloom.llm import graphs, near_dup
from tests.llm.helpers import classes, docs, got, near, prose


def corpus():
    rng, rows = random.Random(5), []
    for g in range(12):
        base = prose(rng, 120)
        rows += [base] + [near(rng, base, rng.randrange(0, 5)) for _ in range(rng.randrange(1, 9))]
    chain = prose(rng, 200)
    for _ in range(12):  # ends of the chain are not similar
        chain = near(rng, chain, 2)
        rows.append(chain)
    rows += [prose(rng, rng.randrange(1, 60)) for _ in range(60)] + ["one two", "One, two!", "one two three", "", None, "...", "..."]
    return list(enumerate(rows, 1))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    out = got(near_dup.classes(docs(spark, rows)))
    want = classes(dict(rows))
    assert {i: r.class_id for i, r in out.items()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r.class_size == sizes[want[i]] for i, r in out.items())


def test_large_components_are_searched_in_blocks(spark):
    rows = corpus()
    out = got(near_dup.classes(docs(spark, rows), group=600))
    assert {i: r.class_id for i, r in out.items()} == classes(dict(rows))


def test_pairs_with_a_repeated_line_are_found(spark):
    """A line repeated in one text of a pair leaves the plain sets as they are, but not the weighted ones."""
    rng, rows = random.Random(9), []
    for times in (20, 50, 378):
        for _ in range(10):
            base = prose(rng, 84, 100_000)  # 80 shingles
            line = prose(rng, 16, 100_000)
            rows += [base, base + f" {line}" * times]
    rows = list(enumerate(rows, 1))
    want = classes(dict(rows))
    assert sum(want[i] < i for i, _ in rows) == 30
    assert {i: r.class_id for i, r in got(near_dup.classes(docs(spark, rows))).items()} == want


def test_keep_and_hard_rows(spark):
    rng = random.Random(1)
    base = prose(rng, 100)
    rows = [(5, base), (3, near(rng, base, 1)), (None, base), (7, None), (8, ""), (9, "lone text"), (9, "lone text"), (10, prose(rng, 60_000))]
    table = docs(spark, rows)
    left = near_dup.keep(table)
    assert left.columns == table.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 3, 7, 8, 9, 9, 10]
    assert near_dup.classes(table).count() == len(rows)


def test_one_id_with_different_texts(spark):
    rng = random.Random(2)
    base, other = prose(rng, 100), prose(rng, 100)
    left = near_dup.keep(docs(spark, [(3, base), (5, near(rng, base, 1)), (5, other), (5, None), (6, near(rng, base, 1))]))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(3, base), (5, ""), (5, other)]


def test_empty_table(spark):
    assert near_dup.classes(docs(spark, [])).count() == 0 and near_dup.keep(docs(spark, [])).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = (np.arange(0, 200), rng.uniform(1, 5, 200)), (np.arange(100, 300), rng.uniform(1, 5, 200))
    owner = np.r_[np.zeros(200, int), np.ones(200, int)]
    sig = near_dup.signatures(owner, np.r_[keys[a[0]], keys[b[0]]], np.r_[a[1], b[1]], 2, 8192)
    wa, wb = np.zeros(300), np.zeros(300)
    wa[a[0]], wb[b[0]] = a[1], b[1]
    both = np.flatnonzero((wa > 0) & (wb > 0))
    want = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (103, 101)]
    out = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
