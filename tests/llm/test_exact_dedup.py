import hashlib
import re

import pytest

from spanloom.llm import exact_dedup, queries
from tests.llm.helpers import docs, got

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "A b"), (8, "a b"), (9, "z" * 200_000), (10, "z" * 100_000 + " " + "z" * 100_000),
        (11, "a  b"), (None, "ab  "), (None, "lonely"), (20, "twice"), (20, "twice"), (21, "\U0001f600 x"), (22, "\U0001f600x")]


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    return {i: (min(g, key=lambda x: x[:2] + ((x[2],) if x[2] is not None else ()))[2], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, i in g if i is not None}


def test_mark(spark):
    out = exact_dedup.mark(docs(spark, ROWS))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == len(ROWS)
    want = plain(ROWS)
    for r in out.filter("doc_id is not null").collect():
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id)
    lost = {r.text_sha256: r for r in out.filter("doc_id is null").collect()}
    assert {r.keep_id for r in lost.values()} == {3, None}


@pytest.mark.parametrize("parts", [1, 20])
def test_rounds_do_not_change_the_result(spark, parts):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(300)]
    out = got(exact_dedup.mark(docs(spark, rows, parts)))
    want = plain(rows)
    assert all((r.keep_id, r.group_size) == want[i][:2] for i, r in out.items())


def test_keep(spark):
    table = docs(spark, ROWS)
    left = exact_dedup.keep(table)
    assert left.columns == table.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([3, 6, 7, 8, 10, -1, 20, 21])


def test_the_longest_row_of_a_repeated_id_stays(spark):
    rows = [(i, "a b" + " " * (k * 7 % 10) + f"c{i}") for i in range(12) for k in range(10)]
    assert {r.doc_id: r.text for r in exact_dedup.keep(docs(spark, rows)).collect()} == {i: f"a b{' ' * 9}c{i}" for i in range(12)}


def test_empty_table(spark):
    empty = docs(spark, [])
    assert exact_dedup.mark(empty).count() == 0 and exact_dedup.keep(empty).count() == 0


def test_native(spark):
    plan = queries.QUERIES["op1_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
