import hashlib
import random

import pytest

from spanloom.llm import decontaminate
from tests.llm.helpers import CLASHING, docs, got, prose, words


def plain(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        size = min(window, len(x))
        for j in range(len(x) - size + 1) if size else ():
            for i in range(len(w) - size + 1):
                if w[i : i + size] == x[j : j + size]:
                    hit.update(range(i, i + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(11, 30))) for i in range(12)] + [(20, "Short Item"), (21, ""), (22, None), (23, "..."), (None, prose(rng, 15)), (24, "x" * 40)]
    items += [items[0], (30, items[0][1])]
    rows = [(1, None), (2, ""), (3, prose(rng, 50)), (4, "a short, item b"), (5, items[3][1].upper()), (6, "pre " + " ".join(items[4][1].split()[2:13]) + " post"),
            (7, items[16][1]), (8, " ".join(items[4][1].split()[:9])), (9, (prose(rng, 30_000) + " " + items[5][1] + " ") * 2), (10, items[0][1] + "\n" + items[1][1]), (10, "short"), (None, items[2][1])]
    extra = ", ".join(f"{c} string" for c in CLASHING if c != "text")
    bench = spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in items], f"item_id bigint, text string, {extra}")
    return rows, items, docs(spark, rows), bench


@pytest.mark.parametrize("most", [1_000_000, 50])  # one pass, and several
def test_matches(spark, most):
    rows, items, table, bench = tables(spark)
    out = decontaminate.report(decontaminate.matches(table, bench, max_windows=most)).collect()
    assert len(out) == len(rows)
    have = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out)
    assert have == sorted((i or -1, *plain(t, items)) for i, t in rows)


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_drop(spark, most):
    rows, items, table, bench = tables(spark)
    left = decontaminate.drop_contaminated(table, bench, max_windows=most)
    assert left.columns == table.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(i or -1 for i, t in rows if not plain(t, items)[-1])


def test_empty_tables(spark):
    _, _, table, bench = tables(spark)
    assert decontaminate.matches(docs(spark, []), bench).count() == 0
    assert {r.contaminated for r in decontaminate.report(decontaminate.matches(table, bench.limit(0))).collect()} == {False}
    assert decontaminate.drop_contaminated(table, bench.limit(0)).count() == table.count()
