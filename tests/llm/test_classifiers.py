import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid, quality, queries, toxicity
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = score.rank()
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.mark.parametrize("name, label, least", [("op6_quality_gam", "quality", 0.99), ("op8_toxicity_fm", "toxic", 0.95)])
def test_held_out(spark, name, label, least):
    out = queries.QUERIES[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    rows = out.merge(labels, on="doc_id")
    held = rows[rows.held_out]
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count() and 0 < len(held) < len(rows) / 2
    assert out.score.between(0, 1).all() and auc(held.score, held[label]) >= least
    assert ((held.predicted == 1) == (held[label] == 1)).mean() >= 0.97


def test_held_out_languages(spark):
    out = queries.QUERIES["op4_langid"](spark, "/root/testdata/sf0.01").toPandas()
    rows = out.merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


LANGS = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)] + [(100, None, "en"), (101, "", "de"), (102, "123 !", "en"), (103, "the and", None), (None, "der die", "de"),
         (104, "the " * 100_000, "fr"), (105, "the dog", "en"), (105, "the dog", "en")]


def test_languages_of_hard_rows(spark):
    table = docs(spark, LANGS)
    model = langid.fit(table, F.col("id") != 104)
    assert model.languages == ["de", "en"]
    out = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 100, 101, 102, 103, 104, 105, None)] == ["en", "de", "und", "und", "und", "en", "en", "en", "de"]
    assert out[100].score == 0 and out[100].rejected and not out[0].rejected
    none = langid.fit(docs(spark, []), F.lit(True))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).count() == 0


def test_rejection_is_calibrated():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 3000)
    logits = rng.normal(0, 1, (3000, 3))
    logits[np.arange(3000), y] += 2
    m = langid.Model(["a", "b", "c"])
    langid.calibrate(m, 5 * logits, y)
    p = langid.softmax(5 * logits / m.temperature)
    kept = p.max(1) >= m.least
    assert (p.argmax(1) != y)[kept].mean() <= langid.ERROR and 0.05 < kept.mean() < 1
    assert abs(p.max(1).mean() - (p.argmax(1) == y).mean()) < 0.03


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_hard_rows(spark, module, label):
    rows = [(i, "you idiot person" if i % 2 else "a kind person") for i in range(60)] + [(100, None), (101, ""), (102, "idiot " * 100_000), (None, "idiot"), (103, "idiot"), (103, "idiot")]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (2, None), (999, 1)], f"doc_id bigint, {label} int")
    model = module.fit(table, labels, F.col("id") != 5)
    out = module.score(table, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[100] == by[101] and by[3] > 0.5 > by[4]
    bare = module.fit(table, labels.limit(0), F.lit(True))
    assert {r.score for r in module.score(table, bare).collect()} == {0.0 if module is toxicity else 0.5}
    assert module.score(docs(spark, []), model).count() == 0


def test_pairs_of_terms_count():
    """Two words that mean something only together: no additive weights can say it, factors can."""
    rows, terms, y = [], [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        for t, has in ((0, a), (1, b), (2, 1 - a), (3, 1 - b)):
            if has:
                rows.append(i)
                terms.append(t)
        y.append(a ^ b)
    keep = np.full(toxicity.BUCKETS, -1, np.int32)
    keep[:4] = np.arange(4)
    m = toxicity.train(keep, np.array(rows), np.array(terms), np.array(y, float))
    raw = m.raw(np.array(rows), np.array(terms), 400)
    assert ((raw > 0) == (np.array(y) == 1)).all()


def test_pairs_of_terms_are_learned_from_documents(spark):
    """2,000 texts that are toxic if they hold an insult or a group's name, but not both; neither tells alone."""
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(2000):
        a, b = i % 2, i // 2 % 2
        words = [*rng.choice(filler, 30), "insult" if a else "praise", "group" if b else "nobody"]
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(a ^ b)))
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("id") % 5 != 0)
    out = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    right = [(out[i] > 0.5) == bool(t) for i, t in labels if i % 5 == 0]
    assert np.mean(right) > 0.97


def test_interaction_is_a_difference_of_correlations():
    cell = lambda *v: np.array(v, float)[:, None]
    same = toxicity.interaction(cell(100, 1000), cell(90, 900), cell(100, 1000), cell(10, 100))
    turned = toxicity.interaction(cell(1000, 1000), cell(900, 100), cell(1000, 1000), cell(100, 900))
    assert same[0] < 1e-9 and turned[0] > toxicity.PAIR_CHI and toxicity.interaction(cell(0, 5), cell(0, 5), cell(9, 9), cell(1, 1))[0] < 10


def test_scores_equal_a_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Model(np.zeros(1, np.int32), -0.3, rng.normal(0, 1, 20), rng.normal(0, 1, (20, toxicity.RANK)))
    sets = [sorted(rng.choice(20, n, replace=False).tolist()) for n in (0, 1, 2, 7, 20)]
    raw = m.raw(np.repeat(np.arange(5), [len(x) for x in sets]), np.array([t for x in sets for t in x], int), 5)
    plain = [m.bias + sum(m.weight[i] for i in x) + sum(m.factor[i] @ m.factor[j] for i in x for j in x if i < j) for x in sets]
    assert np.allclose(raw, plain)


def test_samples_are_bounded_in_bytes(spark):
    from spanloom.llm.common import labelled

    table = docs(spark, [(i, "x" * 1000) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    assert labelled(table, labels, "toxic", F.lit(True), 40, most=10_500).count() == 10
    assert labelled(table, labels, "toxic", F.lit(True), 40, most=1 << 30).count() == 40


def test_pairs_of_features_count():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y)
    assert ((m.raw(x) > 0) == (y == 1)).mean() > 0.95 and (0, 1) in [(i, j) for i, j, _ in m.pairs]


def test_drop_toxic_keeps_columns(spark):
    table = docs(spark, [(i, "vile words" if i % 2 else "kind words") for i in range(80)] + [(200, None)])
    model = toxicity.fit(table, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int"), F.lit(True))
    left = toxicity.drop_toxic(table, model)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} >= set(range(0, 80, 2)) and not {r.doc_id for r in left.collect()} & set(range(1, 80, 2))
