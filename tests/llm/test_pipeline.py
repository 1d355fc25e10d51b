import hashlib
import random
import re

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from spanloom.llm import bpe, queries, toxicity
from tests.llm.helpers import classes, near, prose
from tests.llm.test_decontaminate import plain as leaks


def tables(tmp_path, spark, rows, labels, items):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_equals_plain_stages(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, prose(rng, 20, 5000)) for i in range(5)]
    texts = [prose(rng, rng.randrange(20, 150), 5000) + (" you vile scum" if i % 5 == 0 else "") for i in range(200)]
    texts += [near(rng, texts[i], 1) for i in range(1, 30)] + [texts[i] + "  " for i in range(3, 20)] + [texts[50] + " " + items[1][1], None, "", "", "idle", prose(rng, 20_000, 5000)]
    rows = [(i, t, "en", None, None, "x") for i, t in enumerate(texts)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(150)]
    tables(tmp_path, spark, rows, labels, items)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), toxicity.learnable())
    left = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert not left & set(range(0, 200, 5)) and left >= {i for i in range(200) if i % 5}
    groups = {}
    for i in sorted(left):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append(i)
    left = {min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in groups.values()}
    of = classes({i: texts[i] for i in left})
    left = {i for i in left if of[i] == i}
    left = {i for i in left if not leaks(texts[i], items)[-1]}
    assert set(out) == left
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i in left:
        ids = library.encode_ordinary(texts[i] or "")
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_hard_tables(spark, tmp_path):
    tables(tmp_path, spark, [(None, None, None, None, None, None), (1, "a", None, None, None, None), (1, "a", None, None, None, None), (2, "a", None, None, None, None)], [], [])
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [None, 1]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_registered():
    names = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names) and len([n for n in names if re.match(r"op\d+_", n)]) == 13
    assert set(queries.ORACLES) <= set(queries.QUERIES)
