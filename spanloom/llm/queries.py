"""Queries over the given tables, one for each operator, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, exact_dedup, fingerprints, html_text, langid, near_dup, quality, secret_ledger, suffix_dedup, token_align, toxicity, vector_codes
from spanloom.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)""")
def op1(spark, sf_dir):
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


@query("op3_decontaminate", r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     cut AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win
             FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
     doc AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
             FROM low, (SELECT DISTINCT size FROM cut), unnest(range(1, len(w) - size + 2)) AS r(i)),
     hit AS (SELECT doc_id, item_id, i, doc.size FROM doc JOIN cut ON doc.win = cut.win AND doc.size = cut.size),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op3(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _matches_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST(length(array_to_string(gaps[1:i], '')) + length(coalesce(array_to_string(whole[1:i-1], ''), '')) AS BIGINT) AS start, len(whole[i]) AS size
      FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS part FROM d), unnest(range(1, len(whole) + 1)) AS r(i) WHERE len(part[i]) >= {least}"""


_RULES_SQL = " UNION ALL ".join(_matches_sql(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least) for i, r in enumerate(secret_ledger.RULES))


@query("op7_secret_ledger", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_RULES_SQL}),
     g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS spans,
                  string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) FILTER (rank < 3) AS base FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)""")
def op7(spark, sf_dir):
    ledger, paths = secret_ledger.update(secret_ledger.empty_ledger(spark), table(spark, sf_dir, "documents"))
    out = secret_ledger.findings(ledger, paths)
    n = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda f: f["rank"] < 3)
    return out.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"),
                      F.sha2(secret_ledger.joined(base).cast("binary"), 256).alias("base_sha256"), secret_ledger.joined(F.col("found")).alias("spans"))


@query("op6_quality_gam")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learnable())
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), quality.FOLDS) == quality.HELD).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_toxicity_fm")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_bpe")
def op10(spark, sf_dir):
    return bpe.report(bpe.encode(table(spark, sf_dir, "documents"), bpe.share(spark)))


@query("op4_langid")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.learnable())
    return langid.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), langid.FOLDS) == langid.HELD).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_near_dup")
def op2(spark, sf_dir):
    return near_dup.classes(table(spark, sf_dir, "documents"))


@query("op5_html_text")
def op5(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    out = suffix_dedup.cut(table(spark, sf_dir, "documents"))
    return suffix_dedup.report(out).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_token_align")
def op11(spark, sf_dir):
    return token_align.align(table(spark, sf_dir, "documents"))


def _lloyd_sql() -> str:
    rounds = []
    for r in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""d{r} AS MATERIALIZED (SELECT rid, p, k, sum((x - y) * (x - y)) AS d FROM c JOIN b{r} USING (p, j) GROUP BY ALL),
     a{r} AS MATERIALIZED (SELECT rid, p, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, k) = 1)""")
        if r < vector_codes.ROUNDS:
            rounds.append(f"""m{r} AS MATERIALIZED (SELECT p, k, j, sum(x) AS s, count(*) AS n FROM a{r} JOIN c USING (rid, p) GROUP BY ALL),
     b{r + 1} AS MATERIALIZED (SELECT p, k, j, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM b{r} LEFT JOIN m{r} USING (p, k, j))""")
    last = vector_codes.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
       FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c AS MATERIALIZED (SELECT rid, i // (len(e) // 8) AS p, i % (len(e) // 8) AS j, CAST(e[i + 1] AS HUGEINT) AS x FROM v, unnest(range(len(e))) AS r(i)),
     b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, j, x AS y FROM c WHERE rid <= 16), {", ".join(rounds)},
     own AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} JOIN v USING (rid) GROUP BY rid, vec_id, label),
     book AS (SELECT sha256(string_agg(y, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM own, book"""


@query("op13_vector_codes", _lloyd_sql())
def op13(spark, sf_dir):
    coded, book = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(vector_codes.digest(book)))


@query("op12_fingerprints")
def op12(spark, sf_dir):
    return fingerprints.against_edited(table(spark, sf_dir, "documents"))
