"""Checks of vector search, batch scoring and signal operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.roles import check, keypoints, points, sql, table, vectors
from spanloom.operators import signal as G
from spanloom.operators import vectors as V
from spanloom.session import ensure_checkpoint_dir


@check("vector_topk", """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT * FROM v), r AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS s, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.id) AS rank FROM q, v)
SELECT query_id, id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 16""")
def _(s, d):
    v = vectors(s, d)
    q = v.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return V.vector_topk(v, q, 16).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


@check("vector_topk_pruned", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
r AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS s FROM v AS q, v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) <= 3)
SELECT query_id, id, round(s, 6) AS similarity, (SELECT count(*) FROM v) * (SELECT count(*) FROM v WHERE vec_id % 20 = 0) AS pairs, true AS fewer FROM r""")
def _(s, d):
    """Searches of the rows whose id is divisible by 20 against all rows, and whether cells spare comparisons."""
    v = vectors(s, d)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    work = V.vector_topk_work(v, q, 3, cells=64).select("pairs", (F.col("compared") <= F.col("pairs")).alias("fewer"))
    near = V.vector_topk(v, q, 3, cells=64).select("query_id", "id", F.round("similarity", 6).alias("similarity"))
    return near.withColumn("_one", F.lit(1)).join(work.withColumn("_one", F.lit(1)), "_one").drop("_one")


@check("batch_score", "SELECT doc_id, lang, ord(substr(lang, 1, 1)) + ord(substr(lang, 2, 1)) + 3e0 AS score FROM documents")
def _(s, d):
    def total_of_codes(items):
        return [float(sum(ord(c) for c in x)) + 3.0 for x in items]

    x = table(s, d, "documents").select("doc_id", "lang")
    scored = V.batch_score(x, total_of_codes, column="lang", schema="double", batch=2)
    return scored.select("doc_id", "lang", "score")


@check("batch_score_stored", "SELECT doc_id, source, length(source) + ord(substr(source, 1, 1)) + 0e0 AS score FROM documents")
def _(s, d):
    """Scores kept in a folder: the second run asks for the inputs that the first had not seen only."""
    def score(items):
        return [float(len(x) + ord(x[0])) for x in items]

    x = table(s, d, "documents").select("doc_id", "source")
    store = f"{ensure_checkpoint_dir(s)}/scores-{uuid.uuid4().hex}"
    V.batch_score(x.filter("doc_id % 2 = 0"), score, column="source", schema="double", store=store)
    return V.batch_score(x, score, column="source", schema="double", store=store).select("doc_id", "source", "score")


# a chroma per user and day: event counts by hour, folded to twelve classes
CHROMA = """h AS (SELECT timeline_id, CAST(floor(t / 259200) AS BIGINT) AS win, CAST(floor(t / 3600) AS INT) % 12 AS pc, count(*)::DOUBLE AS n FROM kp GROUP BY ALL),
ch AS (SELECT timeline_id, win, list_transform(generate_series(0, 11), lambda i: coalesce(list_sum(list_transform(list_filter(l, lambda y: y.pc = i), lambda y: y.n)), 0e0)) AS c FROM (SELECT timeline_id, win, list({'pc': pc, 'n': n}) AS l FROM h GROUP BY ALL)),
names AS (SELECT ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'] AS nm, [6.35e0,2.23,3.48,2.33,4.38,4.09,2.52,5.19,2.39,3.66,2.29,2.88] AS maj, [6.33e0,2.68,3.52,5.38,2.60,3.53,2.54,4.75,3.98,2.69,3.34,3.17] AS mn),"""
KS = CHROMA + """ tm AS (SELECT r * 2 AS i, nm[r + 1] || ' Major' AS key, list_transform(generate_series(0, 11), lambda p: maj[(p - r + 12) % 12 + 1]) AS v FROM names, (SELECT unnest(generate_series(0, 11)) AS r)
  UNION ALL SELECT r * 2 + 1, nm[r + 1] || ' Minor', list_transform(generate_series(0, 11), lambda p: mn[(p - r + 12) % 12 + 1]) FROM names, (SELECT unnest(generate_series(0, 11)) AS r))
SELECT timeline_id, win, key, round(s, 6) AS score FROM (SELECT timeline_id, win, key, s, row_number() OVER (PARTITION BY timeline_id, win ORDER BY round(s, 9) DESC, i) AS rn FROM (SELECT timeline_id, win, key, i, list_cosine_similarity(c, v) AS s FROM ch, tm)) WHERE rn = 1"""
HELIX = CHROMA + """ ps AS (SELECT pc, [cos(2 * pi() * k / 12), sin(2 * pi() * k / 12), 0.35e0 * k] AS p FROM (SELECT unnest([0,7,2,9,4,11,6,1,8,3,10,5]) AS pc, unnest(generate_series(0, 11)) AS k)),
al AS (SELECT list(p ORDER BY pc) AS p FROM ps),
tm AS (SELECT r * 2 + m AS i, nm[r + 1] || CASE m WHEN 0 THEN ' Major' ELSE ' Minor' END AS key, list_transform(generate_series(1, 3), lambda d: p[r + 1][d] + 0.8e0 * p[(r + CASE m WHEN 0 THEN 4 ELSE 3 END) % 12 + 1][d] + 0.6e0 * p[(r + 7) % 12 + 1][d]) AS v
  FROM names, al, (SELECT unnest(generate_series(0, 11)) AS r), (VALUES (0), (1)) mm(m)),
ce AS (SELECT timeline_id, win, list_transform(generate_series(1, 3), lambda d: list_sum(list_transform(generate_series(1, 12), lambda q: c[q] * p[q][d]))) AS e FROM ch, al)
SELECT timeline_id, win, key, round(s, 6) AS score FROM (SELECT timeline_id, win, key, s, row_number() OVER (PARTITION BY timeline_id, win ORDER BY round(s, 9) DESC, i) AS rn FROM (SELECT timeline_id, win, key, i, list_cosine_similarity(e, v) AS s FROM ce, tm)) WHERE rn = 1"""


def _chroma(s, d):
    k = points(s, d).select("timeline_id", F.floor(F.col("t") / 259200).alias("win"), (F.floor(F.col("t") / 3600) % 12).alias("pc"))
    return k.groupBy("timeline_id", "win").agg(F.array(*[F.sum((F.col("pc") == i).cast("double")) for i in range(12)]).alias("chroma"))


@check("key_from_chroma", sql("kp", KS))
def _(s, d):
    return G.key_from_chroma(_chroma(s, d)).select("timeline_id", "win", "key", F.round("score", 6).alias("score"))


@check("key_from_chroma_spiral", sql("kp", HELIX))
def _(s, d):
    return G.key_from_chroma(_chroma(s, d), "spiral").select("timeline_id", "win", "key", F.round("score", 6).alias("score"))


@check("chroma_fold", sql("kp", """b AS (SELECT timeline_id, 20e0 + k * 13.7e0 AS freq, intensity AS power FROM kp), m AS (SELECT timeline_id, freq, avg(power) AS p FROM b WHERE freq >= 50 GROUP BY ALL),
c AS (SELECT timeline_id, ((CAST(round_even(69 + 12 * log2(freq / 440), 0) AS INT) % 12) + 12) % 12 AS pc, sum(p) AS p FROM m GROUP BY ALL)
SELECT timeline_id, pc, round(coalesce(c.p, 0) / sum(c.p) OVER (PARTITION BY timeline_id), 6) AS share FROM (SELECT * FROM (SELECT DISTINCT timeline_id FROM m), (SELECT unnest(generate_series(0, 11)) AS pc)) LEFT JOIN c USING (timeline_id, pc)"""))
def _(s, d):
    b = keypoints(s, d).select("timeline_id", (F.lit(20.0) + F.col("k") * 13.7).alias("freq"), F.col("intensity").alias("power"))
    x = G.chroma_fold(b).select("timeline_id", F.posexplode("chroma").alias("pc", "v"))
    return x.select("timeline_id", F.col("pc").cast("bigint").alias("pc"), F.round("v", 6).alias("share"))


SAMPLES = """smp AS (SELECT l_suppkey AS timeline_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_quantity / 50 - 0.5 AS x FROM lineitem)"""


def _samples(s, d):
    """Line items of a supplier as a signal, numbered by a running count over order keys."""
    from spanloom.operators.ordered import scan
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("timeline_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_quantity") / 50 - 0.5).alias("x"))
    n = scan(li, t="l_orderkey", tie=["l_linenumber", "l_partkey", "l_extendedprice"], cell=100_000, run={"n": ("sum", F.lit(1))})
    return n.select("timeline_id", (F.col("n") - 1).alias("i"), "x")


@check("rms_db_frames", "WITH " + SAMPLES + """, tot AS (SELECT timeline_id, count(*) AS n FROM smp GROUP BY 1), fr AS (SELECT timeline_id, f, n FROM tot, LATERAL (SELECT unnest(generate_series(0, (n - 48) // 16)) AS f) WHERE n >= 48),
r AS (SELECT fr.timeline_id, f, sqrt(sum(x * x) / 48) AS rms FROM fr JOIN smp ON smp.timeline_id = fr.timeline_id AND i >= f * 16 AND i < f * 16 + 48 GROUP BY ALL),
g AS (SELECT *, 20 * log10(greatest(rms, 1e-12)) AS db, max(20 * log10(greatest(rms, 1e-12))) OVER (PARTITION BY timeline_id) AS top FROM r),
sh AS (SELECT timeline_id, sqrt(avg(x * x)) AS rms FROM smp JOIN tot USING (timeline_id) WHERE n < 48 GROUP BY 1)
SELECT timeline_id, f AS frame_idx, round(rms, 7) AS rms, round(db, 6) AS db, round(db, 6) >= round(top - 1, 6) AS sound, f * 16 / 16000e0 AS t FROM g
UNION ALL SELECT timeline_id, 0, round(rms, 7), round(20 * log10(rms + 1e-12), 6), 20 * log10(rms + 1e-12) > -120, 0e0 FROM sh""")
def _(s, d):
    x = G.rms_db_frames(_samples(s, d), 48, 16, 16000.0, -1.0)
    return x.select("timeline_id", "frame_idx", F.round("rms", 7).alias("rms"), F.round("db", 6).alias("db"), "sound", "t")


@check("rms_bars", "WITH " + SAMPLES + """, tot AS (SELECT timeline_id, greatest(1, count(*) // 40) AS per FROM smp GROUP BY 1), b AS (SELECT timeline_id, i // per AS bar, sqrt(avg(x * x)) AS r FROM smp JOIN tot USING (timeline_id) WHERE i // per < 40 GROUP BY ALL),
m AS (SELECT timeline_id, max(r) AS top FROM b GROUP BY 1)
SELECT timeline_id, bar, round(CASE WHEN top > 0 THEN coalesce(r, 0) / top ELSE coalesce(r, 0) END, 7) AS rms FROM (SELECT timeline_id, bar, top FROM m, (SELECT unnest(generate_series(0, 39)) AS bar)) LEFT JOIN b USING (timeline_id, bar)""")
def _(s, d):
    return G.rms_bars(_samples(s, d), 40).withColumn("rms", F.round("rms", 7))
