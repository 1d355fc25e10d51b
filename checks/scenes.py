"""Checks of the scene operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.roles import check, keypoints, shots, sql, vectors
from spanloom.operators import scenes as S

# pictures and tag vectors come from the embeddings table: tag<n> is vector n
VECS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
full_ AS (SELECT s.*, p.e AS pic, a.e AS t1, b.e AS t2 FROM shots s JOIN v p USING (vec_id) LEFT JOIN v a ON 'tag' || a.vec_id = tags[1] LEFT JOIN v b ON 'tag' || b.vec_id = tags[2])"""
COS = "list_cosine_similarity({0}, {1})"


def _tagsim(a: str, b: str) -> str:
    c = {(i, j): COS.format(f"{a}.t{i}", f"{b}.t{j}") for i in (1, 2) for j in (1, 2)}
    return (f"((greatest({c[1, 1]}, {c[1, 2]}) + greatest({c[2, 1]}, {c[2, 2]})) / 2 + (greatest({c[1, 1]}, {c[2, 1]}) + greatest({c[1, 2]}, {c[2, 2]})) / 2) / 2")


def _soft(a, b, pairs):
    arms = " ".join(f"WHEN ['{x}', '{y}'] = list_sort([lower({a}), lower({b})]) THEN {v}e0" for x, y, v in pairs)
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5e0 WHEN lower({a}) = lower({b}) THEN 1 {arms} ELSE 0 END"


PLACES = [("hybrid", "interior", 0.6), ("exterior", "hybrid", 0.6), ("exterior", "space/abstract", 0.1), ("exterior", "interior", 0.05)]
TIMES = [("dawn/dusk", "day", 0.6), ("dawn/dusk", "night", 0.6), ("day", "night", 0.1), ("day", "unclear", 0.5), ("night", "unclear", 0.5)]


def _sim(a, b):
    return (f"0.30e0 * {_soft(a + '.place', b + '.place', PLACES)} + 0.15e0 * {_soft(a + '.tm', b + '.tm', TIMES)} + 0.35e0 * {_tagsim(a, b)} "
            f"+ 0.20e0 * greatest(0, {COS.format(a + '.pic', b + '.pic')})")


SIM = VECS + f""",
n AS (SELECT timeline_id, ord, function, scale, "start", "end", start_frame, end_frame, source_filename, row_number() OVER (PARTITION BY timeline_id ORDER BY ord) AS i,
  {{'place': place, 'tm': "time", 'pic': pic, 't1': t1, 't2': t2}} AS me FROM full_),
adj AS (SELECT b.*, {_sim('a.me', 'b.me')} AS sim_prev, {_sim('a.me', 'c.me')} AS sim_skip FROM n b LEFT JOIN n a ON a.timeline_id = b.timeline_id AND a.i = b.i - 1 LEFT JOIN n c ON c.timeline_id = b.timeline_id AND c.i = b.i + 1),
adj2 AS (SELECT * REPLACE (CASE WHEN i > 1 THEN sim_prev END AS sim_prev, CASE WHEN i > 1 AND i < max(i) OVER (PARTITION BY timeline_id) THEN sim_skip END AS sim_skip) FROM adj)"""
CUTS = SIM + """,
cutf AS (SELECT *, coalesce(sim_prev < 0.5, false) AND NOT (coalesce(sim_skip >= 0.5, false) AND (function IN ('Insert', 'Cut-away', 'Reaction', 'Transition') OR scale IN ('Extreme Close-up', 'Close-up'))) AS is_cut FROM adj2),
sc0 AS (SELECT *, sum(CASE WHEN is_cut THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY ord)::BIGINT AS scene_id FROM cutf)"""


def _with_vectors(s, d):
    v = vectors(s, d)
    x = shots(s, d).join(v.select(F.col("id").alias("vec_id"), F.col("vector").alias("picture")), "vec_id")
    return S.attach_tag_vectors(x, v.select(F.concat(F.lit("tag"), "id").alias("tag"), "vector"))


@check("tagset_similarity", sql("shots", VECS + f""", q AS (SELECT timeline_id, ord, row_number() OVER (PARTITION BY timeline_id ORDER BY ord) AS i, {{'t1': t1, 't2': t2}} AS me FROM full_)
SELECT b.ord, round({_tagsim('a.me', 'b.me')}, 6) AS similarity FROM q b JOIN q a ON a.timeline_id = b.timeline_id AND a.i = b.i - 1"""))
def _(s, d):
    from spanloom.operators.ordered import scan
    x = scan(_with_vectors(s, d).select("timeline_id", "ord", "tag_vectors"), t="ord", cell=4096, prev={"before": "tag_vectors"})
    return x.filter("before is not null").select("ord", F.round(S.tagset_similarity("before", "tag_vectors"), 6).alias("similarity"))


@check("adjacent_similarity", sql("shots", SIM + " SELECT timeline_id, ord, round(sim_prev, 6) AS sim_prev, round(sim_skip, 6) AS sim_skip FROM adj2"))
def _(s, d):
    x = S.adjacent_similarity(_with_vectors(s, d))
    return x.select("timeline_id", "ord", F.round("sim_prev", 6).alias("sim_prev"), F.round("sim_skip", 6).alias("sim_skip"))


@check("scene_cuts", sql("shots", CUTS + " SELECT timeline_id, ord, is_cut, scene_id FROM sc0"))
def _(s, d):
    return S.scene_cuts(S.adjacent_similarity(_with_vectors(s, d))).select("timeline_id", "ord", "is_cut", "scene_id")


# scenes given by the ids alone, so that many lengths and functions occur
GIVEN = """g0 AS (SELECT *, sum(CASE WHEN ord % 3 = 0 OR ord % 10 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY ord)::BIGINT AS scene_id FROM shots)"""
ABSORB = """, a1 AS (SELECT timeline_id, scene_id, count(*) AS n, bool_or(function = 'Establishment') AS est, count(*) FILTER (function = 'Progression') AS pro FROM g0 GROUP BY ALL),
a2 AS (SELECT *, coalesce(sum(CASE WHEN n <= 3 AND est THEN 0 ELSE 1 END) OVER (PARTITION BY timeline_id ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM a1),
a3 AS (SELECT timeline_id, h, sum(n) AS n, sum(pro) AS pro FROM a2 GROUP BY ALL),
a4 AS (SELECT *, sum(CASE WHEN row_number = 1 THEN 0 WHEN n <= 5 AND pro / n >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY timeline_id ORDER BY h) AS s FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY h) AS row_number FROM a3)),
ab AS (SELECT g0.* EXCLUDE (scene_id), a4.s::BIGINT AS scene_id FROM g0 JOIN a2 USING (timeline_id, scene_id) JOIN a4 ON a4.timeline_id = g0.timeline_id AND a4.h = a2.h)"""


def _given(s, d):
    from spanloom.operators.ordered import scan
    i = F.col("ord")
    return scan(shots(s, d), t="ord", cell=4096, run={"scene_id": ("sum", F.when((i % 3 == 0) | (i % 10 == 1), 1).otherwise(0).cast("bigint"))})


@check("absorb_scenes", sql("shots", GIVEN + ABSORB + " SELECT timeline_id, ord, scene_id FROM ab"))
def _(s, d):
    return S.absorb_scenes(_given(s, d)).select("timeline_id", "ord", "scene_id")


SPLIT = """recursive:b0 AS (SELECT *, ord // 150 AS scene FROM shots), b1 AS (SELECT timeline_id, scene, list({'e': "end", 'ord': ord} ORDER BY ord) AS r, arg_min("start", ord) AS s, arg_max("end", ord) AS e FROM b0 GROUP BY ALL),
b2 AS (SELECT *, e - s > 300 AS long, (e - s) / ceil((e - s) / 300) AS target FROM b1),
wk AS (SELECT timeline_id, scene, r, long, target, 0 AS i, s AS cs, 0 AS piece, 0 AS mine FROM b2
  UNION ALL SELECT timeline_id, scene, r, long, target, i + 1, CASE WHEN long AND r[i + 1].e - cs >= target THEN r[i + 1].e ELSE cs END, CASE WHEN long AND r[i + 1].e - cs >= target THEN piece + 1 ELSE piece END, piece FROM wk WHERE i < len(r)),
p0 AS (SELECT timeline_id, scene, r[i].ord AS ord, mine, max(piece) OVER (PARTITION BY timeline_id, scene) AS total FROM wk WHERE i > 0),
p1 AS (SELECT *, count(*) OVER (PARTITION BY timeline_id, scene, mine) AS n FROM p0)
SELECT timeline_id, ord, scene AS scene_id, CAST(CASE WHEN mine = total AND total > 0 AND n <= 2 THEN mine - 1 ELSE mine END AS BIGINT) AS piece FROM p1"""


@check("split_long_scenes", sql("shots", SPLIT))
def _(s, d):
    x = shots(s, d).withColumn("scene_id", F.floor(F.col("ord") / 150))
    return S.split_long_scenes(x, 300.0).select("timeline_id", "ord", "scene_id", "piece")


@check("scene_rollup", sql("shots", GIVEN + """ SELECT timeline_id, scene_id, count(*) AS shot_count, arg_min("start", ord) AS start_seconds, arg_max("end", ord) AS end_seconds, arg_min(start_frame, ord) AS start_frame, arg_max(end_frame, ord) AS end_frame,
 string_agg(source_filename, ',' ORDER BY ord) AS shot_list FROM g0 GROUP BY ALL"""))
def _(s, d):
    return S.scene_rollup(_given(s, d)).withColumn("shot_list", F.array_join("shot_list", ","))


@check("known_characters", sql("shots", """c AS (SELECT timeline_id, ord // 100 AS scene_id, ord, p, tags[p] AS visual_id, CASE WHEN ord % 3 = 0 THEN 'No description' ELSE 'seen in ' || ord END AS appearance FROM shots, (VALUES (1), (2)) x(p))
SELECT timeline_id, scene_id, visual_id, arg_min(appearance, ord * 10 + p) AS appearance, min(ord) AS first_ord FROM c GROUP BY ALL"""))
def _(s, d):
    x = shots(s, d)
    look = F.when(F.col("ord") % 3 != 0, F.concat(F.lit("seen in "), "ord"))
    x = x.withColumn("scene_id", F.floor(F.col("ord") / 100)).withColumn("characters", F.transform("tags", lambda t: F.struct(t.alias("visual_id"), look.alias("appearance"))))
    return S.known_characters(x)


@check("default_importance", sql("shots", """x AS (SELECT ord, CASE ord % 6 WHEN 0 THEN 'credits' WHEN 1 THEN 'mixed' WHEN 2 THEN 'technical_issue' WHEN 3 THEN 'transition' WHEN 4 THEN 'content' END AS typ, CASE WHEN ord % 5 = 0 THEN 0 WHEN ord % 5 = 1 THEN 4 END AS sc, ord % 7 <> 0 AS us FROM shots)
SELECT 'film' AS kind, ord, s AS importance_score, CASE WHEN s = 0 THEN false ELSE u END AS is_usable FROM (SELECT ord, coalesce(sc, CASE WHEN typ IN ('credits', 'transition') THEN 0 WHEN typ = 'mixed' THEN 2 ELSE 3 END) AS s, CASE WHEN sc IS NULL THEN NOT coalesce(typ IN ('credits', 'transition'), false) ELSE us END AS u FROM x)
UNION ALL SELECT 'vlog', ord, s, CASE WHEN s = 0 THEN false ELSE u END FROM (SELECT ord, coalesce(sc, CASE WHEN typ IN ('technical_issue', 'transition') THEN 0 WHEN typ = 'mixed' THEN 2 ELSE 3 END) AS s, CASE WHEN sc IS NULL THEN NOT coalesce(typ IN ('technical_issue', 'transition'), false) ELSE us END AS u FROM x)"""))
def _(s, d):
    return _scene_rows(s, d, "film").unionByName(_scene_rows(s, d, "vlog"))


def _scene_rows(s, d, kind):
    i = F.col("ord")
    typ = F.when(i % 6 == 0, "credits").when(i % 6 == 1, "mixed").when(i % 6 == 2, "technical_issue").when(i % 6 == 3, "transition").when(i % 6 == 4, "content")
    x = shots(s, d).select("ord", typ.alias("scene_type"), F.when(i % 5 == 0, 0).when(i % 5 == 1, 4).alias("importance_score"), (i % 7 != 0).alias("is_usable"))
    return S.default_importance(x, kind).select(F.lit(kind).alias("kind"), "ord", "importance_score", "is_usable")


@check("usable_scenes", sql("shots", """x AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN NULL ELSE ord % 4 <> 1 END AS u, CASE WHEN ord % 5 > 0 THEN ord % 7 END AS sc, CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 13 <> 0 THEN lang END AS summary FROM shots)
SELECT 'strict' AS how, ord FROM x WHERE coalesce(u, true) AND coalesce(sc, 5) > 3 AND coalesce(summary, '') <> '' UNION ALL SELECT 'loose', ord FROM x WHERE coalesce(u, true) AND coalesce(sc, 5) >= 3 AND coalesce(summary, '') <> ''"""))
def _(s, d):
    i = F.col("ord")
    x = shots(s, d).select("ord", F.when(i % 3 != 0, i % 4 != 1).alias("is_usable"), F.when(i % 5 > 0, i % 7).alias("importance_score"), F.when(i % 11 == 0, "").when(i % 13 != 0, F.col("lang")).alias("summary"))
    return S.usable_scenes(x).select(F.lit("strict").alias("how"), "ord").unionByName(S.usable_scenes(x, strict=False).select(F.lit("loose").alias("how"), "ord"))
