"""Checks of the streaming forms: a table read as a stream until everything available is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.points import interval_sql
from checks.roles import check, sql
from spanloom.session import ensure_checkpoint_dir
from spanloom.streaming import forms


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"


def _events(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return e.select(F.col("user_id").alias("timeline_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("intensity"))


# results count only once the watermark (last time less the delay, in whole milliseconds) has passed them
MARK = "(SELECT floor((epoch_us(max(ts)) - 3600000000) / 1e3) / 1e3 FROM events)"


@check("stream_min_interval", sql("kp", interval_sql("SELECT user_id AS timeline_id, epoch_us(ts) / 1e6 AS t, event_id AS id, value AS v FROM events", 50_000.0).replace("held AS (SELECT src.*,", "held AS (SELECT src.*, anchor.a,")
                                  + f" SELECT timeline_id, t, id, v AS intensity FROM held WHERE rn = 1 AND {MARK} - a >= 50000"))
def _(s, d):
    return forms.run_available(forms.stream_min_interval(_events(s, d), 50_000.0, "1 hour"), _folder(s))


TOPK = """w AS (SELECT user_id AS timeline_id, event_id AS id, value AS intensity, floor(epoch_us(ts) / 1e6 / 86400) * 86400e0 AS window_start, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 1e6 / 86400) ORDER BY value DESC, ts, event_id) AS rank FROM events)
SELECT timeline_id, window_start, rank, id, intensity FROM w WHERE rank <= {0} AND window_start + 86400 <= """ + MARK


@check("stream_window_topk", sql("kp", TOPK.format(3)))
def _(s, d):
    return forms.run_available(forms.stream_window_topk(_events(s, d), 86_400, 3, "1 hour"), _folder(s))


@check("stream_window_top1", sql("kp", TOPK.format(1)))
def _(s, d):
    return forms.run_available(forms.stream_window_topk(_events(s, d), 86_400, 1, "1 hour"), _folder(s))


@check("stream_merge_turns", sql("kp", f"""f AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 + value * 100 AS e, event_type AS l, event_id FROM events WHERE epoch_us(ts) / 1e6 <= {MARK}),
n AS (SELECT *, CASE WHEN lag(l) OVER w = l AND t - lag(e) OVER w <= 40000 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM n),
m AS (SELECT user_id AS timeline_id, min(t) AS "start", last(e ORDER BY t) AS "end", any_value(l) AS label, string_agg(l, ' ' ORDER BY t) AS text, count(*) AS turns, g FROM g GROUP BY user_id, g)
SELECT timeline_id, "start", "end", label, text, turns FROM m WHERE g < (SELECT max(g) FROM m AS o WHERE o.timeline_id = m.timeline_id) OR {MARK} - "end" > 40000"""))
def _(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = s.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    x = raw.select(F.col("user_id").alias("timeline_id"), F.col("ts").cast("timestamp").alias("ts"), (t + F.col("value") * 100).alias("end"),
                   F.col("event_type").alias("label"), F.col("event_type").alias("text"))
    return forms.run_available(forms.stream_merge_turns(x, 40_000.0, "1 hour"), _folder(s))


@check("stream_sessions", sql("kp", f"""e AS (SELECT user_id, event_type, epoch_us(ts) AS u, event_id FROM events),
n AS (SELECT *, CASE WHEN u - lag(u) OVER w <= 200000000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY u)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM n),
s AS (SELECT user_id AS timeline_id, event_type AS label, min(u) AS a, max(u) AS z, count(*) AS "rows" FROM g GROUP BY user_id, event_type, g)
SELECT timeline_id, label, a / 1e6 AS "start", z / 1e6 AS "end", "rows" FROM s WHERE (z + 200000000000) / 1e6 <= {MARK}"""))
def _(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = s.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    x = raw.select(F.col("user_id").alias("timeline_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    return forms.run_available(forms.stream_sessions(x, 200_000.0, "1 hour"), _folder(s))
