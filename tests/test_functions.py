import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions import timecode as C


def one(spark, col, *args):
    return spark.range(1).select(col(*args).alias("x")).first().x


@pytest.mark.parametrize("text,want", [("01:02:03:01", 3723.5), ("01:02:03.5", 3723.5), ("02:03", 123.0), ("7.25", 7.25), ("1.0f", None), ("", None), ("a:b", None), ("1:2:3:4:5", None), (None, None)])
def test_timecodes(spark, text, want):
    assert one(spark, C.timecode_to_seconds, F.lit(text).cast("string")) == want


@pytest.mark.parametrize("value,style", [(v, s) for v in (0.35, 1.15, 2.25, 37.5625, 59.97, 59.99, 3723.45, 0.005, 83.449999) for s in ("hms1", "hms3", "ms1", "ms2")])
def test_printed_seconds_round_like_the_exact_value(spark, value, style):
    sec, whole = value % 60, f"{int(value // 3600):02d}:{int(value % 3600 // 60):02d}:"
    mins = f"{int(value // 60):02d}:"
    want = {"hms1": f"{whole}{sec:04.1f}", "hms3": f"{whole}{sec:06.3f}", "ms1": f"{mins}{sec:04.1f}", "ms2": f"{mins}{sec:05.2f}"}[style]
    assert one(spark, C.seconds_to_timecode, F.lit(value), style) == want


@pytest.mark.parametrize("text,want", [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('so {"k": 3} then', 3), ('{"k": 4', None), ("", None), ("```\n{\"k\": 5}```", 5)])
def test_lenient_json(spark, text, want):
    got = one(spark, X.json_lenient, F.lit(text), "k int")
    assert (got.k if got else None) == want


def test_natural_order(spark):
    names = ["clip_10", "clip_2", "Clip_1", "clip_2b"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key("n")).collect()]
    assert got == ["Clip_1", "clip_2", "clip_2b", "clip_10"]


@pytest.mark.parametrize("text,n,want", [("a  b\n c", 50, "a b c"), ("hello wide world", 12, "hello wide…"), ("unbroken", 4, "unbr…")])
def test_truncation(spark, text, n, want):
    assert one(spark, X.squash_truncate, F.lit(text), n) == want


def test_slug_of_nothing(spark):
    assert one(spark, X.asset_slug, F.lit("!!")).startswith("instruction_")
