import __spark_entry__ as entry
import pytest
from checks import registry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["timeline_id", "id", "t", "type", "normalized_intensity"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


JOINS = ["overlap_join", "point_in_interval", "gate_by_intervals", "dominant_label", "attach_text", "conflicts", "snap_clip_to_cut", "nearest_boundary",
         "allocate_slots", "scene_distribution", "key_from_chroma", "normalize_by_type"]


@pytest.mark.parametrize("name", JOINS)
def test_no_cross_join_in_the_plan(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["select_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in scan
