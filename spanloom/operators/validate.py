"""Validators: they return violations or flags and never drop rows silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import as_list


def validate_docs(docs: DataFrame, *, body="body", required: Sequence[str] = ("summary", "sections"),
                  section_keys: Sequence[str] = ("name", "description"), check_times: bool = False,
                  int_list: str | None = None) -> DataFrame:
    """JSON documents with an array of violations: required keys, a non-empty ``sections`` list whose members hold
    ``section_keys`` and, with ``check_times``, a start and an end in either spelling. ``int_list`` names a key
    that must be a list of integers."""
    # parsed once per row, then read by all rules
    d = docs.withColumn("_top", F.from_json(body, "map<string,string>"))
    d = d.withColumn("_raw", F.try_element_at("_top", F.lit("sections"))).withColumn("_ids", F.try_element_at("_top", F.lit(int_list or "")))
    d = d.withColumn("_items", F.from_json("_raw", "array<map<string,string>>")).withColumn("_idlist", F.from_json("_ids", "array<string>"))
    is_object = F.col("_top").isNotNull()

    def has(k):
        return F.map_contains_key("_top", k)

    def is_list(c):
        return F.coalesce(F.trim(c).startswith("["), F.lit(False))

    out = [F.when(~is_object, F.lit("not an object"))]
    out += [F.when(is_object & ~has(k), F.lit(f"missing {k}")) for k in required]
    if "sections" in required:
        given = is_object & has("sections")
        listed = given & is_list("_raw")
        out.append(F.when(given & ~is_list("_raw"), F.lit("sections is not a list")))
        out.append(F.when(listed & (F.json_array_length("_raw") == 0), F.lit("sections is empty")))

        def lacks(*names):
            def without(m):
                found = F.map_contains_key(m, names[0])
                for n in names[1:]:
                    found = found | F.map_contains_key(m, n)
                return m.isNull() | ~found
            return F.exists("_items", without)

        out += [F.when(listed & lacks(k), F.lit(f"section without {k}")) for k in section_keys]
        if check_times:
            out.append(F.when(listed & lacks("start_time", "Start_Time"), F.lit("section without start time")))
            out.append(F.when(listed & lacks("end_time", "End_Time"), F.lit("section without end time")))
    if int_list:
        given = is_object & has(int_list)
        out.append(F.when(given & ~is_list("_ids"), F.lit(f"{int_list} is not a list")))
        out.append(F.when(given & F.exists("_idlist", lambda x: x.isNull() | ~x.rlike(r"^-?\d+$")), F.lit(f"{int_list} holds a non-integer")))
    found = F.array_compact(F.array(*out))
    return (d.withColumn("violations", found).withColumn("valid", F.size("violations") == 0)
            .drop("_top", "_raw", "_ids", "_items", "_idlist"))


def validate_section_bounds(sections: DataFrame, *, duration="duration", tol: float = 1.0,
                            cols=("start_time", "end_time")) -> DataFrame:
    """Sections whose start or end lies past the duration plus tolerance, with the issue."""
    S, E = cols
    limit = F.col(duration) + tol
    return (sections.withColumn("issue", F.when(F.col(S) > limit, "start_past_end").when(F.col(E) > limit, "end_past_end"))
            .filter(F.col("issue").isNotNull() & (F.col(duration) > 0)))


def validate_section_lengths(sections: DataFrame, min_len: float = 5.0, max_len: float = 90.0, *,
                             cols=("start_time", "end_time")) -> DataFrame:
    """Sections that are too short, too long or have no readable times."""
    n = F.col(cols[1]) - F.col(cols[0])
    return (sections.withColumn("length", n)
            .withColumn("issue", F.when(n.isNull(), "parse_error").when(n < min_len, "too_short").when(n > max_len, "too_long"))
            .filter(F.col("issue").isNotNull()))


def validate_coverage(sections: DataFrame, tol: float = 5.0, *, by="timeline_id", ord="ord", end="end_time",
                      duration="duration") -> DataFrame:
    """Per timeline: does the last section end within ``tol`` of the duration?"""
    return (sections.groupBy(*as_list(by)).agg(F.max_by(F.struct(F.col(end).alias("e")), ord)["e"].alias("last_end"), F.max(duration).alias(duration))
            .withColumn("missing", F.abs(F.col(duration) - F.col("last_end")))
            .withColumn("covered", F.coalesce(F.col(duration).isNull() | (F.col("missing") <= tol), F.lit(False))))


def repair_sections(sections: DataFrame, *, duration="duration", cols=("start_time", "end_time")) -> DataFrame:
    """Drop sections that start at or past the end; clamp ends to the duration."""
    S, E = cols
    return sections.filter(F.col(S) < F.col(duration)).withColumn(E, F.least(F.col(E), F.col(duration)))


def default_sections(timelines: DataFrame, sections: DataFrame | None = None, length: float = 30.0, *,
                     by="timeline_id", duration="duration") -> DataFrame:
    """Fixed-length sections for timelines that have none; existing sections pass through."""
    keys = as_list(by)
    bare = timelines if sections is None else timelines.join(sections.select(*keys).distinct(), keys, "left_anti")
    n = F.ceil(F.col(duration) / length).cast("int")
    made = (bare.filter(F.col(duration) > 0)
            .select(*keys, duration, F.posexplode(F.sequence(F.lit(0), n - 1)).alias("ord", "_k"))
            .select(*keys, F.concat(F.lit("Section "), F.col("_k") + 1).alias("name"), F.col("ord").cast("bigint").alias("ord"),
                    (F.col("_k") * length).alias("start_time"), F.least((F.col("_k") + 1) * length, F.col(duration)).alias("end_time")))
    return made if sections is None else sections.select(*made.columns).unionByName(made)
