"""Exact deduplication by a tree merge of digest runs, in DataFrame expressions only.

Every input partition is a run. A run is reduced to one row per digest; then runs exchange rows in rounds: ``FANOUT``
neighbouring runs merge into one by a grouped aggregation (no run is sorted), and each merge keeps, per digest, the smallest identifier of the best rows and the
number of rows. After the last round one row per digest is left in the whole table. A hot digest is reduced in its runs
first, so no round sees more than ``FANOUT`` rows of it per merged run.

Equality is verified at every level: rows merge only if SHA-256, a second independent 64-bit hash and the length of the
normalised text agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize

#: Characters deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
FANOUT = 8
KEY = ["sha", "check", "size"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: run, digest key, id, rank of the row in its group. Read once, kept in the shared folder."""
    norm = normalised(F.col(text))
    return materialize(docs.select(
        F.col(doc_id).alias("id"), F.spark_partition_id().alias("run"), F.sha2(norm.cast("binary"), 256).alias("sha"),
        F.xxhash64(norm).alias("check"), F.length(norm).alias("size"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars")))


def merge_runs(rows: DataFrame) -> DataFrame:
    """Tree merge of the runs to one row per digest: key, ``best`` (longest text first, then smallest id, null ids last), ``n``."""
    best = F.struct((-F.col("chars")).alias("short"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    level = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    last = rows.agg(F.max("run")).first()[0] or 0
    while last > 0:
        last //= FANOUT
        level = (level.withColumn("run", F.floor(F.col("run") / FANOUT).cast("int")).groupBy("run", *KEY)
                 .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    return level.select(*KEY, F.col("best.id").alias("keep_id"), (-F.col("best.short")).alias("most"), F.col("n").alias("group_size"))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text is the empty text; empty texts form one group. A null id loses ties against any id. Repeated rows of one
    id and text all count in ``group_size`` and all carry the id that stays. An empty table gives no rows. Other columns
    are not read.
    """
    rows = runs(docs, doc_id, text)
    out = rows.join(merge_runs(rows), KEY)
    return out.select(F.col("id").alias(doc_id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per group, all columns as they are.

    Repeated rows of the id that stays are reduced to one row, of those with the most characters.
    """
    rows = runs(docs, doc_id, text)
    won = merge_runs(rows).withColumn("id", F.col("keep_id"))
    same = rows.groupBy("id", *KEY).agg(F.count(F.lit(1)).alias("copies"))
    id_ok = F.col("_won.id").eqNullSafe(F.col(f"_docs.{doc_id}"))
    won = won.alias("a").join(same.alias("b"), (F.col("a.id").eqNullSafe(F.col("b.id"))) & (F.col("a.sha") == F.col("b.sha")) & (F.col("a.check") == F.col("b.check")) & (F.col("a.size") == F.col("b.size")))
    won = materialize(won.select("a.id", "a.sha", "a.most", "b.copies"))
    sha = F.sha2(normalised(F.col(f"_docs.{text}")).cast("binary"), 256)
    chars = F.length(F.coalesce(F.col(f"_docs.{text}"), F.lit("")))
    pick = lambda some: docs.alias("_docs").join(some.alias("_won"), id_ok & (F.col("_won.sha") == sha) & (F.col("_won.most") == chars), "left_semi")
    single = pick(won.filter("copies = 1"))
    repeated = won.filter("copies > 1")
    if repeated.isEmpty():
        return single
    tag = "_llm_sha_of_row"
    again = pick(repeated).withColumn(tag, F.sha2(normalised(F.col(text)).cast("binary"), 256))
    return single.unionByName(again.dropDuplicates([doc_id, tag]).drop(tag))
