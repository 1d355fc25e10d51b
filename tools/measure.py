"""Compare the two-level and binned forms with the plain ones when one timeline holds every row.

Usage: measure.py [sf_dir]. Prints seconds, one line per case.
"""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from checks import roles
from spanloom.operators import intervals as I
from spanloom.operators import points as P
from spanloom.operators.ordered import scan


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name, make, repeat=2):
        best = None
        for _ in range(repeat):
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        print(f"{name}: {best:.2f}", flush=True)

    one = (spark.read.parquet(f"{sf}/lineitem.parquet")
           .select(F.lit(1).alias("timeline_id"), (F.col("l_orderkey") * 10.0 + F.col("l_linenumber")).alias("t"),
                   (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"), F.col("l_extendedprice").alias("intensity"))
           .dropDuplicates(["timeline_id", "t"]))
    path = tempfile.mkdtemp(prefix="measure-")
    one.write.mode("overwrite").parquet(path)
    one = spark.read.parquet(path)
    print("rows on the one timeline:", one.count())
    timed("next value, plain window (one task)", lambda: one.withColumn("n", F.lead("t").over(Window.partitionBy("timeline_id").orderBy("t"))))
    timed("next value, two-level scan", lambda: scan(one, cell=50_000.0, next={"n": "t"}))

    def loop(pdf):
        pdf = pdf.sort_values("t")
        keep, anchor, best = [], None, None
        for i, (t, v) in enumerate(zip(pdf["t"].tolist(), pdf["intensity"].tolist())):
            if anchor is None or t - anchor >= 25.0:
                if best is not None:
                    keep.append(best[0])
                anchor, best = t, (i, v)
            elif v > best[1]:
                best = (i, v)
        keep.append(best[0])
        return pdf.iloc[keep]

    timed("spacing fold, one group (one task)", lambda: one.groupBy("timeline_id").applyInPandas(loop, one.schema))
    timed("spacing fold, chained cells", lambda: P.min_interval_best(one, 25.0, score="intensity", cell=50_000.0))

    small = roles.spans(spark, sf.replace("sf0.1", "sf0.01")).select(F.lit(1).alias("timeline_id"), F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    big = roles.spans(spark, sf).select(F.lit(1).alias("timeline_id"), F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))

    def other(x):
        return x.select("timeline_id", *[F.col(c).alias(c.replace("a_", "b_")) for c in ("a_id", "a_start", "a_end")])

    hit = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    timed(f"interval join, key and residual, {small.count()} rows", lambda: small.join(other(small), "timeline_id").filter(hit), 1)
    timed(f"interval join, binned, {small.count()} rows", lambda: I.overlap_join(small, other(small)), 1)
    timed(f"interval join, binned, {big.count()} rows", lambda: I.overlap_join(big, other(big)), 1)


if __name__ == "__main__":
    main()
