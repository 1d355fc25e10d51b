"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

A blob is a text, named by its SHA-256. Every row of ``versions`` (a path at some time) points to a blob. The ledger has
one row per scanned pair of blob and rule version, with the findings. A run scans only the pairs the ledger lacks: one
representative row per unseen blob is chosen on narrow rows, and only those texts are read again and matched. Findings are
then joined back to all paths.

Offsets come from the pieces between matches: ``split`` gives the texts around them, ``regexp_extract_all`` the matches,
and running lengths give start and end in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` is the part that needs ``least`` characters; shorter matches are dropped, not rejoined."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base rules, then rules of this method.
ASSIGN = "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + ")" \
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 1, ASSIGN, 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int>>"



def _none() -> Column:
    return F.array().cast(FINDINGS)


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find(text: Column, rule: Rule, rank: int) -> Column:
    """Findings of one rule, leftmost first, non-overlapping."""
    text = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1 + rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    match = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    step = lambda acc, m: F.struct(
        (acc["at"] + F.length(m["gap"]) + F.coalesce(F.length(m["whole"]), F.lit(0))).cast("int").alias("at"),
        F.when(F.length(m["part"]) >= rule.least, F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(m["gap"])).cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            (acc["at"] + F.length(m["gap"]) + F.length(m["whole"])).cast("int").alias("end"))))).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), _none().alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(match, zero, step, lambda acc: acc["out"])).otherwise(_none())


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, kind string, version int, found {FINDINGS}")


def update(ledger: DataFrame, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what is unseen. Returns the new ledger and the paths (``path``, ``blob``), one row per row of ``versions``.

    Null text is the empty blob. Repeated rows, equal texts under many paths and old versions cost one scan. A raised rule
    version scans all blobs again for that rule alone. The path is never a join key of texts, so null paths do no harm.
    """
    spark = versions.sparkSession
    paths = materialize(versions.select(F.col(path).alias("path"), _blob(F.col(text)).alias("blob")))
    wanted = spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, rank int")
    seen = (ledger.join(wanted, ["kind", "version"]).groupBy("blob").agg(F.collect_set("rank").alias("done")))
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    blobs = paths.groupBy("blob").agg(F.min("path").alias("of"))
    todo = (blobs.join(seen, "blob", "left").select("blob", "of", F.array_except(every, F.coalesce("done", F.array().cast("array<int>"))).alias("todo"))
            .filter(F.size("todo") > 0))
    texts = versions.select(F.col(path).alias("_path"), F.col(text).alias("_text"), _blob(F.col(text)).alias("_blob"))
    scan = texts.join(todo, (F.col("_blob") == F.col("blob")) & F.col("_path").eqNullSafe(F.col("of")))
    found = [F.when(F.array_contains("todo", i), find(F.col("_text"), r, i)).alias(f"f{i}") for i, r in enumerate(rules)]
    new = materialize(scan.select("blob", "todo", *found)).dropDuplicates(["blob"])
    pairs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(f"f{i}").alias("found")) for i, r in enumerate(rules)])
    new = new.select("blob", F.explode(pairs).alias("p")).filter("p.found is not null").select("blob", "p.kind", "p.version", "p.found")
    return ledger.unionByName(new), paths.select("path", "blob")


def findings(ledger: DataFrame, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per path: ``path``, ``blob``, ``found`` (all spans of the current rule versions, by start, then rule order)."""
    wanted = [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules]
    current = wanted[0]
    for w in wanted[1:]:
        current = current | w
    by_blob = (ledger.filter(current & (F.size("found") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found")))
    return paths.join(materialize(by_blob), "blob", "left").select("path", "blob", F.coalesce("found", _none()).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
