"""Operators on sampled signals: samples ``(timeline, i, x)``, spectrum bins ``(timeline, freq, power)``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import as_list

# Pitch class names, key profiles, and the order of fifths.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
FIFTHS = [0, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10, 5]
SPIRAL_RADIUS, SPIRAL_HEIGHT = 1.0, 0.35
TRIAD_WEIGHTS = (1.0, 0.8, 0.6)
EPS = 1e-12


def _unit(v):
    n = math.sqrt(sum(x * x for x in v)) + EPS
    return [x / n for x in v]


def _profiles():
    """24 unit templates in the order C major, C minor, C# major, ..."""
    out = []
    for root, name in enumerate(PITCH_CLASSES):
        for mode, profile in (("Major", MAJOR_PROFILE), ("Minor", MINOR_PROFILE)):
            unit = _unit(profile)
            out.append((f"{name} {mode}", [unit[(pc - root) % 12] for pc in range(12)]))
    return out


def _helix():
    place = {pc: k for k, pc in enumerate(FIFTHS)}
    turn = [2.0 * math.pi * place[pc] / 12.0 for pc in range(12)]
    return [(SPIRAL_RADIUS * math.cos(a), SPIRAL_RADIUS * math.sin(a), SPIRAL_HEIGHT * place[pc]) for pc, a in enumerate(turn)]


def _triads():
    pos, out = _helix(), []
    for root, name in enumerate(PITCH_CLASSES):
        for mode, third in (("Major", 4), ("Minor", 3)):
            notes = (pos[root], pos[(root + third) % 12], pos[(root + 7) % 12])
            out.append((f"{name} {mode}", _unit([sum(w * n[d] for w, n in zip(TRIAD_WEIGHTS, notes)) for d in range(3)])))
    return out


def key_from_chroma(df: DataFrame, method: str = "ks", *, chroma="chroma") -> DataFrame:
    """``key`` and ``score``: the best of 24 templates by cosine (``ks``) or of 24 triads on a helix (``spiral``).

    Each row is decided on its own, so nothing is shuffled. A chroma without energy
    gets key "" and score 0. Scores equal to 9 decimals are a tie, which the first template wins: rotations of a
    symmetric chroma are equal but for rounding, and summation order must not decide the key.
    """
    if method not in ("ks", "spiral"):
        raise ValueError(f"unknown method {method}")
    spiral = method == "spiral"
    templates = _triads() if spiral else _profiles()
    names = np.array([name for name, _ in templates] + [""])
    matrix = np.array([t for _, t in templates]).T
    helix = np.array(_helix())

    # 24 products of 12 terms per row: a matrix product over an Arrow batch, where unrolled expressions are too large
    # to compile and nested array functions are interpreted term by term
    @F.pandas_udf("key string, score double")
    def best(column: pd.Series) -> pd.DataFrame:
        known = column.notna().to_numpy()
        v = np.zeros((len(column), 12))
        if known.any():
            v[known] = np.stack([np.asarray(x, dtype=float)[:12] for x in column[known]])
        total = v.sum(axis=1)
        q = v @ helix if spiral else v
        length = np.linalg.norm(q, axis=1, keepdims=True)
        scores = (q / np.maximum(length, EPS)) @ matrix
        pick = np.where(total > 0, np.round(scores, 9).argmax(axis=1), len(templates))
        score = np.where(total > 0, np.take_along_axis(scores, np.minimum(pick, len(templates) - 1)[:, None], 1)[:, 0], 0.0)
        return pd.DataFrame({"key": names[pick], "score": score})

    out = df.withColumn("_best", best(F.col(chroma).cast("array<double>")))
    return out.withColumn("key", F.col("_best.key")).withColumn("score", F.col("_best.score")).drop("_best")


def chroma_fold(bins: DataFrame, *, by="timeline_id", freq="freq", power="power") -> DataFrame:
    """Spectrum bins to 12 pitch classes: at least 50 Hz, nearest semitone, mean over time per bin, normalised."""
    keys = as_list(by)
    mean = bins.filter(F.col(freq) >= 50.0).groupBy(*keys, freq).agg(F.avg(power).alias("_p"))
    semitone = F.rint(F.lit(69.0) + F.lit(12.0) * F.log2(F.greatest(F.col(freq), F.lit(1e-6)) / 440.0)).cast("int")
    pc = F.pmod(semitone, F.lit(12))
    sums = [F.sum(F.when(F.col("_pc") == i, F.col("_p")).otherwise(0.0)) for i in range(12)]
    folded = mean.withColumn("_pc", pc).groupBy(*keys).agg(F.array(*sums).alias("_c"))
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x)
    return folded.select(*keys, F.when(total > 0, F.transform("_c", lambda x: x / total)).otherwise(F.col("_c")).alias("chroma"))


def rms_db_frames(samples: DataFrame, length: int, hop: int, sr: float, threshold_db: float = -40.0,
                  ref: str = "max", *, by="timeline_id", i="i", x="x") -> DataFrame:
    """Frame RMS in dB and whether it reaches the threshold: relative to the loudest frame (``max``) or absolute.

    Samples are first summed in blocks that divide both the frame and the hop, so overlapping frames repeat
    block sums, not samples. A timeline shorter than one frame gives one frame, loud above -120 dB.
    """
    keys = as_list(by)
    g = math.gcd(length, hop)
    block = samples.groupBy(*keys, F.floor(F.col(i) / g).alias("_b")).agg(F.sum(F.col(x) * F.col(x)).alias("_e"), F.count(F.lit(1)).alias("_n"))
    size = block.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    b = block.join(size, keys)
    first = F.greatest(F.lit(0), F.ceil((F.col("_b") * g + g - length) / hop))
    last = F.least(F.floor(F.col("_b") * g / hop), F.floor((F.col("_total") - length) / hop))
    long = (b.filter(F.col("_total") >= length).withColumn("_f0", first.cast("bigint")).withColumn("_f1", last.cast("bigint"))
            .filter("_f0 <= _f1").withColumn("frame_idx", F.explode(F.sequence("_f0", "_f1")))
            .groupBy(*keys, "frame_idx").agg(F.sqrt(F.sum("_e") / length).alias("rms"))
            .withColumn("frame_sec", F.lit(length / sr)).withColumn("db", F.lit(20.0) * F.log10(F.greatest("rms", F.lit(EPS)))))
    short = (b.filter(F.col("_total") < length).groupBy(*keys)
             .agg(F.sqrt(F.sum("_e") / F.sum("_n")).alias("rms"), F.sum("_n").alias("_t"))
             .select(*keys, F.lit(0).cast("bigint").alias("frame_idx"), "rms", (F.col("_t") / sr).alias("frame_sec"),
                     (F.lit(20.0) * F.log10(F.col("rms") + EPS)).alias("db"), (F.lit(20.0) * F.log10(F.col("rms") + EPS) > -120.0).alias("sound")))
    if ref == "absolute":
        long = long.withColumn("sound", F.col("db") >= threshold_db)
    else:
        top = long.groupBy(*keys).agg(F.max("db").alias("_top"))
        long = long.join(top, keys).withColumn("sound", F.col("db") >= F.col("_top") + threshold_db).drop("_top")
    return long.unionByName(short).withColumn("t", F.col("frame_idx") * hop / F.lit(float(sr)))


def rms_bars(samples: DataFrame, n: int = 400, *, by="timeline_id", i="i", x="x") -> DataFrame:
    """``n`` equal buckets per timeline with their RMS, scaled to the largest; buckets past the end are 0."""
    keys = as_list(by)
    size = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    per = F.greatest(F.lit(1), F.floor(F.col("_total") / n))
    sums = (samples.join(size, keys).withColumn("bar", F.floor(F.col(i) / per)).filter(F.col("bar") < n)
            .groupBy(*keys, "bar").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms")))
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bar"))
    full = grid.join(sums, [*keys, "bar"], "left").withColumn("rms", F.coalesce("rms", F.lit(0.0)))
    top = sums.groupBy(*keys).agg(F.max("rms").alias("_top"))
    return (full.join(top, keys, "left")
            .withColumn("rms", F.when(F.col("_top") > 0, F.col("rms") / F.col("_top")).otherwise(F.col("rms"))).drop("_top"))
