"""Expressions on frames, boxes and pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import _c

# Symmetric similarity of place and time labels.
PLACE_SIMILARITY = {
    ("interior", "hybrid"): 0.6,
    ("exterior", "hybrid"): 0.6,
    ("exterior", "space/abstract"): 0.1,
    ("interior", "exterior"): 0.05,
}
TIME_SIMILARITY = {
    ("day", "dawn/dusk"): 0.6,
    ("night", "dawn/dusk"): 0.6,
    ("day", "night"): 0.1,
    ("day", "unclear"): 0.5,
    ("night", "unclear"): 0.5,
}
# Picture sizing.
PICTURE_FACTOR, MIN_PIXELS, MAX_PIXELS, MAX_RATIO = 28, 4 * 28 * 28, 16384 * 28 * 28, 200
FRAME_FACTOR, MIN_FRAMES, MAX_FRAMES = 2, 4, 768


def soft_match(a, b, table: dict[tuple[str, str], float]) -> Column:
    """Null or empty 0.5; equal ignoring case 1; else the symmetric table, default 0."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    entries = [F.lit(v) for (p, q), s in table.items() for v in ("|".join(sorted((p, q))), s)]
    key = F.array_join(F.array_sort(F.array(x, y)), "|")
    looked = F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(0.0))
    blank = x.isNull() | y.isNull() | (x == "") | (y == "")
    return F.when(blank, 0.5).when(x == y, 1.0).otherwise(looked)


def detection_size(width, height, short_side: int = 360) -> tuple[Column, Column]:
    """Size of the picture detection ran on: short side fixed, long side truncated."""
    w, h = _c(width), _c(height)
    dw = F.when(w < h, F.lit(short_side)).otherwise((w * (F.lit(float(short_side)) / h)).cast("int"))
    dh = F.when(w < h, (h * (F.lit(float(short_side)) / w)).cast("int")).otherwise(F.lit(short_side))
    return dw, dh


def scale_box(box, width, height, short_side: int = 360) -> Column:
    """Box in detection pixels -> box in video pixels, truncated."""
    dw, dh = detection_size(width, height, short_side)
    sx, sy = _c(width) / dw, _c(height) / dh
    b = _c(box)
    return F.when(b.isNotNull(), F.struct((b["x"] * sx).cast("int").alias("x"), (b["y"] * sy).cast("int").alias("y"),
                                          (b["width"] * sx).cast("int").alias("width"),
                                          (b["height"] * sy).cast("int").alias("height")))


def frame_budget(total, fps, sample_fps: float = 2.0, min_frames: int = MIN_FRAMES, max_frames: int | None = None) -> Column:
    """Frames to sample: clamped to [min, max] and the total, floored to the frame factor; null if below it."""
    n = _c(total)
    low = F.ceil(F.lit(min_frames) / FRAME_FACTOR) * FRAME_FACTOR
    cap = F.lit(max_frames) if max_frames is not None else F.least(F.lit(MAX_FRAMES), n)
    high = F.floor(cap / FRAME_FACTOR) * FRAME_FACTOR
    want = n / _c(fps) * sample_fps
    got = F.least(F.least(F.greatest(want, low.cast("double")), high.cast("double")), n.cast("double"))
    even = (F.floor(got / FRAME_FACTOR) * FRAME_FACTOR).cast("bigint")
    return F.when((even >= FRAME_FACTOR) & (even <= n), even)


def frame_span(total, fps, start=None, end=None) -> Column:
    """struct(start_frame, end_frame, frames) of a time range; null when empty or the input is not positive.

    ``start``/``end`` may be null: from the first frame, to the last one.
    """
    n, f = _c(total), _c(fps)
    s = _c(start) if start is not None else F.lit(None).cast("double")
    e = _c(end) if end is not None else F.lit(None).cast("double")
    limit = n / f

    def clamp(x):
        return F.greatest(F.lit(0.0), F.least(x, limit))

    first = F.when(s.isNotNull(), F.ceil(clamp(s) * f)).otherwise(F.lit(0)).cast("bigint")
    last = F.when(e.isNotNull(), F.least(F.floor(clamp(e) * f), n - 1)).otherwise(n - 1).cast("bigint")
    open_ended = s.isNull() & e.isNull()
    ok = (f > 0) & (n > 0) & (open_ended | (first < last))
    return F.when(ok, F.struct(first.alias("start_frame"), last.alias("end_frame"), (last - first + 1).alias("frames")))


def fit_resolution(height, width, factor: int = PICTURE_FACTOR, min_pixels: int = MIN_PIXELS,
                   max_pixels: int = MAX_PIXELS) -> Column:
    """struct(height, width) divisible by ``factor`` with the pixel count in bounds and the ratio kept; null if
    the sides differ by more than the largest allowed ratio."""
    h, w = _c(height).cast("double"), _c(width).cast("double")

    def near(x):
        return F.greatest(F.lit(float(factor)), F.bround(x / factor) * factor)

    h0, w0 = near(h), near(w)
    shrink, grow = F.sqrt(h * w / max_pixels), F.sqrt(F.lit(float(min_pixels)) / (h * w))

    def pick(x, x0):
        return (F.when(h0 * w0 > max_pixels, F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor))
                .when(h0 * w0 < min_pixels, F.ceil(x * grow / factor) * factor)
                .otherwise(x0).cast("bigint"))

    fits = F.greatest(h, w) / F.least(h, w) <= MAX_RATIO
    return F.when(fits, F.struct(pick(h, h0).alias("height"), pick(w, w0).alias("width")))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def with_norm(v) -> Column:
    """Vector and its length, so that comparing it many times costs one product each."""
    x = _c(v)
    return F.struct(x.alias("v"), F.sqrt(_total(F.transform(x, lambda p: p.cast("double") * p.cast("double")))).alias("n"))


def cosine_normed(a: Column, b: Column) -> Column:
    """Cosine of two :func:`with_norm` structs; 0 where a length is 0."""
    dot = _total(F.zip_with(a["v"], b["v"], lambda p, q: p.cast("double") * q.cast("double")))
    return F.coalesce(F.try_divide(dot, a["n"] * b["n"]), F.lit(0.0))


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays; 0 where a length is 0."""
    return cosine_normed(with_norm(a), with_norm(b))
