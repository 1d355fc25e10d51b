"""Timecode expressions (Column -> Column). Unparsable input is null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """Text to double; only plain decimal notation counts. The cast alone would also take ``1.0f``, ``NaN`` and hex,
    none of which ends in a digit or a dot without an ``x``."""
    text = F.trim(_c(c))
    last = F.right(text, F.lit(1))
    return F.when((last.between("0", "9") | (last == ".")) & ~F.lower(text).contains("x"), text.try_cast("double"))


def whole(c) -> Column:
    """Text to integer; a fraction is null."""
    return F.trim(_c(c)).try_cast("bigint")


def timecode_to_seconds(c, fps: float = 2.0) -> Column:
    """``HH:MM:SS:FF`` (frames divided by ``fps``), ``HH:MM:SS(.s)``, ``MM:SS(.s)`` or plain seconds."""
    def value(p):
        def at(i):
            return F.get(p, F.lit(i))

        n = F.size(p)
        return (F.when(n == 3, whole(at(0)) * 3600 + whole(at(1)) * 60 + number(at(2)))
                .when(n == 2, whole(at(0)) * 60 + number(at(1)))
                .when(n == 4, whole(at(0)) * 3600 + whole(at(1)) * 60 + whole(at(2)) + whole(at(3)) / F.lit(float(fps)))
                .when(n == 1, number(at(0))))

    # the text is split once and the parts are bound, instead of splitting it for every part read
    return F.get(F.transform(F.array(F.split(F.trim(_c(c)), ":")), value), F.lit(0))


def srt_to_seconds(c) -> Column:
    """``HH:MM:SS,mmm`` or ``HH:MM:SS.mmm``; text without three parts is 0.0."""
    p = F.split(F.replace(F.trim(_c(c)), F.lit(","), F.lit(".")), ":")
    three = whole(F.get(p, F.lit(0))) * 3600 + whole(F.get(p, F.lit(1))) * 60 + number(F.get(p, F.lit(2)))
    return F.when(F.size(p) == 3, three).otherwise(F.lit(0.0))


def mmss_to_seconds(c) -> Column:
    """``MM:SS(.f)`` or plain seconds; anything else is 0.0."""
    text = _c(c)
    p = F.split(text, ":")
    value = F.when(F.size(p) == 2, whole(F.get(p, F.lit(0))) * 60 + number(F.get(p, F.lit(1)))).otherwise(number(text))
    return F.coalesce(value, F.lit(0.0))


def _decimals(x: Column, d: int) -> Column:
    """Seconds as ``SS.ddd``, rounded half to even on the exact binary value.

    The formatter of the JVM rounds the shortest decimal form half up, so 37.5625 and 1.15 would differ from the
    printed values elsewhere. ``x`` is split into parts whose products with ``2 * 10**d`` are exact; the sign of the
    rest decides.
    """
    unit = 10 ** d
    n = F.floor(x * unit)
    high = F.floor(x * 1048576.0) / 1048576.0
    rest = (high * (2.0 * unit) - (n * 2 + 1)) + (x - high) * (2.0 * unit)
    value = n + F.when((rest > 0) | ((rest == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%02d.%0{d}d", F.floor(value / unit), value % unit)


def seconds_to_timecode(c, style: str = "hms") -> Column:
    """Styles: ``hms`` (truncated), ``hms1``, ``hms3``, ``ms1``, ``ms2`` (decimals of the seconds) and ``srt``
    (input in milliseconds)."""
    x = _c(c)
    if style == "srt":
        ms = x.cast("bigint")
        s = F.floor(ms / 1000)
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)),
                               F.pmod(s, F.lit(60)), F.pmod(ms, F.lit(1000)))
    x = x.cast("double")
    hours, minutes = F.floor(x / 3600), F.floor(F.pmod(x, F.lit(3600.0)) / 60)
    rest = F.pmod(x, F.lit(60.0))
    if style == "hms":
        return F.format_string("%02d:%02d:%02d", hours, minutes, F.floor(rest))
    if style == "hms1":
        return F.format_string("%02d:%02d:%s", hours, minutes, _decimals(rest, 1))
    if style == "hms3":
        return F.format_string("%02d:%02d:%s", hours, minutes, _decimals(rest, 3))
    if style == "ms1":
        return F.format_string("%02d:%s", F.floor(x / 60), _decimals(rest, 1))
    if style == "ms2":
        return F.format_string("%02d:%s", F.floor(x / 60), _decimals(rest, 2))
    raise ValueError(f"unknown style {style}")


def clip_key_times(c) -> Column:
    """``"8393_8396_shot2044_sub18"`` -> struct(start, end); null for a bad key."""
    p = F.split(_c(c), "_")
    s, e = number(F.get(p, F.lit(0))), number(F.get(p, F.lit(1)))
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("start"), e.alias("end")))


def time_range(c, fps: float = 2.0) -> Column:
    """First ``A to B`` of a text as struct(start, end) in seconds."""
    pattern = r"(?i)([\d:.]+)\s+to\s+([\d:.]+)"
    a, b = F.regexp_extract(_c(c), pattern, 1), F.regexp_extract(_c(c), pattern, 2)
    return F.when(a != "", F.struct(timecode_to_seconds(a, fps).alias("start"), timecode_to_seconds(b, fps).alias("end")))


def shot_ranges(c, fps: float = 2.0) -> Column:
    """All ``[shot N: A to B]`` ranges as array of struct(start_time, end_time, start, end)."""
    pattern = r"(?i)\[?shot[\s_]*\d*:\s*([0-9:.]+)\s+to\s+([0-9:.]+)\]?"
    a = F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(1))
    b = F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(2))
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("start_time"), y.alias("end_time"),
                                                  timecode_to_seconds(x, fps).alias("start"),
                                                  timecode_to_seconds(y, fps).alias("end")))
