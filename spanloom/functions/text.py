"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def natural_key(c) -> Column:
    """Sort key that puts ``clip_2`` before ``clip_10``: lower case, digit runs padded to 20."""
    low = F.lower(_c(c))
    runs = F.regexp_extract_all(low, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def json_lenient(c, schema: str) -> Column:
    """Parse JSON from model output: code fences stripped; else the outermost ``{...}``; else null."""
    text = F.trim(_c(c), F.lit(" \t\r\n"))
    fenced = text.startswith("```")
    body = F.when(fenced, F.regexp_replace(F.regexp_replace(text, r"^```(json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    opts = {"columnNameOfCorruptRecord": "_bad"}
    typed = schema + ", _bad string"
    first = F.from_json(body, typed, opts)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    second = F.from_json(F.when(inner != "", inner), typed, opts)

    def good(x):
        return F.when(x.isNotNull() & x["_bad"].isNull(), x)

    return F.coalesce(good(first), good(second)).dropFields("_bad")


def first_number(c) -> Column:
    """First number in a text, else 0.0."""
    return F.coalesce(F.regexp_extract(_c(c), r"(\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0))


def est_tokens(c) -> Column:
    return F.floor(F.length(_c(c)) / 3).cast("bigint")


def squash_truncate(c, n: int) -> Column:
    """Collapse white space; beyond ``n`` characters cut back to the last space and add an ellipsis."""
    flat = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    cut = F.substring(flat, 1, n)
    return F.when(F.length(flat) > n, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…"))).otherwise(flat)


def asset_slug(c) -> Column:
    """File-safe name: word characters, blanks and hyphens, at most 50, plus 8 hex digits of the md5."""
    raw = _c(c)
    digest = F.substring(F.md5(raw), 1, 8)
    safe = F.regexp_replace(F.trim(F.substring(F.regexp_replace(raw, r"(?U)[^\w\s-]", ""), 1, 50), F.lit(" \t\r\n")), " ", "_")
    return F.concat(F.when(safe != "", safe).otherwise(F.lit("instruction")), F.lit("_"), digest)


def caption_text(event, purpose, mood, legacy=None) -> tuple[Column, Column]:
    """(event summary used, text to embed). ``legacy`` is the older caption: a string or an array of strings."""
    ev = F.nullif(F.coalesce(_c(event), F.lit("")), F.lit(""))
    if legacy is not None:
        ev = F.coalesce(ev, _c(legacy))
    ev = F.nullif(ev, F.lit(""))

    def part(label, c):
        return F.when(F.length(c) > 0, F.concat(F.lit(label), c))

    text = F.when(ev.isNotNull(), F.concat_ws(" ", F.concat(F.lit("Event: "), ev), part("Purpose: ", _c(purpose)),
                                               part("Mood: ", _c(mood))))
    return ev, text


def scene_digest(scene_id, start, end, location, time, key_event, narrative) -> Column:
    """Four text lines describing a scene."""
    def x(c, default=""):
        return F.coalesce(_c(c).cast("string"), F.lit(default))
    return F.concat(F.lit("[Scene "), x(scene_id, "Unknown"), F.lit("] ("), x(start, "N/A"), F.lit(" - "), x(end, "N/A"),
                    F.lit(")\nLocation: "), x(location), F.lit(", Time: "), x(time), F.lit("\nKey Event: "),
                    x(key_event), F.lit("\nNarrative: "), x(narrative), F.lit("\n"))


def shot_line(shot_id, scale, tags, names, action, interaction, function) -> Column:
    """One text line per shot: scale, first three tags, names or ``Empty``, action, function."""
    def x(c, default=""):
        return F.coalesce(_c(c), F.lit(default))
    who = F.when(F.size(_c(names)) > 0, F.array_join(_c(names), ", ")).otherwise(F.lit("Empty"))
    return F.concat(F.lit("["), x(shot_id, "unknown"), F.lit("] ("), x(scale), F.lit(") Loc: "),
                    F.coalesce(F.array_join(F.slice(_c(tags), 1, 3), ", "), F.lit("")), F.lit(". Chars: "), who,
                    F.lit(". Action: "), x(action, "None"), F.lit(" ("), x(interaction), F.lit("). Func: "),
                    x(function, "Unknown"), F.lit("."))
