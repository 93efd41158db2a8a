"""Text, time and naming helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def trim_all(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def number_or(c: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(fallback))


def number_prefix_or(c: Column, fallback: float = 0.0) -> Column:
    """The number that a text is or begins with (``12abc`` is 12), else the fallback."""
    text = F.regexp_extract(c.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(c.try_cast("double"), F.nullif(text, F.lit("")).try_cast("double"), F.lit(fallback))


def truthy(c: Column) -> Column:
    return F.lower(trim_all(c)).isin("true", "1", "yes")


def shape_of(text: Column) -> Column:
    """``1x3x640x640`` or ``1,3,640,640`` as an array."""
    return F.transform(F.split(F.regexp_replace(F.lower(trim_all(text)), r"[x,\s]+", " "), " "), lambda x: x.cast("int"))


def parse_epoch(c: Column, legacy_iso: bool = False) -> Column:
    """Seconds since 1970 of a number or an ISO date and time; null if neither.

    Without a zone UTC is meant. ``legacy_iso`` gives null for ``Z`` and zone-less texts, and
    takes ``+0700`` (no colon) as no offset, like programs that look for the last sign.
    """
    text = trim_all(c)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    day = F.unix_micros(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" UTC")), F.lit("yyyy-MM-dd HH:mm:ss z"))) / 1e6
    zone = F.regexp_replace(part(4), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone.isin("", "Z"), 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60))
    if legacy_iso:
        day, offset = F.when(~zone.isin("", "Z"), day), F.when(part(4).contains(":"), offset).otherwise(0)
    fraction = F.coalesce(F.concat(F.lit("0"), F.nullif(part(3), F.lit(""))).try_cast("double"), F.lit(0.0))
    return F.coalesce(number, F.when(text.rlike(pattern), day + fraction - offset))


def time_window(start: Column, end: Column, padding: float = 0.0) -> tuple[Column, Column]:
    """Padded, unbounded where unknown or not finite, swapped if the end comes first."""
    pad = max(0.0, padding)
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)
    lo = F.when(known(start), start - pad).otherwise(-INF)
    hi = F.when(known(end), end + pad).otherwise(INF)
    return F.least(lo, hi), F.greatest(lo, hi)


def frame_clock(moment: Column, pos: Column, fps: Column) -> Column:
    """Seconds of a frame by its 0-based position."""
    return moment + (pos + 1) / fps


def resolve_fps(fps: Column, frames: Column, duration: Column) -> Column:
    """The container's rate if sensible, else frames by duration, else any positive rate, else 30."""
    fine = ~F.isnan(fps) & (F.abs(fps) < INF)
    by_time = frames / F.when(duration > 0, duration)
    return F.when(fine & (fps > 0.1), fps).when(by_time > 0.1, by_time).when(fine & (fps > 0), fps).otherwise(30.0)


def output_path(video_id: Column, engine: Column, directory: str | None = None) -> Column:
    name = F.format_string("video_%04d_%s.bin", video_id, engine)
    return F.concat(F.lit(directory.rstrip("/") + "/"), name) if directory else name


def model_type_name(c: Column) -> Column:
    return F.when(c == 0, "DETECTION").when(c == 1, "POSE").otherwise(F.format_string("UNKNOWN(%d)", c))
