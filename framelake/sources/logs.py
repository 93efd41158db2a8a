"""Log lines ``[time] [LEVEL] [component] message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.schemas import LOG_LEVELS


def parse_log(lines: DataFrame, least: str | None = None) -> DataFrame:
    """Rows (ts, level, component, message); ``least`` drops lower levels, lines of another form have nulls."""
    part = lambda i: F.nullif(F.regexp_extract("value", r"^\[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] (.*)$", i), F.lit(""))
    rows = lines.select(part(1).alias("ts"), F.trim(part(2)).alias("level"), part(3).alias("component"), part(4).alias("message"))
    if least is None:
        return rows
    return rows.where(_rank(F.col("level")) >= LOG_LEVELS[least])


def _rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, i in LOG_LEVELS.items():
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def log_lines(rows: DataFrame, least: str = "INFO") -> DataFrame:
    """Lines (value) of rows (ts, level, component, message) of a level and above; ``STATS`` rows are always logged."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    kept = rows.where((_rank(F.col("level")) >= LOG_LEVELS[least]) | (F.col("level") == "STATS"))
    return kept.select(F.concat(F.lit("["), stamp, F.lit("] ["), F.rpad("level", 5, " "), F.lit("] ["), "component", F.lit("] "), F.regexp_replace("message", r"[\r\n]+", " ")).alias("value"))


def write_log(rows: DataFrame, path: str, least: str = "INFO") -> None:
    """Appends lines to the log files below ``path``, in order of their times where they are ranges of these."""
    ordered = rows.repartitionByRange("ts").sortWithinPartitions("ts")
    log_lines(ordered, least).write.mode("append").text(path)
