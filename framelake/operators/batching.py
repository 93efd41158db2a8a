"""Fixed-size batches in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that are numbered in one task, about; sampled rows for each such task.
PER_TASK, SAMPLED = 1_000_000, 20


def numbered(df: DataFrame, keys: list[str], order: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``_i``, the place of each row among those of its keys (from 0), and ``_n``, how many these are.

    A key with very many rows is cut into ranges of the order, at splits of a small sample; rows are
    numbered inside their range, and the ranges before it are added. The splits decide only which task numbers a row.
    """
    place = F.struct(*order)
    total = df.count()
    pieces = min(1000, -(-total // per_task))
    if pieces <= 1:
        w = W.partitionBy(*keys)
        return df.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    share = F.pmod(F.xxhash64(*keys, *order), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, SAMPLED * pieces / total))
    listed = F.sort_array(F.collect_list(place))  # about SAMPLED rows for each piece
    splits = df.where(share).groupBy(*keys).agg(F.filter(listed, lambda x, i: i % SAMPLED == SAMPLED - 1).alias("_splits"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    rows = df.alias("r").join(F.broadcast(splits.alias("s")), same("r", "s"), "left").select("r.*", F.size(F.filter(F.coalesce("_splits", F.array().cast(splits.schema["_splits"].dataType)), lambda s: s < place)).alias("_piece"))
    own = W.partitionBy(*keys, "_piece").orderBy(*order)
    rows = rows.withColumn("_own", F.row_number().over(own) - 1)
    whole = W.partitionBy(*keys)
    counts = rows.groupBy(*keys, "_piece").agg(F.count("*").alias("_c"))  # as many rows as pieces
    counts = counts.withColumn("_before", F.sum("_c").over(whole.orderBy("_piece")) - F.col("_c")).withColumn("_n", F.sum("_c").over(whole)).select(*keys, "_piece", "_before", "_n")
    both = rows.alias("r").join(counts.alias("c"), [*same("r", "c"), F.col("r._piece") == F.col("c._piece")])
    return both.select(*(f"r.`{c}`" for c in df.columns), (F.col("_own") + F.col("_before")).cast("long").alias("_i"), F.col("_n"))


def batches(df: DataFrame, n: int, keys: list[str], order: list[str], tail: str = "pad", per_task: int = PER_TASK) -> DataFrame:
    """``batch`` and ``slot`` (both from 0) for each row.

    ``pad`` keeps an incomplete last batch, ``drop`` leaves it out, ``repeat`` fills it with
    copies of the last row (``is_copy``).
    """
    rows = numbered(df, keys, order, per_task)
    rows = rows.withColumn("batch", F.floor(F.col("_i") / n).cast("long")).withColumn("slot", (F.col("_i") % n).cast("long"))
    if tail == "drop":
        return rows.where((F.col("batch") + 1) * n <= F.col("_n")).drop("_i", "_n")
    rows = rows.withColumn("is_copy", F.lit(False))
    if tail == "pad":
        return rows.drop("_i", "_n", "is_copy")
    if tail != "repeat":
        raise ValueError(f"tail: {tail}")
    last = F.col("_i") == F.col("_n") - 1
    slots = F.when(last, F.sequence(F.col("slot"), F.lit(n - 1).cast("long"))).otherwise(F.array("slot"))
    return rows.withColumn("_s", F.explode(slots)).withColumn("is_copy", F.col("_s") > F.col("slot")).withColumn("slot", F.col("_s")).drop("_i", "_n", "_s")
