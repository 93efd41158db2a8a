"""Greedy overlap matching of two detection sets, and precision and recall from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import field_box, iou


def _both(left: DataFrame, right: DataFrame, keys: list[str], order: str, rest: list[str] | None = None) -> DataFrame:
    """The boxes of both sides for each key, as arrays ``l`` and ``r`` in order: one exchange for the two."""
    rest = rest or []
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), F.struct(F.col(order).alias("id"), "cx", "cy", "w", "h", *rest).alias("_b"))
    listed = lambda n: F.sort_array(F.collect_list(F.when(F.col("_side") == n, F.col("_b"))))
    return side(left, 0).unionByName(side(right, 1)).groupBy(*keys).agg(listed(0).alias("l"), listed(1).alias("r"))


def _matches(threshold: float) -> Column:
    """The fold over ``l``, in the JVM: each left box in order takes the unused right box that it overlaps most."""
    start = F.array().cast("array<struct<left_id:bigint,right_id:bigint,iou:double>>")

    def step(acc, x):
        free = F.filter("r", lambda y: ~F.exists(acc, lambda m: m["right_id"] == y["id"]))
        scored = F.transform(free, lambda y: F.struct(iou(field_box(x), field_box(y)).alias("iou"), (-y["id"]).alias("no")))
        good = F.filter(scored, lambda s: (s["iou"] >= threshold) & (s["iou"] > 0))
        best = F.array_max(good)
        pair = F.struct(x["id"].cast("long").alias("left_id"), (-best["no"]).cast("long").alias("right_id"), best["iou"].cast("double").alias("iou"))
        return F.when(F.size(good) == 0, acc).otherwise(F.concat(acc, F.array(pair)))

    return F.aggregate("l", start, step)


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], threshold: float = 0.5, order: str = "anchor") -> DataFrame:
    """Rows (keys, left_id, right_id, iou): each left box in order takes the unused right box it overlaps most.

    The first of equal overlaps wins; pairs need an overlap above 0 and of at least the threshold.
    """
    return _both(left, right, keys, order).select(*keys, F.explode(_matches(threshold)).alias("m")).select(*keys, "m.*")


def unmatched_boxes(left: DataFrame, right: DataFrame, keys: list[str], side: str, threshold: float = 0.5, order: str = "anchor", rest: list[str] | None = None) -> DataFrame:
    """Boxes (keys, order, box, and columns ``rest`` that both sides have) of one side ("left" or "right") that no match has, from the fold that matches: one exchange."""
    m = _both(left, right, keys, order, rest).withColumn("_m", _matches(threshold))
    ids = F.transform("_m", lambda x: x[f"{side}_id"])
    left_over = F.filter(side[0], lambda b: ~F.array_contains(ids, b["id"].cast("long")))
    return m.select(*keys, F.explode(left_over).alias("b")).select(*keys, F.col("b.id").alias(order), *(f"b.{c}" for c in ("cx", "cy", "w", "h", *(rest or []))))


def unmatched(df: DataFrame, matches: DataFrame, keys: list[str], side: str, order: str = "anchor") -> DataFrame:
    """Rows of one side ("left" or "right") that no match has."""
    taken = matches.select(*keys, F.col(f"{side}_id").alias(order))
    return df.join(taken, [*keys, order], "left_anti")


def match_metrics(left: DataFrame, right: DataFrame, keys: list[str], threshold: float = 0.5, order: str = "anchor") -> DataFrame:
    """One row: frames and boxes of the left side, right boxes in left frames, matches, precision, recall."""
    each = _both(left, right, keys, order).where(F.size("l") > 0)
    sizes = each.select(F.size("l").alias("n_left"), F.size("r").alias("n_right"), F.size(_matches(threshold)).alias("n_match"))
    total = sizes.agg(F.count("*").alias("frames"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_left", "n_right", "n_match")))
    share = lambda c: F.when(F.col(c) > 0, F.col("n_match") / F.when(F.col(c) > 0, F.col(c))).otherwise(0.0)
    return total.withColumn("precision", share("n_right")).withColumn("recall", share("n_left"))
