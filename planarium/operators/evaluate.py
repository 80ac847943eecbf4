"""Measures of predictions against truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import norm
from ..functions.numbers import ratio


def corner_scores(pred: DataFrame, truth: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, precision_, recall_, f) from corners (keys, id, x, y).

    A true corner counts once, if it is some prediction's nearest (the first of equals) and within the tolerance. Only
    corners that near are ever met: both lie in cells of the tolerance's width, and a prediction asks the nine around.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    t = truth.select(*keys, F.col("id").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("_i"), cell("y").alias("_j"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = pred.withColumn("_o", F.explode(around)).withColumn("_i", cell("x") + F.col("_o.i")).withColumn("_j", cell("y") + F.col("_o.j"))
    pairs = asked.join(t, [*keys, "_i", "_j"]).withColumn("d", norm(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).where(F.col("d") <= tolerance)
    nearest = pairs.groupBy(*keys, "id").agg(F.min(F.struct("d", "t")).alias("m"))
    hits = nearest.groupBy(*keys).agg(F.countDistinct("m.t").alias("hits"))
    sizes = pred.groupBy(*keys).agg(F.count("*").alias("preds")).join(truth.groupBy(*keys).agg(F.count("*").alias("truths")), keys, "full")
    k, p, g = F.coalesce("hits", F.lit(0)), F.coalesce("preds", F.lit(0)), F.coalesce("truths", F.lit(0))
    return sizes.join(hits, keys, "left").select(*keys, ratio(k, p).alias("precision_"), ratio(k, g).alias("recall_"), ratio(2 * k, p + g).alias("f"))


def evenly_spaced(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Of each key's rows in order those at n evenly spaced places, ends included, rounded half to even."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * (F.col("_n") - 1).cast("double") / (n - 1)).cast("int"))
    return df.withColumn("_i", place).withColumn("_n", size).where(F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def depth_errors(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mae, rmse, delta1) of pred against truth where truth is above 0, in one aggregation."""
    gap = F.col("pred") - F.col("truth")
    near = F.greatest(F.col("pred") / F.col("truth"), F.col("truth") / F.col("pred")) < 1.25
    return pairs.where("truth > 0").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.when(near, 1.0).otherwise(0.0)).alias("delta1")
    )


def loss_terms(least: float = 1e-6) -> list[Column]:
    """Aggregates of pred, truth, and of the probability p of the outcome y."""
    d = F.abs(F.col("pred") - F.col("truth"))
    p = F.least(F.greatest(F.col("p"), F.lit(least)), F.lit(1 - least))
    huber = F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    bce = -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))
    focal = -(F.col("y") * (1 - p) ** 2 * F.ln(p) + (1 - F.col("y")) * p**2 * F.ln(1 - p))
    return [F.avg(d).alias("l1"), F.avg(d * d).alias("l2"), F.avg(huber).alias("huber"), F.avg(bce).alias("bce"), F.avg(focal).alias("focal")]


def berhu(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, berhu): the mean error up to a fifth of the largest, beyond it (m^2 + c^2) / 2c of the mean m."""
    d = F.abs(F.col("pred") - F.col("truth"))
    s = df.groupBy(*keys).agg(F.avg(d).alias("m"), (F.max(d) * 0.2).alias("c"))
    return s.select(*keys, F.when(F.col("m") <= F.col("c"), F.col("m")).otherwise((F.col("m") ** 2 + F.col("c") ** 2) / (2 * F.col("c"))).alias("berhu"))


def box_overlap(x: Column, y: Column, w: Column, h: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """The area that two axis-aligned boxes share."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(x + w, x2 + w2) - F.greatest(x, x2)) * F.greatest(zero, F.least(y + h, y2 + h2) - F.greatest(y, y2))


def to_truth_centre(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """pred (keys, x, y, ...) moved so that its centre is that of truth; nothing is scaled."""
    a = pred.groupBy(*keys).agg(F.avg("x").alias("_px"), F.avg("y").alias("_py"))
    b = truth.groupBy(*keys).agg(F.avg("x").alias("_tx"), F.avg("y").alias("_ty"))
    moved = pred.join(a, keys).join(b, keys)
    return moved.withColumn("x", F.expr("x - _px + _tx")).withColumn("y", F.expr("y - _py + _ty")).drop("_px", "_py", "_tx", "_ty")


def total_loss(losses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total): the sum of the losses (keys, name, value) whose names begin with `total`; 0 without any."""
    return losses.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("name").startswith("total"), F.col("value"))), F.lit(0.0)).alias("total"))


def mean_positive_overlap(scores: DataFrame, iou: str = "iou") -> DataFrame:
    """(n, mean_iou) over the rooms whose overlap is above 0."""
    return scores.agg(F.count_if(F.col(iou) > 0).alias("n"), F.avg(F.when(F.col(iou) > 0, F.col(iou))).alias("mean_iou"))
