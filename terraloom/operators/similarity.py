"""Similarity of vectors inside batches, and the contrastive loss over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1 / 0.07  # initial logit scale
MOST = 4.6052  # of its logarithm


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """v by its length, plus a little against zero vectors."""
    size = F.sqrt(dot(v, v)) + 1e-8
    return F.element_at(F.transform(F.array(F.struct(v.alias("v"), size.alias("n"))), lambda p: F.transform(p["v"], lambda x: x / p["n"])), 1)


def finite(v: Column) -> Column:
    """v with zeros for NaN and infinite components."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def contrastive_loss(rows: DataFrame, batch: int = 32, scale: float = SCALE) -> DataFrame:
    """(label, batch, loss, n): the symmetric loss of each batch of rows (label, vec_id, embedding) with one label.

    The other view of a vector is the vector turned by one place. Pairs stay inside a batch of bounded size; each
    direction is a log-softmax with the largest logit taken out.
    """
    number = F.floor((F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) / batch)
    v = F.transform("embedding", lambda x: x.cast("double"))
    views = rows.withColumn("batch", number).withColumn("g", unit(v)).withColumn("c", unit(F.concat(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), F.slice("g", 1, 1))))
    left = views.select("label", "batch", F.col("vec_id").alias("i"), "g")
    right = views.select("label", "batch", F.col("vec_id").alias("j"), "c")
    logits = left.join(right, ["label", "batch"]).select("label", "batch", "i", "j", (F.lit(min(scale, 2.718281828459045**MOST)) * dot(F.col("g"), F.col("c"))).alias("z"))

    def side(name: str) -> DataFrame:
        top = F.max("z").over(Window.partitionBy("label", "batch", name))
        per = logits.withColumn("top", top).groupBy("label", "batch", name).agg((F.max("top") + F.log(F.sum(F.exp(F.col("z") - F.col("top")))) - F.max(F.when(F.col("i") == F.col("j"), F.col("z")))).alias("loss"))
        return per.groupBy("label", "batch").agg(F.avg("loss").alias(f"loss_{name}"), F.count("*").alias("n"))

    both = side("i").join(side("j").drop("n"), ["label", "batch"])
    return both.select("label", "batch", ((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"), "n")
