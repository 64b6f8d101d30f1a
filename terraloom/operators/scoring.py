"""Scores of locations: feature counters, the proxy richness made of them, buckets, and diverse selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.ranges import counts_in_boxes
from terraloom.operators.spatial import mercator

# fixed values: the tags that are counted, on features of one geometry type each
COUNTED = {"point": ("amenity", "shop", "leisure", "tourism", "historic", "natural"), "line": ("highway", "waterway", "railway"), "polygon": ("building", "landuse")}
TAGS = tuple(t for own in COUNTED.values() for t in own)
COUNTERS = tuple(c for kind, own in COUNTED.items() for c in (f"n_{kind}s", *(f"n_{t}" for t in own)))
# fixed values: the nine groups of counters whose presence is scored
GROUPS = (("amenity",), ("shop",), ("highway", "railway"), ("leisure",), ("natural",), ("waterway",), ("tourism", "historic"), ("building",), ("landuse",))
# fixed values: bucket bounds on richness, and the share of each bucket
BUCKETS = (("very_low", 0.20, 0.02), ("low", 0.40, 0.12), ("medium", 0.65, 0.77), ("high", 1.01, 0.09))


def location_counts(features: DataFrame, locations: DataFrame, half: float) -> DataFrame:
    """Per location COUNTERS over the features within `half` Mercator metres in x and y, 0 where none."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    kinds = {}
    for kind, own in COUNTED.items():
        kinds |= {f"n_{kind}s": F.col("geom_type") == kind} | {f"n_{t}": (F.col("geom_type") == kind) & F.col(t).isNotNull() for t in own}
    points = features.withColumn("px", fx).withColumn("py", fy)
    found = counts_in_boxes(points, locations.select("loc_id", x.alias("cx"), y.alias("cy")), (half,), kinds)
    return locations.join(found, "loc_id", "left").select("loc_id", "lat", "lon", *[F.coalesce(f"{n}_0", F.lit(0)).alias(n) for n in COUNTERS])


def feature_density(features: DataFrame, locations: DataFrame, half: float) -> DataFrame:
    """(loc_id, density): features a square kilometre of the box of half size `half` Mercator metres."""
    fx, fy = mercator(F.col("lat"), F.col("lon"))
    x, y = mercator(F.col("lat"), F.col("lon"))
    found = counts_in_boxes(features.withColumn("px", fx).withColumn("py", fy), locations.select("loc_id", x.alias("cx"), y.alias("cy")), (half,), {"n": F.lit(True)})
    side = 2.0 * half / 1000.0
    return locations.select("loc_id").join(found, "loc_id", "left").select("loc_id", (F.coalesce("n_0", F.lit(0)) / (side * side)).alias("density"))


def proxy_richness() -> Column:
    """Weights .30 / .25 / .20 / .15 / .10 of tag variety, categories, count, geometry balance, density."""
    c = F.col
    total = c("n_points") + c("n_lines") + c("n_polygons")
    cats = sum((F.greatest(*[c(f"n_{t}") for t in own], F.lit(0)).cast("long") > 0).cast("int") for own in GROUPS)
    share = [c(k) / total for k in ("n_points", "n_lines", "n_polygons")]
    entropy = -sum((F.when(p > 0, p * F.log(p)).otherwise(0.0) for p in share), F.lit(0.0)) / 1.0986122886681098
    score = 0.30 * cats / 9.0 + 0.25 * cats / 10.0 + 0.20 * F.least(total / 50.0, F.lit(1.0)) + 0.15 * entropy + 0.10 * F.least(total / 20.0, F.lit(1.0))
    return F.when(total == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def bucket(score: Column) -> Column:
    out = F
    for name, high, _ in BUCKETS:
        out = out.when(score < high, name)
    return out.otherwise("high")


def quotas(total: int) -> dict[str, int]:
    """Largest-remainder shares of total; ties by bucket order."""
    exact = [(n, total * f) for n, _, f in BUCKETS]
    out = {n: int(x) for n, x in exact}
    for n, x in sorted(exact, key=lambda p: -(p[1] - int(p[1])))[: total - sum(out.values())]:
        out[n] += 1
    return out


def stratified(scored: DataFrame, total: int, per_cell: int, seed: int) -> DataFrame:
    """At most per_cell locations of each (bucket, cell), in hash order; then each bucket's quota, again in hash order."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("loc_id").cast("string")))
    capped = scored.withColumn("key", key).withColumn("r", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("key"))).where(F.col("r") <= per_cell)
    shares, quota = quotas(total), F.lit(0)
    for n, q in shares.items():
        quota = F.when(F.col("bucket") == n, q).otherwise(quota)
    ranked = capped.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("key")))
    # the constant bound lets each task drop rows before a bucket meets in one
    return ranked.where((F.col("k") <= max(shares.values())) & (F.col("k") <= quota)).drop("r", "k", "key")


def shifted_quotas(pools: DataFrame, total: int, once: Column | None = None) -> DataFrame:
    """pools (bucket, n, ...; a row for each bucket at most, or once tells of one of each) with quota, the rows that a bucket gives.

    A bucket with fewer rows than its share gives all. What is lacking is shared out among the others in proportion to
    what they have left, rounded half to even, so the sum may miss the total by a few; nobody gives more than it has.
    """
    share = F.coalesce(*[F.when(F.col("bucket") == n, q) for n, q in quotas(total).items()], F.lit(0))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.greatest(F.col("n") - share, F.lit(0))
    each = lambda x: F.sum(x if once is None else F.when(once, x)).over(every)
    lack, spare = total - each(F.least("n", share)), each(left)
    more = F.when((lack > 0) & (spare > 0), F.least(left, F.bround(lack * left / spare))).otherwise(0)
    return pools.withColumn("quota", (F.least("n", share) + more).cast("long"))


def diverse(scored: DataFrame, total: int, per_cell: int, seed: int, balance: float) -> DataFrame:
    """About `total` rows of scored (loc_id, bucket, cell, size, richness), with quotas by bucket.

    At most per_cell rows of a (bucket, cell) stand for choice, in hash order; those of a bucket meet in a task. They are drawn without
    replacement, by weights of balance * (size between the bucket's least and greatest) + (1 - balance) * richness:
    those of the greatest ln(u) / weight, u from a hash of the row, which is repeatable and needs no state.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("loc_id").cast("string")))
    capped = scored.withColumn("key", key).withColumn("r", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("key"))).where(F.col("r") <= per_cell)
    own = Window.partitionBy("bucket")  # windows, as a second use of capped would make scored again
    held = capped.withColumns({"n": F.count("*").over(own), "low": F.min("size").over(own), "high": F.max("size").over(own)})
    part = F.when(F.col("high") > F.col("low"), (F.col("size") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    weight = balance * part + (1.0 - balance) * F.col("richness") + 1e-8
    u = F.conv(F.substring("key", 25, 8), 16, 10).cast("double") / 4294967296.0 + 1e-10
    ranked = held.withColumn("draw", F.log(u) / weight).withColumn("k", F.row_number().over(own.orderBy(F.desc("draw"), "loc_id")))
    # no quota is beyond total and what rounding adds, so few rows meet for the quotas
    first = shifted_quotas(ranked.where(F.col("k") <= total + len(BUCKETS)), total, F.col("k") == 1)
    return first.where(F.col("k") <= F.col("quota")).select("loc_id", "bucket", "cell", "size", "richness")


def hash_ranked(df: DataFrame, name: str, seed: int, digits: int = 3) -> DataFrame:
    """df with place, from 1, in the order of md5("seed:name"), and total, the number of rows.

    Rows are ranked inside 16 ** digits ranges of the hash, which are about equal; only the ranges' sizes are summed
    in one task and broadcast. Rows with one value of name stand beside each other; null has no place, and comes before the others.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))
    rows = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, digits))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = rows.groupBy("_range").count()
    sizes = sizes.select(F.col("_range").alias("_of"), (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_base"), F.sum("count").over(every).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    ranked = rows.withColumn("_inside", inside).join(F.broadcast(sizes), F.col("_range").eqNullSafe(F.col("_of")))
    return ranked.withColumn("place", F.when(F.col("_range").isNotNull(), F.col("_base") + F.col("_inside"))).drop("_key", "_range", "_inside", "_of", "_base")
