"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking.

Equal vectors are one row with their least ids (more than a result can name), so a vector that fills a third of
the table is one entry. Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is
assigned and coded. No neighbour is missed, whatever the rows: lists and codes are left out only by bounds. A vector at
distance a of its centroid c and e of its code lies no nearer to q than ||q - c| - a| and than the code's distance less e,
and the k-th distance to some vectors, first those of the sample, is no less than that to all. A query probes every list
that may hold a vector so near. Vectors with clear clusters need few lists; such without any (the synthetic table is
mostly so) need nearly all.

Lists are dealt to groups of like size, and a query goes once to each group that holds lists it probes. Large groups,
and groups with many queries, are dealt to blocks. A block scans the codes of a list with all its queries in one product
of matrices: the distance of query q to the code r of list c is |q - c|^2 + (|r|^2 + 2cr) - 2qr, whose middle part is
stored beside the code; all are less the sample's mean. Each block measures a short list of the least approximate distances exactly on the
original vectors, and then all whose bound is no more than the k-th of those.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Rows without an id take none either; rows that repeat an id are candidates with that id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import spread_join, staged, table, tidied

SAMPLE = 20_000  # vectors that are learnt from, at least; 32 for each list beyond that
LISTS = 4096  # at most
PARTS = 16
CODES = 256
NEAR = 8192  # vectors of the sample at most whose distances bound a query's
SHORT = 64  # of a query in a block, measured exactly before bounds are known
SLACK = 1e-12  # for rounding: bounds give way by this share of the terms they come from
BLOCK = 50_000  # vectors of a group in one task
QUERIES = 20_000  # queries in one task
GROUPS = 16  # at least, where there are as many lists


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    fine = vectors.select("vec_id", F.col("embedding").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    most = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("v") == (most.n if most else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = ((c**2).sum(1) - 2 * x[at : at + 4096] @ c.T).argmin(1)
    return out


class Quantiser:
    """Coarse centroids, and codebooks for equal parts of the residuals."""

    def __init__(self, x: np.ndarray, lists: int) -> None:
        self.mean = x.mean(0)
        self.some = x[: min(NEAR, max(256, (1 << 19) // x.shape[1]))].copy()
        x = x - self.mean
        self.coarse = kmeans(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.bounds = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [kmeans(rest[:, b], CODES, 8) for b in self.bounds]

    def limits(self, q: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has k vectors: that of the k-th of some of the sample."""
        if len(self.some) < k:
            return np.full(len(q), np.inf)
        own = self.some - self.mean
        near = np.argpartition((own**2).sum(1) - 2 * (q - self.mean) @ own.T, k - 1, axis=1)[:, :k]
        return np.array([np.sqrt(((self.some[at] - one) ** 2).sum(1)).max() for at, one in zip(near, q, strict=True)])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, |r|^2 + 2cr of each vector's coded residual r and centroid c, and the distances to c and to c + r."""
        x = x - self.mean
        at = nearest(x, self.coarse)
        c = self.coarse[at]
        codes = np.stack([nearest((x - c)[:, b], book) for b, book in zip(self.bounds, self.books, strict=True)], 1).astype(np.uint8)
        r = self.decoded(codes)
        return at, codes, (r * (r + 2 * c)).sum(1), np.sqrt(((x - c) ** 2).sum(1)), np.sqrt(((x - c - r) ** 2).sum(1))

    def probes(self, q: np.ndarray, limits: np.ndarray, radii: np.ndarray, most: int | None = None) -> list[np.ndarray]:
        """Lists that may hold a vector within each query's limit, the nearest first; radii: of lists, negative where one is empty."""
        out = []
        for one, limit in zip(q - self.mean, limits, strict=True):
            d = np.sqrt(((self.coarse - one) ** 2).sum(1))
            away = d - radii - SLACK * (d + radii) > limit
            at = np.argsort(d, kind="stable")
            out.append(at[(radii[at] >= 0) & ~away[at]][:most])
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray, inner: np.ndarray, away: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (less the mean) to each code of list `at`: the squared distance, and what its vector's is no less than."""
        c = ((q - self.coarse[at]) ** 2).sum(1)[:, None]
        out = q @ (-2 * self.decoded(codes)).T
        out += inner
        out += c
        terms = (q**2).sum(1)[:, None] + (self.coarse[at] ** 2).sum() + 2 * (away**2 + error**2)
        c = np.sqrt(c)
        least = np.maximum(np.sqrt(np.maximum(out - SLACK * terms, 0)) - error, np.abs(c - away))
        return out, least - SLACK * (c + away + error)


def searched(quantiser: Quantiser, lists: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], v: np.ndarray, reps: np.ndarray, q: np.ndarray, probed: list[np.ndarray], limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, rep, distance) of the k nearest within the limit in one block: vectors in order of lists, queries with the lists they probe here."""
    first = np.searchsorted(lists, np.arange(len(quantiser.coarse) + 1))
    asks = np.zeros((len(q), len(quantiser.coarse)), bool)
    for i, own in enumerate(probed):
        asks[i, own] = True
    near: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in q]
    centred = q - quantiser.mean
    for at in np.flatnonzero((np.diff(first) > 0) & asks.any(0)).tolist():
        a, b = int(first[at]), int(first[at + 1])
        some = np.flatnonzero(asks[:, at])
        d, least = quantiser.distances(centred[some], at, *(x[a:b] for x in coded))
        within = ~(least > limits[some, None])
        for i, own, low, fine in zip(some.tolist(), d, least, within, strict=True):
            found = np.flatnonzero(fine)
            if len(found):
                near[i].append((own[found], low[found], found + a))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    exact = lambda i, rows: np.sqrt(((v[rows] - q[i]) ** 2).sum(1))
    for i, found in enumerate(near):
        if not found:
            continue
        d, low, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.argpartition(d, max(SHORT, k) - 1)[: max(SHORT, k)] if len(d) > max(SHORT, k) else np.arange(len(d))
        own = exact(i, rows[best])
        if len(d) > len(best):
            rest = ~(low > np.partition(own, k - 1)[k - 1])
            rest[best] = False
            rest = np.flatnonzero(rest)
            own = np.concatenate([own, *(exact(i, rows[rest[x : x + 4096]]) for x in range(0, len(rest), 4096))])
            best = np.concatenate([best, rest])
        rows = rows[best]
        best = np.lexsort((reps[rows], own))[:k]
        out.append((np.full(len(best), i), reps[rows][best], own[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _groups(sizes: dict[int, int], n: int) -> dict[int, int]:
    """A group for each list, the largest lists first, each to the group with the least vectors."""
    import heapq

    loads = [(0, g) for g in range(max(1, min(len(sizes), max(GROUPS, -(-n // BLOCK)))))]
    out = {}
    for at, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, g = heapq.heappop(loads)
        out[at] = g
        heapq.heappush(loads, (load + size, g))
    return out


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, *, probed: int | None = None, sample: int = SAMPLE, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query_id of queries (an id of vectors) its k nearest, itself left out.

    probed: lists at most that a query probes, the nearest, if not all that may hold a neighbour; lists: how many there are.
    """
    spark = vectors.sparkSession
    fine = usable(vectors)
    # the k + 1 least ids of each distinct vector are all that results can name
    ranked = fine.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = staged(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    n = distinct.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    lists = min(n, lists or max(1, min(LISTS, int(n**0.5))))
    share = min(1.0, max(sample, 32 * lists) / n)
    some = distinct if share == 1.0 else distinct.where(F.xxhash64("v") < min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))
    drawn = some.select("v", F.xxhash64("v", F.lit(7)).alias("h")).orderBy("h").toArrow()  # about the sample's size, in an order that is the same every time
    x = _matrix(drawn.column("v").combine_chunks())
    model = Quantiser(x, min(lists, len(x)))
    lists = len(model.coarse)
    quantiser = spark.sparkContext.broadcast(model)  # at most LISTS centroids, CODES codes a part and NEAR vectors
    kind = distinct.schema["v"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, codes, *more = quantiser.value.code(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, more), b.column(0), b.column(1)], ["list", "code", "inner", "away", "error", "v", "rep"])

    index = staged(distinct.select("v", "rep").mapInArrow(tidied(coded), f"list int, code binary, inner double, away double, error double, v {kind}, rep long"))
    found = index.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # LISTS rows at most
    sizes = {r.list: r.n for r in found}
    radius = {r.list: r.radius for r in found}
    group = _groups(sizes, n)
    wanted = fine.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    named = spread_join(wanted, distinct.select("v", F.col("rep").alias("q")), ["v"], wanted.groupBy("v").agg(F.count("*").alias("n")))
    asked = staged(named.select("vec_id", "q", "v"))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of = np.array([group.get(i, -1) for i in range(lists)])
        radii = np.array([radius.get(i, -1.0) for i in range(lists)])
        for b in batches:
            if not b.num_rows:
                continue
            rows, groups, own, limit = [], [], [], []
            q = _matrix(b.column(1))
            limits = quantiser.value.limits(q, k + 1)
            for i, at in enumerate(quantiser.value.probes(q, limits, radii, probed)):
                for g in np.unique(group_of[at]).tolist():
                    rows.append(i)
                    groups.append(g)
                    own.append(at[group_of[at] == g])
                    limit.append(limits[i])
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(groups, pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(limit, pa.float64())], ["q", "qv", "g", "probed", "within"])

    ask = staged(asked.groupBy("q").agg(F.first("v").alias("v")).mapInArrow(tidied(asking), f"q long, qv {kind}, g int, probed array<int>, within double"))
    asks = {r.g: r["count"] for r in ask.groupBy("g").count().collect()}  # one row for each group of lists
    load: dict[int, int] = {}
    for at, g in group.items():
        load[g] = load.get(g, 0) + sizes[at]
    blocks = spark.createDataFrame([(at, g, -(-load[g] // BLOCK), -(-asks.get(g, 0) // QUERIES)) for at, g in group.items()], "list int, g int, n_i int, n_q int")
    per_group = blocks.select("g", "n_i", "n_q").distinct()
    left = index.join(F.broadcast(blocks), "list").where("n_q > 0")
    left = left.select("g", F.pmod(F.xxhash64("rep"), "n_i").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("j"), "list", "code", "inner", "away", "error", "v", "rep")
    right = ask.join(F.broadcast(per_group), "g").select("g", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)).alias("i"), F.pmod(F.xxhash64("q"), "n_q").cast("int").alias("j"), "q", "qv", "probed", "within")

    def meet(key, rows: pd.DataFrame, ask_: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(ask_):
            rows = rows.sort_values(["list", "rep"])
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            coded_ = (codes, *(rows[c].to_numpy() for c in ("inner", "away", "error")))
            v, reps = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["rep"].to_numpy()
            for at in range(0, len(ask_), 64):
                part = ask_.iloc[at : at + 64]
                q = np.stack(part["qv"].to_numpy()).astype(np.float64)
                who, near, d = searched(quantiser.value, rows["list"].to_numpy(), coded_, v, reps, q, list(part["probed"]), part["within"].to_numpy(), k + 1)
                out.append(pd.DataFrame({"q": part["q"].to_numpy()[who], "rep": near, "d": d}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "d": []}).astype({"q": "int64", "rep": "int64", "d": "float64"})

    met = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(meet, "q long, rep long, d double")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "rep"))).where(F.col("r") <= k + 1).select("q", F.col("rep").alias("near"), "d")
    found = best.join(distinct.select(F.col("rep").alias("near"), "ids"), "near").select("q", F.explode("ids").alias("vec_id"), "d")
    # at most k + 2 rows of each distinct query vector, dealt to all who ask for it
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r") <= k + 1)
    first = first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    who = asked.select(F.col("vec_id").alias("query_id"), "q").distinct()
    per_query = spread_join(who, first, ["q"], who.groupBy("q").agg(F.count("*").alias("n")))
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return per_query.select("query_id", F.posexplode(mine).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", F.col("x.d").alias("score"))


def op1_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))
