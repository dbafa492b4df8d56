"""Exact top-k inner-product search with M-trees.

The vectors are the leaves of one M-tree whose upper levels are laid over the cluster. Vectors are dealt to regions by their nearest routing vector, and
within a region to rings by their distance to it, so that a shard (region, ring) has a covering radius and a stored distance to its parent; of a shard
that still holds too much, vectors are dealt to pieces by their ids. Each piece of bounded size is bulk-loaded as a tree: pages of entries, where an inner entry
holds a routing vector, its child page, the covering radius of everything below it and its distance to the routing
vector above, and a leaf entry holds a vector and that distance. Inner products become distances by one more component, which
lifts all vectors to the same norm m: |q - x|^2 = |q|^2 + m^2 - 2 q.x, so the largest products are the nearest vectors.

A query searches its best shard first. With the k-th score from there it goes only to shards that can hold one as good, by the triangle inequality over
the distance to the region's routing vector and the ring's bounds; there pages are opened only if they can beat that score.
A search opens pages best bound first and ends when no page can hold a better vector than the k-th. Before a distance is computed, the
stored distance to the parent bounds it by the triangle inequality, and entries that cannot matter are passed over.
Bounds carry a margin for rounding; scores are computed on the integer vectors, so results are exact.

Queries of a piece are dealt to blocks of bounded size, and (piece, block) is the key of a group: no task holds more than one piece and one block at a
time, and only k rows per query and piece leave it. What every task knows of all shards is at most `regions` routing vectors and `regions * rings` bounds.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither as queries nor as candidates; vectors of different
length are never compared; equal scores go to the smaller id; identical rows count once, and rows with a query's own id are
no candidates of it. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.textcore import lean, written


@dataclass(frozen=True)
class TreeParams:
    """shard_rows: expected vectors of a piece. regions, rings: most routing vectors, and most rings of each. page: most entries of a page. fanout: children of
    an inner page. block: expected queries of a block."""

    shard_rows: int = 4096
    regions: int = 256
    rings: int = 16
    page: int = 256
    fanout: int = 16
    block: int = 1024


def quantised(vector: Column, factor: float = 1024.0) -> Column:
    """floor(factor * x) of every component as long; null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def lifted(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with the component that gives all the same norm, and the square of that norm."""
    squares = np.einsum("ij,ij->i", x, x)
    top = float(squares.max())
    return np.column_stack([x, np.sqrt(np.maximum(top - squares, 0.0))]), top


def bulk_load(points: np.ndarray, params: TreeParams) -> list[dict]:
    """The pages of a tree over the rows of points; page 0 is the root. An entry has at: row or child page."""
    pages: list[dict] = []
    rng = np.random.default_rng(len(points))

    def distances(rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[rows] - pivot) ** 2).sum(axis=1))

    def load(rows: np.ndarray, pivot: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= params.page:
            gap = distances(rows, pivot) if pivot is not None else np.zeros(len(rows))
            pages[number] = {"leaf": True, "at": rows, "gap": gap, "radius": np.zeros(len(rows)), "pivot": points[rows]}
            return number
        chosen = rng.choice(rows, min(params.fanout, math.ceil(len(rows) / params.page)), replace=False)
        apart = np.stack([distances(rows, points[c]) for c in chosen], axis=1)
        nearest = apart.argmin(axis=1)
        groups = [(c, rows[nearest == k], apart[nearest == k, k]) for k, c in enumerate(chosen) if (nearest == k).any()]
        if len(groups) == 1:  # equal vectors: any even split has the same radius
            c, own, _ = groups[0]
            groups = [(c, part, distances(part, points[c])) for part in np.array_split(own, params.fanout)]
        routing = points[[c for c, _, _ in groups]]
        gap = np.sqrt(((routing - pivot) ** 2).sum(axis=1)) if pivot is not None else np.zeros(len(groups))
        radius = np.array([d.max() for _, _, d in groups])
        children = np.array([load(own, points[c]) for c, own, _ in groups])
        pages[number] = {"leaf": False, "at": children, "gap": gap, "radius": radius, "pivot": routing}
        return number

    load(np.arange(len(points)), None)
    return pages


def search(pages: list[dict], top: float, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, floor: float = -math.inf) -> list[tuple[int, int]]:
    """The k best (score, id) of one query in one tree, best first, ties to the smaller id; scores below floor need not be among them."""
    q = np.append(query.astype(np.float64), 0.0)
    norm = float(q @ q)
    slack = 1e-9 * (norm + top) + 1e-6

    def best_score(distance: np.ndarray | float) -> np.ndarray | float:
        return (norm + top - np.square(distance)) / 2 + slack

    found: list[tuple[int, int]] = []  # a heap with the worst first; ids negated, so that of equal scores the larger id goes first
    line = [(-math.inf, 0, math.nan)]
    while line:
        bound, number, to_parent = heapq.heappop(line)
        worst = max(floor, found[0][0]) if len(found) == k else floor
        if -bound < worst:
            break
        page = pages[number]
        at, pivot, radius = page["at"], page["pivot"], page["radius"]
        if worst > -math.inf and not math.isnan(to_parent):
            near = np.maximum(np.abs(to_parent - page["gap"]) - radius, 0.0)
            open_ = best_score(near) >= worst
            at, pivot, radius = at[open_], pivot[open_], radius[open_]
        if not len(at):
            continue
        if page["leaf"]:
            scores = vectors[at] @ query
            good = scores >= worst
            for score, one in zip(scores[good].tolist(), ids[at][good].tolist()):
                if one == own:
                    continue
                entry = (int(score), -one)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        else:
            apart = np.sqrt(((pivot - q) ** 2).sum(axis=1))
            bounds = best_score(np.maximum(apart - radius, 0.0))
            for child, b, d in zip(at.tolist(), bounds.tolist(), apart.tolist()):
                if b >= worst:
                    heapq.heappush(line, (-b, child, d))
    return [(s, -i) for s, i in sorted(found, reverse=True)]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, dim) if len(column) else np.zeros((0, dim), dtype=np.int64)


def _exact(x: np.ndarray, dim: int) -> np.ndarray:
    """As doubles where every product of two such vectors is exact in them: then the products run on vector units."""
    return x.astype(np.float64) if len(x) and float(np.abs(x).max()) ** 2 * dim < 2**52 else x


@dataclass(frozen=True)
class Upper:
    """The upper levels of one dimension's tree: routing vectors, the square of the norm all vectors are lifted to, ring bounds, and shards (region, ring)."""

    pivots: np.ndarray
    top: float
    cuts: np.ndarray
    shard: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pieces: np.ndarray


def _apart(x: np.ndarray, pivots: np.ndarray, top: float, lift: bool) -> np.ndarray:
    """Distances of vectors, lifted unless they are queries, to the lifted routing vectors."""
    tall = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", pivots, pivots), 0.0))
    squares = np.einsum("ij,ij->i", x, x)
    own = np.sqrt(np.maximum(top - squares, 0.0)) if lift else np.zeros(len(x))
    gap = squares[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None] - 2 * x @ pivots.T + (own[:, None] - tall[None]) ** 2
    return np.sqrt(np.maximum(gap, 0.0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def _placed(dim: int, pivots: np.ndarray, top: float):
    """Adds region and distance to rows (vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_vectors(batch.column(1), dim), pivots, top, True)
            region = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region.astype(np.int32)), pa.array(apart[np.arange(len(region)), region])], names=["vec_id", "v", "region", "distance"]
            )

    return run


def upper_levels(placed: DataFrame, pivots: np.ndarray, top: float, params: TreeParams) -> tuple[Upper, DataFrame]:
    """The bounds of all shards over placed rows, and the rows with shard and piece."""
    regions = placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", [k / params.rings for k in range(1, params.rings)], 1000).alias("cuts")
    ).collect()  # params.regions rows at most
    cuts = np.full((len(pivots), params.rings - 1), np.inf)
    for r in regions:
        rings = min(params.rings, math.ceil(r["n"] / params.shard_rows))
        picked = [r["cuts"][round(k * params.rings / rings) - 1] for k in range(1, rings)]
        cuts[r["region"], : len(picked)] = picked
    table = F.array(*[F.array(*[F.lit(float(c)) for c in row if c < np.inf]).cast("array<double>") for row in cuts])
    ring = F.size(F.filter(F.element_at(table, F.col("region") + 1), lambda c: c < F.col("distance")))
    rows = placed.withColumn("shard", (F.col("region") * params.rings + ring).cast("int"))
    found = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("shard").collect()
    pieces = {r["shard"]: max(1, math.ceil(r["n"] / params.shard_rows)) for r in found}
    upper = Upper(pivots, top, cuts, np.array([r["shard"] for r in found]), np.array([r["low"] for r in found]), np.array([r["high"] for r in found]), np.array([pieces[r["shard"]] for r in found]))
    many = {k: n for k, n in pieces.items() if n > 1}
    parts = F.lit(1)
    for k, n in many.items() if len(many) <= 64 else ():
        parts = F.when(F.col("shard") == k, n).otherwise(parts)
    if len(many) > 64:
        parts = F.coalesce(F.create_map(*[F.lit(x) for pair in many.items() for x in pair])[F.col("shard")], F.lit(1))
    return upper, rows.withColumn("piece", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).select("shard", "piece", "vec_id", "v")


def _visits(dim: int, upper: Upper, params: TreeParams, first: bool):
    """(query_id, q, floor, shard, piece) of rows (query_id, q, floor): the best shard, or with floors all others that can hold as good a score."""
    region = upper.shard // params.rings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _vectors(batch.column(1), dim)
            apart = _apart(q, upper.pivots, upper.top, False)[:, region]
            near = np.maximum(np.maximum(apart - upper.high, upper.low - apart), 0.0)
            norm = np.einsum("ij,ij->i", q, q)[:, None]
            # ring bounds were computed in doubles: the margin is that of the searches, and some
            best = (norm + upper.top - near**2) / 2 + 1e-8 * (norm + upper.top) + 1e-5
            home = (near + 1e-9 * apart).argmin(axis=1)
            if first:
                row, at = np.arange(len(home)), home
            else:
                open_ = best >= batch.column(2).to_numpy()[:, None]
                open_[np.arange(len(home)), home] = False
                row, at = np.nonzero(open_)
            n = upper.pieces[at]
            full = np.repeat(np.arange(len(row)), n)
            piece = np.arange(len(full)) - np.repeat(np.cumsum(n) - n, n)
            taken = pa.array(row[full])
            for a in range(0, len(full), 4096):
                part = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(taken[part]) for c in batch.columns[:3]], pa.array(upper.shard[at][full][part].astype(np.int32)), pa.array(piece[part].astype(np.int32))],
                    names=["query_id", "q", "floor", "shard", "piece"],
                )

    return run


def _searched(index: DataFrame, visits: DataFrame, dim: int, k: int, params: TreeParams) -> DataFrame:
    """query_id, vec_id, score of the k best of every visit."""
    visits = written(visits, "visits")
    loads = visits.groupBy("shard", "piece").agg(F.ceil(F.count(F.lit(1)) / params.block).cast("int").alias("blocks"))
    mine = visits.join(loads, ["shard", "piece"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    theirs = index.join(loads, ["shard", "piece"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["shard", "piece", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, raw = left.column("vec_id").to_numpy(), _matrix(left.column("v"), dim)
            _, first = np.unique(np.column_stack([ids, raw]), axis=0, return_index=True)
            ids, raw = ids[first], raw[first]
            points, top = lifted(raw.astype(np.float64))
            pages = bulk_load(points, params)
            sums, typed = _exact(raw, dim), _exact(_matrix(right.column("q"), dim), dim)
            if sums.dtype != typed.dtype:
                sums, typed = raw, _matrix(right.column("q"), dim)
            for query, own, floor in zip(typed, right.column("query_id").to_pylist(), right.column("floor").to_pylist()):
                for score, one in search(pages, top, sums, ids, query, own, k, floor):
                    out[0].append(own)
                    out[1].append(one)
                    out[2].append(score)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    groups = theirs.select(*key, "vec_id", "v").groupBy(*key).cogroup(mine.select(*key, "query_id", "q", "floor").groupBy(*key))
    return groups.applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, params: TreeParams = TreeParams()) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's k largest inner products.

    Both frames have an id `vec_id` and integer components `v`; rows whose v is null take no part. Rows of one query id count as one query: the
    k best scores that any of its vectors reaches.
    """
    vectors = vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "v")
    queries = queries.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), F.col("v").alias("q")).distinct()
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    kinds = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).collect()
    found = None
    for kind in kinds:  # one for each length of vector
        dim, top = kind["dim"], kind["top"]
        own = vectors.where(F.size("v") == dim)
        wanted = min(params.regions, math.ceil(kind["n"] / params.shard_rows))
        chosen = own.orderBy(F.xxhash64("vec_id", F.lit(7)), "v").limit(wanted).collect()
        pivots = np.array([r["v"] for r in chosen], dtype=np.float64).reshape(-1, dim)
        placed = written(own.mapInArrow(lean(_placed(dim, pivots, top)), "vec_id long, v array<long>, region int, distance double"), "placed")
        upper, index = upper_levels(placed, pivots, top, params)
        schema = "query_id long, q array<long>, floor double, shard int, piece int"
        asked = queries.where(F.size("q") == dim)
        home = asked.withColumn("floor", F.lit(-float("inf"))).mapInArrow(lean(_visits(dim, upper, params, True)), schema)
        near = written(_searched(index, home, dim, k, params).distinct(), "home")
        bounds = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
        floor = F.when(F.col("n") >= k, F.element_at("scores", k).cast("double"))
        repeated = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))
        bounds = bounds.select("query_id", floor.alias("floor")).join(repeated.where(F.col("rows") == 1), "query_id")
        again = asked.join(bounds.select("query_id", "floor"), "query_id", "left").select("query_id", "q", F.coalesce("floor", F.lit(-float("inf"))).alias("floor"))
        rest = _searched(index, again.mapInArrow(lean(_visits(dim, upper, params, False)), schema), dim, k, params)
        here = near.unionByName(rest)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
