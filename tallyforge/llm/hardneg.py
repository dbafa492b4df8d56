"""Hard negatives by bit-sliced integer products.

For every anchor its positives are the best rows of its own label, and for every positive the hard negatives are the best rows of other labels whose score lies between
a share of the positive's score and that score.

Components are integers, cut into bit planes: x = -2**b * sign + sum of 2**k * bit_k. A search takes the planes of a piece of rows most significant first. After
each plane a row's score lies in an interval: what the planes so far give, and of the rest at least (2**k - 1) times the anchor's negative and at most
(2**k - 1) times its positive components. Rows whose interval cannot qualify any more are dropped before the next plane: for positives, those whose upper end is
below the k-th best lower end; for negatives, those whose interval misses every window, or, in each window that it meets, stays below the k-th best lower end
of the rows surely inside. After the last plane the intervals are the exact scores.

Anchors are dealt to blocks and rows to pieces of bounded size; (piece, block) is the key of a group, so no task holds more than one piece and one block, and only
k rows per anchor and piece leave it. For positives, pieces are made of rows of few labels, and anchors go to the pieces of their label only; a hot label takes many pieces.
Windows that rank keep k rows of a key in each task before the shuffle.

Defined results: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part. Of rows with one id the least by label, then vector,
counts, so repeated rows count once. Vectors of different lengths are never compared. Equal scores go to the smaller id. Scores must fit 64 bits; products
are exact whatever the components, by whole numbers of Python where doubles would not hold them. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.mtree import quantised
from tallyforge.llm.textcore import written


@dataclass(frozen=True)
class NegativeParams:
    """positives, negatives: how many of an anchor, and of each positive. low, high: bounds of a negative's score in percent of the positive's.
    piece: expected rows of a piece. block: expected anchors of a block."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    piece: int = 4096
    block: int = 1024


class Planes:
    """The rows of a piece as bit planes, most significant first; weights[k] is what a set bit of plane k counts."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.exact = len(rows) == 0 or float(np.abs(rows).max()) < 2**31
        top = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length() if len(rows) else 0
        self.weights = [-(1 << top), *[1 << k for k in range(top - 1, -1, -1)]]
        self.bits = [((rows >> (top if k == 0 else top - k)) & 1).astype(np.float64) for k in range(top + 1)]

    def rest(self, k: int) -> int:
        """The largest value that the planes behind plane k can add to a component."""
        return (1 << (len(self.weights) - 1 - k)) - 1

    def intervals(self, query: np.ndarray):
        """A generator of (lower, upper, last) of the rows still alive, plane by plane; it is sent the mask of those to keep."""
        # doubles hold every partial sum exactly below this
        fits = self.exact and float(np.abs(query.astype(np.float64)).sum()) * (1 << len(self.weights)) < 2**52
        q = query.astype(np.float64) if fits else query.astype(object)
        plus, minus = (np.maximum(query, 0), np.minimum(query, 0)) if fits else (np.where(query > 0, query, 0).astype(object), np.where(query < 0, query, 0).astype(object))
        plus, minus = int(plus.sum()), int(minus.sum())
        alive = np.arange(len(self.rows))
        score = np.zeros(len(self.rows), dtype=np.int64 if fits else object)
        for k, weight in enumerate(self.weights):
            if not len(alive):
                return
            plane = self.bits[k] if len(alive) == len(self.rows) else self.bits[k][alive]
            score = score + weight * ((plane @ q).astype(np.int64) if fits else plane.astype(np.int64).astype(object) @ q)
            rest = self.rest(k)
            kept = yield alive, score + rest * minus, score + rest * plus
            alive, score = alive[kept], score[kept]


def best_rows(planes: Planes, query: np.ndarray, open_: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best of the rows open_, best first, ties to the smaller id."""
    steps = planes.intervals(query)
    mask = None
    found: tuple[np.ndarray, np.ndarray] | None = None
    first = True
    while True:
        try:
            alive, low, high = steps.send(mask)
        except StopIteration:
            break
        ok = open_[alive]
        n = int(ok.sum())
        if n > k:
            floor = np.sort(low[ok])[n - k] if low.dtype == object else np.partition(low[ok], n - k)[n - k]
            ok &= (high >= floor).astype(bool)
        mask, first = ok, False
        found = (alive[ok], low[ok])
    if first or found is None:
        return []
    order = sorted(zip((-found[1]).tolist(), ids[found[0]].tolist()))[:k]
    return [(-s, i) for s, i in order]


def rows_in_windows(planes: Planes, query: np.ndarray, open_: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (least, most score) the (score, id) of its k best rows of open_, best first, ties to the smaller id."""
    steps = planes.intervals(query)
    mask = None
    found: tuple[np.ndarray, np.ndarray] | None = None
    while True:
        try:
            alive, low, high = steps.send(mask)
        except StopIteration:
            break
        ok = open_[alive]
        wanted = np.zeros(len(alive), dtype=bool)
        for least, most in windows:
            meets = ok & (high >= least).astype(bool) & (low <= most).astype(bool)
            inside = low[meets & (low >= least).astype(bool) & (high <= most).astype(bool)]
            if len(inside) > k:
                floor = np.sort(inside)[len(inside) - k] if low.dtype == object else np.partition(inside, len(inside) - k)[len(inside) - k]
                meets &= (high >= floor).astype(bool)
            wanted |= meets
        mask = wanted
        found = (alive[wanted], low[wanted])
    out = []
    for least, most in windows:
        pairs = [] if found is None else sorted((-s, i) for s, i in zip(found[1].tolist(), ids[found[0]].tolist()) if least <= s <= most)
        out.append([(-s, i) for s, i in pairs[:k]])
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, dim) if len(column) else np.zeros((0, dim), dtype=np.int64)


def _dealt(rows: DataFrame, by: Column, expected: int) -> DataFrame:
    """The rows with a bucket of `by` and a piece: buckets that hold too much are cut by id."""
    n = F.col("n_of_kind")
    own = rows.join(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n_of_kind")), "dim")
    own = own.withColumn("bucket", F.pmod(F.xxhash64(by), F.ceil(n / expected)).cast("int")).drop("n_of_kind")
    loads = own.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / expected).cast("int").alias("pieces"))
    return own.join(loads, ["dim", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("pieces")).cast("int"))


def _against(index: DataFrame, anchors: DataFrame, key: list[str], columns: list[str], search, schema: str, params: NegativeParams) -> DataFrame:
    """search over every piece with the blocks of anchors that have its key."""
    loads = anchors.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / params.block).cast("int").alias("blocks"))
    mine = anchors.join(loads, key).withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.col("blocks")).cast("int"))
    mine = mine.join(index.select(*{**dict.fromkeys(key), "bucket": None, "piece": None}).distinct(), key)
    theirs = index.join(loads, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = ["dim", "bucket", "piece", "block"]
    left = theirs.select(*full, "vec_id", "label", "v").groupBy(*full)
    return left.cogroup(mine.select(*full, *columns).groupBy(*full)).applyInArrow(search, schema)


def _positives(index: DataFrame, anchors: DataFrame, params: NegativeParams) -> DataFrame:
    """anchor_id, positive_id, positive_score of the best rows of each anchor's label."""
    k = params.positives

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = len(left.column("v")[0])
            ids, labels, planes = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), Planes(_matrix(left.column("v"), dim))
            for one, label, q in zip(right.column("anchor_id").to_pylist(), right.column("label").to_pylist(), _matrix(right.column("v"), dim)):
                for score, other in best_rows(planes, q, (labels == label) & (ids != one), ids, k):
                    out[0].append(one)
                    out[1].append(other)
                    out[2].append(score)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score"])

    found = _against(index, anchors, ["dim", "bucket"], ["anchor_id", "label", "v"], search, "anchor_id long, positive_id long, positive_score long", params)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("place", rank).where(F.col("place") <= k).drop("place")


def _negatives(index: DataFrame, anchors: DataFrame, params: NegativeParams) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank, negative_id, negative_score; anchors have pairs: array<struct<positive_id, positive_score>>."""
    k = params.negatives

    def window(score: int) -> tuple[int, int]:
        return -(-params.low * score // 100), params.high * score // 100

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            dim = len(left.column("v")[0])
            ids, labels, planes = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), Planes(_matrix(left.column("v"), dim))
            for one, label, q, pairs in zip(right.column("anchor_id").to_pylist(), right.column("label").to_pylist(), _matrix(right.column("v"), dim), right.column("pairs").to_pylist()):
                found = rows_in_windows(planes, q, labels != label, ids, [window(p["positive_score"]) for p in pairs], k)
                for p, rows in zip(pairs, found):
                    for score, other in rows:
                        for column, value in zip(out, (one, p["positive_id"], p["positive_score"], other, score)):
                            column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _against(index, anchors, ["dim"], ["anchor_id", "label", "v", "pairs"], search, schema, params)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, params: NegativeParams = NegativeParams()) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score for rows (vec_id, label, v: array<long>); is_anchor is a condition on them."""
    sound = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    sound = sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    one = sound.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("vec_id", "r.*")
    index = written(_dealt(one.withColumn("dim", F.size("v")), F.col("label"), params.piece), "vectors")
    anchors = index.where("anchor").select("vec_id", "label", "v", "dim", "bucket").toDF("anchor_id", "label", "v", "dim", "bucket")
    # a negative score has no negatives: the upper bound is below the lower one
    near = written(_positives(index, anchors, params).where(F.col("positive_score") >= 0), "positives")
    pairs = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("pairs"))
    found = _negatives(index, anchors.drop("bucket").join(pairs, "anchor_id"), params)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors(embeddings: DataFrame, factor: float = 256.0) -> DataFrame:
    """vec_id, label, v: the embeddings with their components as floor(factor * x)."""
    return embeddings.select("vec_id", "label", quantised(F.col("embedding"), factor).alias("v"))
