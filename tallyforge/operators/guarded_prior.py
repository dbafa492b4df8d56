"""As-of join under a pairwise guard: each purchase's newest earlier purchase that its price may chain to.

The guard compares two rows (families, preservation, forms, weights, the ratio of their prices), so the candidates of a row are no key. Rows are ordered inside their
ingredient by a window and searched newest first by numpy, batch after batch, where they lie: an ingredient of at most `chunk` rows moves once, by its id.

The purchases of a longer ingredient are cut into chunks of whole days of about `chunk` rows, and searched inside a chunk. A row that finds none there asks a zone map
of the chunks before: per chunk and octave of price, which contracts it holds. The newest chunk that may hold a partner is searched next, and so on. A hot ingredient is
therefore many tasks; a row moves only to chunks that the map names; rounds end when no row is open. Each round is written to the shared folder.

Rows without a positive price, and implausible liquids, neither chain nor are chained to. A single day of one ingredient is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.sources.views import saved

# Largest ratio of weights, of prices, and of prices where the contracts differ.
WEIGHT_RATIO = 10.0
PRICE_RATIO = 14.0
FORMAT_RATIO = 2.0
MISMATCH_RATIO = 25.0

_TEXTS = ("family", "preservation", "form", "contract")
_SNAPSHOT = (*_TEXTS, "grams", "price")


@dataclass(frozen=True)
class PriorParams:
    """chunk: rows of an ingredient that are searched together; a longer one is cut there, to the next whole day. bundle: rows of several long ingredients that share a task."""

    chunk: int = 4096
    bundle: int = 65_536


def reason(before: Column, after: Column) -> Column:
    """Why `after` may not chain to `before`, both structs of a snapshot with `blocked`; null if it may. Two codes can never come first, as a sharper rule stands before them."""
    apart = F.greatest(before["price"], after["price"]) / F.least(before["price"], after["price"])
    heavier = F.greatest(before["grams"], after["grams"]) / F.least(before["grams"], after["grams"])
    known = (before["preservation"] != "unknown") & (after["preservation"] != "unknown")
    counted = (before["family"].isin("countable", "weight")) & (after["family"].isin("countable", "weight"))
    differ = before["contract"] != after["contract"]
    return (
        F.when(after["blocked"], "implausible_volume").when(before.isNull(), F.lit(None).cast("string"))
        .when(before["family"] != after["family"], "unit_family_mismatch").when((before["family"] != after["family"]) & counted, "countable_weight_mismatch")
        .when(known & (before["preservation"] != after["preservation"]), "preservation_mismatch").when(before["form"] != after["form"], "form_mismatch")
        .when(heavier > WEIGHT_RATIO, "pack_weight_magnitude").when(apart > PRICE_RATIO, "extreme_price_ratio")
        .when(differ & (apart > MISMATCH_RATIO), "extreme_price_ratio_with_contract_change").when(differ & (apart > FORMAT_RATIO), "format_change")
    )


class _Rows:
    """Snapshots of a table as arrays; texts become codes that agree between tables of one call."""

    def __init__(self, table: pa.Table, codes: dict[str, dict[str, int]]) -> None:
        for name in _TEXTS:
            known = codes.setdefault(name, {"unknown": 0})
            said = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
            places = np.array([known.setdefault(x, len(known)) for x in said.dictionary.to_pylist()], dtype=np.int32)
            setattr(self, name, places[said.indices.to_numpy()])
        self.grams = table.column("grams").to_numpy().astype(float)
        self.price = table.column("price").to_numpy().astype(float)

    def fits(self, at: np.ndarray, other: _Rows, there: np.ndarray) -> np.ndarray:
        """Whether rows `at` of this table may chain to rows `there` of the other one."""
        ok = (self.family[at] == other.family[there]) & (self.form[at] == other.form[there])
        mine, theirs = self.preservation[at], other.preservation[there]
        ok &= (mine == 0) | (theirs == 0) | (mine == theirs)
        a, b = self.grams[at], other.grams[there]
        with np.errstate(invalid="ignore"):
            ok &= ~(np.maximum(a, b) / np.minimum(a, b) > WEIGHT_RATIO)
        p, q = self.price[at], other.price[there]
        return ok & (np.maximum(p, q) / np.minimum(p, q) <= np.where(self.contract[at] == other.contract[there], PRICE_RATIO, FORMAT_RATIO))


def _searched(table: pa.Table, first: np.ndarray, kept: Sequence[str], carried: Sequence[str]) -> pa.Table:
    """kept, and price and carried of the prior, of every row; first: where the earlier rows of a row's ingredient begin."""
    rows = _Rows(table, {})
    n = table.num_rows
    prior, open_, step = np.full(n, -1), np.arange(n), 0
    while len(open_):
        step += 1
        open_ = open_[open_ - step >= first[open_]]
        found = rows.fits(open_, rows, open_ - step)
        prior[open_[found]] = open_[found] - step
        open_ = open_[~found]
    taken = pa.array(np.where(prior < 0, 0, prior), mask=prior < 0)
    out = [table.column(c) for c in kept] + [table.column(c).take(taken) for c in ("price", *carried)]
    return pa.Table.from_arrays(out, names=[*kept, "prior_price", *[f"prior_{c}" for c in carried]])


def _inside(order: Sequence[str], kept: Sequence[str]):
    """prior of every row of a group, searched among the earlier rows of its ingredient in the group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("ingredient_id", *order)])
        ids = table.column("ingredient_id").to_numpy()
        n = len(ids)
        first = np.maximum.accumulate(np.where(np.append(True, ids[1:] != ids[:-1]), np.arange(n), 0)) if n else np.zeros(0, dtype=int)
        return _searched(table, first, kept, ("row",))

    return run


def _in_line(kept: Sequence[str], carried: Sequence[str]):
    """prior of every row of batches in which an ingredient's rows follow each other, numbered from 0; the last ingredient of a batch waits for the next."""

    def ended(table: pa.Table) -> list[pa.RecordBatch]:
        found = _searched(table, np.arange(table.num_rows) - table.column("place").to_numpy(), kept, carried)
        return found.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("place").to_numpy() == 0)
            if len(starts):
                yield from ended(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield from ended(pa.Table.from_batches(held))

    return run


def _elsewhere(order: Sequence[str]):
    """Open rows with the rows of an earlier chunk: the newest that fits, if any."""

    def run(there: pa.Table, mine: pa.Table) -> pa.Table:
        there = there.sort_by([(c, "ascending") for c in order])
        codes: dict[str, dict[str, int]] = {}
        rows, asked = _Rows(there, codes), _Rows(mine, codes)
        prior = np.full(mine.num_rows, -1)
        for i in range(mine.num_rows if there.num_rows else 0):
            good = np.flatnonzero(asked.fits(np.full(there.num_rows, i), rows, np.arange(there.num_rows)))
            if len(good):
                prior[i] = good[-1]
        taken = pa.array(np.where(prior < 0, 0, prior), mask=prior < 0)
        return pa.Table.from_arrays([mine.column("row"), there.column("price").take(taken), there.column("row").take(taken)], names=["row", "prior_price", "prior_row"])

    return run


def chunked(rows: DataFrame, day: Column, params: PriorParams) -> DataFrame:
    """The rows with the number of their chunk inside the ingredient: days are counted, not rows ordered."""
    dated = rows.withColumn("_day", day)
    counts = dated.groupBy("ingredient_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("ingredient_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("ingredient_id", "_day", F.floor(F.coalesce(before, F.lit(0)) / params.chunk).cast("int").alias("chunk"))
    return dated.join(places, ["ingredient_id", "_day"]).drop("_day")


def nearest_compatible(rows: DataFrame, order: Sequence[str], params: PriorParams = PriorParams(), carried: Sequence[str] = ("row",), sizes: DataFrame | None = None) -> DataFrame:
    """ingredient_id, carried, prior_price and prior_<carried> of every row that may chain.

    rows: ingredient_id, family, preservation, form, contract, grams, price, blocked, carried, and the columns of order, of which the first is a time; carried and order together are a key of an ingredient's rows.
    sizes: ingredient_id and n, at least the number of the ingredient's rows, where that is known without working out the rows.
    """
    sound = rows.where((F.col("price") > 0) & ~F.col("blocked")).select(*dict.fromkeys(("ingredient_id", *_SNAPSHOT, *carried, *order)))
    sizes = rows.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    # one in `chunk` rows at most, so it may be broadcast
    long = saved(sizes.where(F.col("n") > params.chunk).select("ingredient_id"), "long")
    if long.isEmpty():
        return _whole(sound, order, carried)
    key = F.struct(*[F.col(c) for c in dict.fromkeys(("ingredient_id", *carried, *order))])
    cut = _cut(sound.join(F.broadcast(long), "ingredient_id", "left_semi").withColumn("row", key), order, params)
    cut = cut.select("ingredient_id", *[F.col("row")[c].alias(c) for c in carried], "prior_price", *[F.col("prior_row")[c].alias(f"prior_{c}") for c in carried])
    return _whole(sound.join(F.broadcast(long), "ingredient_id", "left_anti"), order, carried).unionByName(cut)


def _whole(sound: DataFrame, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """The rows of ingredients that are not cut. The window brings each ingredient into one partition and its rows into line; rows without an ingredient stand alone."""
    place = F.when(F.col("ingredient_id").isNull(), 0).otherwise(F.row_number().over(Window.partitionBy("ingredient_id").orderBy(*[F.asc_nulls_last(c) for c in order])) - 1)
    lined = sound.withColumn("place", place).select(*dict.fromkeys(("ingredient_id", "place", *_SNAPSHOT, *carried)))
    found = [T.StructField(f"prior_{f.name}", f.dataType) for f in (sound.schema[c] for c in ("price", *carried))]
    schema = T.StructType([sound.schema["ingredient_id"], *[sound.schema[c] for c in carried], *found])
    return lined.mapInArrow(_in_line(("ingredient_id", *carried), carried), schema)


def _cut(sound: DataFrame, order: Sequence[str], params: PriorParams) -> DataFrame:
    """ingredient_id, row, prior_price, prior_row of long ingredients, chunk by chunk; row is a key of all rows."""
    kind = sound.schema["row"].dataType.simpleString()
    sound = sound.select(*dict.fromkeys(("ingredient_id", "row", *_SNAPSHOT, *order)))
    sound = saved(sound, "sound")  # what names say is read once
    total = max(1, sound.count())
    ready = chunked(sound, F.to_date(order[0]), params).withColumn("bundle", F.pmod(F.xxhash64("ingredient_id"), F.lit(max(1, total // params.bundle))).cast("int"))
    ready = saved(ready, "purchases")
    kept = ["ingredient_id", "row", "chunk"]
    near = ready.groupBy("bundle", "chunk").applyInArrow(_inside(order, kept), f"ingredient_id long, row {kind}, chunk int, prior_price double, prior_row {kind}")
    near = saved(near, "near")
    found = near.where(F.col("prior_row").isNotNull() | (F.col("chunk") == 0)).drop("chunk")
    open_ = near.where(F.col("prior_row").isNull() & (F.col("chunk") > 0)).select("row", F.col("chunk").alias("bound")).join(ready.select("ingredient_id", "row", *_SNAPSHOT), "row")
    octave = F.floor(F.log2("price")).cast("int")
    cut = ready.where(F.col("chunk") > 0).select("ingredient_id").distinct()
    zones = ready.join(cut, "ingredient_id", "left_semi").groupBy("ingredient_id", *_TEXTS, "grams", octave.alias("octave"), "chunk").agg(F.min("price").alias("least"), F.max("price").alias("most"))
    zones = saved(zones, "zones")
    kinds = zones.groupBy("ingredient_id", *_TEXTS, "grams", "octave").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    kinds = kinds.withColumn("kind", F.xxhash64(*_TEXTS, F.coalesce("grams", F.lit(-1.0)), "octave"))
    zoned = zones.select("ingredient_id", F.xxhash64(*_TEXTS, F.coalesce("grams", F.lit(-1.0)), "octave").alias("kind"), "chunk")
    open_ = saved(open_, "open")
    while not open_.isEmpty():
        a, k = open_.alias("a"), kinds.alias("k")
        limit = F.when(F.col("a.contract") == F.col("k.contract"), PRICE_RATIO).otherwise(FORMAT_RATIO)
        may = (
            (F.col("a.ingredient_id") == F.col("k.ingredient_id")) & (F.col("a.family") == F.col("k.family")) & (F.col("a.form") == F.col("k.form"))
            & ((F.col("a.preservation") == "unknown") | (F.col("k.preservation") == "unknown") | (F.col("a.preservation") == F.col("k.preservation")))
            & (F.col("k.most") * limit * 1.000001 >= F.col("a.price")) & (F.col("k.least") <= F.col("a.price") * limit * 1.000001)
        )
        probes = a.join(k, may).select("a.ingredient_id", "k.kind", F.col("a.bound").alias("chunk"), "a.row")
        line = zoned.withColumns({"row": F.lit(None).cast(kind), "after": F.lit(1)}).unionByName(probes.withColumn("after", F.lit(0)))
        newest = F.last(F.when(F.col("after") == 1, F.col("chunk")), ignorenulls=True).over(Window.partitionBy("ingredient_id", "kind").orderBy("chunk", "after").rowsBetween(Window.unboundedPreceding, -1))
        target = line.withColumn("target", newest).where((F.col("after") == 0) & F.col("target").isNotNull()).groupBy("row").agg(F.max("target").alias("target"))
        aimed = saved(open_.join(target, "row", "left"), "aimed")
        asked = aimed.where(F.col("target").isNotNull()).withColumnRenamed("target", "chunk")
        there = ready.join(asked.select("ingredient_id", "chunk").distinct(), ["ingredient_id", "chunk"], "left_semi").groupBy("ingredient_id", "chunk")
        got = saved(there.cogroup(asked.toDF(*asked.columns).groupBy("ingredient_id", "chunk")).applyInArrow(_elsewhere(order), f"row {kind}, prior_price double, prior_row {kind}"), "got")
        ended = aimed.where(F.col("target").isNull()).select("ingredient_id", "row", F.lit(None).cast("double").alias("prior_price"), F.lit(None).cast(kind).alias("prior_row"))
        hits = got.where(F.col("prior_row").isNotNull()).join(aimed.select("row", "ingredient_id"), "row").select("ingredient_id", "row", "prior_price", "prior_row")
        found = found.unionByName(ended).unionByName(hits)
        open_ = saved(asked.join(got.where(F.col("prior_row").isNull()).select("row"), "row", "left_semi").withColumn("bound", F.col("chunk")).drop("chunk"), "open")
    return found
