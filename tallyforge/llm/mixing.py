"""Mixing sources to target weights by systematic sampling.

Sources share the size of the whole corpus by weight; a target stops at `factor` times its source's own size, and what is over goes to the other sources by
weight until none is above. Within a source every document is expected target / size times. The expected copies are summed along the source's order, one
random offset is added, and a document is taken once for every whole number that its stretch of that sum crosses: so it is taken floor(rate) or ceil(rate) times,
and never more than `factor` times, which is a whole number.

The order decides how near the words come to the target: documents are ranked by their size in steps of about four percent; the odd ranks come first, upward, then
the even ones, downward. So what the offset gives on the way up it takes on the way down. The sums are whole numbers of 2**-24 copies: they do not depend on the layout.

No window holds a source: documents are ordered inside cells (source, step, salt), and the cells' counts are summed along the salts of a step and along the steps of a source.
There are at most `salts` cells in a step and 2,048 steps in a source. The only windows without a key run over one row per source.

Defined results: null text has size 0 and empty or blank text too; a document of size 0 is taken like any other, but adds no words; a source without
words has target 0. A null source is a source, the last one. Rows are documents, repeated rows and null ids included; rows equal in id, size and place in the
order are interchangeable. Columns other than doc_id, text and source are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.textcore import written

#: Units of one copy.
UNIT = 1 << 24

_BLANK = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class MixParams:
    """weights: of the sources in order, repeating. factor: most copies. salts: most cells of a step. seed: of the offsets."""

    weights: tuple[int, ...] = (5, 2, 1)
    factor: int = 3
    salts: int = 64
    seed: str = "mix"


def n_words(text: Column) -> Column:
    """The number of words: every word, with the blanks around it, becomes one character, so no list of words is built."""
    marks = F.regexp_replace(text, f"[{_BLANK}]*+[^{_BLANK}]++[{_BLANK}]*+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _digest(column: Column, at: int) -> Column:
    """Six hexadecimal digits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(column.cast("binary")), at, 6), 16, 10).cast("long")


def placed(docs: DataFrame, params: MixParams, carried: list[str] = ()) -> DataFrame:
    """doc_id, src, size, step, salt of every row: its cell in the order of its source. src is never null and sorts like the source, null last.

    Columns to be carried come in a struct `row`.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    mark = _digest(F.concat_ws("\x1f", F.col("doc_id").cast("string"), text), 1)
    src = F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))
    row = [F.struct(*[docs[c] for c in carried]).alias("row")] if carried else []
    rows = docs.select("doc_id", src.alias("src"), n_words(text).alias("size"), mark.alias("mark"), *row)
    # sixteen steps to each doubling of the size, in whole numbers: how many bits it has, and the five first of them
    bits = F.length(F.bin("size"))
    first = F.when(bits > 5, F.expr("shiftright(size, length(bin(size)) - 5)")).otherwise(F.col("size"))
    step = (bits * 32 + first).cast("long")
    return rows.select("doc_id", "src", "size", step.alias("step"), (F.col("mark") % params.salts).alias("salt"), *(["row"] if carried else []))


def targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """src, source_size, target of rows (src, source_size): one row per source, so these windows are as long as there are sources."""
    place = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in params.weights]), place % len(params.weights) + 1)
    most = F.col("source_size").cast("double") * params.factor
    rows = sizes.select("src", "source_size", weight.alias("weight"), most.alias("most"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "src")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(every).cast("double")
    # What a unit of weight gets if the sources before are full: it rises while they stop below their share, and falls from there on.
    rows = rows.withColumn("share", (whole - full) / open_)
    return rows.select("src", "source_size", F.least("most", F.col("weight") * F.max("share").over(every)).alias("target"))


def copies(docs: DataFrame, params: MixParams = MixParams(), carried: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row, and the struct `row` if columns are carried."""
    rows = written(placed(docs, params, carried), "sizes")
    past = (Window.unboundedPreceding, -1)
    cells = rows.groupBy("src", "step", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    steps = cells.groupBy("src", "step").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = steps.groupBy("src").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("source_size"))
    rates = targets(sources, params).join(sources.select("src", "n_docs"), "src")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0)
    rates = rates.withColumn("rate", rate).withColumn("start", _digest(F.concat_ws("\x1f", F.lit(params.seed), "src"), 7))
    by_step = F.sum("n").over(Window.partitionBy("src").orderBy("step").rowsBetween(*past))
    by_salt = F.sum("n").over(Window.partitionBy("src", "step").orderBy("salt").rowsBetween(*past))
    steps = steps.select("src", "step", F.coalesce(by_step, F.lit(0)).alias("before_step"))
    cells = cells.select("src", "step", "salt", F.coalesce(by_salt, F.lit(0)).alias("before_cell")).join(steps, ["src", "step"]).join(rates, "src")
    inside = F.row_number().over(Window.partitionBy("src", "step", "salt").orderBy("size", "doc_id"))
    met = rows.withColumn("inside", inside).join(cells, ["src", "step", "salt"]).withColumn("rank", F.col("before_step") + F.col("before_cell") + F.col("inside"))
    met = met.withColumn("place", F.when(F.col("rank") % 2 == 1, F.expr("(rank + 1) div 2")).otherwise(F.expr("n_docs + 1 - rank div 2")))
    crossed = F.expr(f"(place * rate + start) div {UNIT} - ((place - 1) * rate + start) div {UNIT}")
    source = F.when(F.startswith("src", F.lit("0")), F.expr("substring(src, 2)"))
    return met.select("doc_id", source.alias("source"), "size", "source_size", "target", crossed.alias("copies"), *(["row"] if carried else []))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) of every row of (doc_id, text, source)."""
    return copies(docs, params).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with the columns it came with."""
    rows = copies(docs, params, docs.columns).where(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
