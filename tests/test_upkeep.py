"""Upkeep of histories on rows with nulls, ties and repeats."""

from pyspark.sql import functions as F

from tallyforge.operators import upkeep


def test_unchanged_prices(spark):
    rows = [(1, 10.0, 2.0, 5.0, 1.0), (2, 10.0, 2.0, 10.0, 1.0), (3, 10.0, None, 10.0, 3.0), (4, None, 2.0, 10.0, 2.0), (5, 10.0, 0.0, 11.0, 1.0), (6, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    same = frame.select("id", upkeep.prices_unchanged(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("same")).collect()
    assert {r.id: r.same for r in same} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_implausible_volumes_and_servings(spark):
    frame = spark.createDataFrame([(1, 10.0, 330.0), (2, 20.0, 330.0), (3, 1.0, 49.0), (4, 1.0, None), (5, None, 20.0), (6, 1.0, 0.0)], "id int, price double, ml double")
    found = frame.select("id", upkeep.implausible_volume(F.col("price"), F.col("ml")).alias("bad"), upkeep.servings(F.col("ml"), F.lit(33.0)).alias("n")).collect()
    assert {r.id for r in found if r.bad} == {2, 3, 5}
    assert [r.n for r in sorted(found)][:2] == [10.0, 10.0] and [r.n for r in sorted(found)][3::2] == [None, None]


def test_signals_of_one_ingredient(spark):
    rows = [(1, 7, "low", 9.0), (2, 7, "high", 1.0), (3, 7, "high", 2.0), (4, 7, "high", 2.0), (5, None, "low", 1.0), (6, None, "low", 1.0), (7, 8, "positive", 5.0), (8, 9, None, 5.0)]
    frame = spark.createDataFrame(rows, "signal_id long, ingredient_id long, severity string, priority double")
    assert sorted(r.signal_id for r in upkeep.deduped_signals(frame).collect()) == [3, 5, 6]
    assert upkeep.deduped_signals(frame.limit(0)).count() == 0


def test_chains_after_a_deleted_invoice(spark):
    rows = [(1, 10, 1, 5.0), (1, 11, 2, 6.0), (1, 12, 3, 7.0), (2, 12, 1, 1.0), (2, 13, 2, 2.0), (3, 11, 1, 4.0)]
    frame = spark.createDataFrame(rows, "ingredient_id long, invoice_id long, at int, unit_price double")
    gone = spark.createDataFrame([(11,), (11,), (99,)], "invoice_id long")
    found = {(r.ingredient_id, r.invoice_id): r.previous_price for r in upkeep.relinked_after_delete(frame, gone, ["at", "invoice_id"]).collect()}
    assert found == {(1, 10): None, (1, 12): 5.0}
