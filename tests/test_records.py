"""Payloads and recorded impacts at their edges."""

from pyspark.sql import functions as F

from tallyforge.operators import impact_store, payloads


def test_payloads_lose_nothing(spark):
    rows = [
        (1, '{"name": "a", "quantity": "2,5", "unit": " kg ", "unit_price": "4"}'), (2, '{"name": "b", "quan'), (3, None), (4, "[]"), (5, '[{"name": "c"}, {"name": ""}, {"unit": "g"}]'), (6, "plain"),
        (7, '{"name": "d", "quantity": null, "unit": null, "unit_price": "x", "total": 7, "more": [1]}'), (8, '[{"name": "e"}, {"name": "f"'), (9, '{"name": "g", "total": "1,5"}'),
    ]
    got = {}
    for r in payloads.lines(spark.createDataFrame([(*r, "kept") for r in rows], "id int, payload string, source string")).orderBy("id", "item").collect():
        assert r.source == "kept"
        got.setdefault(r.id, []).append((r.name, r.quantity, r.unit, r.unit_price, r.total, r.rejected))
    assert got[1] == [("a", 2.5, "kg", 4.0, 10.0, None)] and got[7] == [("d", 1.0, "un", None, 7.0, None)] and got[9] == [("g", 1.0, "un", None, 1.5, None)]
    assert [g[5] for i in (2, 3, 6, 8) for g in got[i]] == ["torn"] * 4 and got[4] == [(None, None, None, None, None, "empty")]
    assert [g[5] for g in got[5]] == [None, "unnamed", "unnamed"] and len(got) == len(rows)
    assert payloads.lines(spark.createDataFrame([], "id int, payload string")).count() == 0


def test_impacts_are_recorded_once(spark, tmp_path):
    store = impact_store.ImpactStore(f"file://{tmp_path}/impacts")
    rows = "recipe_id int, ingredient_id int, cost_up double, margin_drop double, impact string"
    first = spark.createDataFrame([(1, 1, 1.0, 2.0, "LOW"), (1, 1, 1.5, 3.0, "MEDIUM"), (2, 1, 1.0, 1.0, "LOW")], rows)
    assert store.record(first, 1) and not store.record(first.limit(1), 1)
    assert store.record(spark.createDataFrame([(1, 1, 9.0, 9.0, "HIGH")], rows), 2)
    assert sorted(tuple(r) for r in store.newest(spark).collect()) == [(1, 1, 2, 9.0, 9.0, "HIGH"), (2, 1, 1, 1.0, 1.0, "LOW")]
    assert store.history(spark).count() == 3


def test_impacts_of_moves(spark):
    edges = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 9, 1.0)], "recipe_id int, ingredient_id int, quantity double")
    made = spark.createDataFrame([(1, "dish", 10.0), (2, "prep", None), (3, "dish", 0.0), (4, "dish", 5.0)], "recipe_id int, type string, selling_price double")
    catalog = spark.createDataFrame([(1, 6.0, 3.0), (2, 1.0, 1.0)], "ingredient_id int, current_price double, purchase_quantity double")
    got = impact_store.direct_impacts(edges, made, catalog, F.when(F.col("ingredient_id") != 2, F.lit(20.0))).collect()
    assert [(r.recipe_id, r.ingredient_id, r.cost_up, r.margin_drop, r.impact) for r in got] == [(1, 1, 0.8, 8.0, "HIGH")]
