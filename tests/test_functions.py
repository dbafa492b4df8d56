"""Expressions at their edges."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tallyforge.functions import dates, invoice_lines, numbers, text, units
from tallyforge.operators import decisions, history, invoices, quality
from tallyforge.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers(spark):
    r = one(
        spark, a=numbers.half_up(F.lit(2.5)), b=numbers.half_up(F.lit(-2.5)), c=numbers.pct_change(F.lit(0.0), F.lit(1.0)), d=numbers.pct_change(F.lit(2.0), F.lit(3.0)),
        e=numbers.gross_margin_pct(F.lit(0.0), F.lit(1.0)), f=numbers.unit_cost(F.lit(10.0), F.lit(0.5)), g=numbers.monthly_exposure(F.lit(1.0), F.lit(0)),
        h=numbers.monthly_exposure(F.lit(-1.0), F.lit(3)), i=numbers.impact_band(F.lit(5.0)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (3, -2, None, 50.0, None, 10.0, 120, 0, "MEDIUM")


def test_units(spark):
    r = one(
        spark, a=units.base_quantity(F.lit(2.0), F.lit(" KG ")), b=units.base_unit(F.lit("box")), c=units.repaired_quantity(F.lit(0.6), F.lit("ml")), d=units.repaired_quantity(F.lit(0.4), F.lit("ml")),
        e=units.density_quantity(F.lit(100.0), F.lit("ml"), F.lit("g"), F.lit(0.5)), f=units.density_quantity(F.lit(100.0), F.lit("ml"), F.lit("g"), F.lit(None).cast("double")),
        g=units.prep_line_cost(F.lit(1.0), F.lit("kg"), F.lit(20.0), F.lit(2000.0), F.lit("g")), h=units.prep_line_cost(F.lit(1.0), F.lit("kg"), F.lit(20.0), F.lit(2.0), F.lit("un")),
        i=units.inferred_base_unit(F.lit(None).cast("string"), F.lit(1000.0)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (2000.0, None, 600.0, 0.4, 50.0, None, 10.0, None, "g")


def test_text(spark):
    r = one(
        spark, a=text.simple_key(F.lit("Água (lata)  c-Gás")), b=text.dice(F.lit("night"), F.lit("nacht")), c=text.dice(F.lit(""), F.lit("a")), d=text.weakly_contains(F.lit("molho"), F.lit("molho bbq")),
        e=text.weakly_contains(F.lit("olho"), F.lit("molho bbq")), f=text.fingerprint(F.lit("filete de anchovas alconfrisa 495")), g=text.token_overlap(F.lit("a b"), F.lit("b c d")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.g) == ("agua c gas", 0.25, 0.0, True, False, 0.5)
    assert r.f.endswith("alconfrisa")


def test_dates(spark):
    at = F.lit(datetime(2024, 3, 1, 12))
    r = one(
        spark, a=dates.invoice_date(F.lit("05/03/2024")), b=dates.invoice_date(F.lit("x")), c=dates.days_since(F.lit(datetime(2024, 2, 29, 13)), at), d=dates.days_since(F.lit(datetime(2025, 1, 1)), at),
        e=dates.freshness(F.lit(90)), f=dates.freshness(F.lit(None).cast("int")), g=dates.narrowest_window(F.lit(400)), h=dates.narrowest_window(F.lit(29)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (date(2024, 3, 5), None, 0, 0, "stale", "unknown", "6 months", "30 days")


def test_upsert_and_states(spark):
    state = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, at int")
    changes = spark.createDataFrame([("b", 3, 2), ("b", 4, 3), ("c", 5, 2)], "k string, v int, at int")
    assert sorted(tables.upserted(state, changes, "k", "at").collect()) == [("a", 1, 1), ("b", 4, 3), ("c", 5, 2)]
    assert sorted(tables.upserted(state, changes.limit(0), "k", "at").collect()) == [("a", 1, 1), ("b", 2, 1)]


def test_guard_ladder(spark):
    rows = spark.createDataFrame(
        [(1, 1, "weight", "unknown", "weight:1", 1.0), (1, 2, "weight", "unknown", "weight:1", 2.0), (1, 3, "volume", "unknown", "volume:1", 2.0),
         (1, 4, "volume", "fresh", "volume:1", 40.0), (1, 5, "volume", "preserved", "volume:1", 40.0), (1, 6, "volume", "preserved", "volume:2", 100.0)],
        "ingredient_id int, chrono int, family string, preservation string, contract string, unit_price double",
    )
    got = [(r.reason, r.previous_price) for r in history.guarded_chain(rows, ["chrono"]).orderBy("chrono").collect()]
    assert got == [(None, None), (None, 1.0), ("unit_family_mismatch", None), ("extreme_price_ratio", None), ("preservation_mismatch", None), ("format_change", None)]


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "ingredient_id int, chrono timestamp, unit_price double, supplier_name string, invoice_id int, total double, quantity double")
    assert invoices.month_kpis(lines).count() == 0
    assert history.latest_moves(lines, ["chrono"]).count() == 0
    assert history.variability(lines).count() == 0


def test_coverage(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    matches = spark.createDataFrame([(1,), (1,), (9,)], "item_id int")
    assert tuple(quality.coverage(items, matches).first()) == (2, 1, 1)


def test_invoice_lines(spark):
    rows = spark.createDataFrame(
        [
            (1, "AB1234 Tomate pelado 2,500 kg 3,20 € 6%", None, None, None, None), (2, "Leite  gordo 12 un 0,89", 12.0, "Unidades", 0.89, None), (3, "IBAN PT50 0000", None, None, None, None),
            (4, "Rua das Flores 5", None, None, None, None), (5, "Frutas Lda", None, None, None, None), (6, "Frutas Lda", 1.0, None, None, None), (7, "12,50", None, None, None, None),
            (8, "Molho (CARTÃO) - Produto de Stock", 1.0, "cx", None, None), (9, None, None, None, None, None), (10, "Queijo 3 kg 5,00", 4.0, "kg", None, None),
        ],
        "id int, name string, quantity double, unit string, unit_price double, total double",
    )
    got = {r.id: r for r in invoice_lines.cleaned(rows).collect()}
    assert (got[1].name, got[1].quantity, got[1].unit, got[1].rejected) == ("Tomate pelado", 2.5, "kg", False)
    assert (got[2].name, got[2].unit) == ("Leite gordo", "un")
    assert [i for i, r in got.items() if r.rejected] == [3, 4, 5, 7, 9]
    assert got[8].name == "Molho (CARTÃO)" and got[10].name == "Queijo 3 kg 5,00"
    r = one(spark, a=invoice_lines.number(F.lit("1.234,5")), b=invoice_lines.number(F.lit("1,234.5")), c=invoice_lines.number(F.lit("€ 7")), d=invoice_lines.number(F.lit("x")), e=invoice_lines.is_surcharge(F.lit("Recargo por combustible")))
    assert (r.a, r.b, r.c, r.d, r.e) == (1234.5, 1234.5, 7.0, None, True)


def test_decisions(spark):
    r = one(
        spark, a=decisions.bumped_severity(F.lit("info"), [F.lit(True), F.lit(True)]), b=decisions.bumped_severity(F.lit("high"), [F.lit(True)] * 5), c=decisions.bumped_severity(F.lit("positive"), [F.lit(True)]),
        d=decisions.insight_priority(F.lit("info"), F.lit(80.0), F.lit(None).cast("double")), e=decisions.decision_tier(F.lit("informational"), F.lit(5.0), F.lit("cost"), F.lit(None).cast("string")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("high", "critical", "positive", "warning", "background")
    change = decisions.visit_delta(spark.createDataFrame([("a", 1)], "name string, n int"), spark.createDataFrame([("a", 3), ("b", 2)], "name string, n int")).orderBy("name").collect()
    assert [tuple(r) for r in change] == [("a", 3, 1, 2), ("b", 2, 0, 2)]
