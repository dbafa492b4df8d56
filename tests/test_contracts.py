"""Pack phrases, contracts and the guarded as-of join at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import contracts, packs
from tallyforge.operators import guarded_prior
from tallyforge.operators.guarded_prior import PriorParams

# text, tier, bought, inner, size, unit, usable
PARSED = [
    ("1 pack x 250 g", "container_size", 1, None, 250, "g", 250), ("2 kg", "bare_measure", 1, None, 2, "kg", 2000), ("24 x 330 ml", "count_size", 24, None, 330, "ml", 7920),
    ("4 cases x 24 x 330ml", "triple_nested", 4, 24, 330, "ml", 31680), ("5 packs x 1kg", "container_size", 5, None, 1, "kg", 5000), ("Caixa 40 un x 180g", "caixa_units_size", 1, 40, 180, "g", 7200),
    ("24X80G", "count_size", 24, None, 80, "g", 1920), ("24 un x 80 g", "units_size", 1, 24, 80, "g", 1920), ("Caixa 24x80g", "caixa_compact_size", 1, 24, 80, "g", 1920),
    ("Pack 6 x 1 L", "container_size", 6, None, 1, "L", 6000), ("Pão de leite 80g 24x80g", "count_size", 24, None, 80, "g", 1920), ("Molho 1 pack x 250 g 1 pack x 3 g", "container_size", 1, None, 250, "g", 250),
    ("Ovos Cx.15 dúzias (M)", "caixa_dozen_count", 1, 15, 12, "un", 180), ("Ovos caixa 30 dz", "caixa_dozen_count", 1, 30, 12, "un", 360), ("33cl x24", "size_count", 1, 24, 33, "cl", 7920),
    ("75cl x 15ud", "size_count", 1, 15, 75, "cl", 11250), ("Queijo 125GR*8", "size_count", 1, 8, 125, "g", 1000), ("Agua (CX 75CL*15)", "size_count", 1, 15, 75, "cl", 11250),
    ("Natas 22% 6x1 Lt", "count_size", 6, None, 1, "L", 6000), ("Cerveja 0.20cl", "bare_measure", 1, None, 20, "cl", 200), ("Pão 80g caixa 24", "caixa_compact_size", 1, 24, 80, "g", 1920),
]
LEFT = [("", "no_measure"), ("Salsa", "no_measure"), ("Pão 80g 120 UN", "pieces_counted"), ("Leite PACK6 1L", "packs_counted"), ("1 x 80 g", "multiplied"), ("caixas x 6 x 1L", "container_uncounted"), ("A4x80g", "no_measure")]


def test_phrases_are_read(spark):
    frame = spark.createDataFrame([(t,) for t, *_ in PARSED] + [(t,) for t, _ in LEFT] + [(None,)], "t string")
    got = {r.t: r.s for r in frame.select("t", packs.structure(F.col("t")).alias("s")).collect()}
    for text, *wanted in PARSED:
        s = got[text]
        assert (s.tier, s.bought, s.inner, s.size, s.unit, s.usable) == tuple(wanted), text
        assert s.reason is None
    for text, why in LEFT:
        assert (got[text].tier, got[text].reason, got[text].usable) == ("none", why, None), text
    assert got[None] is None
    found = spark.range(1).select(packs.measure_tokens(F.lit("Molho 1 pack x 250 g, 4 ml e 1,5kg")).alias("m")).first().m
    assert [(m.value, m.unit) for m in found] == [(250.0, "g"), (4.0, "ml"), (1.5, "kg")]


BROUGHT = [
    ("Queijo 125GR*8", 10.0, "un", 10000, "scaled", 10), ("Cerveja 33cl*24", 24.0, "un", 7920, "name", 1), ("Presunto 1,5kg*7", 5.996, "un", 5996, "row_weight", 1), ("Agua 75cl x 15ud", 2.0, "un", 22500, "scaled", 2),
    ("Natas 6x1L", 5.0, "cx", 30000, "scaled", 5), ("24x80g", 2.0, "un", 1920, "name", 1), ("Vinagre 5l*2", 1.0, "un", 10000, "name", 1), ("Queijo 3kg", 10.0, "un", 30000, "recomputed", 10),
    ("Cerveja 0.20cl", 24.0, "un", 4800, "recomputed", 24), ("24x80g", 60.0, "g", 60, "row_part", 24), ("4 cases x 24 x 330ml", 4.0, "ml", 31680, "name", 4), ("1 pack x 250 g", 3.0, "g", 250, "name", 1),
    ("2 packs x 1kg", None, None, 2000, "name", 2),
]


def test_rows_bring(spark):
    frame = spark.createDataFrame([(k, *case[:3]) for k, case in enumerate(BROUGHT)], "k int, n string, q double, u string")
    for r in frame.select("k", packs.usable_of_row(packs.structure(F.col("n")), F.col("q"), F.col("u")).alias("u")).collect():
        assert (r.u.usable, r.u.source, r.u.containers) == BROUGHT[r.k][3:], BROUGHT[r.k]


def test_names_tell_contracts(spark):
    rows = [(1, "Pepino em conserva 400g", "kg"), (2, "Atum LATA", "un"), (3, "Queijo fatiado congelado", None), (4, "Batata palha frita", None), (5, None, "kg"), (6, "Sumo 20 ml", "L"), (7, "Latada fresca", "x")]
    got = {r.id: r for r in contracts.described(spark.createDataFrame(rows, "id int, printed string, unit string")).collect()}
    assert len(got) == len(rows)
    assert (got[1].preservation, got[1].family, got[1].grams, got[1].contract) == ("preserved", "weight", 400.0, "weight:kg:none:preserved")
    assert got[2].preservation == "preserved" and got[3].form == "frozen+sliced" and got[4].form == "palha" and got[7].preservation == "unknown"
    assert got[6].drink and got[6].pack_ml == 20.0


SCHEMA = "ingredient_id long, row string, family string, preservation string, form string, contract string, grams double, price double, blocked boolean, at timestamp, n int"


def plain(rows):
    out = {}
    for r in rows:
        if r[8] or r[7] <= 0:
            continue
        out[r[1]] = None
        for b in rows:
            if b[0] != r[0] or b[8] or b[7] <= 0 or (b[9], b[10]) >= (r[9], r[10]):
                continue
            apart = max(r[7], b[7]) / min(r[7], b[7])
            fits = r[2] == b[2] and r[4] == b[4] and ("unknown" in (r[3], b[3]) or r[3] == b[3]) and not (r[6] and b[6] and max(r[6], b[6]) / min(r[6], b[6]) > 10)
            if fits and apart <= (14 if r[5] == b[5] else 2) and (out[r[1]] is None or (b[9], b[10]) > out[r[1]][:2]):
                out[r[1]] = (b[9], b[10], b[1])
    return {k: v and v[2] for k, v in out.items()}


@pytest.mark.parametrize("params", [PriorParams(), PriorParams(chunk=6, bundle=40)])
def test_prior_equals_plain(spark, params):
    from datetime import datetime, timedelta

    rng = random.Random(4)
    rows = []
    for k in range(240):
        family, kept, form = rng.choice(["weight"] * 6 + ["volume"]), rng.choice(["unknown", "fresh", "preserved"]), rng.choice(["none"] * 5 + ["sliced"])
        rows.append((1 if k % 3 else k % 7, f"r{k}", family, kept, form, f"{family}{kept}{form}{rng.randint(0, 2)}", rng.choice([None, 80.0, 500.0, 6000.0]), 2.0 ** rng.uniform(-6, 6) if k % 40 else 0.0, rng.random() < 0.05, datetime(2024, 1, 1) + timedelta(hours=9 * rng.randint(0, 200)), k))
    got = guarded_prior.nearest_compatible(spark.createDataFrame(rows, SCHEMA), ["at", "n"], params).collect()
    assert {r.row: r.prior_row for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_prior_of_nothing(spark):
    assert guarded_prior.nearest_compatible(spark.createDataFrame([], SCHEMA), ["at", "n"]).count() == 0


def random_purchases(n):
    from datetime import datetime, timedelta

    rng = random.Random(8)
    rows = []
    for k in range(n):
        family, kept = rng.choice(["weight"] * 6 + ["volume"]), rng.choice(["unknown", "fresh", "preserved"])
        rows.append((0 if k % 2 else k % 31, f"r{k}", family, kept, "none", f"{family}{kept}", rng.choice([None, 80.0, 6000.0]), 2.0 ** rng.uniform(-6, 6), k % 19 == 0, datetime(2024, 1, 1) + timedelta(hours=9 * rng.randint(0, 200)), k))
    return rows


@pytest.mark.parametrize("params", [PriorParams(), PriorParams(chunk=40, bundle=40)])
def test_short_ingredients_move_once(spark, params, monkeypatch):
    """Short ingredients are searched where the window lines them up, over the borders of batches; only what a long one needs is written."""
    rows, written = random_purchases(400), []
    monkeypatch.setattr(guarded_prior, "saved", lambda frame, name, save=guarded_prior.saved: written.append(name) or save(frame, name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = guarded_prior.nearest_compatible(spark.createDataFrame(rows, SCHEMA), ["at", "n"], params, carried=("row", "contract"))
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    contract = {r[1]: r[5] for r in rows}
    assert {r.row: r.prior_row for r in got} == plain(rows) and len(got) == len(plain(rows))
    assert all(r.contract == contract[r.row] and r.prior_contract == contract.get(r.prior_row) for r in got)
    assert written == ["long"] if params.chunk > 400 else {"sound", "near"} <= set(written)


def test_rows_without_ingredient_stand_alone(spark):
    from datetime import datetime

    rows = [(k, f"r{j}", "weight", "unknown", "none", "c", None, 2.0, False, datetime(2024, 1, 1 + j), j) for j, k in enumerate([None, None, 5, 5])]
    got = guarded_prior.nearest_compatible(spark.createDataFrame(rows, SCHEMA), ["at", "n"]).collect()
    assert {r.row: r.prior_row for r in got} == {"r0": None, "r1": None, "r2": None, "r3": "r2"}
