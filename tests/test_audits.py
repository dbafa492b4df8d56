"""Identity of names, products of invoices, audits of units and aliases, and nearest entries, against plain versions and edges."""

import random
from collections import Counter

from tallyforge.functions import identity
from tallyforge.operators import audits, clusters


def plain_score(a, b):
    pairs = lambda x: Counter(x[i : i + 2] for i in range(len(x) - 1))
    x, y = pairs(a), pairs(b)
    total = sum(x.values()) + sum(y.values())
    dice = 1.0 if a == b else 2.0 * sum((x & y).values()) / total if x and y else 0.0
    held = len(a) >= 4 and (a in b or b in a) and min(len(a), len(b)) > 1
    return max(dice, 0.65 if held else 0.0)


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("aab c") for _ in range(rng.randint(1, 12))).strip() or "a"
    mine = [make() for _ in range(60)] + ["a", "a", "", None, "aaaaaaaa"]
    theirs = [(i, make()) for i in range(60)] + [(90, "aaaa"), (91, "aaaa"), (92, ""), (93, None)]
    got = {r.key: (r.ingredient_id, round(r.score, 9)) for r in audits.neighbours(spark.createDataFrame([(x,) for x in mine], "key string"), spark.createDataFrame(theirs, "ingredient_id long, key string")).collect()}
    wanted = {}
    for a in {x for x in mine if x}:
        score, entry = max((round(plain_score(a, b), 9), -i) for i, b in theirs if b)
        if score >= audits.LEAST_NEIGHBOUR:
            wanted[a] = (-entry, score)
    assert got == wanted
    empty = spark.createDataFrame([], "ingredient_id long, key string")
    assert audits.neighbours(empty, empty).count() == 0


def test_described_edges(spark):
    names = ["", "9 x 9", "BATT PALHA", "!!!", "12 kg", "Pão  de BATATA 80 g", "palha", "cheddar ralado queijo", "HMB ANG 180G CX", "x" * 5000]
    rows = {r.name: r for r in identity.described(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert rows[""].words == [] and rows[""].family is None and not rows[""].shorthand
    assert rows["9 x 9"].words == ["9x9"] and rows["9 x 9"].kitchen == "frozen_potato"
    assert rows["12 kg"].words == [] and rows["!!!"].core == ""
    # A short word with one letter too many is written out like the shortest that it is near to.
    assert rows["BATT PALHA"].expanded == ["batata", "palha"]
    assert rows["Pão  de BATATA 80 g"].kitchen == "bread"
    assert (rows["palha"].family, rows["palha"].cluster) == ("batata", "batata-palha")
    assert (rows["cheddar ralado queijo"].cluster, rows["cheddar ralado queijo"].form) == ("cheddar-grated", "grated")
    assert rows["HMB ANG 180G CX"].shorthand and rows["HMB ANG 180G CX"].kitchen == "burger_meat"


def test_clusters(spark):
    lines = [
        (1, "Batata palha 1 kg"), (2, "molho bbq"), (3, "molho bbq"), (3, "BBQ molho 2kg"), (4, "cheddar bloco"), (4, "cheddar fatiado"), (5, "cheddar bloco"), (5, "queijo cheddar"),
        (6, "cheddar bloco"), (6, "cheddar block 2 kg"), (7, None), (7, ""), (8, "molho fatiado"), (8, "molho fatiado"), (9, "gizmo"), (9, "gizmo"), (None, "cheddar dip"),
    ]
    got = {(r.invoice_id, r.cluster_id, r.n_lines) for r in clusters.clusters(spark.createDataFrame(lines, "invoice_id long, name string")).collect()}
    assert got == {(1, "batata-palha", 1), (3, "sauce-molho", 2), (6, "cheddar-block", 2), (None, "cheddar-dip", 1)}


def test_unit_audit_edges(spark):
    rows = [
        (1, "Bun 80g", 80.0, "un", None, None, 1.0, None), (2, "Bun 80g", 80.0, "un", None, None, 9.0, None), (3, "Bun 80g", 80.0, "un", None, None, 9.0, "g"), (4, None, 80.0, "g", None, None, 1.0, None),
        (None, "Bun 80g", 80.0, "g", None, None, 1.0, None), (5, "Farinha", 1000.0, "g", " ", "", 1.0, None), (6, "Bun", 1000.0, None, None, None, None, None),
    ]
    entries = spark.createDataFrame(rows, "ingredient_id long, name string, purchase_quantity double, purchase_unit string, base_unit string, unit string, current_price double, cost_base_unit string")
    found = {r.ingredient_id: r.patterns for r in audits.unit_findings(entries).collect()}
    assert found == {k: "gram_denominator_matches_embedded_weight" for k in (1, 2, 3)} | {6: "inferred_mass_base_from_pq_heuristic"}
    fixed = {r.ingredient_id: (r.purchase_quantity, r.usable_g) for r in audits.repaired_units(entries).collect() if r.ingredient_id}
    assert fixed == {1: (1.0, 80.0), 3: (80.0, 80.0)}
    assert [r.n for r in audits.unit_summary(audits.unit_findings(entries.limit(0))).collect()] == [0] * 5


def test_alias_audit_edges(spark):
    rows = [(1, "CHK FLT", 1, "sumo zero"), (2, "", 1, "x"), (3, None, 1, "x"), (4, "gizmo", 7, None), (5, "Bat Palha", 5, "batata palha"), (6, "cola", 6, "xyzzy")]
    got = {r.alias_id: r for r in audits.alias_findings(spark.createDataFrame(rows, "alias_id long, alias_name string, ingredient_id long, name string")).collect()}
    assert set(got) == {1, 4, 5, 6}
    assert got[1].reasons == "category_token_mismatch" and got[1].suspicious and got[1].confidence <= 0.12
    assert got[5].confidence == 1.0 and not got[5].suspicious
    assert got[6].reasons == "low_token_jaccard,low_string_similarity" and got[6].confidence == 0
