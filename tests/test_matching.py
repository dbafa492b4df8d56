"""Matching, containment, merges and the chain store against plain versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import containment, line_costs, matching, merging
from tallyforge.streaming import chain_store


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_deletions_meet_within_two_edits(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(60)] + ["", "a"]
    rows = spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", matching.deletions(F.col("w")).alias("d")).collect()
    left = {r.w: set(r.d) for r in rows}
    for a in left:
        for b in left:
            if edits(a, b) <= 2:
                assert left[a] & left[b], (a, b)


@pytest.mark.parametrize("direct", [64, 0])
def test_fuzzy_aliases(spark, direct):
    lines = spark.createDataFrame([("s", "queijo flamengu"), ("s", "queijo x"), ("t", "queijo flamengo"), ("s", "molho flamengo"), ("s", None), ("s", "queijo montes"), ("s", "queijo montes")], "supplier_name string, key string")
    known = spark.createDataFrame([("s", "queijo flamengo", 1, True), ("s", "queijo monter", 2, True), ("s", "queijo montex", 3, True), ("", "queijo flamengu", 9, True), ("s", "queijo flamengo", 1, True)], "supplier_name string, normalized_alias string, ingredient_id int, confirmed boolean")
    got = [tuple(r) for r in matching.fuzzy_aliases(lines, known, direct=direct).collect()]
    assert got == [("s", "queijo flamengu", 1, 1)]


def test_similar_entries_equal_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = ["tomate", "queijo", "pelado", "lata", "bio", "velho", "novo", "grande"] + [f"marca{k}" for k in range(30)]
    entries = [(k, " ".join(rng.sample(vocabulary, rng.randint(1, 4)))) for k in range(80)] + [(200, "molho tomate"), (201, "queijo fatiado")]
    lines = [(" ".join(rng.sample(vocabulary, rng.randint(1, 4))),) for _ in range(160)] + [("molho tomate",), ("queijo",), ("",), (None,)]
    catalog, asked = spark.createDataFrame(entries, "ingredient_id int, key string"), spark.createDataFrame(lines, "key string")
    got = {(r.key, r.ingredient_id): r.overlap for r in matching.similar_entries(asked, catalog).collect()}
    import math

    df = {}
    for _, key in entries:
        for w in set(key.split()):
            df[w] = df.get(w, 0) + 1
    weigh = lambda ws: sum(math.floor(1000 * math.log(1 + len(entries) / df.get(w, 1))) if w in df else math.floor(1000 * math.log(1 + len(entries))) for w in ws)
    wanted = {}
    for (key,) in lines:
        for i, other in entries:
            a, b = set((key or "").split()), set(other.split())
            if a and 2 * weigh(a & b) >= weigh(a | b) and ("molho" in a) == ("molho" in b) and ("fatiado" in a) == ("fatiado" in b):
                wanted[key, i] = weigh(a & b) / weigh(a | b)
    assert got == pytest.approx(wanted) and len(got) > 40


@pytest.mark.parametrize("direct, common", [(64, 1_000), (64, 2), (2, 1_000), (0, 1_000)])
def test_cascade_equals_plain_stages(spark, direct, common):
    """Every stage, refusals and suppliers without a name among them, whether little or much is told of a supplier; words are looked up or joined."""
    rng = random.Random(12)
    words = ["queijo", "molho", "lata", "bio", "serra"] + [f"marca{k}" for k in range(6)] + ["marcax", "marcaxy"]
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    entries = [(k, name()) for k in range(40)] + [(k + 100, key) for k, key in enumerate(["queijo serra"] * 3)]
    suppliers = ["s", "t", "", None]
    lines = [(k, rng.choice(suppliers), name()) for k in range(250)] + [(300, "s", None), (301, "s", "queijo serra"), (302, "t", "queijo serra"), (303, "s", ""), (304, None, "queijo serra")]
    aliases = [(rng.choice(["s", "t", "", " "]), name(), rng.randint(0, 39)) for _ in range(60)]
    keys = [k for _, _, k in lines if k]
    some = lambda n: [(rng.choice(["s", "t", ""]), rng.choice(keys), rng.randint(0, 39)) for _ in range(n)]
    overrides = some(25)
    refused = some(60) + [o for o in overrides[:8]] + [(s, a, i) for s, a, i in aliases[:20]] + [(s, key, i) for s in ("s", "t", "") for i, key in entries[:15]] + [("s", "queijo serra", 100), ("t", "queijo serra", 100), ("t", "queijo serra", 101)]
    catalog = spark.createDataFrame(entries, "ingredient_id int, key string")
    asked = spark.createDataFrame(lines, "line_id int, supplier_name string, key string")
    schema = "supplier_name string, key string, ingredient_id int"
    scores = {}
    for r in matching.similar_entries(asked, catalog, common=common).collect():
        scores.setdefault(r.key, []).append((r.ingredient_id, r.score))
    printed = {r.key: r.p for r in asked.select("key").unionByName(spark.createDataFrame([(a,) for _, a, _ in aliases], "key string")).select("key", text.fingerprint(F.col("key")).alias("p")).collect()}
    no = set(refused)

    def one(ids):
        return ids.pop() if len(ids) == 1 else None

    def answer(s, key):
        if s is None or key is None:
            return None, "unmatched", 0.0
        ok = lambda i: i is not None and (s, key, i) not in no
        named = [i for a, k, i in overrides if (a, k) == (s, key) and ok(i)]
        if named:
            return min(named), "override", 1.0
        if ok(i := one({i for a, k, i in aliases if k == key and a.strip() == s})):
            return i, "alias", 1.0
        if ok(i := one({i for a, k, i in aliases if k == key and not a.strip()})):
            return i, "global_alias", 1.0
        if s.strip() and len(printed[key]) >= 4:
            near = [(edits(printed[key], printed[k]), i) for a, k, i in aliases if a == s and k.split(" ")[0] == key.split(" ")[0] and len(printed[k]) >= 4]
            near = [x for x in near if x[0] <= 2]
            if near and ok(i := one({i for d, i in near if d == min(near)[0]})):
                return i, "fuzzy_alias", 1.0
        if same := [i for i, k in entries if k == key and ok(i)]:
            return min(same), "exact", 1.0
        best = sorted((-round(x, 9), i, x) for i, x in scores.get(key, []) if ok(i) and x >= matching.OPERATIONAL)
        return (best[0][1], "semantic" if best[0][2] >= matching.SEMANTIC else "operational", best[0][2]) if best else (None, "unmatched", 0.0)

    frames = [spark.createDataFrame(rows, schema) for rows in (aliases, overrides, refused)]
    got = {r.line_id: (r.ingredient_id, r.kind, r.score) for r in matching.cascade(asked, catalog, frames[0].withColumnRenamed("key", "normalized_alias"), *frames[1:], direct=direct).collect()}
    wanted = {i: answer(s, key) for i, s, key in lines}
    assert got == wanted
    assert {kind for _, kind, _ in wanted.values()} == {"override", "alias", "global_alias", "fuzzy_alias", "exact", "semantic", "operational", "unmatched"}


def test_contained_equals_all_pairs(spark):
    rng = random.Random(7)
    names = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(120)] + ["", None, " ", "abab"]
    got = {tuple(r) for r in containment.contained(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    real = {n for n in names if n and n.strip()}
    assert got == {(a, b) for a in real for b in real if a != b and all(w in b for w in a.split(" ") if w)}
    entries = spark.createDataFrame([(1, "palha", 0), (2, "batata palha", 3), (3, "arroz", 0), (4, "palha", 0), (5, "arroz", 0), (6, None, 0)], "ingredient_id int, name string, n_uses int")
    assert sorted(tuple(r) for r in containment.hidden_orphans(entries).collect()) == [(1, "palha", 2), (4, "palha", 2)]


def test_components_and_merges(spark, tmp_path):
    rng = random.Random(9)
    chain = [(k, k + 1) for k in range(1, 40)]
    links = chain + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(20)] + [(7, 7), (300, 299), (None, 5), (60, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    frame = spark.createDataFrame(links, "a int, b int")
    assert {r.id: r.root for r in merging.components(frame).collect()} == {x: root(x) for x in parent}
    references = spark.createDataFrame([(20, 5), (300, 5), (299, 5)], "ingredient_id int, references long")
    ids = merging.id_map(frame, references)
    got = {r.source_id: r.target_id for r in ids.collect()}
    assert got[1] == got[40] == 20 and 20 not in got and got[300] == 299
    rows = spark.createDataFrame([(1, "x"), (20, "y"), (None, "z"), (999, "w")], "ingredient_id int, note string")
    once = merging.rewritten_once(spark, {"rows": rows}, ids, f"file://{tmp_path}", "r1")["rows"]
    assert sorted((r.note, r.ingredient_id, r.was_rewritten) for r in once.collect()) == [("w", 999, False), ("x", 20, True), ("y", 20, False), ("z", None, False)]
    again = merging.rewritten(once.drop("was_rewritten"), ids)
    assert again.where("was_rewritten").count() == 0
    stays = merging.rewritten_once(spark, {"rows": rows.limit(1)}, ids, f"file://{tmp_path}", "r1")["rows"]
    assert stays.count() == 4
    assert merging.components(frame.limit(0)).count() == 0


def test_line_cost_paths(spark):
    cases = [
        ("pieces", 2.0, "un", 3.0, "un", None, None, None, 6.0), ("same_family", 2.0, "kg", 0.01, "g", None, None, None, 20.0), ("piece_volume", 660.0, "ml", 1.5, "un", None, 330.0, None, 3.0),
        ("piece_weight", 160.0, "g", 0.5, "un", 80.0, None, None, 1.0), ("pieces_by_weight", 2.0, "un", 0.01, "g", 80.0, None, None, 1.6), ("density", 100.0, "ml", 0.01, "g", None, None, 0.5, 0.5),
        ("unitless", 2.0, " ", 3.0, "g", None, None, None, 6.0), ("unpriced", 2.0, "g", None, "g", None, None, None, None), (None, 2.0, "g", 3.0, "un", 0.0, None, None, None), (None, 2.0, "box", 3.0, "g", None, None, None, None),
    ]
    frame = spark.createDataFrame([(k, *c[1:8]) for k, c in enumerate(cases)], "k int, q double, u string, c double, p string, g double, m double, d double")
    got = {r.k: r.c for r in frame.select("k", line_costs.line_cost(*[F.col(x) for x in "qucpgmd"]).alias("c")).collect()}
    for k, case in enumerate(cases):
        assert got[k].path == case[0] and got[k].cost == pytest.approx(case[8]), case


def plain_chains(events):
    puts, gone = {}, {}
    for op, ingredient, _, at, event, document, price, seq in events:
        if op == "delete":
            gone[document] = max(seq, gone.get(document, -1))
        elif event not in puts or puts[event][4] < seq:
            puts[event] = (ingredient, at, document, price, seq)
    alive = sorted((p[0], p[1], e, p[3]) for e, p in puts.items() if gone.get(p[2], -1) < p[4])
    return {e: (price, alive[k - 1][3] if k and alive[k - 1][0] == i else None) for k, (i, _, e, price) in enumerate(alive)}


def test_chain_store_in_any_cut(spark, tmp_path):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    events = []
    for e in range(90):
        row = ("put", e % 6, f"s{e % 4}", start + timedelta(hours=rng.randint(0, 500)), e, e // 3, round(rng.uniform(1, 9), 2), e * 2)
        events.append(row)
        if e % 7 == 0:
            events.append(row)
        if e % 11 == 0:
            events.append((*row[:6], 50.0 + e, e * 2 + 1))
    for document in (0, 4, 9, 15, 29, 77):
        events.append(("delete", None, None, None, None, document, None, document * 6 + 10))
    events.append(("put", 0, "s0", start, 12, 4, 99.0, 500))
    rng.shuffle(events)
    wanted = plain_chains(events)
    store = chain_store.ChainStore(f"file://{tmp_path}/a", buckets=4)
    cuts = [0, 3, 60, 60, len(events)]
    batches = [spark.createDataFrame(events[a:b], chain_store.EVENT) for a, b in zip(cuts, cuts[1:])]
    for k, batch in enumerate(batches):
        store(batch, k)
        if k == 1:
            store(batch, k)  # as after a failure
    got = {r.event_id: (r.unit_price, r.previous_price) for r in store.chains(spark, len(batches)).collect()}
    assert got == wanted
    one = spark.createDataFrame([("put", 3, "s", start, 500, 500, 1.0, 1)], chain_store.EVENT)
    store(one, len(batches))
    manifest = spark.read.parquet(f"file://{tmp_path}/a/manifest/{len(batches)}").where(F.col("version") == len(batches)).collect()
    assert sorted(r.store for r in manifest) == ["chains", "index"]  # one bucket of each
