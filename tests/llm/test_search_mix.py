"""Hard negatives, ranked search and mixing against plain versions, at their edges."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hardneg, mixing, wand

VECTORS = "vec_id long, label long, v array<long>, positive_id string, bucket string"


def plain_negatives(rows, is_anchor, n_pos=5, n_neg=5):
    kept = {}
    for i, label, v in sorted((r for r in rows if None not in r[:3] and r[2]), key=lambda r: (r[0], r[1], r[2])):
        kept.setdefault(i, (label, v))
    out = set()
    for a, (label, q) in kept.items():
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in kept.items() if i != a and len(v) == len(q)]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == label][:n_pos]:
            near = [(-s, i) for s, i, other in scored if other != label and -80 * p <= -100 * s <= -100 * p][:n_neg]
            out |= {(a, positive, k, i, -p, s) for k, (s, i) in enumerate(near, 1)}
    return out


def mined(frame, params):
    rows = hardneg.mined(frame, F.col("vec_id") % 3 == 0, params).collect()
    got = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("params", [hardneg.NegativeParams(), hardneg.NegativeParams(piece=16, block=4)])
def test_hard_negatives_equal_plain(spark, params):
    rng = random.Random(3)
    rows = [(k, 0 if k % 3 else k % 4, [rng.randint(-300, 300) + 90 for _ in range(6)]) for k in range(160)]
    rows += [(200 + k, 1, [7, 7, 7, 7, 7, 7]) for k in range(9)] + [(300, 0, [1, 2]), (303, 1, [1, 2]), (306, 0, [2, 1]), (309, 2, [0, 0]), (312, 2, [0, 0])]
    rows += [(None, 1, [1] * 6), (401, None, [1] * 6), (402, 1, None), (403, 1, []), rows[5], (6, 3, [1] * 6), (-3, 0, [90] * 6)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    assert mined(frame, params) == plain_negatives(rows, lambda i: i % 3 == 0)
    assert not mined(frame.where("vec_id < 0"), params) and not mined(frame.where("false"), params)


def test_products_are_exact_beyond_doubles(spark):
    big = 2**40
    rows = [(0, 0, [big + 1, 3]), (1, 0, [big, 1]), (2, 1, [big - 1, 1]), (3, 1, [big // 2, 7]), (4, 1, [-big, 5]), (5, 0, [1, -1]), (6, 1, [0, 0])]
    rows = [(i, k, [x // 2**10 for x in v] if i in (0, 3) else [x // 2**9 for x in v]) for i, k, v in rows]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)
    assert mined(frame, hardneg.NegativeParams()) == plain_negatives(rows, lambda i: i % 3 == 0)


def test_intervals_hold_and_tighten():
    rng = np.random.default_rng(1)
    rows = rng.integers(-512, 512, (50, 8))
    query = rng.integers(-512, 512, 8)
    steps, mask, width = hardneg.Planes(rows).intervals(query), None, None
    exact = rows @ query
    for _ in hardneg.Planes(rows).weights:
        alive, low, high = steps.send(mask)
        assert (low <= exact[alive]).all() and (exact[alive] <= high).all()
        assert width is None or (high - low).max() < width
        width, mask = (high - low).max(), np.ones(len(alive), dtype=bool)
    assert (low == exact).all() and (high == exact).all()


def test_components_become_integers(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, 1, [None, 1.0]), (3, 1, [float("nan"), 1.0]), (4, 1, [float("inf"), 1.0]), (5, 1, None)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: r.v for r in hardneg.vectors(frame).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    bags = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    wanted = defaultdict(set)
    for i, text in items:
        wanted[i] |= set(terms_of(text))
    out = {}
    for item, words in wanted.items():
        scored = []
        for i, bag, length in bags:
            m = 50 + (50 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in words if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out[item] = [(-s, i) for s, _, _, i in sorted(scored, key=lambda x: x[:3])[:k]]
    return {i: rows for i, rows in out.items() if rows}


@pytest.mark.parametrize("params", [wand.SearchParams(k=7), wand.SearchParams(k=7, shard_postings=60, block=2, run=4, longest=16)])
def test_search_equals_plain(spark, docs, rows, params):
    texts = [(r[0], r[1]) for r in rows] + [(None, "two words"), (900, "!!! --- \x7f"), (901, "É É é W"), (902, "ÉÉ, w w w w w w"), (903, "one-two three")]
    common = [(1000 + k, "common " * (k % 5 + 1) + f"rare{k % 50}") for k in range(300)]
    items = [(1, texts[5][1]), (2, "Two WORDS, two"), (3, "é w"), (4, None), (5, ""), (6, "absent"), (7, "common rare3 word"), (7, "rare4"), (7, "rare4"), (8, "common"), (9, texts[13][1])]
    frame = spark.createDataFrame([(*r, "a", "b") for r in texts + common], "doc_id long, text string, score string, terms string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = defaultdict(list)
    for r in wand.ranked(frame, asked, params).orderBy("item_id", "rank").collect():
        assert r["rank"] == len(got[r.item_id]) + 1
        got[r.item_id].append((r.score, r.doc_id))
    assert dict(got) == plain_ranking(texts + common, items, 7)


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert wand.ranked(none, items).count() == 0
    assert wand.ranked(items.select(F.col("item_id").alias("doc_id"), "text"), items.where("false")).count() == 0


def test_pivots_skip_documents():
    """Documents that hold only a weak term are never scored once the heap is full of better ones."""
    n = 4000
    places = np.concatenate([np.arange(n), np.arange(0, n, 100)])
    terms = np.concatenate([np.full(n, 5), np.full(n // 100, 9)])
    tfs = np.ones(len(places), dtype=np.int64)
    shard = wand.Shard(np.arange(n), np.full(n, 10), terms, places, tfs, n, 10 * n)
    where, scores = shard.search(np.array([5, 9]), np.array([3, 4000]), 5, 128, 512)
    assert where.tolist() == [0, 100, 200, 300, 400] and len(set(scores.tolist())) == 1


MIX = "doc_id long, text string, source string, size string, target string"


def words(n):
    return " ".join(["w"] * n)


def plain_targets(sizes, weights, factor):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, target, over = sum(sizes.values()), {}, set()
    while True:
        rest = whole - sum(factor * sizes[s] for s in over)
        share = sum(weight[s] for s in names if s not in over)
        target = {s: factor * sizes[s] if s in over else rest * weight[s] / share for s in names}
        new = {s for s in names if s not in over and target[s] > factor * sizes[s]}
        if not new:
            return target
        over |= new


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = []
    for source, n in (("a", 900), ("b", 60), ("é", 500), (None, 200), ("c", 0), ("d", 2500)):
        rows += [(len(rows) + k, words(int(rng.lognormvariate(3, 1))), source, "x", "y") for k in range(n)]
    rows += [(None, None, "b", "", ""), (7, "", "a", "", ""), (8, " \n\t", "a", "", ""), (9, words(30), "b", "", ""), (9, words(30), "b", "", ""), (10, None, "empty", "", "")]
    frame = spark.createDataFrame(rows, MIX)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    wanted = plain_targets(sizes, (5, 2, 1), 3)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source], rel=1e-12)
        assert 0 <= r.taken == r.copies * r["size"] <= 3 * r["size"]
        assert r.target == 0 or r.copies in (math.floor(r.target / r.source_size), math.ceil(r.target / r.source_size - 1e-6))
        taken[r.source] += r.taken
    longest = max(len((r[1] or "").split()) for r in rows)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(0.02 * wanted[s], longest)
    again = mixing.mix(frame.repartition(5)).collect()
    key = lambda rows_: Counter((r.doc_id, r.source, r["size"], r.copies) for r in rows_)
    assert key(got) == key(again)
    assert mixing.mixed(frame).columns == frame.columns
    assert mixing.mixed(frame).count() == sum(r.copies for r in got)


def test_mixing_hot_sizes_and_nothing(spark):
    """Thousands of documents of one size in one source are spread over cells; an empty table gives none."""
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"))
    got = mixing.mix(frame).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 2 for r in got)
    cells = mixing.placed(frame, mixing.MixParams()).groupBy("src", "step", "salt").count()
    assert cells.agg(F.max("count")).first()[0] < 150
    assert mixing.mix(frame.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" \t\r\n\x0b\x0c", 0), ("a", 1), (" a b\nc ", 3), ("a b", 1), ("x" * 100_000 + " y", 2)])
def test_words_are_counted(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.n_words(F.col("t"))).first()[0] == n
