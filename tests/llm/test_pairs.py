"""Near-duplicates, repeated spans and benchmark leaks against brute force."""

import itertools
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import components, decontaminate, neardup, substring
from tallyforge.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same
from tests.conftest import SMALL
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


def shingles(text, n):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if len(found) >= n else {tuple(found)} - {()}


def brute_components(texts, n, percent):
    sets, up = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs, rows, n, percent):
    want, sizes = brute_components({r[0]: r[1] for r in rows}, n, percent)
    got = neardup.near_duplicates(docs, neardup.NearParams(shingle=n, percent=percent)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_are_split_and_still_joined(spark):
    """More near copies than a leaf and a cluster hold."""
    rng = random.Random(1)
    base = words(rng, 150).split()
    texts = {k: " ".join([w if j != k % 150 else f"new{k}" for j, w in enumerate(base)]) for k in range(300)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    small = neardup.NearParams(shingle=3, percent=85, leaf=16, cluster=64, levels=3, broadcast_ids=10)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, small).collect()}
    assert got == brute_components(texts, 3, 85)[0]


def test_a_large_star_cluster_is_confirmed_whole(spark):
    """Variants that are linked to their base only, or to one base of two, and more of them than a cluster holds."""
    rng = random.Random(3)
    bases = [words(rng, 100).split(), words(rng, 100).split()]
    texts = {5000 + k: " ".join(base) for k, base in enumerate(bases)}
    for k in range(1200):
        at = set(rng.sample(range(100), 2))
        texts[k] = " ".join([f"new{k}x{j}" if j in at else w for j, w in enumerate(bases[k % 2])])
    centres, others = [shingles(texts[5000 + k], 5) for k in range(2)], {k: shingles(texts[k], 5) for k in range(1200)}
    want = [{k for k, s in others.items() if k % 2 == c and 100 * len(s & centres[c]) >= 80 * len(s | centres[c])} for c in range(2)]
    assert len(want[0]) == len(want[1]) == 600
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    params = neardup.NearParams(cluster=128, block=50_000)
    reps = neardup.sketched(frame, params).select("doc_id", "sketch", "n_shingles")
    one = spark.createDataFrame([(k, 0) for k in texts if k], "vertex long, component long")
    found = components.components(neardup.confirmed_links(frame, reps, one, params)).collect()
    got = {r.vertex: r.component for r in found}
    assert got == {k: k % 2 for k in texts if k > 1}


def test_pairs_of_blocks_find_every_link():
    """Sets of all sizes, met as one block with another and as one with itself."""
    rng = random.Random(4)
    sets = []
    for _ in range(40):
        core = rng.sample(range(10_000), rng.randint(1, 60))
        for _ in range(6):
            own = {x if rng.random() < 0.93 else rng.randrange(10_000) for x in core}
            sets.append(np.array(sorted(own), dtype=np.uint64))
    plain = [set(s.tolist()) for s in sets]
    rows = np.arange(len(sets))
    for a, b in ((rows, rows), (rows[:90], rows[60:])):
        hits = neardup._set_hits(sets, b, 80)
        for i in a.tolist():
            want = [j for j in b.tolist() if j != i and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])]
            assert hits(i, rows).tolist() == want


def test_deduplicated_keeps_one_of_each(docs, rows):
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    want, _ = brute_components({r[0]: r[1] for r in rows}, 5, 80)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({i for i, c in want.items() if i == c})


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)}


def test_empty_tables(none):
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.deduplicated(none).count() == 0
    assert substring.removed_words(none).count() == 0


def brute_removed(rows, n):
    first = {}
    for i, t in ((r[0], r[1]) for r in rows):
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in ((r[0], r[1]) for r in rows):
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("params", [substring.SpanParams(), substring.SpanParams(shard_words=60, hot=3, crowd=2), substring.SpanParams(hot=4, crowd=100)])
def test_removed_words_equal_brute_force(docs, rows, params):
    """With the small bounds there are many shards, and most anchors' windows are dealt one by one, or both ways."""
    got = substring.removed_words(docs, params).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == brute_removed(rows, 13)


def test_rows_of_one_id_with_different_texts(spark):
    """They count as one document, and each gets a result of its own."""
    rng = random.Random(8)
    passage = words(rng, 30)
    rows = [(1, words(rng, 40)), (1, passage + " " + words(rng, 5)), (2, words(rng, 20) + " " + passage), (2, "short"), (2, None), (3, passage), (3, passage)]
    got = substring.removed_words(spark.createDataFrame(rows, "doc_id long, text string"), substring.SpanParams(crowd=2)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == brute_removed(rows, 13)


def test_a_hot_phrase_with_other_words_around_it(spark):
    """Six common words in all documents, thirteen in few: the hot anchors' windows are dealt one by one."""
    rng = random.Random(12)
    phrase, passage = words(rng, 6), words(rng, 16)
    rows = [(k, f"{words(rng, 12)} {passage if k % 9 == 0 else phrase} {words(rng, 12)} {phrase} {words(rng, 3)}") for k in range(90)]
    got = substring.removed_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), substring.SpanParams(hot=20, crowd=10)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == brute_removed(rows, 13)
    assert sum(r.n_removed for r in got) == 9 * 16


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(50):
        texts = [[rng.randint(0, 3) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for k, t in enumerate(texts):
            automaton.add(t, k)
        stream = [rng.randint(0, 3) for _ in range(30)]
        held = lambda x: next((k for k, t in enumerate(texts) if any(t[i : i + len(x)] == x for i in range(len(t)))), -1)
        want = [max(n for n in range(i + 2) if n == 0 or held(stream[i + 1 - n : i + 1]) >= 0) for i in range(len(stream))]
        assert automaton.statistics(stream) == want
        assert automaton.first_owners(stream, 3) == [held(stream[i : i + 3]) for i in range(len(stream) - 2)]


def test_spans_against_a_reference(docs, rows, spark):
    passage = next(r[1] for r in rows if r[0] == 13)
    found = substring.against_reference(docs, spark.createDataFrame([(passage,), (None,)], "text string")).collect()
    assert {(r.doc_id, r.n_words) for r in found} == {(12, 40), (13, 40), (15, 40)}
    assert next(r.start for r in found if r.doc_id == 15) == 200


def leaks(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_leaks_survive_substitution_and_clean_documents_stay(spark, docs, rows):
    rng = random.Random(9)
    passage = next(r[1] for r in rows if r[0] == 13).split()
    changed = [w if k % 9 != 4 else "other" for k, w in enumerate(passage)]
    found = leaks(spark, docs, [(1, " ".join(passage)), (2, " ".join(changed)), (3, words(rng, 30)), (4, None), (5, ""), (6, "Word"), (7, "Word")])
    assert {k for k in found if k[1] == 1} == {(12, 1), (13, 1), (15, 1)}
    assert {k for k in found if k[1] == 2} == {(12, 2), (13, 2), (15, 2)}
    assert found[12, 1].matched_words == 40 and found[12, 1].start_word == 60
    assert found[12, 2].matched_words == 40 - sum(k % 9 == 4 for k in range(40))
    assert not [k for k in found if k[1] in (3, 4, 5)]
    assert (4, 6) in found and (4, 7) in found
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, " ".join(changed))], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r[0] for r in rows if r[0] not in (12, 13, 15))


def test_leaks_of_a_benchmark_that_is_not_broadcast(spark, docs, rows):
    items = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows) if r[1] and len(r[1].split()) > 20], "item_id long, text string")
    one = decontaminate.overlaps(docs, items).collect()
    many = decontaminate.overlaps(docs, items, decontaminate.LeakParams(few_seeds=0, few_words=0, filter_bits=16)).collect()
    assert sorted(one) == sorted(many) and one


def test_leaks_of_empty_tables(spark, docs, none):
    assert leaks(spark, none, [(1, "a b c d e f g h i j k l m n")]) == {}
    assert decontaminate.overlaps(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def escapes(params, size, span, equal):
    """Whether some overlap of that many words, of which so many are equal, escapes the masks of an item of the size."""
    masks = [[j for j, m in enumerate(mask) if m == "1"] for mask in params.masks_for(size)]
    for gone in itertools.combinations(range(1, span - 1), span - equal):
        same = [j not in gone for j in range(span)]
        if not any(all(same[a + j] for j in mask) for mask in masks for a in range(span - mask[-1])):
            return gone
    return None


def test_no_overlap_escapes_the_masks():
    """All placements of a fifth of replaced words in up to 25 words, for the masks of every size of item."""
    params = decontaminate.LeakParams()
    for size in range(1, 17):
        needed = params.needed(size)
        for span in range(needed, min(size, 16) + 1):
            if needed >= params.identity * span:
                assert escapes(params, size, span, needed) is None, (size, span)
    for span in range(17, 26):
        assert escapes(params, 99, span, max(13, span - span // 5)) is None


def brute_overlaps(docs, items, params):
    out = {}
    for d, text in docs:
        for i, item in items:
            x, y = text.split(), item.split()
            best = None
            for diagonal in range(-len(y), len(x)):
                low, high = max(0, -diagonal), min(len(y), len(x) - diagonal)
                if low < high:
                    run = decontaminate.best_run(np.array([x[j + diagonal] == y[j] for j in range(low, high)]), params.identity)
                    if run and run[2] >= params.needed(len(y)):
                        key = (run[2], -(low + diagonal + run[0]), -(run[1] - run[0]), -(low + run[0]))
                        best = key if best is None or key > best else best
            if best:
                out[d, i] = (best[0], -best[1], -best[2], -best[3])
    return out


def test_overlaps_equal_brute_force(spark):
    """Passages with a fifth of their words replaced, at random and at every fifth word, short items, and repetitive texts."""
    rng = random.Random(21)
    params = decontaminate.LeakParams()
    items = [(k, words(rng, n)) for k, n in enumerate([3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 25, 40, 100])]
    items += [(90, "very " * 30), (91, "a b " * 12)]
    docs = [(1, "very " * 400), (2, "b a " * 300), (3, words(rng, 300))]
    for k, item in items[:18]:
        own = item.split()
        for j, gone in enumerate([set(range(4, len(own), 5)), set(rng.sample(range(len(own)), len(own) // 5)), set(rng.sample(range(len(own)), len(own) // 4))]):
            docs.append((100 + 10 * k + j, " ".join([words(rng, 7), *["new" if n in gone else w for n, w in enumerate(own)], words(rng, 7)])))
    found = leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), items)
    want = brute_overlaps(docs, items, params)
    assert {k: (r.matched_words, r.start_word, r.n_words, r.item_start_word) for k, r in found.items()} == want
    assert all((100 + 10 * k, k) in want for k in range(8, 18))


def test_best_run_is_exact():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        same = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 25))])
        want = None
        for i in range(len(same)):
            for j in range(i, len(same)):
                n = int(same[i : j + 1].sum())
                if same[i] and same[j] and n >= 0.8 * (j - i + 1) - 1e-9 and (want is None or (n, -(j - i), -i) > (want[2], -(want[1] - want[0] - 1), -want[0])):
                    want = (i, j + 1, n)
        assert decontaminate.best_run(same, 0.8) == want


def test_word_rows_ignore_case_and_signs():
    rows = list(decontaminate.word_rows(pa.array(["Alpha, beta!", "alpha BETA"])))
    _, _, hashes, bounds = rows[0]
    assert Counter(hashes[: bounds[1]].tolist()) == Counter(hashes[bounds[1] :].tolist())


def test_case_accents_and_signs_beyond_ascii_hide_no_leak(spark):
    item = "Doesbo dora el ñ es queasarjarr mente ciónmiírr asesrr ños ueíos ueie osesgaiedo esci llar"
    texts = [item.upper(), unicodedata.normalize("NFD", item), "«" + item.replace(" ", "\u00a0— ") + "»", "“" + item.replace(" ", "” “") + "…", "Größe é à ü " * 20, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {k for k, _ in leaks(spark, docs, [(1, item)])} == {0, 1, 2, 3}
