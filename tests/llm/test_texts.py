"""Classifier, language identification, personal data and packing: edges, brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import langid, packing, pii, quality
from tallyforge.llm.queries import QUERIES
from tests.conftest import SMALL

DOC_SF = "/root/testdata/sf0.01"

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "p_q%r@s-t.u.v", "1.2.3.4", "256.1.1.1", "0255.01.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (234) 555-0000",
             "+49.30.123456", "+1((((", "+", "@", ".", " ", "-", "é", "日", "\u0001", "12", "7", "a", "\n", "_d@e.fg", "𝒳"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "1" * 5000, "1 " * 5000, "a" * 20000 + "@b.c", "a@" * 3000, "1." * 4000, "4111 1111 1111 1111 " * 300, "x.y@z.com" * 200, "+1-" * 3000 + "5"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_base_spans(frame).select("doc_id", pii.listed(pii.F.col("base_spans")).alias("s")).collect()
    for r in rows:
        assert r.s == ",".join(base_spans(texts[r.doc_id])), repr(texts[r.doc_id])[:200]


def test_terms_that_reveal_are_generalised_or_removed(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(300)]
    for k in range(0, 300, 50):
        texts[k] += f" zorblat jan.{0}@mail.example.com the quiet end {k}"
    for k in range(1, 300, 3):
        texts[k] += " quiet the end"
    rows = [(k, t, "kept", len(t)) for k, t in enumerate(texts)] + [(900, None, "kept", 0), (901, "", "kept", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _terms string, n_chars long")
    spans = {r.doc_id: r.term_spans for r in pii.with_spans(frame.select("doc_id", "text")).collect()}
    for k, t in enumerate(texts):
        told = {t[s.start : s.end] for s in spans[k]}
        assert told == ({"zorblat"} if "@" in t else set()), told
    out = pii.sanitise(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    assert "[EMAIL]" in got[0].text and "@" not in got[0].text and "zorblat" not in got[0].text
    assert got[1].text == texts[1] and got[900].text is None and got[901].text == ""
    assert all(r.n_chars == len(r.text or "") and r._terms == "kept" for r in got.values())


def test_pii_query_over_whole_documents(spark, duck):
    rows = {r.doc_id: r for r in QUERIES["op5_pii"](spark, SMALL).collect()}
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        want = base_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
        assert set(want) <= set(rows[i].spans.split(","))


def test_sanitise_empty(none):
    assert pii.sanitise(none).count() == 0


def held_out_labels():
    import duckdb

    return dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{DOC_SF}/labels.parquet'").fetchall())


def test_quality_is_right_on_held_out_documents(spark):
    rows = QUERIES["op7_quality"](spark, DOC_SF).collect()
    labels = held_out_labels()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(6, 1), (6, 0), (17, 1), (None, 1), (20, None), (25, 1), (30, 0)], "doc_id long, quality int")
    kept = quality.reject(docs, labels)
    assert kept.columns == docs.columns and {r.quality_score for r in kept.collect()} <= {"q"}
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == len(rows)
    assert len({r.quality_score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    blank = quality.fit(none, labels.limit(0))
    assert {r.quality_score for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.reject(none, labels).count() == 0


def test_quality_features_do_not_depend_on_the_batch():
    texts = pa.array(["One two two THREE!! 4", None, "", "a b c " * 50])
    whole = list(quality.feature_rows(texts, 18))
    parts = [x for k in range(4) for x in quality.feature_rows(texts.slice(k, 1), 18)]
    at = np.concatenate([w[3] for w in whole])
    assert at.tolist() == np.concatenate([p[3] for p in parts]).tolist()


def test_ftrl_learns_a_separable_rule():
    rng = np.random.default_rng(1)
    examples = [(np.array(sorted(rng.choice(50, 8, replace=False)) + [60 + (k % 2)]), np.full(9, 1 / 3)) for k in range(400)]
    y = np.array([k % 2 for k in range(400)], dtype=float)
    w = quality.ftrl(examples, y, quality.QualityParams(bits=7))
    right = [((v @ w[a] + w[-1]) > 0) == bool(t) for (a, v), t in zip(examples, y)]
    assert np.mean(right) > 0.99


def test_language_is_right_on_held_out_documents(spark):
    import duckdb

    langs = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{DOC_SF}/documents.parquet'").fetchall())
    held = [r for r in QUERIES["op9_langid"](spark, DOC_SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_language_edges(spark, docs, none):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("le chat noir", "fr"), ("the black cat", "en"), ("der schwarze hund", "de")] * 12)]
    train = spark.createDataFrame([*rows, (99, "x y z", None), (98, None, "en")], "doc_id long, text string, lang string")
    profiles = langid.fit(train)
    assert sorted(profiles) == ["de", "en", "fr"]
    probe = spark.createDataFrame([(1, "THE BLACK CAT", "old"), (2, None, "old"), (3, "", "old"), (4, "123 !!", "old"), (5, "Schwarze", "old"), (6, "日本", "old")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(probe, profiles).collect()}
    assert (got[1].lang_pred, got[5].lang_pred) == ("en", "de")
    assert all(got[k].lang_pred == "und" and got[k].lang_score == 0 for k in (2, 3, 4))
    assert got[6].lang_pred in profiles and 0 <= got[6].lang_score <= 1
    assert langid.fit(none) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_out_of_place_distance_equals_brute_force():
    params = langid.LangParams(orders=(1, 2), profile=20, document=10)
    text = "abra kadabra"
    (_, _, row, gram, n) = next(iter(langid.gram_rows(pa.array([text]), params)))
    grams = re.findall("[a-z]", text)
    padded = f" {text} "
    grams += [padded[k : k + 2] for k in range(len(padded) - 1)]
    assert sorted(n.tolist()) == sorted(__import__("collections").Counter(grams).values())


def check_pieces(rows, tokens, window=2048):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        assert any(ids.tolist() == t[r.start : r.start + r.length] and r.doc_tokens == len(t) for t in tokens[r.doc_id])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0
    for doc, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, tokens[doc]))
    assert set(by_doc) == set(tokens)


@pytest.mark.parametrize("block_tokens", [4_000_000, 3_000])
def test_packing_holds_every_token_once(docs, rows, block_tokens):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    tokens = {}
    for r in rows:
        tokens.setdefault(r[0], []).append([*slow.encode(r[1] or "", add_special_tokens=False).ids, 1])
    got = packing.pack(docs, packing.PackParams(window=256, shard_docs=16, block_tokens=block_tokens)).collect()
    check_pieces(got, tokens, 256)


def test_packing_of_an_empty_table(none):
    assert packing.pack(none).count() == 0


def test_both_tokenizers_give_the_same_ids():
    texts = ["It's 'we'll  two  blanks\n\n and\ttabs ", "<|endoftext|> inside", "Größe, façade ÀÉ", "日本語 emoji 🎉 x y z", "\u0085a\u001cb", "", "１２ ٣ ½ǅ", "a\r\nb "]
    fast = packing.Encoder(packing.tokenizer_path(), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    slow = packing.Encoder(packing.tokenizer_path())
    assert [list(map(int, x)) for x in fast.encode(pa.array(texts))] == [list(x) for x in slow.encode(pa.array(texts))]


def test_neighbours_share_windows():
    """A seed's window is filled with the documents on its own subject."""
    rng = np.random.default_rng(0)
    docs = [(k, 100, (rng.integers(0, 40, 100) + 100 * (k % 4)).astype("<u2").tobytes()) for k in range(80)]
    ids = [np.frombuffer(d[2], "<u2") for d in docs]
    held = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=50257)
    idf = np.log1p((80 - held + 0.5) / (held + 0.5))
    filler = packing.Filler(500)
    packing.fill(docs, packing.Block(ids, idf, 100.0, packing.PackParams()), filler)
    filler.close()
    subjects = {}
    for (doc, _, _), _, _, seq, _ in filler.done:
        subjects.setdefault(seq, set()).add(doc % 4)
    assert np.mean([len(s) == 1 for s in subjects.values()]) >= 0.9
