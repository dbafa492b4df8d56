"""The corpus pipeline as a whole, and operators on what archives and pages may hold."""

import io
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import html_tree, langid, mtree, warc
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents, labels and a benchmark as files: good and bad texts, copies, a leak, personal data, null and empty texts, a null id."""
    rng = random.Random(6)
    good = lambda: words(rng, 120)
    bad = lambda: " ".join(["buy", "now", "click"] * 40)
    item, base = words(rng, 40), good()
    rows = [(k, good() if k % 3 else bad() + f" {k}") for k in range(120)]
    rows += [(200, base), (201, base), (202, base + " more"), (203, good() + " " + item), (204, good() + " write to jane.roe@example.org now"), (205, None), (206, ""), (None, good())]
    labels = [(k, int(k % 3 > 0), 0) for k in range(120)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows)


def test_stages_take_effect_and_keep_columns(spark, corpus):
    folder, texts = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, near, clean, private = seen
    assert not [k for k in quality if k is not None and k < 120 and k % 3 == 0]
    assert len([k for k in quality if k is not None and k < 120]) == 80
    assert 200 in near and 201 not in near and 202 not in near
    assert 203 in near and 203 not in clean
    assert set(private) == set(clean)
    assert "jane.roe@example.org" not in private[204] and "[EMAIL]" in private[204]
    assert private[200] == texts[200]


def test_run_packs_every_token_once(spark, corpus):
    folder, _ = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    spots = {}
    for p in pieces:
        spots.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    for own in spots.values():
        own.sort()
        assert own[0][0] == 0 and sum(n for _, n, _ in own) % own[0][2] == 0


def test_archives_keep_any_bytes(spark):
    payloads = [b"\xff\xfe\x00GIF89a\r\n\r\n", "café".encode("latin-1"), b"", None, b"WARC/1.0\r\n\r\n", b"plain", b"plain"]
    pages = spark.createDataFrame(list(enumerate([f"http://x/{k}" for k in range(len(payloads))])), "page_id long, url string")
    html = spark.createDataFrame(list(enumerate(payloads)), "page_id long, html binary")
    rows = {r.page_id: r for r in warc.archived(pages.join(html, "page_id")).collect()}
    assert len(rows) == len(payloads)
    for k, payload in enumerate(payloads):
        assert rows[k].payload_digest == warc.digest_of(payload or b"") and rows[k].payload_bytes == len(payload or b"")
    assert rows[5].record_type == "revisit" and rows[5].refers_to == 6 and rows[2].refers_to == 3


def test_runs_of_records_are_read_back(monkeypatch):
    monkeypatch.setattr(warc, "RUN_BYTES", 100)
    records = [warc.arc_header("1", f"http://x/{k}", "20240101000000", "text/html", 30) + bytes([65 + k]) * 30 for k in range(9)]
    rows = [b.column(0)[0].as_py() for b in warc._grouped(iter(records), b"\n", lambda row: b"")]
    assert len(rows) > 2
    read = list(warc.read_arc(io.BytesIO(b"\n".join(rows))))
    assert [r.block for r in read] == [bytes([65 + k]) * 30 for k in range(9)]


def test_unmatched_tags_take_linear_time():
    n = 30_000
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<div>" * n + "<tr>" * n, "<option><select>" + "<b>" * n + "<option></option>" * n):
        start = time.monotonic()
        html_tree.parse(page)
        assert time.monotonic() - start < 8


def test_searches_visit_few_shards_of_clustered_vectors(spark):
    """Four far-apart clusters: a query's best shard and the bounds tell that the others hold nothing as good; results equal brute force."""
    rng = np.random.default_rng(3)
    centres = np.array([[900, 0, 0, 0], [0, 900, 0, 0], [0, 0, 900, 0], [0, 0, 0, 900]])
    x = (centres[np.arange(400) % 4] + rng.integers(-20, 20, (400, 4))).astype(np.int64)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist())], "vec_id long, v array<long>")
    params = mtree.TreeParams(shard_rows=50, regions=4, rings=4, page=16, block=8)
    got = {}
    for r in mtree.top_k(frame, frame.where("vec_id % 20 = 0"), 5, params).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 20):
        scores = x @ x[q]
        order = [k for k in np.lexsort((np.arange(400), -scores)).tolist() if k != q][:5]
        assert sorted(got[q]) == [(n + 1, k, int(scores[k])) for n, k in enumerate(order)]
    assert mtree.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_predictions_equal_plain_out_of_place_distances(spark):
    """Rank-order distances from profiles of plain counts, with repeated rows and null texts."""
    rng = random.Random(4)
    sets = {"aa": "abcde", "bb": "defgh", "cc": "ijklm"}
    rows = [(k, " ".join("".join(rng.choice(sets[lang]) for _ in range(4)) for _ in range(30)), lang) for k, lang in enumerate(list(sets) * 20)]
    rows += [rows[0], (900, None, "aa"), (901, "123 !", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).collect()}
    assert all(got[k] == lang for k, _, lang in rows if k < 900)
    assert got[900] == got[901] == "und"
