"""Archives, page text and vector search: round trips, labelled pages and brute force."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import extract, html_tree, mtree, warc
from tallyforge.llm.textcore import scratch_dir


def test_arc_versions_and_lengths():
    block = b"HTTP/1.1 200 OK\r\n\r\nhttp://not.a/header 1.2.3.4 20200101000000 text/html 5\nx"
    one = warc.version_block("1", "a.arc", "20200101000000") + b"\n" + warc.arc_header("1", "http://a/ b", "20200102030405", "text/html", len(block)) + block + b"\n\n"
    two = warc.version_block("2", "a.arc", "20200101000000") + b"\n" + warc.arc_header("2", "http://a/", "20200102030405", "text/html", len(block)) + block + b"\n"
    for data, url in ((one, "http://a/ b"), (two, "http://a/")):
        records = list(warc.read_arc(io.BytesIO(data)))
        assert [r.url for r in records] == ["filedesc://a.arc", url]
        assert records[1].block == block and records[1].date == "20200102030405"
        assert data[records[1].offset :].startswith(url.encode())
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_arc(io.BytesIO(one[:-40])))
    with pytest.raises(ValueError, match="no ARC header"):
        list(warc.read_arc(io.BytesIO(b"nonsense\n")))


def test_archives_round_trip(spark):
    trap = "WARC/1.0\r\n\r\nhttp://x 1 2 text/html 3\n"
    rows = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "http://b c\n", ""), (4, "http://d", trap), (5, "http://e", trap), (6, "http://f", "<p>é</p>"), (7, "http://g", "\r\n\r\n"), (None, "http://h", "z"), (8, "http://i", "z"), (9, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 6), 2: ("revisit", 3), 4: ("revisit", 5), None: ("revisit", 8)}
    large = {r.page_id: r.record_type for r in warc.archived(pages, least_bytes=5).collect()}
    assert large[2] == large[3] == large[8] == "response" and large[1] == "revisit"


def test_converted_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "one"), (2, "http://b", "one")], "page_id long, url string, html string").coalesce(1)
    arc, out = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    found = []
    for (content,) in spark.read.format("binaryFile").load(out).select("content").collect():
        found += list(warc.read_warc(io.BytesIO(gzip.decompress(content))))
    kinds = [f["warc-type"] for f, _ in found]
    assert sorted(kinds) == ["response", "revisit", "revisit", "warcinfo"]
    assert len({f["warc-record-id"] for f, _ in found}) == 4
    response = next(f["warc-record-id"] for f, _ in found if f["warc-type"] == "response")
    assert all(f["warc-refers-to"] == response and not warc.payload_of(b)[1] for f, b in found if f["warc-type"] == "revisit")


def test_archives_of_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def text_of(source):
    model = extract.fit(extract.labelled_pages(200))
    page = html_tree.parse(source)
    return extract.page_text(page, extract.marginals([page], model)[0])


def test_page_text():
    source = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies <button>OK</button></div><article><h1>A  title &amp; more</h1><p>First\n paragraph with <b>bold</b> &eacute;.<p>Second one, &#228; of some length here.'
        '<div class="ad">Buy this now</div><script>var x = "<p>no</p>";</script><ul><li>item one is here</li><li>item two is here</li></ul></article>'
        '<section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this.</p></div></section>'
        '<aside class="sidebar"><h2>Related</h2><ul><li><a href="/c">Other story</a></li></ul></aside><form class="newsletter"><label>Mail</label><input></form><footer>&copy; 2024 Site</footer></body></html>'
    )
    assert text_of(source) == "A title & more\nFirst paragraph with bold é.\nSecond one, ä of some length here.\nitem one is here\nitem two is here"


def test_pages_at_the_edges(spark):
    rows = [(1, None), (2, ""), (3, "no markup at all"), (4, "<p unclosed"), (5, "<" * 2000), (6, "<div>" * 3000 + "deep"), (7, "<script>while(1)"), (8, "</p></div>")]
    pages = spark.createDataFrame([(i, "u", h, "old") for i, h in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract.extracted(pages).collect()}
    assert got[1] == got[2] == got[4] == got[7] == got[8] == ""
    assert extract.extracted(pages.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    model = extract.fit(extract.labelled_pages(60))
    page = html_tree.parse('<div class="main"><p>one two three</p><div class="ad"><a href="x">buy</a></div></div><footer>end</footer>')
    shown = extract.marginals([page], model)[0]
    chars, linked = extract._totals(page)
    n = len(page.parent)
    total, on = 0.0, np.zeros(n)
    for code in range(1 << n):
        labels = [(code >> k) & 1 for k in range(n)]
        score = model.prior[labels[0]] + sum(model.step[labels[page.parent[k]], labels[k]] for k in range(1, n))
        score += sum(labels[k] * sum(model.weight.get(f, 0.0) for f in extract._features(page, k, chars[k], linked[k])) for k in range(n))
        total += np.exp(score)
        on += np.exp(score) * np.array(labels)
    assert np.allclose(shown, on / total)


def test_extraction_on_held_out_layouts():
    model = extract.fit(extract.labelled_pages())
    right = wrong = missed = 0
    for source in extract.labelled_pages(150, seed=77):
        page = html_tree.parse(source)
        shown = extract.marginals([page], model)[0] >= 0.5
        for k, label in enumerate(page.label):
            right += page.text_chars[k] * (shown[k] and label == 1)
            wrong += page.text_chars[k] * (shown[k] and label != 1)
            missed += page.text_chars[k] * (not shown[k] and label == 1)
    assert right / (right + wrong) > 0.94 and right / (right + missed) > 0.97


def brute_top(rows, k):
    sound = [(i, np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    sound = list({(i, tuple(v.tolist())): (i, v) for i, v in sound}.values())
    out = []
    for i, q in sound:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in sound if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # equal vectors: ties and a page that cannot be split
    rows += [(2000, None), (2100, []), (2200, [1.0, None] * 8), (2300, [float("nan")] * 16), (2400, [float("inf")] * 16), (2500, [0.5, 0.25]), (2501, [0.1, 0.2]), (2600, [0.0] * 16), (2601, [3e4] * 16), rows[7], rows[100]]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, dim string")
    vectors = frame.select("vec_id", mtree.quantised(F.col("embedding")).alias("v"))
    got = mtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10, mtree.TreeParams(shard_rows=300, page=16, fanout=4, block=4)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 10)
    assert mtree.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_search_passes_over_most_of_a_clustered_set():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1000, (40, 8))
    raw = np.rint(np.concatenate([c + rng.normal(0, 5, (100, 8)) for c in centres])).astype(np.int64)
    points, top = mtree.lifted(raw.astype(np.float64))
    pages = mtree.bulk_load(points, mtree.TreeParams())
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]

    found = mtree.search(pages, top, raw.view(Counted), np.arange(4000), raw[123], 123, 10)
    want = sorted(((int(raw[123] @ v), -j) for j, v in enumerate(raw) if j != 123), reverse=True)[:10]
    assert found == [(s, -j) for s, j in want]
    assert sum(seen) < 2000
