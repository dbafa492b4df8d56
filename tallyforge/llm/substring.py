"""Removal of repeated word spans with suffix automata.

`SuffixAutomaton` holds every substring of the sequences put into it, each state with the first sequence that had its substrings. Streaming a text
through it gives the matching statistics: at each word, the longest suffix that the reference holds, and where it was first seen. Stretches of at least
`window` words that a smaller document holds are removed.

Against a given reference (`against_reference`) the reference is cut into shards of bounded size; each shard's automaton is broadcast and all
documents stream through it.

Against the corpus itself (`removed_words`) the reference grows with the documents, and broadcasting all of it to all of them would be quadratic. So the
reference is cut by content, and a filter names the shards that a piece of a document can match in:

1. Of each window of `window` words the run of `anchor` words with the smallest hash is its anchor; equal windows have equal anchors, and only places
   whose anchor another document has too go on. Only positions are shuffled for this.
2. The words around such an anchor, which hold every window that contains it, are a piece; the anchor's hash deals it to one of the shards of about `shard_words`
   words. An anchor with `hot` places and more would fill a shard alone: there each window is a piece of its own, dealt by the hash of its words, so that no
   shard grows with one phrase. Equal pieces of a batch of documents are one row with the places they stand at.
3. A shard's pieces stream by ascending document through the automaton of all that came before; the matching statistics give the spans of `window` words and more
   that smaller documents hold. Then the piece joins the automaton.
4. The spans go back to their documents, whose texts were shuffled once for this and step 2.

The filter removes nothing: that is left to the automata, which compare words (as 32-bit hashes, thirteen in a row).

Defined results: null texts have no words; documents of fewer words than a window keep all; windows repeated only inside one document stay; rows of
equal id count as one document for the comparison and each get their own result, whether their texts are equal or not; rows with a null id are dropped; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.textcore import document_words, lean, mix, ngram_hashes, within_rows


@dataclass(frozen=True)
class SpanParams:
    """window: words of the shortest span that counts. anchor: words of an anchor. shard_words: reference words of one automaton, as expected.

    hot: places of an anchor from which on its windows are dealt one by one. crowd: documents of a batch from which on an anchor they share is settled there.
    """

    window: int = 13
    anchor: int = 5
    shard_words: int = 60_000
    hot: int = 4096
    crowd: int = 64


class SuffixAutomaton:
    """A generalised suffix automaton over integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def add(self, symbols: list[int], owner: int) -> None:
        """Puts a sequence in; owners must not descend."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(owner)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = cur
            else:
                last = self._split(last, c, q)

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, symbols: list[int]) -> list[int]:
        """Length of the longest suffix at each symbol that the reference holds."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            out.append(size)
        return out

    def first_owners(self, symbols: list[int], window: int) -> list[int]:
        """The first owner of every window of a sequence; -1 where the reference lacks it."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, size, out = 0, 0, []
        for k, c in enumerate(symbols):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                size = length[state]
            if k >= window - 1:
                out.append(first[state] if size >= window else -1)
        return out


def anchors_of(words: np.ndarray, bounds: np.ndarray, params: SpanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, and the hash of every run of params.anchor words."""
    grams = ngram_hashes(words, params.anchor)
    span = params.window - params.anchor + 1
    ok = within_rows(bounds, params.window, len(words))
    count = len(ok)
    if not count:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), grams
    best, at = grams[:count].copy(), np.zeros(count, dtype=np.int64)
    for j in range(1, span):
        here = grams[j : j + count]
        less = here < best
        best[less] = here[less]
        at[less] = j
    starts = np.flatnonzero(ok)
    return starts, starts + at[ok], grams


#: What is known of a row in the task that made it: nothing, that its anchor is shared and it stands for the rest, or that it is one of the rest.
ALONE, STANDS_FOR, SETTLED = 0, 1, 2
#: How a marked anchor's windows are dealt: together, one by one, or both ways where it is not known which the others take.
TOGETHER, SINGLY, BOTH = 0, 1, 2


def _spread(docs: np.ndarray) -> np.ndarray:
    """Routes that deal rows evenly, whatever their anchors."""
    return mix(docs.astype(np.uint64)).view(np.int64)


def _anchor_rows(params: SpanParams):
    """Anchors with what one batch knows of them: of an anchor that many of its documents share only one row goes to the anchor's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            anchors, docs, kinds, places = [], [], [], []
            for at, to, words, bounds in document_words(False, batch.column(2)):
                _, place, grams = anchors_of(words, bounds, params)
                place = np.unique(place)
                row = np.searchsorted(bounds, place, side="right") - 1
                anchors.append(grams[place].view(np.int64))
                docs.append(ids[at:to][row])
                kinds.append(variants[at:to][row])
                places.append((place - bounds[row]).astype(np.int32))
            if not sum(map(len, anchors)):
                continue
            anchor, doc, variant, place = np.concatenate(anchors), np.concatenate(docs), np.concatenate(kinds), np.concatenate(places)
            order = np.lexsort((doc, anchor))
            anchor, doc, variant, place = anchor[order], doc[order], variant[order], place[order]
            begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            end = np.append(begin[1:], len(anchor))
            crowd = (doc[begin] != doc[end - 1]) & (end - begin >= params.crowd)
            state = np.where(np.repeat(crowd, end - begin), SETTLED, ALONE).astype(np.int8)
            state[begin[crowd]] = STANDS_FOR
            route = np.where(state == SETTLED, _spread(doc), anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), pa.array(doc), pa.array(variant), pa.array(place.astype(np.int64) * 4 + state)], names=["route", "doc_id", "variant", "place"]
            )

    return run


def _repeated(params: SpanParams):
    """Of rows sorted by anchor and document, those whose anchor more than one document has, as marks: 4 * position + how their windows are dealt.

    Holds `hot` rows of one anchor at a time, or those of one document.
    """

    def marks(batch: pa.RecordBatch, dealt: np.ndarray) -> pa.RecordBatch:
        mark = batch.column(3).to_numpy() // 4 * 4 + dealt
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(mark)], names=["doc_id", "variant", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the newest anchor, while it is not known how its rows are dealt
        last, first_doc, n, shared, told = None, None, 0, False, False

        def closing() -> Iterator[pa.RecordBatch]:
            if shared and not told:
                for some in held:
                    yield marks(some, np.full(some.num_rows, TOGETHER))

        for batch in batches:
            settled = batch.column(3).to_numpy() % 4 == SETTLED
            if settled.any():
                yield marks(batch.filter(pa.array(settled)), np.full(int(settled.sum()), BOTH))
                batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            anchor, doc, state = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy() % 4
            begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            end = np.append(begin[1:], len(anchor))
            if last is not None and anchor[0] == last:  # the newest anchor goes on
                size = int(end[0])
                n += size
                shared = shared or bool((doc[:size] != first_doc).any() or (state[:size] == STANDS_FOR).any())
                held.append(batch.slice(0, size))
                if shared and (told or n >= params.hot):
                    told = True
                    for some in held:
                        yield marks(some, np.full(some.num_rows, SINGLY))
                    held = []
                batch = batch.slice(size)
                anchor, doc, state, begin, end = anchor[size:], doc[size:], state[size:], begin[1:] - size, end[1:] - size
                if not len(begin):
                    continue
            yield from closing()
            # All anchors but the newest are whole here.
            many = (doc[begin] != doc[end - 1]) | np.logical_or.reduceat(state == STANDS_FOR, begin)
            dealt = np.where(end - begin >= params.hot, SINGLY, TOGETHER)
            keep = np.repeat(many, end - begin)
            keep[begin[-1] :] = False
            if keep.any():
                yield marks(batch.filter(pa.array(keep)), np.repeat(dealt, end - begin)[keep])
            last, first_doc, n, shared = anchor[-1], doc[begin[-1]], int(end[-1] - begin[-1]), bool(many[-1])
            held, told = [batch.slice(int(begin[-1]))], False
            if shared and n >= params.hot:
                told = True
                yield marks(held[0], np.full(n, SINGLY))
                held = []
        yield from closing()

    return run


#: The first place of a piece, and the others, if there are any, as 64-bit numbers: document, variant and start of each.
_PIECE = "shard int, owner long, variant long, start int, words binary, others binary"


def _pieces(params: SpanParams, shards: int):
    """The pieces at the marks of rows (doc_id, variant, text, marks), equal ones as one row with their places by ascending document."""
    reach = params.window - params.anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants, marks = batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist(), batch.column(3)
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for at, to, words, bounds in document_words(False, batch.column(2)):
                starts, anchor, grams = anchors_of(words, bounds, params)
                home = (mix(grams) % np.uint64(shards)).astype(np.int64).tolist()
                single = None
                small = words.astype("<u4")
                edges = bounds.tolist()
                for r in range(at, to):
                    a, b = edges[r - at], edges[r - at + 1]
                    for mark in np.unique(np.asarray(marks[r].values)).tolist():
                        p, dealt = a + (mark >> 2), mark & 3
                        if dealt != SINGLY:
                            low = max(a, p - reach)
                            key = (home[p], small[low : min(b, p + params.window)].tobytes())
                            found.setdefault(key, []).append((ids[r], variants[r], low - a))
                        if dealt != TOGETHER:
                            if single is None:
                                single = mix(ngram_hashes(words, params.window) ^ np.uint64(params.window)) % np.uint64(shards)
                            k, end = np.searchsorted(starts, [max(a, p - reach), p + 1])
                            for low in starts[k:end][anchor[k:end] == p].tolist():
                                key = (int(single[low]), small[low : low + params.window].tobytes())
                                found.setdefault(key, []).append((ids[r], variants[r], low - a))
            if found:
                places = [sorted(set(spots)) if len(spots) > 1 else spots for spots in found.values()]
                first = list(zip(*[spots[0] for spots in places]))
                others = [np.array(spots[1:], dtype="<i8").tobytes() if len(spots) > 1 else None for spots in places]
                columns = [[k[0] for k in found], *first, [k[1] for k in found], others]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _PIECE.split(", ")])

    return run


def _stream(params: SpanParams):
    """Over pieces sorted by shard and first document: the spans that smaller documents hold, as the automaton of all pieces before finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, known = None, SuffixAutomaton(), {}
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for shard, owner, variant, start, blob, others in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    now, automaton, known = shard, SuffixAutomaton(), {}
                firsts = known.get(blob)
                if firsts is None:
                    words = np.frombuffer(blob, "<u4").tolist()
                    firsts = automaton.first_owners(words, params.window)
                    automaton.add(words, owner)
                    firsts = known[blob] = [owner if f < 0 else f for f in firsts]
                least = min(firsts)
                spots = [(owner, variant, start), *(np.frombuffer(others, "<i8").reshape(-1, 3).tolist() if others else ())]
                for doc, kind, at in spots:
                    if least < doc:
                        for low, n in _covered(firsts, doc, params.window):
                            for column, value in zip(out, (doc, kind, (at + low) << 16 | n)):
                                column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "variant", "span"])

    return run


def _covered(firsts: list[int], doc: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, words) of the maximal runs of windows whose first document is smaller."""
    begin = None
    for k, first in enumerate(firsts):
        if first < doc:
            begin = k if begin is None else begin
        elif begin is not None:
            yield begin, k - 1 - begin + window
            begin = None
    if begin is not None:
        yield begin, len(firsts) - 1 - begin + window


def _without(params: SpanParams):
    """doc_id, n_words, n_removed, kept of rows (doc_id, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n_words, n_removed, kept = [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2)):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n_words.append(len(words))
                    if spans.is_valid:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        at, n = np.asarray(spans.values) >> 16, np.asarray(spans.values) & 0xFFFF
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + n, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist()) if s]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def with_variants(documents: DataFrame) -> DataFrame:
    """doc_id, variant, text: rows of one id have different variants where their texts differ; without repeated ids the variant is 0."""
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    variant = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")
    return rows.select("doc_id", variant.alias("variant"), "text")


def repeated_spans(texts: DataFrame, params: SpanParams = SpanParams()) -> DataFrame:
    """doc_id, variant, spans: 65536 * start + words of the runs of each text that windows of smaller documents cover. texts: as from with_variants."""
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / 6 / params.shard_words))
    key = ["doc_id", "variant"]
    rows = texts.mapInArrow(lean(_anchor_rows(params)), "route long, doc_id long, variant long, place long")
    hits = rows.repartition("route").sortWithinPartitions(F.col("place") % 4 == SETTLED, "route", "doc_id").mapInArrow(lean(_repeated(params)), "doc_id long, variant long, mark long")
    marks = hits.groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    pieces = texts.join(marks, key).select(*key, "text", "marks").mapInArrow(lean(_pieces(params, shards)), _PIECE)
    spans = pieces.repartition("shard").sortWithinPartitions("shard", "owner").mapInArrow(lean(_stream(params)), "doc_id long, variant long, span long")
    return spans.groupBy(*key).agg(F.collect_set("span").alias("spans"))


def removed_words(documents: DataFrame, params: SpanParams = SpanParams()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes of the kept words joined by a blank)."""
    texts = with_variants(documents)
    rows = texts.join(repeated_spans(texts, params), ["doc_id", "variant"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lean(_without(params)), "doc_id long, n_words long, n_removed long, kept binary")


def against_reference(documents: DataFrame, reference: DataFrame, params: SpanParams = SpanParams()) -> DataFrame:
    """doc_id, start, n_words: maximal spans of at least params.window words that a reference text (column text) holds.

    One pass over the documents for each shard of about params.shard_words reference words; spans of different shards are merged.
    """
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = reference.where(F.col("text").isNotNull()).select("text")
    chars = held.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / 6 / params.shard_words))
    spark, found = documents.sparkSession, None
    for k in range(shards):
        part = held.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k)
        automaton = SuffixAutomaton()
        for row in part.toLocalIterator():  # one shard, which is bounded
            for _, _, words, _ in document_words(False, pa.array([row[0]])):
                automaton.add(words.astype("<u4").tolist(), 0)
        model = spark.sparkContext.broadcast((automaton.next, automaton.link, automaton.length, automaton.first))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            own = SuffixAutomaton()
            own.next, own.link, own.length, own.first = model.value
            for batch in batches:
                ids, out = batch.column(0).to_numpy(), []
                for at, to, words, bounds in document_words(False, batch.column(1)):
                    small = words.astype("<u4")
                    for r in range(to - at):
                        stats = own.statistics(small[bounds[r] : bounds[r + 1]].tolist())
                        for i, n in enumerate(stats):
                            if n >= params.window and (i + 1 == len(stats) or stats[i + 1] <= n):
                                out.append((int(ids[at + r]), i + 1 - n, n))
                if out:
                    cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_words"])

        here = texts.mapInArrow(lean(run), "doc_id long, start int, n_words int")
        found = here if found is None else found.unionByName(here)
    return found.distinct()
