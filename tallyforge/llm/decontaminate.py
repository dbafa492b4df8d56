"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: positions marked 0 are ignored, so a window still matches after words there were
replaced. The hashes of all windows of the documents under all masks are joined with those of the benchmark. Every hit lies
on a diagonal (document position less benchmark position); along it the two word sequences are compared position by position, and
the longest run that keeps the asked share of equal words is the overlap. An overlap counts if it has enough equal words.

The masks lose no overlap: with 16 to 31 words of which at most a fifth are replaced, however they are placed, at least one of the six masks
meets equal words only (a test goes through all placements), and a longer overlap contains such a stretch. Shorter items have masks of their own
(`masks_for`), just as complete.

The words are runs of letters, digits and other characters beyond ASCII, in lower case and compatibility form, with general punctuation
between them, so neither punctuation nor case nor the way accents are written hides a leak, in any language.

The documents are read once. A bit filter of fixed size over the benchmark's hashes tells which of a document's hashes are worth joining; only documents
with such a hash are written, as numbers. The join is one by hash, salted where the benchmark is too large to be broadcast; equal hashes of one text are
one row with their places, so repetitive texts cost their length and not its square. Only the stretches around the hits meet the items' words.

Defined results: null and empty texts have no overlap; an item of up to four words is matched as one whole sequence; rows of one
doc_id are one document, rows of one item_id one item: of their several overlaps the one with most equal words counts, then the earlier. Rows
without an id are dropped. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.textcore import SLICE_ROWS, lean, mix, seeds, span_hashes, text_chunks, word_spans, written

_KEEP = np.zeros(256, dtype=bool)
_KEEP[0x30:0x3A] = True
_KEEP[0x41:0x5B] = True
_KEEP[0x61:0x7B] = True
_KEEP[0x80:] = True
SEPARATORS = ~_KEEP


#: Six masks of weight seven that no placement of replaced words in 16 to 31 words escapes, a fifth of them at most.
MASKS = ("11110111", "11101001011", "110011111", "11111000101", "1010111011", "111011011")


@dataclass(frozen=True)
class LeakParams:
    """masks: the spaced seeds of items of 16 words and more. min_words: equal words of an overlap, or min_share of the item if that is less. identity: least share
    of equal words. filter_bits: the filter has two to the power of it bits. few_seeds, few_words: most rows and words of the benchmark that are broadcast. salts: of
    a join by hash.
    """

    masks: tuple[str, ...] = MASKS
    min_words: int = 13
    min_share: float = 0.8
    identity: float = 0.8
    filter_bits: int = 26
    few_seeds: int = 200_000
    few_words: int = 2_000_000
    salts: int = 8

    def masks_for(self, size: int) -> tuple[str, ...]:
        """The masks of an item of so many words: none of its overlaps escapes them."""
        if size >= 16:
            return self.masks
        if size <= 4:
            return ("1" * size,)
        # In the overlaps of 8, 9 and 12 to 14 words four equal ones stand together, in the others three, or two beside two.
        return ("1111",) if size in (8, 9, 12, 13, 14) else ("111", "11011")

    def every_mask(self) -> tuple[str, ...]:
        return tuple(sorted({m for size in range(1, 17) for m in self.masks_for(size)}))

    def needed(self, size: int) -> int:
        return min(self.min_words, math.ceil(self.min_share * size - 1e-9))


def _spaced(data: np.ndarray) -> np.ndarray:
    """The bytes with blanks for the signs from U+0080 to U+00BF, from U+2000 to U+207F and from U+3000 to U+303F."""
    data = data.copy()
    two = np.flatnonzero(data[:-1] == 0xC2)
    three = np.flatnonzero(((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80)) | ((data[:-2] == 0xE3) & (data[1:-1] == 0x80)))
    for at, size in ((two, 2), (three, 3)):
        for k in range(size):
            data[at + k] = 0x20
    return data


def word_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, word hashes, where each row's words begin)."""
    for base in range(0, len(column), SLICE_ROWS):
        part = pc.fill_null(column.slice(base, SLICE_ROWS).cast(pa.large_string()), "")
        for at, to, data, offsets in text_chunks(pc.utf8_lower(pc.utf8_normalize(part, form="NFKC"))):
            data = _spaced(data)
            starts, ends, bounds = word_spans(data, offsets, SEPARATORS)
            yield base + at, base + to, span_hashes(data, starts, ends), bounds


_STEP = np.uint64(0xA0761D6478BD642F)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked words of every window of the mask's span; different masks hash differently."""
    count = max(0, len(words) - len(mask) + 1)
    acc = np.full(count, seeds(1, int(mask, 2) + 64 * len(mask))[0], dtype=np.uint64)
    for j, mark in enumerate(mask):
        if mark == "1":
            acc = (acc + words[j : j + count]) * _STEP
    return mix(acc)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter."""
    return h >> np.uint64(64 - bits), (h << np.uint64(bits)) >> np.uint64(64 - bits)


def best_run(same: np.ndarray, identity: float) -> tuple[int, int, int] | None:
    """(start, end, equal) of the run with most equal words whose share of equal ones is at least identity, both ends equal; the shortest, then first, of these."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return None
    # Between the i-th and j-th equal word lie j-i+1 equal ones out of hits[j]-hits[i]+1: with gain = rank - identity * place, the share suffices
    # if gain[i] <= gain[j] + 1 - identity. The earliest such i is where the least gain so far first falls that low.
    rank = np.arange(len(hits))
    gain = rank - identity * hits
    first = np.searchsorted(-np.minimum.accumulate(gain), -(gain + 1 - identity + 1e-9), side="left")
    equal = np.where(first <= rank, rank - first + 1, 0)
    begin = hits[np.minimum(first, rank)]
    best = np.lexsort((begin, hits - begin, -equal))[0]
    return int(begin[best]), int(hits[best]) + 1, int(equal[best])


_KEY = "key long, id long, words binary, seeds array<struct<hash:long,at:array<int>>>"
_SEEDS = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.list_(pa.int32()))]))


def _by_hash(h: np.ndarray, at: np.ndarray) -> list[dict]:
    """The places of each hash."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
    return [{"hash": int(np.int64(part[0])), "at": places} for part, places in zip(np.split(h.view(np.int64), cuts), np.split(at.astype(np.int32), cuts))] if len(h) else []


def _hashed(params: LeakParams, masks: tuple[str, ...], bits: np.ndarray | None = None):
    """(key, id, words, seeds) of rows (id, text): all seeds of an item (no filter), those of a document that pass the filter; documents without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, to, words, bounds in word_rows(batch.column(1)):
                row_of = np.repeat(np.arange(to - at), np.diff(bounds))
                size = np.diff(bounds)
                rows, hashes, places = [], [], []
                for mask in masks if at < to else ():
                    h = seed_hashes(words, mask)
                    if bits is None:
                        near = np.flatnonzero(np.isin(size[row_of[: len(h)]], [n for n in np.unique(size) if mask in params.masks_for(int(n))]))
                    else:
                        one, two = _slots(h, params.filter_bits)
                        near = np.flatnonzero((bits[(one >> np.uint64(3)).astype(np.int64)] >> (one & np.uint64(7)).astype(np.uint8)) & 1)
                        two = two[near]
                        near = near[((bits[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                    near = near[row_of[near] == row_of[near + len(mask) - 1]]
                    rows.append(row_of[near])
                    hashes.append(h[near])
                    places.append(near - bounds[row_of[near]])
                if not rows:
                    continue
                row, h, place = np.concatenate(rows), np.concatenate(hashes), np.concatenate(places)
                order = np.argsort(row, kind="stable")
                row, h, place = row[order], h[order], place[order]
                some = np.unique(row)
                keys, out_ids, blobs, found = [], [], [], []
                for r in some.tolist():
                    a, b = np.searchsorted(row, [r, r + 1])
                    own = words[bounds[r] : bounds[r + 1]]
                    spread = mix(own + seeds(1, 99)[0] * np.arange(1, len(own) + 1, dtype=np.uint64)).sum(dtype=np.uint64)
                    keys.append(int(mix(mix(ids[at + r : at + r + 1].view(np.uint64)) + spread).view(np.int64)[0]))
                    out_ids.append(int(ids[at + r]))
                    blobs.append(own.astype("<u4").tobytes())
                    found.append(_by_hash(h[a:b], place[a:b]))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(out_ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(found, _SEEDS)], names=["key", "id", "words", "seeds"]
                    )

    return run


def _filter(seeds_: DataFrame, bits: int) -> np.ndarray:
    """The bit filter over the column hash, packed; its size is fixed, however many rows there are."""
    one = F.shiftrightunsigned(F.col("hash"), 64 - bits)
    two = F.shiftrightunsigned(F.shiftleft(F.col("hash"), bits), 64 - bits)
    slot = seeds_.select(F.explode(F.array(one, two)).alias("slot"))
    parts = slot.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # 4 KB each, 2**bits / 32768 of them at most
        at = (row["part"] - 1) * 4096
        packed[at : at + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)[: len(packed) - at]
    return packed


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, words, found) the stretch of words that each item's diagonals need, a row for every cluster of diagonals."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        ids, blobs = batch.column(0).to_numpy(), batch.column(1)
        for k in range(batch.num_rows):
            words = np.frombuffer(blobs[k].as_buffer(), "<u4")
            for item in batch.column(2)[k]:
                size = item["size"].as_py()
                steps = []
                for place in item["places"]:
                    mine, theirs = np.asarray(place["mine"].values), np.asarray(place["theirs"].values)
                    steps += [np.unique(mine - np.int32(t)) for t in theirs] if len(mine) > len(theirs) else [np.unique(np.int32(m) - theirs) for m in mine]
                    if len(steps) > 256:
                        steps = [np.unique(np.concatenate(steps))]
                diagonals = np.unique(np.concatenate(steps))
                for part in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > size) + 1):
                    low, high = max(0, int(part[0])), min(len(words), int(part[-1]) + size)
                    for column, value in zip(out, (item["key"].as_py(), int(ids[k]), low, words[low:high].tobytes(), part.tolist())):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["key", "doc_id", "low", "stretch", "diagonals"])


def overlaps_along(stretch: np.ndarray, low: int, item: np.ndarray, diagonals: np.ndarray, params: LeakParams) -> Iterator[tuple[int, int, int, int]]:
    """(equal words, first word in the document, words, first word in the item) of every diagonal that has an overlap."""
    needed = params.needed(len(item))
    span, base = int(diagonals[-1] - diagonals[0]) + len(item), int(diagonals[0])
    if len(item) <= 4096:
        # Words beyond the stretch are none: they equal nothing.
        padded = np.full(span, -1, dtype=np.int64)
        padded[low - base : low - base + len(stretch)] = stretch
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(item))
        step = max(1, (1 << 21) // len(item))
        for a in range(0, len(diagonals), step):
            part = diagonals[a : a + step]
            same = windows[part - base] == item
            for k in np.flatnonzero(same.sum(axis=1) >= needed).tolist():
                found = best_run(same[k], params.identity)
                if found and found[2] >= needed:
                    yield found[2], int(part[k]) + found[0], found[1] - found[0], found[0]
        return
    for d in diagonals.tolist():
        begin, end = max(0, low - d), min(len(item), low + len(stretch) - d)
        found = best_run(stretch[begin + d - low : end + d - low] == item[begin:end], params.identity)
        if found and found[2] >= needed:
            yield found[2], d + begin + found[0], found[1] - found[0], begin + found[0]


_OVERLAP = "doc_id long, item_id long, matched_words int, start_word int, n_words int, item_start_word int, item_words int"


def overlaps(documents: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """A row per document and item that overlap: doc_id, item_id, matched_words, start_word, n_words, item_start_word, item_words."""
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = written(items.mapInArrow(lean(_hashed(params, params.every_mask())), _KEY).dropDuplicates(["key"]), "items")
    size = F.octet_length("words") / 4
    seeds_ = items.select("key", size.cast("int").alias("size"), F.explode("seeds").alias("s")).select("s.hash", "key", "size", F.col("s.at").alias("theirs"))
    total = items.agg(F.sum(F.size("seeds")).alias("n"), F.sum(size).alias("words")).first()
    sizes = [r["size"] for r in seeds_.select(F.least("size", F.lit(16)).alias("size")).distinct().collect()]  # 16 at most
    masks = tuple(sorted({m for n in sizes for m in params.masks_for(n)}))
    bits = documents.sparkSession.sparkContext.broadcast(_filter(seeds_, params.filter_bits))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _hashed(params, masks, bits.value)(batches)

    hits = written(docs.mapInArrow(lean(near), _KEY), "hits")
    mine = hits.select(F.col("key").alias("row"), F.explode("seeds").alias("s")).select("row", "s.hash", F.col("s.at").alias("mine"))
    if (total["n"] or 0) <= params.few_seeds:
        met = mine.join(F.broadcast(seeds_), "hash")
    else:  # a passage in very many documents is one hash with very many rows
        salts = F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt")
        met = mine.withColumn("salt", F.pmod("row", F.lit(params.salts)).cast("int")).join(seeds_.select("*", salts), ["hash", "salt"])
    pairs = met.groupBy("row", "key", "size").agg(F.collect_set(F.struct("mine", "theirs")).alias("places"))
    found = pairs.groupBy("row").agg(F.collect_list(F.struct("key", "size", "places")).alias("found"))
    rows = hits.dropDuplicates(["key"]).join(found, F.col("key") == F.col("row")).select("id", "words", "found")
    stretches = rows.mapInArrow(_stretches, "key long, doc_id long, low int, stretch binary, diagonals array<int>")
    own = items.select("key", F.col("id").alias("item_id"), "words")
    if (total["words"] or 0) <= params.few_words:
        both = stretches.join(F.broadcast(own), "key")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt")
        both = stretches.withColumn("salt", F.pmod("doc_id", F.lit(params.salts)).cast("int")).join(own.select("*", salts), ["key", "salt"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                doc, low, item_id = (batch.column(c)[k].as_py() for c in (0, 1, 4))
                stretch, item = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in (2, 5))
                for m, s, n, b in overlaps_along(stretch, low, item, np.asarray(batch.column(3)[k].values), params):
                    out.append((doc, item_id, m, s, n, b, len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in _OVERLAP.split(", ")])

    here = both.select("doc_id", "low", "stretch", "diagonals", "item_id", "words").mapInArrow(lean(verify), _OVERLAP)
    best = F.max_by(
        F.struct("matched_words", "start_word", "n_words", "item_start_word", "item_words"),
        F.struct(F.col("matched_words"), -F.col("start_word"), -F.col("n_words"), -F.col("item_start_word"), -F.col("item_words")),
    )
    return here.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(documents: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The documents without an overlap, with the columns they came with; rows without an id are kept."""
    leaks = overlaps(documents, benchmark, params).select(F.col("doc_id").alias("_leak")).distinct()
    return documents.join(leaks, documents["doc_id"] == leaks["_leak"], "left_anti")
