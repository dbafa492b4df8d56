"""Ranked lexical search with WAND over document shards.

Items are queries over all documents. A document's score sums, over the item's terms, the term's weight times an impact that grows with the term's occurrences and
falls with the document's length; all in whole numbers, so shards and their merge are exact.

1. A fixed-size bit filter of the items' terms picks the occurrences that are kept; texts are read once, which also counts documents and terms.
2. Documents are dealt to shards of bounded postings. A shard's index holds, per term, its documents in order with their impacts and the largest of these.
3. Each item searches each shard: a heap of the k best gives the threshold. Terms are ordered by their largest impact; those whose largest impacts together
   cannot pass the threshold never make a pivot, so documents that hold no other term are not looked at. A document is a pivot only if the largest impacts of the
   terms that it can hold pass the threshold; pivots are then scored term by term and given up as soon as what is left cannot lift them over it. Pivots are found for a run of
   documents at a time, by numpy on the sorted postings, and the threshold rises between runs.
4. The shards' heaps are merged by a window that keeps k rows of an item in each task before the shuffle.

Nothing grows on the driver: it sees the filter and the three counts. Items are dealt to blocks; (shard, block) is the key of a group.

Defined results: null, empty and termless texts count in no statistic and match nothing; rows are documents, so repeated rows rank one behind the other; rows of one item
id are one item with the terms of all its texts, each once. A null doc_id is ranked behind equal scores of other documents. Extra columns are ignored. Terms are
compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.textcore import LOWER, lean, rows_of, span_hashes, text_chunks, word_spans, written

#: Bytes between terms: all ASCII but digits and letters.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x41:0x5B] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False


@dataclass(frozen=True)
class SearchParams:
    """k: documents of an item. shard_postings: expected postings of a shard. block: expected items of a block. filter_bits: the filter has 2**filter_bits bits.
    run: documents of the first run of a search; each run is twice as long as the one before, up to `longest`."""

    k: int = 50
    shard_postings: int = 2_000_000
    block: int = 1024
    filter_bits: int = 23
    run: int = 512
    longest: int = 16_384


_DOC = "doc_id long, n long, terms array<long>, tfs array<long>"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _counted(bits: np.ndarray | None, width: int):
    """(doc_id, n, terms, tfs) of rows (doc_id, text) with a term: how many terms, and those that pass the filter with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, to, data, offsets in text_chunks(batch.column(1)):
                data = LOWER[data]
                starts, ends, bounds = word_spans(data, offsets, BETWEEN)
                hashes, row = span_hashes(data, starts, ends), rows_of(bounds)
                if bits is not None:
                    slot = (hashes >> np.uint64(64 - width)).astype(np.int64)
                    near = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0
                    hashes, row = hashes[near], row[near]
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                tfs = np.diff(np.append(first, len(row)))
                n = np.diff(bounds)
                own = np.searchsorted(row[first], np.arange(to - at + 1))
                some = n > 0
                # rows without a term have no postings, so the bounds of the others stay whole
                limits = np.append(own[:-1][some], own[-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at).filter(pa.array(some)), pa.array(n[some]), _lists(hashes[first].view(np.int64), limits), _lists(tfs, limits)],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def _filter(terms: DataFrame, width: int) -> np.ndarray:
    """The bit filter over the column term, packed; its size is fixed, however many rows there are."""
    slot = F.shiftrightunsigned(F.col("term"), 64 - width) + 1
    parts = terms.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    packed = np.zeros((1 << width) // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # 4 KB each, 2**width / 32768 of them at most
        at = (row["part"] - 1) * 4096
        packed[at : at + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)[: len(packed) - at]
    return packed


class Shard:
    """Postings of a shard by term: places of documents in order of their ids, and impacts, times a weight when an item asks."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, places: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids = ids
        m = 50 + (50 * lengths * n_docs) // n_terms
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[places])
        order = np.lexsort((places, terms))
        self.places, self.impacts = places[order], impacts[order]
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.first = np.append(self.first, len(terms))
        self.top = np.maximum.reduceat(self.impacts, self.first[:-1]) if len(terms) else np.zeros(0, dtype=np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, run: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents with a score above 0; ties to the earlier place."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (weights > 0)
        here[here] = self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        bound = self.top[at] * weights
        order = np.argsort(-bound, kind="stable")
        at, weights, bound = at[order], weights[order], bound[order]
        after = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the terms from here on can give together
        lists = [(self.places[self.first[t] : self.first[t + 1]], self.impacts[self.first[t] : self.first[t + 1]]) for t in at.tolist()]
        cursor = [0] * len(lists)
        best_places, best_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        threshold, begin = 0, 0
        while begin < len(self.ids):
            end = min(begin + run, len(self.ids))
            # terms behind these cannot pass the threshold together: they make no pivot
            leading = int(np.searchsorted(-after, -threshold, side="left"))
            if not leading:
                break
            # the largest impacts of the leading terms that a document holds, and of all others
            reach = np.full(end - begin, after[leading], dtype=np.int64)
            parts = []
            for t in range(leading):
                places, impacts = lists[t]
                low = cursor[t] + int(np.searchsorted(places[cursor[t] :], begin))
                high = low + int(np.searchsorted(places[low:], end))
                cursor[t] = high
                parts.append((places[low:high] - begin, impacts[low:high]))
                reach[parts[t][0]] += bound[t]
            pivots = np.flatnonzero((reach > threshold) & (reach > after[leading]))
            score = np.zeros(end - begin, dtype=np.int64)
            for t in range(leading):
                score[parts[t][0]] += parts[t][1] * weights[t]
            score = score[pivots]
            for t in range(leading, len(lists)):
                open_ = score + after[t] > threshold
                if not open_.all():
                    pivots, score = pivots[open_], score[open_]
                if not len(pivots):
                    break
                places, impacts = lists[t]
                spot = np.searchsorted(places, pivots + begin)
                spot[spot == len(places)] = 0
                hit = places[spot] == pivots + begin
                score[hit] += impacts[spot[hit]] * weights[t]
            good = score > threshold
            if good.any():
                best_places = np.concatenate([best_places, pivots[good] + begin])
                best_scores = np.concatenate([best_scores, score[good]])
                if len(best_places) > k:
                    keep = np.lexsort((best_places, -best_scores))[:k]
                    best_places, best_scores = best_places[keep], best_scores[keep]
                if len(best_places) == k:
                    threshold = int(best_scores.min())
            begin, run = end, min(run * 2, longest)
        return best_places, best_scores


def item_terms(items: DataFrame, params: SearchParams) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    texts = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(lean(_counted(None, params.filter_bits)), _DOC)
    return found.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


def ranked(documents: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """item_id, rank from 1, doc_id, score: the k best documents of each item, of rows (doc_id, text) and (item_id, text)."""
    asked = written(item_terms(items, params), "terms")
    session = documents.sparkSession
    bits = session.sparkContext.broadcast(_filter(asked, params.filter_bits))  # 2**filter_bits bits, whatever the items

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(bits.value, params.filter_bits)(batches)

    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(docs.mapInArrow(lean(postings), _DOC), "postings")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l"), F.sum(F.size("terms").cast("long")).alias("p")).first()
    n_docs, n_terms = total["n"], total["l"] or 0
    shards = max(1, -(-(total["p"] or 0) // params.shard_postings))
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(df, "term").select("item_id", F.struct("term", weight.alias("weight")).alias("t"))
    query = weighed.groupBy("item_id").agg(F.collect_list("t").alias("t"))
    query = written(query.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "items")
    blocks = max(1, -(-query.count() // params.block))
    key = ["shard", "block"]
    # places in the table deal out the rows, so equal rows do not meet; results do not depend on the shards
    left = found.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = query.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(docs_: pa.Table, items_: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if docs_.num_rows and items_.num_rows:
            docs_ = docs_.sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls behind
            ids = docs_.column("doc_id").combine_chunks()
            lists, tfs = docs_.column("terms").combine_chunks(), docs_.column("tfs").combine_chunks()
            places = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            shard = Shard(np.arange(len(ids)), docs_.column("n").to_numpy(), lists.flatten().to_numpy(), places, tfs.flatten().to_numpy(), n_docs, n_terms)
            for item, terms, weights in zip(items_.column("item_id").to_pylist(), items_.column("terms"), items_.column("weights")):
                where, scores = shard.search(terms.values.to_numpy(), weights.values.to_numpy(), params.k, params.run, params.longest)
                out[0] += [item] * len(where)
                out[1] += ids.take(pa.array(where)).to_pylist()
                out[2] += scores.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["item_id", "doc_id", "score"])

    heaps = left.select(*key, "doc_id", "n", "terms", "tfs").groupBy(*key).cogroup(right.select(*key, "item_id", "terms", "weights").groupBy(*key))
    merged = heaps.applyInArrow(search, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return merged.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= params.k)
