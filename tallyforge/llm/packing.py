"""Lexical retrieval packing: documents that share rare terms fill one training window.

1. Every document is tokenised once, and its ids are written to the shared folder.
2. Document frequencies of the terms, which are the tokenizer's ids, are counted over all documents; the vocabulary bounds that table.
3. The documents are range-partitioned by their most telling terms, ties by id, into shards of bounded size, so that lexical
   neighbours meet and a frequent term is spread over as many shards as it needs.
4. In each shard an inverted index with BM25 weights is built. A seed document opens a window, the index gives the unused
   documents by their score for the seed's most telling terms, and they fill the window greedily; the last is cut where the window
   ends, and its rest opens the next window. Where no unused document shares a term, the next unused one by order is taken.
5. What is left at the end of a shard, less than a window, is cut into sequences of power-of-two lengths, which need no padding.

So every sequence is `window` long or a power of two, and no padding is written. A task holds one block of at most
`block_tokens` tokens at a time, or one longer document.

Defined results: a null or empty text is the closing id alone; repeated rows are packed one by one; ties in score go to the lower
position in the shard; extra columns are dropped.
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

from tallyforge.llm.textcore import binary_views, lean, written


@dataclass(frozen=True)
class PackParams:
    """window: tokens of a sequence. shard_docs, block_tokens: bounds on what one index holds. query_terms: terms a seed asks for."""

    window: int = 2048
    closing_id: int = 1
    vocabulary: int = 50257
    k1: float = 1.2
    b: float = 0.75
    query_terms: int = 24
    shard_docs: int = 2048
    block_tokens: int = 2_000_000


#: Texts of these characters alone (ASCII, Latin and common punctuation) are split alike by both libraries; others go to the slower one.
PLAIN = "^[\\t\\n\\r\\x20-\\x7E\u00A1-\u024F\u2010-\u2027\u20AC]*$"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine that runs this has the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of a text as the tokenizers library gives them.

    The same vocabulary as ranks is read by tiktoken, several times as fast; it takes the texts of plain characters, on which both libraries
    split words alike, and the tokenizers library takes the rest.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.path, self.fast, self._slow = path, None, None
        if ranks_path:
            import base64
            import json

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            with open(path, encoding="utf-8") as description:
                special = {t["content"]: t["id"] for t in json.load(description)["added_tokens"]}
            self.special = set(special)
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def slow(self):  # noqa: ANN201
        if self._slow is None:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def encode(self, texts: pa.Array) -> list[np.ndarray | list[int]]:
        texts = pc.fill_null(texts, "")
        if self.fast is None:
            return [e.ids for e in self.slow.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        plain = pc.match_substring_regex(texts, PLAIN)
        return [
            self.fast.encode_to_numpy(t, allowed_special=self.special) if p else self.slow.encode(t, add_special_tokens=False).ids
            for t, p in zip(texts.to_pylist(), plain.to_pylist())
        ]


def tokenised(documents: DataFrame, params: PackParams = PackParams(), path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16 bits, or 32 if the vocabulary needs them) with the closing id, n_tokens."""
    kind = "<u2" if params.vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path or tokenizer_path()
        encoder = Encoder(own, ranks_path or (None if path else tokenizer_path("byte_bpe_50k.tiktoken")))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.append(x, params.closing_id).astype(kind) for x in encoder.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())],
                    names=["doc_id", "ids", "n_tokens"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, ids binary, n_tokens long")


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of every document's different terms, by document, then term; one sort for all of them."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    key = (np.repeat(np.arange(len(docs), dtype=np.uint64), sizes) << np.uint64(32)) | np.concatenate(docs).astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(docs[0].dtype), count


def term_statistics(tokens: DataFrame, params: PackParams) -> tuple[np.ndarray, int, float]:
    """Documents that hold each term, the number of documents, and their mean length, over all documents."""
    kind = "<u2" if params.vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(params.vocabulary + 2, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                docs = binary_views(batch.column(0).slice(at, 1024), kind)
                _, term, _ = term_counts(docs)
                held[: params.vocabulary] += np.bincount(term, minlength=params.vocabulary)
                held[-2] += len(docs)
                held[-1] += sum(map(len, docs))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(params.vocabulary + 2, dtype=np.int64)
    for term, n in rows:
        held[term] = n
    return held[:-2], int(held[-2]), float(held[-1]) / max(1, int(held[-2]))


class Block:
    """An inverted index with BM25 weights over a list of documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, params: PackParams):
        self.params, self.idf, self.size = params, idf, len(docs)
        owner, self.term, self.count = term_counts(docs)
        self.doc_begin = np.searchsorted(owner, np.arange(len(docs) + 1))
        order = np.argsort(self.term, kind="stable")
        self.owner = owner[order]
        term, count = self.term[order], self.count[order]
        length = np.array([len(d) for d in docs])[self.owner]
        self.weight = idf[term] * count * (params.k1 + 1) / (count + params.k1 * (1 - params.b + params.b * length / max(mean, 1e-9)))
        self.begin = np.searchsorted(term, np.arange(params.vocabulary + 1))

    def query(self, seed: int) -> np.ndarray:
        """The seed's most telling terms."""
        own = slice(self.doc_begin[seed], self.doc_begin[seed + 1])
        term, count = self.term[own], self.count[own]
        return term[np.argsort(-self.idf[term] * count / (count + self.params.k1), kind="stable")[: self.params.query_terms]]

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share one of the seed's terms, best first."""
        spans = [slice(self.begin[t], self.begin[int(t) + 1]) for t in self.query(seed)]
        score = np.bincount(
            np.concatenate([self.owner[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.size
        )
        score[~unused] = 0.0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


class Filler:
    """Deals pieces of documents to the open window; knows nothing of texts."""

    def __init__(self, window: int):
        self.window, self.sequence, self.offset = window, 0, 0
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, doc: tuple, start: int, length: int) -> int:
        """Puts as much of the piece as fits; returns how much."""
        put = min(length, self.window - self.offset)
        self.open.append((doc, start, put, self.offset))
        self.offset += put
        if self.offset == self.window:
            self.done += [(*p[:3], self.sequence, p[3]) for p in self.open]
            self.open, self.offset, self.sequence = [], 0, self.sequence + 1
        return put

    def close(self) -> None:
        """Cuts what is open into sequences of power-of-two lengths."""
        left, at = self.offset, 0
        pieces = self.open
        self.open, self.offset = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            for doc, start, length, offset in pieces:
                low, high = max(offset, at), min(offset + length, at + size)
                if low < high:
                    self.done.append((doc, start + low - offset, high - low, self.sequence, low - at))
            self.sequence, at, left = self.sequence + 1, at + size, left - size


def fill(docs: list[tuple], index: Block, filler: Filler) -> None:
    """Deals all documents of a block; docs: what Filler gets, the length at [1]."""
    unused = np.ones(len(docs), dtype=bool)
    nxt, seed = 0, None
    line = np.zeros(0, dtype=np.int64)
    at = 0
    while True:
        if filler.offset == 0:
            seed = None
        if seed is not None:
            while at < len(line) and not unused[line[at]]:
                at += 1
        if seed is not None and at < len(line):
            doc = int(line[at])
        else:
            while nxt < len(docs) and not unused[nxt]:
                nxt += 1
            if nxt == len(docs):
                return
            doc = nxt
        unused[doc] = False
        start, length = 0, docs[doc][1]
        while start < length:
            start += filler.add(docs[doc], start, length - start)
            if filler.offset == 0:
                seed = None
        if filler.offset and seed is None:  # what is left of this document is the seed of the window it opened
            seed, line, at = doc, index.ranked(doc, unused), 0


def pack(documents: DataFrame, params: PackParams = PackParams(), path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    kind = "<u2" if params.vocabulary <= 1 << 16 else "<u4"
    tokens = written(tokenised(documents, params, path, ranks_path), "tokens")
    held, n_docs, mean = term_statistics(tokens, params)
    idf = np.log1p((n_docs - held + 0.5) / (held + 0.5))
    idf[params.closing_id] = 0.0
    stats = spark.sparkContext.broadcast(idf)  # the vocabulary bounds it

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = stats.value
        for batch in batches:
            keys = np.zeros((batch.num_rows, 2), dtype=np.int32)
            for at in range(0, batch.num_rows, 1024):
                owner, term, count = term_counts(binary_views(batch.column(1).slice(at, 1024), kind))
                w = weights[term] * count / (count + params.k1)
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                for k in range(2):  # the best, then the best of the rest; of equal ones the smaller term
                    best = np.maximum.reduceat(w, begin)
                    hit = np.flatnonzero((w == best[owner]) & (best[owner] > 0))
                    _, one = np.unique(owner[hit], return_index=True)
                    keys[at + owner[hit[one]], k] = term[hit[one]]
                    w[hit[one]] = -1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=[*batch.schema.names, "term1", "term2"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filler = Filler(params.window)
        base = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            done, filler.done = filler.done, []
            for k in range(0, len(done), 4096):
                part = done[k : k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0][0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                        pa.array([np.frombuffer(p[0][2], kind)[p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in part], pa.binary()),
                        pa.array([p[0][1] for p in part], pa.int64()), pa.array([base + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, ids, n = (batch.column(c)[k].as_py() for c in range(3))
                waiting.append((doc_id, n, ids))
                size += n
                if size >= params.block_tokens:
                    fill(waiting, Block([np.frombuffer(d[2], kind) for d in waiting], stats.value, mean, params), filler)
                    yield from rows()
                    waiting, size = [], 0
        if waiting:
            fill(waiting, Block([np.frombuffer(d[2], kind) for d in waiting], stats.value, mean, params), filler)
        filler.close()
        yield from rows()

    shards = max(1, math.ceil(n_docs / params.shard_docs))
    dealt = tokens.mapInArrow(lean(keyed), "doc_id long, ids binary, n_tokens long, term1 int, term2 int")
    dealt = dealt.repartitionByRange(shards, "term1", "term2", "doc_id").sortWithinPartitions("term1", "term2", "doc_id")
    return dealt.select("doc_id", "ids", "n_tokens").mapInArrow(
        lean(packed), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
