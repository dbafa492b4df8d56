"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams by rank, from every labelled document outside the held-out fold. A text's
own ranks are compared with each profile by the out-of-place distance: the sum of the rank differences, an n-gram that the
profile lacks counting as the longest distance. The nearest profile names the language.

Words are runs of letters, lower-cased, and an n-gram may reach over one blank at either end of its word. Characters are
code points. Equal counts rank by the n-gram's hash, equal distances by the language's name.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text if nothing was learnt. Null languages are not
learnt from. Repeated rows get the same answer; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.textcore import in_fold, lean, mix, seeds, text_chunks


@dataclass(frozen=True)
class LangParams:
    """orders: lengths of the n-grams. profile: ranks a language keeps. document: ranks a text keeps. buckets_bits: width of a hash."""

    orders: tuple[int, ...] = (1, 2, 3)
    profile: int = 1000
    document: int = 400
    hash_bits: int = 40


_ORDER_SALT = seeds(8, 21)


def _letters(column: pa.Array) -> pa.Array:
    """Lower case, every run of other characters than letters one blank, one blank at either end."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    text = pc.replace_substring_regex(text, r"[^\p{L}]+", " ")
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_trim(text, " "), blank, pa.scalar("", pa.large_string()))


def gram_rows(column: pa.Array, params: LangParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, row of each distinct n-gram, its hash, its count); rows ascend."""
    mask = np.uint64((1 << params.hash_bits) - 1)
    for at, to, data, offsets in text_chunks(_letters(column)):
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        bounds = np.searchsorted(lead, offsets)
        row = np.repeat(np.arange(to - at, dtype=np.uint64), np.diff(bounds))
        blank = chars == 32
        keys = []
        for n in params.orders:
            count = max(0, len(chars) - n + 1)
            acc = np.zeros(count, dtype=np.uint64)
            for j in range(n):
                acc = (acc << np.uint64(21)) ^ (acc >> np.uint64(43)) ^ chars[j : j + count]
            ok = row[:count] == row[n - 1 : n - 1 + count]
            for j in range(1, n - 1):
                ok &= ~blank[j : j + count]
            if n <= 2:  # a longer one has a letter inside
                ok &= ~(blank[:count] & blank[n - 1 : n - 1 + count])
            keys.append(((mix(acc ^ _ORDER_SALT[n]) & mask) | (row[:count] << np.uint64(params.hash_bits)))[ok])
        key = np.concatenate(keys)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        yield at, to, (key >> np.uint64(params.hash_bits)).astype(np.int64), (key & mask).astype(np.int64), count


def fit(documents: DataFrame, params: LangParams = LangParams(), text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Each language's n-gram hashes by rank; params.profile numbers a language.

    Counts cover every labelled text outside the held-out fold: they are summed in each task first, then by (language, n-gram).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                pairs = np.concatenate(parts)
                order = np.argsort(pairs["g"], kind="stable")
                g, c = pairs["g"][order], pairs["c"][order]
                first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(first), pa.string()), pa.array(g[first]), pa.array(np.add.reduceat(c, first))], names=["lang", "gram", "n"]
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for at, to, row, gram, n in gram_rows(batch.column(0), params):
                if not len(row):
                    continue
                here = langs[at:to][row]
                for name in set(here):
                    mine = here == name
                    pairs = np.empty(int(mine.sum()), dtype=[("g", "<i8"), ("c", "<i8")])
                    pairs["g"], pairs["c"] = gram[mine], n[mine]
                    held.setdefault(name, []).append(pairs)
                    rows += len(pairs)
                if rows > 2_000_000:
                    yield from flush()
                    rows = 0
        yield from flush()

    learn = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    counts = learn.select(text, lang).mapInArrow(lean(count), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= params.profile)
    profiles: dict[str, np.ndarray] = {}
    for r in top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams")).collect():
        profiles[r["lang"]] = np.array([g["gram"] for g in r["grams"]], dtype=np.int64)
    return profiles


def predict(documents: DataFrame, profiles: dict[str, np.ndarray], params: LangParams = LangParams(), text: str = "text") -> DataFrame:
    """The rows with lang_pred and lang_score: the gap between the nearest and the second profile, in [0, 1]."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, dtype=np.int64)
    table = np.full((len(known) + 1, len(names)), -1, dtype=np.int32)
    for k, name in enumerate(names):
        table[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))
    model = documents.sparkSession.sparkContext.broadcast((names, known, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, table = model.value
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for at, to, row, gram, n in gram_rows(batch.column(text), params) if names else ():
                order = np.lexsort((gram, -n, row))
                row, gram = row[order], gram[order]
                begin = np.searchsorted(row, np.arange(to - at + 1))
                rank = np.arange(len(row)) - begin[row]
                top = rank < params.document
                row, gram, rank = row[top], gram[top], rank[top]
                if not len(row):
                    continue
                spot = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                spot = np.where(known[spot] == gram, spot, len(known))
                ranks = table[spot]
                away = np.where(ranks < 0, params.profile, np.abs(ranks - rank[:, None]))
                total = np.stack([np.bincount(row, weights=away[:, k], minlength=to - at) for k in range(len(names))], axis=1)
                size = np.bincount(row, minlength=to - at)
                near = np.argmin(total, axis=1)
                low = np.sort(total, axis=1)
                second = low[:, 1] if len(names) > 1 else size * float(params.profile)
                has = size > 0
                best[at:to] = np.where(has, near, -1)
                score[at:to] = np.where(has, np.clip((second - low[:, 0]) / np.maximum(second, 1e-9), 0, 1), 0)
            lang = pa.array([names[b] if b >= 0 else "und" for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score)], names=[*batch.schema.names, "lang_pred", "lang_score"])

    documents = documents.drop("lang_pred", "lang_score")
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return documents.mapInArrow(lean(run), schema)
