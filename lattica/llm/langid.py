"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a gap. Features are pairs and triples of characters around a letter, gaps
included at word ends, hashed into BUCKETS. Counts come from a bounded sample of labelled texts, merged in two levels;
the log-probability matrix, a row for each bucket and a column for each language, is broadcast, and whole batches are
scored by gathers and segment sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import small_batches
from lattica.llm.words import chunks
from lattica.llm.workers import tidy

BUCKETS, SMOOTHING = 1 << 15, 0.1
#: About so many labelled texts are learned from; the sample is by hash of doc_id, and all of them if there are fewer.
FIT_ROWS = 20_000
#: Bytes that the broadcast matrix may have.
MOST_MATRIX = 256 << 20
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows in a row, each row's number of n-grams, and which rows have a letter."""
    texts = pc.fill_null(column, "") if column.null_count else column
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.zeros(len(code) + len(sizes) + 1, np.uint64)  # a gap before each row, and at the end
    row = np.repeat(np.arange(len(sizes)), sizes)
    letter[np.arange(len(code)) + row + 1] = _letters()[code]
    mid = np.flatnonzero(letter)
    which = np.searchsorted(np.cumsum(sizes + 1), mid, side="right")
    a, b, c = letter[mid - 1], letter[mid], letter[mid + 1]
    pair = b * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = pair + a * np.uint64(0x165667B19E3779F9) + np.uint64(0x27D4EB2F165667C5)
    both = np.stack([pair, triple], 1).reshape(-1)
    both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    count = 2 * np.bincount(which, minlength=len(sizes)).astype(np.int64)
    return (both >> np.uint64(49)).astype(np.int32), count, count > 0


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves no remainder modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            h, count, _ = features(part.column("text"))
            langs = part.column("lang").to_pylist()
            names = list(dict.fromkeys(langs))
            of = np.repeat(np.array([names.index(x) for x in langs]), count)
            table = np.bincount(of * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for i, name in enumerate(names):
                sums[name] = sums.get(name, 0) + table[i]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])


def _summed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in part["counts"])
    return pd.DataFrame({"lang": [key[0]], "counts": [total.tobytes()]})


def fitted(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and how often each bucket occurs in the sample of each: one row for a bucket, one column for a language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    sample = rows.select("lang", "text").repartition(16)
    counts = sample.mapInArrow(tidy(_counted), "lang string, counts binary").groupBy("lang").applyInPandas(_summed, "lang string, counts binary")
    found = sorted((r["lang"], np.frombuffer(r["counts"], "<i8")) for r in counts.collect())
    if len(found) * BUCKETS * 4 > MOST_MATRIX:
        raise ValueError(f"{len(found)} languages need a matrix beyond {MOST_MATRIX} bytes")
    return [x for x, _ in found], np.stack([x for _, x in found], 1) if found else np.zeros((BUCKETS, 0), np.int64)


def identified(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs(doc_id, text, lang, ...) with held_out, lang_pred and score; columns of these names are replaced.

    It learns from rows whose id isn't held out and whose lang isn't null, and predicts from text alone. lang_pred is
    "und", with score 0, for a null text, for one without letters, and where nothing was learned. score is the
    posterior probability of lang_pred times the share of the text's n-grams seen in that language. Ties go to the
    first language in order. A null doc_id isn't learned from, and isn't held out. Repeated rows count each.
    """
    names, counts = fitted(small_batches(docs), fit_rows)
    logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32) if names else None
    shared = docs.sparkSession.sparkContext.broadcast((names, logs, counts > 0))
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    base = docs.select(*own).withColumn("text", F.col("text").cast("string")).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, seen = shared.value
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                n = part.num_rows
                best, score = np.full(n, len(langs)), np.zeros(n)
                if langs:
                    h, count, some = features(part.column("text"))
                    if some.any():
                        at = (np.cumsum(count) - count)[some]
                        sums = np.add.reduceat(matrix[h], at, axis=0, dtype=np.float64)
                        best[some] = sums.argmax(1)
                        p = np.exp(sums - sums.max(1, keepdims=True))
                        known = np.add.reduceat(seen[h, np.repeat(best, count)], at, dtype=np.int64)
                        score[some] = (p.max(1) / p.sum(1)) * known / count[some]
                pred = pa.array([*langs, "und"]).take(pa.array(best))
                yield pa.RecordBatch.from_arrays([*part.columns, pred, pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "lang_pred string, score double"])
    return base.mapInArrow(tidy(run), schema)
