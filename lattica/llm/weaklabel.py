"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a text. How often each pattern of votes occurs is
counted over all texts; there are at most 3 ** len(LABELLERS) patterns, so expectation-maximisation runs on that table.
It estimates how each labeller votes on good and on bad texts, and a posterior for each pattern. Posteriors of a bounded
sample of texts then train a linear scorer on hashed features, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import small_batches
from lattica.llm.words import Words, chunks, mix, words
from lattica.llm.workers import tidy

CHUNK = 1 << 20
BUCKETS = 1 << 15
#: About so many texts, by hash of the text, train the scorer; their features are in one task's memory.
FIT_ROWS = 4_000
EPOCHS, RATE, DECAY = 30, 0.5, 1e-5
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128)
_BANG = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)

#: Statistic, and its bounds: good up to the first, bad from the second on, no vote in between.
LABELLERS = {"symbols": (0.005, 0.03), "upper": (0.10, 0.30), "top_word": (0.20, 0.35), "digits": (0.08, 0.25), "adjacent": (0.05, 0.20)}
#: Bounds on what EM may estimate: a labeller's share of objections to good texts, and to bad ones. Without them the bad
#: class would shrink to the commonest kind of junk, since the labellers look for different kinds.
FALSE_ALARM, LEAST_HIT = 0.002, 0.1
#: With fewer words no labeller votes: shares of a handful of words say little.
LEAST_WORDS = 20


def statistics(w: Words, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Of each row: shares of kinds of characters, of repeated words and of the commonest word, and how odd words are."""
    off = np.concatenate(([0], np.cumsum(sizes)))

    def share(kind: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[w.raw])))
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(of, 1)

    n = w.counts
    length = np.concatenate(([0], np.cumsum(w.ends - w.starts)))[w.first]
    chars = np.diff(length)
    order = np.lexsort((w.hashes, w.rows))
    row, h = w.rows[order], w.hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(h)))
    distinct = np.bincount(row[begin], minlength=len(n))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, row[begin], times)
    letters = share(_LETTER, np.ones(len(n))) if len(n) else np.zeros(0)
    again = np.zeros(len(w.hashes), np.int64)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.rows[1:] == w.rows[:-1])
    again = np.bincount(w.rows, weights=again, minlength=len(n)) / np.maximum(n, 1)
    return {
        "symbols": share(_SYMBOL, chars), "upper": share(_UPPER, letters), "repeated": 1 - distinct / np.maximum(n, 1), "top_word": top / np.maximum(n, 1),
        "bangs": share(_BANG, chars), "digits": share(_DIGIT, chars), "adjacent": again, "few": n < LEAST_WORDS,
    }


def patterns(found: dict[str, np.ndarray]) -> np.ndarray:
    """Each row's votes as one number in base 3: 0 none, 1 bad, 2 good."""
    out = 0
    for name, (good, bad) in LABELLERS.items():
        out = out * 3 + np.where(found["few"], 0, np.where(found[name] <= good, 2, np.where(found[name] >= bad, 1, 0)))
    return np.asarray(out, np.int64)


def votes(pattern: np.ndarray) -> np.ndarray:
    m = len(LABELLERS)
    return pattern[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" for each pattern, each labeller's vote shares on bad and good texts, and the share of good."""
    v = votes(pattern)
    p = np.where((v == 1).any(1), 0.1, 0.9)  # to begin with: good unless someone objects
    shares, prior = np.zeros((v.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        prior = (weight[1].sum() + 1) / (count.sum() + 2)
        for k in (1, 2):
            shares[:, :, k] = ((v == k)[:, :, None] * weight.T[:, None, :]).sum(0) + 1
        shares[:, :, 0] = 0
        shares /= shares.sum(2, keepdims=True)
        shares[:, 1, 1] = np.minimum(shares[:, 1, 1], FALSE_ALARM)
        shares[:, 0, 1] = np.maximum(shares[:, 0, 1], LEAST_HIT)
        shares[:, :, 2] = 1 - shares[:, :, 1]
        shares[:, :, 0] = 1  # no vote says nothing
        logs = np.log(shares)[np.arange(v.shape[1])[None, :], :, v].sum(1) + np.log([1 - prior, prior])
        now = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return p, shares, float(prior)


def hashed(w: Words, sizes: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all rows in a row: bucket, weight, and each row's number. Byte triples share a weight of one
    in each row; each statistic's tenth has a weight of a half."""
    raw = w.raw.astype(np.uint64)
    n = len(sizes)
    off = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(n), sizes)
    gram = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16) if len(raw) > 2 else np.zeros(0, np.uint64)
    inside = np.arange(len(gram)) + 3 <= off[1:][row[: len(gram)]]
    gram, row = gram[inside], row[: len(gram)][inside]
    count = np.bincount(row, minlength=n)
    found = {name: np.where(found["few"], 2.0, found[name]) for name in LABELLERS}
    k = len(found)
    size = count + k
    start = np.cumsum(size) - size
    bucket, weight = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.float32)
    at = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count) + start[row]
    bucket[at] = (mix(gram, 41) >> np.uint64(49)).astype(np.int64)
    weight[at] = (1 / np.maximum(count, 1))[row]
    for i, (name, x) in enumerate(found.items()):
        key = np.minimum(20, np.floor(x * 10)).astype(np.uint64) + np.uint64(1000 * (list(LABELLERS).index(name) + 1))
        bucket[start + count + i] = (mix(key, 43) >> np.uint64(49)).astype(np.int64)
        weight[start + count + i] = 0.5
    return bucket, weight, size


def _prepared(part: pa.RecordBatch) -> tuple[Words, np.ndarray, dict[str, np.ndarray]]:
    w = words(part.column("text"))
    sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return w, sizes, statistics(w, sizes)


def _patterned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(patterns(_prepared(part)[2]))], ["pattern"])


def _trainer(posterior: dict[int, float]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("text")  # the same order, and so the same weights, however rows arrive
        buckets, weights, sizes, targets = [], [], [], []
        for part in chunks(pa.RecordBatch.from_pydict({"text": pa.array(frame["text"], pa.string())}), "text", CHUNK):
            w, size, found = _prepared(part)
            b, x, n = hashed(w, size, found)
            targets.append(np.array([posterior[p] for p in patterns(found).tolist()]))
            buckets.append(b), weights.append(x), sizes.append(n)
        b, x, n, y = map(np.concatenate, (buckets, weights, sizes, targets))
        row = np.repeat(np.arange(len(n)), n)
        balance = np.where(y > 0.5, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        theta, bias, square, square_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(EPOCHS * 4):  # full-batch steps with a rate for each coordinate
            score = np.bincount(row, weights=theta[b] * x, minlength=len(n)) + bias
            error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) * balance
            slope = np.bincount(b, weights=x * error[row], minlength=BUCKETS) / len(n) + DECAY * theta
            square, square_bias = square + slope**2, square_bias + error.mean() ** 2
            theta, bias = theta - RATE * slope / np.sqrt(square), bias - RATE * error.mean() / np.sqrt(square_bias)
        return pd.DataFrame({"theta": [np.append(theta, bias).astype("<f4").tobytes()]})

    return run


def classified(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs(text, ...) with posterior (of the labellers' votes), score (of the scorer, 0 to 1) and kept (score of 0.5 or
    more); columns of these names are replaced.

    A null text counts as empty: all its shares are 0. Repeated rows get equal scores. Ties at 0.5 are kept. With no
    texts there is nothing to learn and nothing to return. Labels aren't read.
    """
    own = [c for c in docs.columns if c not in ("posterior", "score", "kept")]
    base = small_batches(docs).select(*own).withColumn("text", F.col("text").cast("string"))
    seen = base.select("text").mapInArrow(tidy(_patterned), "pattern long").groupBy("pattern").count().collect()  # at most 3 ** 5 rows
    pattern = np.array([r["pattern"] for r in seen], np.int64)
    count = np.array([r["count"] for r in seen], float)
    posterior = dict(zip(pattern.tolist(), expectation_maximisation(pattern, count)[0].tolist(), strict=True)) if len(seen) else {}
    total = int(count.sum())
    sample = base.select("text").where("text is not null")
    if total > fit_rows:
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total)).distinct()
    trained = sample.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_trainer(posterior), "theta binary").collect()
    theta = np.frombuffer(trained[0]["theta"], "<f4") if trained else np.zeros(BUCKETS + 1, "<f4")
    shared = docs.sparkSession.sparkContext.broadcast((posterior, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                w, sizes, found = _prepared(part)
                b, x, n = hashed(w, sizes, found)
                score = np.bincount(np.repeat(np.arange(len(n)), n), weights=weights[b] * x, minlength=len(n)) + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
                p = np.array([known[k] for k in patterns(found).tolist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array(score), pa.array(score >= 0.5)], [*part.schema.names, "posterior", "score", "kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "posterior double, score double, kept boolean"])
    return base.mapInArrow(tidy(run), schema)
