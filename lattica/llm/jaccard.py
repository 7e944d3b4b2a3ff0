"""N-gram Jaccard self-join by prefix filters under several global token orders.

Tokens are hashes of five-word shingles. One exchange by token tells each document which of its tokens other documents
have too, and how many (a logarithmic class). Each global order sorts tokens by a rarity class first and an order's own
hash next, so common passages come last in every order. With t = 3/4, two sets can reach the similarity only if they
share a token among the first n - ceil(t n) + 1 of either, under *every* order. Candidates come from the first order's
prefixes; those of the other orders must meet as well before a pair is verified on whole sets.

Families of near copies would make quadratically many pairs. So each document is first held against two of the centres
of its prefix tokens, in a few rounds; then only pairs that cross the components found so far are looked at. Pairs inside
a component can change neither the components nor, after verification of the rest, any other result. Where a token of the
first order still has many documents, these meet only if they share a token of the second order's prefixes as well.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.tables import discard, settled, slices_for, small_batches
from lattica.llm.words import chunks, mix, pack, unpack, windows, words
from lattica.llm.workers import tidy, tidy_group

SHINGLE = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Text bytes tokenised at once, and text bytes whose tokens make one block of the exchange.
CHUNK, BLOCK = 2 << 20, 8 << 20
#: Text bytes behind one slice of the token space.
SLICE = 6 << 20
#: Steps of the rarity class per doubling of a token's document count, for each order; the first is the one joined on.
ORDERS = (4, 2, 1)
#: Entries beyond which a token of the first order is joined on together with one of the second.
HEAVY = 200
#: Rounds in which each document is held against two centres before the remaining pairs across components are.
STARS = 2
_LOW40 = np.uint64((1 << 40) - 1)


def least_overlap(n):
    """The fewest shared tokens that a set of n needs with any partner."""
    return -(-NUM * n // DEN)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by row and hash: rows, hashes, set sizes and 128-bit set digests.

    A text of one to four words has its whole sequence as its one shingle; one without words has the empty set.
    """
    w = words(texts, lower=True)
    n = w.counts
    grams = windows(w.hashes, SHINGLE)
    row = w.rows[: len(grams)]
    inside = np.arange(len(grams)) + SHINGLE <= w.first[1:][row]
    h, row = grams[inside], row[inside]
    for size in range(1, SHINGLE):
        few = np.flatnonzero(n == size)
        if len(few):
            at = w.first[:-1][few]
            part = np.zeros(len(few), np.uint64)
            for k in range(size):
                part = mix(part * np.uint64(31) + w.hashes[at + k], 7 + size)
            h, row = np.concatenate([h, part]), np.concatenate([row, few])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    size = np.bincount(row, minlength=len(n)).astype(np.int64)
    digest = np.zeros((len(n), 2), np.uint64)
    for k in range(2):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h, 101 + k), out=c[1:])
        edge = np.concatenate(([0], np.cumsum(size)))
        digest[:, k] = mix(c[edge[1:]] - c[edge[:-1]] + size.astype(np.uint64), 103 + k)
    return row, h, size, digest


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    slice_, block, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(slice_, pa.int64()), pa.array(block, pa.binary()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["slice", "block", "kind", "payload"])


_EXCHANGED = "slice long, block binary, kind int, payload binary"


def _emit(docs: list, slices: int, place: bytes) -> pa.RecordBatch:
    """One block: a header row, and a row of packed tokens for each slice that has any of them, each token once with the
    number of the block's documents that have it; what other documents have it goes straight to the block. Its id is of
    its header and of its place, task and number, so that blocks of equal rows stay apart."""
    ids = pa.concat_arrays([d[0] for d in docs])
    size, digest = np.concatenate([d[3] for d in docs]), np.concatenate([d[4] for d in docs])
    base = np.concatenate(([0], np.cumsum([len(d[0]) for d in docs])))
    row = np.concatenate([d[1] + b for d, b in zip(docs, base, strict=False)])
    h = np.concatenate([d[2] for d in docs])
    sink = pa.BufferOutputStream()
    header = pa.record_batch([ids, pa.array(size), pa.array(list(map(bytes, digest)), pa.binary())], ["doc_id", "n", "cls"])
    with pa.ipc.new_stream(sink, header.schema) as out:
        out.write_batch(header)
    raw = sink.getvalue().to_pybytes()
    block = hashlib.blake2b(place + raw, digest_size=16).digest()
    rows = [(int.from_bytes(block[:4], "little") % slices, block, 0, raw)]
    part = (h >> np.uint64(40)) % np.uint64(slices)
    token = (h & _LOW40) | part << np.uint64(40)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(token)))
    again = count > 1
    if again.any():
        rest = np.ones(len(token), bool)
        rest[first] = False
        rows.append((rows[0][0], block, 2, np.int64(again.sum()).tobytes() + token[first[again]].astype("<u8").tobytes() + (count[again] - 1).astype("<u2").tobytes() + row[rest].astype("<u2").tobytes()))
    token, row = token[first], row[first]
    part = (token >> np.uint64(40)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for a, b in zip(edge[:-1], edge[1:], strict=False):
        rows.append((int(part[a]), block, 1, row[a:b].astype("<u2").tobytes() + count[a:b].astype("<u2").tobytes() + pack(token[a:b], 5)))
    return _frame(rows)


def _token_blocks(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, held_rows, seen, task = [], 0, 0, set(), TaskContext.get().partitionId()
        places = (struct.pack("<qq", task, k) for k in itertools.count())
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                row, h, size, digest = shingle_sets(part.column("text"))
                new = np.ones(len(size), bool)
                for i, key in enumerate(map(bytes, digest)):  # of equal sets, one in a task sends its tokens
                    new[i] = key not in seen
                    seen.add(key)
                if len(seen) > 200_000:
                    seen.clear()
                keep = new[row]
                if held and (held_bytes + part.nbytes > BLOCK or held_rows + part.num_rows > 65_535):
                    yield _emit(held, slices, next(places))
                    held, held_bytes, held_rows = [], 0, 0
                held.append((part.column("doc_id"), row[keep], h[keep], size, digest))
                held_bytes, held_rows = held_bytes + part.nbytes, held_rows + part.num_rows
        if held:
            yield _emit(held, slices, next(places))

    return run


def _shared_tokens(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: each block's tokens that two or more documents have, with their rarity class. A block has sent each
    token once, so a slice's size doesn't depend on how many documents a token has."""
    out = part[part["kind"] != 1][["block", "kind", "payload"]]
    data = part[part["kind"] == 1]
    if not len(data):
        return out
    size = [len(p) // 9 for p in data["payload"]]
    rows = [np.frombuffer(p, "<u2", n) for p, n in zip(data["payload"], size, strict=True)]
    tokens = [unpack(p[4 * n :], 5) for p, n in zip(data["payload"], size, strict=True)]
    every, count = np.concatenate(tokens), np.concatenate([np.frombuffer(p, "<u2", n, 2 * n) for p, n in zip(data["payload"], size, strict=True)])
    order = np.argsort(every, kind="stable")
    every = every[order]
    edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    count = np.add.reduceat(count[order], edge, dtype=np.int64)
    some = count > 1
    known, cls = every[edge][some], np.minimum(255, ORDERS[0] * np.log2(count[some])).astype(np.uint8)
    replies = []
    for block, r, t in zip(data["block"], rows, tokens, strict=True):
        at = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
        hit = known[at] == t if len(known) else np.zeros(len(t), bool)
        if hit.any():
            k = int(hit.sum())
            replies.append((block, 1, np.array([k, key[0]], "<i8").tobytes() + r[hit].tobytes() + cls[at[hit]].tobytes() + pack(t[hit], 5)))
    return pd.concat([out, pd.DataFrame(replies, columns=["block", "kind", "payload"])])


_DOCS = "doc_id long, n long, cls binary, weight int, tokens array<long>, first array<long>, second array<int>, third array<int>"


def _documents(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Of one block: its documents, with tokens and prefixes of those that share enough tokens to have a partner."""
    head = pa.ipc.open_stream(part[part["kind"] == 0]["payload"].iloc[0]).read_all()
    n = head.column("n").to_numpy()
    rows, cls, tokens = [], [], []
    for p in part[part["kind"] == 1]["payload"]:
        k, slice_ = (int(x) for x in np.frombuffer(p[:16], "<i8"))
        rows.append(np.frombuffer(p[16 : 16 + 2 * k], "<u2").astype(np.int64))
        cls.append(np.frombuffer(p[16 + 2 * k : 16 + 3 * k], np.uint8))
        tokens.append(unpack(p[16 + 3 * k :], 5) | (np.uint64(slice_ % (1 << 24)) << np.uint64(40)))
    for p in part[part["kind"] == 2]["payload"]:
        k = int.from_bytes(p[:8], "little")
        again, times = np.frombuffer(p, "<u8", k, 8), np.frombuffer(p, "<u2", k, 8 + 8 * k)
        have = np.concatenate(tokens)
        order = np.argsort(have)
        rare = np.concatenate(cls)[order[np.searchsorted(have, again, sorter=order)]]
        rows.append(np.frombuffer(p, "<u2", -1, 8 + 10 * k).astype(np.int64))
        tokens.append(np.repeat(again, times))
        cls.append(np.repeat(rare, times))
    out = {c: [None] * len(n) for c in ("tokens", "first", "second", "third")}
    weight = np.zeros(len(n), np.int64)
    if rows:
        row, rare, token = np.concatenate(rows), np.concatenate(cls), np.concatenate(tokens)
        have = np.bincount(row, minlength=len(n))
        prefix = np.maximum(0, n - least_overlap(n) + 1 - (n - have))
        stays = (have >= least_overlap(n)) & (n > 0)
        keep = stays[row]
        row, rare, token = row[keep], rare[keep], token[keep]
        size = np.bincount(row, minlength=len(n))
        end = np.cumsum(size)
        weight = np.bincount(row, weights=rare, minlength=len(n)).astype(np.int64) * 100 // np.maximum(n, 1)
        for k, name in enumerate(("first", "second", "third")):
            mixed = mix(token, 11 + k)
            order = np.lexsort((mixed, rare // (ORDERS[0] // ORDERS[k]), row))
            value = token[order].view(np.int64) if k == 0 else (mixed[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for i in np.flatnonzero(stays):
                out[name][i] = value[end[i] - size[i] : end[i] - size[i] + prefix[i]]
                if k == 0:
                    out["tokens"][i] = value[end[i] - size[i] : end[i]]
    frame = pd.DataFrame({c: head.column(c).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for c in ("doc_id", "n", "cls")})
    return frame.assign(weight=weight, **out)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that meet in every order's prefixes and whose whole sets are similar enough."""
    side = lambda s: sets.select(F.col("cls").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "tokens", "second", "third")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(DEN * shared >= NUM * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b")


def _star_pairs(entries: DataFrame, k: int) -> DataFrame:
    """At most two pairs (a, b) for each document a. Each token's centres are its document with the commonest tokens in
    round 0, which is the hub of a family of near copies, else its least in the k-th order of classes; and its greatest
    in that order. b is the centre of either kind, in another component, with which a shares most prefix tokens."""
    turned = F.concat(F.substring("cls", 1 + 4 * k, 16), F.substring("cls", 1, 4 * k), F.col("of"))  # 16 bytes each
    heavy = F.concat(F.lpad(F.col("weight").cast("string"), 8, "0").cast("binary"), turned)
    one = F.substring(F.max(heavy), 9, 32) if k == 0 else F.min(turned)
    tokens = entries.groupBy("token").agg(one.alias("one"), F.max(turned).alias("two"))
    met = entries.join(tokens, "token")
    side = lambda c: met.where(F.substring(c, 17, 16) != F.col("of")).select("cls", F.substring(c, 1, 16).alias("c")).groupBy("cls", "c").count()
    best = [side(c).groupBy("cls").agg(F.max(F.struct("count", "c"))["c"].alias("c")) for c in ("one", "two")]
    back = F.concat(F.substring("c", 17 - 4 * k, 16), F.substring("c", 1, 16 - 4 * k))
    return best[0].unionByName(best[1]).select(F.col("cls").alias("a"), back.alias("b")).distinct()


def _near(a: str, b: str):
    return (DEN * F.least(a, b) >= NUM * F.greatest(a, b))


def jaccard_join(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Near-duplicate classes of docs(doc_id, text): doc_id, n_shingles, component_id, one row for each row of docs.

    component_id is the smallest doc_id reachable through links, itself included. Texts that are null, empty or
    without words have 0 shingles and their own doc_id. Rows with one doc_id, and repeated rows, each count; a null
    doc_id has links like any other, and takes the smallest id that they reach, or null if there is none. A pair at
    the threshold itself links. An empty table gives an empty one. Other columns, however named, aren't read. A text of
    any length is taken whole. Links rest on 64-bit shingle hashes cut to 40 bits plus the slice, set classes on
    128-bit digests.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = slices or slices_for(texts, "text", SLICE)
    blocks = texts.mapInArrow(tidy(_token_blocks(slices)), _EXCHANGED)
    blocks = blocks.groupBy("slice").applyInPandas(tidy_group(_shared_tokens), "block binary, kind int, payload binary")
    found = blocks.groupBy("block").applyInPandas(tidy_group(_documents), _DOCS)
    found = settled(found, "sets")  # cls is the set's digest, 16 bytes
    sets = found.where("tokens is not null").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "weight", "tokens", "first", "second", "third")))
    sets, heads = settled(sets, "classes"), settled(found.select("doc_id", "n", "cls"), "heads")
    discard(found)
    unique = F.col("n") - F.size("tokens")
    entries = sets.select("cls", "n", "weight", unique.alias("u"), F.posexplode("first").alias("pos", "token"))
    entries = entries.select("token", "cls", "n", "weight", (F.col("n") - F.col("u") - F.col("pos")).alias("rest"))
    entries = entries.join(entries.groupBy("token").count().where("count > 1").select("token"), "token", "left_semi")
    known = settled(entries.withColumn("of", F.col("cls")), "prefixes")
    links = None
    for k in range(STARS):
        star = _star_pairs(known, k)
        more = settled(_verified(star, sets), "links")
        links = more if links is None else links.unionByName(more)
        labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        before = known
        known = known.drop("of").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
        known = known.select("token", "cls", "n", "weight", "rest", F.coalesce("component", "cls").alias("of"))
        mixed = known.groupBy("token").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y").select("token")
        known = settled(known.join(mixed, "token", "left_semi"), "prefixes")
        discard(before, labels)
        if known.isEmpty():
            break
    heavy = known.groupBy("token").count().where(F.col("count") > HEAVY).select("token")
    both = known.join(heavy, "token", "left_semi").join(sets.select("cls", "second"), "cls").withColumn("also", F.explode("second")).drop("second")
    known_by = settled(known.join(heavy, "token", "left_anti").withColumn("also", F.lit(0)).unionByName(both), "prefixes")
    left, right = (known_by.select("token", "also", *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "n", "rest", "of"))) for s in ("a", "b"))
    enough = 7 * F.least("a_rest", "b_rest") >= 3 * (F.col("a_n") + F.col("b_n"))
    pairs = left.join(right, ["token", "also"]).where((F.col("a_of") < F.col("b_of")) & _near("a_n", "b_n") & enough)
    pairs = pairs.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()
    rest = _verified(pairs, sets)
    links = rest if links is None else links.unionByName(rest)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(sets, known, known_by)
    classes = heads.groupBy("cls").agg(F.min("doc_id").alias("least"))
    grouped = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("root"))
    of_class = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("found_id")), "root").select("cls", "found_id")
    return heads.join(of_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found_id")).alias("component_id"))
