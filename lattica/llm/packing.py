"""Packing token pieces into sequences by linear grouping.

Lengths are whole numbers up to the sequence's capacity, so the table of how often each occurs is all that planning
needs, whatever the size of the corpus. Large lengths are cut, in descending order, into groups of equal cardinality and
rounded up to their group's largest. Configurations, the ways to fill a sequence with those few lengths, are optimised
by column generation; each is used its whole number of times. Actual pieces then take the places of the rounded ones,
and everything else goes by best fit into the space that is left.

A plan says which ranks of which length go to which sequences, at which offset. Pieces find their rank within their
length in two levels, by buckets and within them, so no length is gathered in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.interned import Interned
from lattica.llm.tables import settled, small_batches
from lattica.llm.words import LOWER, chunks, span_hashes, words
from lattica.llm.workers import tidy

CAPACITY = 2048
#: Parts of the capacity from which on lengths count as large: each is planned for, and the plan of fewest sequences kept.
#: With the last no length is large, so that no plan needs more sequences than best fit alone.
LARGE = (1 / 2, 1 / 3, 1 / 4, 1 / 8, 2)
#: The groups that large lengths are rounded up in.
GROUPS = 8
BLOCK = 1 << 20
#: Pieces behind one bucket of a length when ranks are dealt.
BUCKET = 20_000


def configurations(sizes: list[int], counts: list[int], capacity: int = CAPACITY, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Ways to fill a sequence, as numbers of each size, and how often to use each: the least total that covers counts."""
    n, demand = len(sizes), np.array(counts, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(min(sizes), capacity + 1):
            value = [(best[room - s] + p, i) for i, (s, p) in enumerate(zip(sizes, price, strict=True)) if s <= room]
            top, i = max(value)
            if top > best[room - 1]:
                best[room], last[room] = top, i
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        have, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, have / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    times = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int).tolist(), float(times[j])) for j in range(n) if times[j] > 1e-9]


class Plan:
    """Where pieces go: ranks lo to hi - 1 of a length go to sequences from `first` on, one in each, at `offset`."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, lo, hi, first, offset
        self._free: dict[int, list[tuple[int, int]]] = {}
        self._rooms: list[int] = []
        self._rank: dict[int, int] = {}

    def open(self, n: int) -> tuple[int, int]:
        self.sequences += n
        return self.sequences - n, self.sequences

    def put(self, length: int, lo: int, hi: int, used: int) -> None:
        """The next pieces of a length, one in each of the sequences lo to hi - 1."""
        rank = self._rank.get(length, 0)
        self.rows.append((length, rank, rank + hi - lo, lo, used))
        self._rank[length] = rank + hi - lo

    def leave(self, lo: int, hi: int, used: int) -> None:
        room = self.capacity - used
        if room and hi > lo:
            if room not in self._free:
                self._free[room] = []
                insort(self._rooms, room)
            self._free[room].append((lo, hi))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self._rooms, length)
            if at == len(self._rooms):
                each = self.capacity // length
                for n, k in ((count // each, each), (1 if count % each else 0, count % each)):
                    if n:
                        lo, hi = self.open(n)
                        for i in range(k):
                            self.put(length, lo, hi, i * length)
                        self.leave(lo, hi, k * length)
                return
            room = self._rooms[at]
            lo, hi = self._free[room].pop()
            if not self._free[room]:
                del self._free[room], self._rooms[at]
            n = min(count, hi - lo)
            self.put(length, lo, lo + n, self.capacity - room)
            self.leave(lo, lo + n, self.capacity - room + length)
            self.leave(lo + n, hi, self.capacity - room)
            count -= n


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The best plan over the LARGE thresholds for counts of lengths from 1 to capacity; it depends on the counts alone."""
    least = -(-sum(s * c for s, c in counts.items()) // capacity)
    best = None
    for part in LARGE:
        made = _plan(counts, capacity, groups, part * capacity)
        best = made if best is None or made.sequences < best.sequences else best
        if best.sequences == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, groups: int, large_from: float) -> Plan:
    out, left = Plan(capacity), {s: c for s, c in counts.items() if c}
    for length in [s for s in left if s == capacity]:
        lo, hi = out.open(left.pop(length))
        out.put(length, lo, hi, 0)
    large = sorted((s for s in left if s >= large_from), reverse=True)
    total = sum(left[s] for s in large)
    streams: list[list[list[int]]] = []  # each group's lengths and counts, longest first
    quota = -(-total // groups) if total else 0
    room = 0
    for s in large:
        count = left[s]
        while count:
            if not room:
                streams.append([])
                room = quota
            n = min(count, room)
            streams[-1].append([s, n])
            count, room = count - n, room - n
    if streams:
        merged: dict[int, list[list[int]]] = {}
        for stream in streams:  # groups that round up to one length are one
            merged.setdefault(stream[0][0], []).extend(stream)
        sizes = list(merged)
        demand = [sum(n for _, n in merged[s]) for s in sizes]
        for config, times in configurations(sizes, demand, capacity):
            lo, hi = out.open(int(times + 1e-9))
            segments = [(lo, hi, 0)] if hi > lo else []
            for size, number in zip(sizes, config, strict=True):
                for _ in range(number):
                    segments = _substitute(out, segments, merged[size], left)
            for lo, hi, used in segments:
                out.leave(lo, hi, used)
    for length in sorted(left, reverse=True):
        out.best_fit(length, left[length])
    return out


def _substitute(out: Plan, segments: list[tuple[int, int, int]], stream: list[list[int]], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """Puts the stream's next actual lengths into one place of each sequence of the segments."""
    after = []
    for lo, hi, used in segments:
        while lo < hi and stream:
            length, count = stream[0]
            n = min(count, hi - lo)
            out.put(length, lo, lo + n, used)
            left[length] -= n
            after.append((lo, lo + n, used + length))
            lo += n
            stream[0][1] -= n
            if not stream[0][1]:
                stream.pop(0)
        if lo < hi:
            after.append((lo, hi, used))
    return after


#: The pattern that parts ordinary words of a known tokenizer, after lower-casing; white space is dropped.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of each byte: 0 white space, 1 a letter or part of one from U+00C0 to U+023F, 2 a digit, 3 a symbol, 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[ord("'")] = 4  # may begin an ending such as 's
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0x80:0xC0] = _KIND[0xC3:0xC9] = 1
_KIND[[32, 9, 10, 11, 12, 13]] = 0
#: Two-byte characters of that range that are no letters (U+00D7, U+00F7), or are two when lower-cased (U+0130).
_ODD = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


class WordTokens:
    """A worker's table of token ids for a tokenizer that drops white space.

    Ordinary words, of letters up to U+023F, digits and symbols, are parted as the tokenizer's pattern parts them, and
    each part is encoded once, whatever its case; other words, and those with a special token's string, are encoded as
    they are. A tokenizer of another pattern or normalisation gets all words as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        parts = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (said["normalizer"] or {}).get("normalizers") or []]
        self.known = parts[0].get("pattern") == {"Regex": KNOWN} and [x["type"] for x in parts] == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"]
        self._whole, self._part = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._part.normalizer = normalizers.Lowercase()
        self._part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = [re.escape(x.content.encode()) for x in self._whole.get_added_tokens_decoder().values()]
        self._special = re.compile(b"|".join(special)) if special else None
        self.table = Interned(self._encode)

    def _encode(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [None] * len(strings), np.zeros(len(strings), np.int64)
        joined = b"".join(strings)
        end = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        other = self._other(np.frombuffer(joined, np.uint8), joined)
        plain = np.diff(np.concatenate(([0], np.cumsum(other)))[np.concatenate(([0], end))]) == 0 if self.known else np.zeros(len(strings), bool)
        some = np.flatnonzero(plain)
        for at in range(0, len(some), 4000):
            group = some[at : at + 4000]
            done = self._part.encode(b" ".join(strings[i] for i in group.tolist()).decode(), add_special_tokens=False)
            number = np.bincount(np.array(done.word_ids, np.int64), minlength=len(group))
            flat, last = np.array(done.ids, np.uint32), np.cumsum(number)
            lengths[group] = number
            for i, a, b in zip(group.tolist(), (last - number).tolist(), last.tolist(), strict=True):
                ids[i] = flat[a:b]
        odd = np.flatnonzero(~plain).tolist()
        for i, done in zip(odd, self._whole.encode_batch_fast([strings[i].decode("utf-8", "surrogatepass") for i in odd], add_special_tokens=False), strict=True):
            ids[i] = np.array(done.ids, np.uint32)
            lengths[i] = len(ids[i])
        return np.concatenate(ids), lengths

    def _other(self, raw: np.ndarray, joined: bytes) -> np.ndarray:
        """Which bytes make their word one that isn't ordinary."""
        out = _KIND[raw] == 4
        for lead, last in _ODD:
            out[1:] |= (raw[:-1] == lead) & (raw[1:] == last)
        if self._special:
            out[[m.start() for m in self._special.finditer(joined)]] = True
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and each row's number of ids."""
        self.table.room()
        w = words(column)
        raw, kind = w.raw, _KIND[w.raw]
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(w.first) - 1, np.int64)
        other = np.concatenate(([0], np.cumsum(self._other(raw, raw.tobytes()))))
        odd = other[w.ends] > other[w.starts] if self.known else np.ones(len(w.starts), bool)
        begins = np.zeros(len(raw), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins |= kind == 2
        begins &= kind != 0
        folded = LOWER[raw]
        if odd.any():
            turn = np.zeros(len(raw) + 1, np.int8)
            np.add.at(turn, w.starts[odd], 1)
            np.add.at(turn, w.ends[odd], -1)
            inside = np.cumsum(turn[:-1], dtype=np.int8) > 0
            begins &= ~inside
            folded[inside] = raw[inside]
        begins[w.starts] = True
        starts = np.flatnonzero(begins)
        own = np.searchsorted(starts, w.starts)
        ends = np.append(starts[1:], 0)
        ends[np.append(own[1:], len(starts)) - 1] = w.ends
        ids, number = self.table.gather(self.table.entries(span_hashes(folded, starts, ends), lambda i: folded[starts[i] : ends[i]].tobytes()))
        total = np.concatenate(([0], np.cumsum(number)))
        return ids, np.diff(total[np.append(own, len(starts))[w.first]])


_tables: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tables:
        _tables[path] = WordTokens(path)
    return _tables[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and a final 0, cut into pieces of at most capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokens(path)
        for batch in batches:
            for part in chunks(batch, "text", BLOCK):
                ids, counts = own.encode(part.column("text"))
                counts = counts + 1
                end = np.cumsum(counts)
                flat = np.zeros(int(end[-1]), "<u4")
                inside = np.ones(len(flat), bool)
                inside[end - 1] = False
                flat[inside] = ids
                number = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = (end - counts)[row] + start
                crc = np.fromiter((zlib.crc32(flat[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(items: DataFrame, total: int) -> DataFrame:
    """items with rank: 0, 1, ... within each length. Buckets are counted, then ranks continue from one to the next."""
    buckets = max(1, -(-total // BUCKET))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counted = items.groupBy("length", "bucket").count()
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "bucket", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return items.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "bucket")


def placed(items: DataFrame, made: Plan) -> DataFrame:
    """items(length, rank, ...) with sequence_id and offset. The plan's size depends on the capacity, not on the corpus."""
    rows = np.array(sorted(made.rows), np.int64).reshape(-1, 5)
    keys, base, first, offset = rows[:, 0] << 48 | rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            yield frame.drop(columns="rank").assign(sequence_id=first[at] + rank - base[at], offset=offset[at])[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return items.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(run, schema)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs(doc_id, text) with the sequence and the offset that each goes to.

    A null or empty text is the one id 0. Repeated rows are packed each, and of equal pieces any may go to any of their
    places. A null doc_id is kept as it is. An empty table gives an empty one. Other columns, however named, aren't read.
    A text of any length is cut into pieces; at most one text and BLOCK bytes are in a worker's memory. path names a
    tokenizers file that every executor can read, of a tokenizer that drops white space; strings of its special tokens
    are those tokens, as the tokenizer has it.
    """
    items = settled(pieces(small_batches(docs), path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    return placed(ranked(items, sum(counts.values())), plan(counts, capacity))
