"""Byte-level BPE by merge replay over the corpus's distinct pieces, and decoding by gathers.

Texts are tiled with pieces. Blocks of documents send their distinct pieces to slices of the space of pieces, so that
each piece of the corpus comes to one slice, however often it occurs, and there from each block once. In a slice the
distinct pieces are laid out in one array of byte tokens. An inverted index leads from each adjacent token pair to its
positions. Pairs are taken in rank order; each is applied at all its positions, from left to right, and only the pairs
with the touched neighbours are filed anew. The ids go back to the blocks, which put documents together by gathers.

A block is named by its texts' bytes, so the two scans of the documents, for pieces and for texts, agree on it wherever
a task runs again. Should a block's texts come without answers, as where an input changes from scan to scan, its pieces
are encoded on the spot.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.llm.tables import slices_for, small_batches
from lattica.llm.words import blocks, span_hashes, text_buffer, words
from lattica.llm.workers import tidy, tidy_group

#: Text bytes of a block, text bytes behind a slice of the pieces, and bytes of distinct pieces replayed at once.
BLOCK, SLICE, REPLAY = 8 << 20, 8 << 20, 1 << 20
#: The level at which texts are compressed for their way to their block's answers.
LEVEL = 3
#: The pattern whose pieces are found by arrays; those of another are found text by text.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of each byte: 0 white space, 1 a letter or part of one from U+00C0 to U+023F, 2 a digit, 3 a symbol, 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[ord("'")] = 4  # may begin an ending such as 's
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0x80:0xC0] = _KIND[0xC3:0xC9] = 1
_KIND[[32, 9, 10, 11, 12, 13]] = 0
#: White space beyond ASCII's six, as UTF-8: rows with any of it go piece by piece.
_WIDE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Replay:
    """Encodes pieces by replaying the merges that a rank table implies."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Each pair of tokens, as one number, to the token that it becomes, whose rank is also the merge's.
        self._merged = {a << 32 | b: rank for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None}
        self._pairs = np.array(sorted(self._merged), np.int64)
        self._ranks = np.array([self._merged[x] for x in self._pairs.tolist()], np.int64)

    def _filed(self, tokens: np.ndarray) -> dict[int, list[int]]:
        """The inverted index: each merge that some adjacent pair allows, to the pair's positions from left to right."""
        keys = tokens[:-1] << 32 | tokens[1:]
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        places = np.flatnonzero((self._pairs[at] == keys) & (tokens[:-1] >= 0) & (tokens[1:] >= 0))
        rank = self._ranks[at[places]]
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order].tolist()
        edge = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1], [True]))).tolist() if len(rank) else [0]
        return {int(rank[a]): places[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)}

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece that is a token itself is that token."""
        out: list[list[int]] = [[whole] if (whole := self.ranks.get(p)) is not None else [] for p in pieces]
        open_ = [i for i, p in enumerate(pieces) if not out[i] and p]
        if not open_:
            return out
        sizes = np.fromiter((len(pieces[i]) for i in open_), np.int64, len(open_))
        begin = np.cumsum(sizes + 1) - sizes - 1
        flat = np.full(int(sizes.sum()) + len(open_), -1, np.int64)  # -1 parts the pieces
        inside = np.ones(len(flat), bool)
        inside[begin + sizes] = False
        flat[inside] = self._byte[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
        index = self._filed(flat)
        tokens, merged, size = flat.tolist(), self._merged, len(flat)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = sorted(index)
        while heap:
            rank = heapq.heappop(heap)
            for at in sorted(index.pop(rank)):
                left, gone = tokens[at], after[at]
                if left < 0 or gone >= size or merged.get(left << 32 | tokens[gone]) != rank or tokens[gone] < 0:
                    continue
                tokens[at], tokens[gone] = rank, -2  # -2: fused into the one before
                end = after[at] = after[gone]
                prior = before[at]
                if end < size:
                    before[end] = at
                    if tokens[end] >= 0 and (new := merged.get(rank << 32 | tokens[end])) is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                if prior >= 0 and tokens[prior] >= 0 and (new := merged.get(tokens[prior] << 32 | rank)) is not None:
                    if new in index:
                        index[new].append(prior)
                    else:
                        index[new] = [prior]
                        heapq.heappush(heap, new)
        flat = np.array(tokens, np.int64)
        kept = flat >= 0
        counts = np.diff(np.concatenate(([0], np.cumsum(kept)))[np.append(begin, size)])
        ids, at = flat[kept].tolist(), 0
        for i, k in zip(open_, counts.tolist(), strict=True):
            out[i] = ids[at : at + k]
            at += k
        return out


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[start : start + length] of all the spans, one after the other."""
    total = np.cumsum(length)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + length, length)]


class Codec:
    """Tiles texts with pieces, encodes pieces and decodes ids, for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.replay = Replay(read_ranks(path))
        self._known, self._split = pattern == KNOWN, regex.compile(pattern)
        size = max(self.replay.bytes_of) + 1
        tokens = [self.replay.bytes_of.get(i, b"") for i in range(size)]
        self._length = np.fromiter(map(len, tokens), np.int64, size)
        self._start = np.cumsum(self._length) - self._length
        self._data = np.frombuffer(b"".join(tokens), np.uint8)

    def tiled(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, the starts of units that tile them, and each row's first unit. A unit is a piece, or a word
        of several pieces that depend on nothing around it; a space before a word is its own."""
        raw, off = text_buffer(column)
        begins = np.zeros(len(raw) + 1, bool)
        if self._known:
            w = words(column)
            opens = np.empty(len(w.starts), np.int64)  # where the white space before each word starts
            opens[1:] = w.ends[:-1]
            heads = np.flatnonzero(w.counts > 0)
            opens[w.first[heads]] = off[heads]
            spaced = (w.starts > opens) & (raw[np.maximum(w.starts - 1, 0)] == 32)
            kind = _KIND[raw]
            sign = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
            kind[sign] = kind[sign + 1] = 3
            begins[1:-1] = kind[1:] != kind[:-1]
            begins[:-1] &= kind != 0
            odd = np.diff(np.concatenate(([0], np.cumsum(kind == 4)))[np.stack([w.starts, w.ends], 1)], axis=1)[:, 0] > 0
            if odd.any():
                turn = np.zeros(len(raw) + 1, np.int8)
                np.add.at(turn, w.starts[odd], 1)
                np.add.at(turn, w.ends[odd], -1)
                begins[np.cumsum(turn, dtype=np.int8) > 0] = False
            begins[w.starts[spaced]] = False
            begins[w.starts - spaced] = True
            begins[opens[w.starts > opens]] = True  # all white space but its last character
            begins[w.starts[~spaced & (w.starts > opens)] - 1] = True
            tail = off[:-1].copy()
            tail[heads] = w.ends[w.first[1:][heads] - 1]
            begins[tail[tail < off[1:]]] = True
            whole = sorted({int(np.searchsorted(off, m.start(), side="right")) - 1 for m in _WIDE.finditer(raw.tobytes())})
        else:
            whole = np.flatnonzero(np.diff(off)).tolist()
        for r in whole:
            pieces = [x.encode("utf-8", "surrogatepass") for x in self._split.findall(raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "surrogatepass"))]
            ends = off[r] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            begins[off[r] : off[r + 1]] = False
            begins[np.append(off[r], ends[:-1])] = True
        starts = np.flatnonzero(begins[:-1])
        return raw, starts, np.searchsorted(starts, off)

    def encode_units(self, strings: list[bytes]) -> list[list[int]]:
        """Ids of each unit, by merge replay over all their distinct pieces."""
        if not strings:
            return []
        kinds = _KIND[np.frombuffer(b"".join(strings), np.uint8)]
        end = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        odd = (np.maximum.reduceat(kinds, end - np.diff(end, prepend=0)) > 3).tolist() if self._known else [True] * len(strings)
        split = [[x.encode("utf-8", "surrogatepass") for x in self._split.findall(s.decode("utf-8", "surrogatepass"))] if o else [s] for s, o in zip(strings, odd, strict=True)]
        pieces = list(dict.fromkeys(p for s in split for p in s))
        ids: dict[bytes, list[int]] = {}
        at = held = 0
        for i, p in enumerate(pieces):
            held += len(p)
            if held > REPLAY or i + 1 == len(pieces):
                ids.update(zip(pieces[at : i + 1], self.replay.encode(pieces[at : i + 1]), strict=True))
                at, held = i + 1, 0
        return [ids[s[0]] if len(s) == 1 else [i for p in s for i in ids[p]] for s in split]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows in a row, and each row's number of bytes."""
        length = self._length[ids]
        total = np.concatenate(([0], np.cumsum(length)))
        return _gathered(self._data, self._start[ids], length), np.diff(total[np.concatenate(([0], np.cumsum(counts)))])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def block_name(raw: np.ndarray, off: np.ndarray) -> bytes:
    name = hashlib.blake2b(raw, digest_size=16)
    name.update(np.ascontiguousarray(off).tobytes())
    return name.digest()


class Units:
    """A block's distinct units, dealt out to slices. Equal texts have equal units in the same order."""

    def __init__(self, own: Codec, column: pa.Array, slices: int):
        self.raw, starts, self.first = own.tiled(column)
        ends = np.append(starts[1:], len(self.raw)) if len(starts) else starts
        hashes, where, self.inverse = np.unique(span_hashes(self.raw, starts, ends), return_index=True, return_inverse=True)
        part = (hashes >> np.uint64(40)).astype(np.int64) % slices
        order = np.argsort(part, kind="stable")
        self.place = np.empty_like(order)
        self.place[order] = np.arange(len(order))
        self.start, self.length = starts[where[order]], (ends - starts)[where[order]]
        edge = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
        self.slices = list(zip(part[order][edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        self.block = block_name(self.raw, text_buffer(column)[1])

    def strings(self, a: int, b: int) -> list[bytes]:
        return [self.raw[s : s + n].tobytes() for s, n in zip(self.start[a:b].tolist(), self.length[a:b].tolist(), strict=True)]

    def packed(self, a: int, b: int) -> bytes:
        return _packed(self.length[a:b], _gathered(self.raw, self.start[a:b], self.length[a:b]))


def _packed(lengths: np.ndarray, flat: np.ndarray) -> bytes:
    """Lists of bytes or ids, as their number, the widths of a length and of an item, the lengths and the items."""
    wide, most = flat.itemsize, int(flat.max()) if len(flat) else 0
    wide, each = 1 if wide == 1 else 2 if most < 1 << 16 else 4, 1 if not len(lengths) or lengths.max() < 1 << 8 else 4
    return np.array([len(lengths), each, wide], "<i8").tobytes() + lengths.astype(f"<u{each}").tobytes() + flat.astype(f"<u{wide}").tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, each, wide = np.frombuffer(payload, "<i8", 3).tolist()
    return np.frombuffer(payload, f"<u{each}", n, 24).astype(np.int64), np.frombuffer(payload, f"<u{wide}", -1, 24 + each * n)


def _strings(payload: bytes) -> list[bytes]:
    lengths, flat = _unpacked(payload)
    end, joined = np.cumsum(lengths), flat.tobytes()
    return [joined[a:b] for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True)]


_ROWS = "slice long, block binary, payload binary"


def _rows(rows: list[tuple[int | None, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], ["slice", "block", "payload"])


def _sent(path: str, pattern: str, slices: int):
    """Each block's distinct units, a row for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            units = Units(codec(path, pattern), part.column("text"), slices)
            yield _rows([(k, units.block, units.packed(a, b)) for k, a, b in units.slices])

    return run


def _answered(path: str, pattern: str):
    """Of one slice: the ids of each block's units, in their order."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        payloads, number = part.column("payload").to_pylist(), {}
        lists = [[number.setdefault(x, len(number)) for x in _strings(p)] for p in payloads]
        ids = codec(path, pattern).encode_units(list(number))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, start = np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum())), np.cumsum(length) - length
        out = []
        for block, own in zip(part.column("block").to_pylist(), lists, strict=True):
            at = np.array(own, np.int64)
            out.append((key[0].as_py(), block, _packed(length[at], _gathered(flat, start[at], length[at]))))
        return pa.Table.from_batches([_rows(out)])

    return run


def _texts():
    """Each block's texts and other columns, compressed, under its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                out.write_batch(part)
            yield _rows([(None, block_name(*text_buffer(part.column("text"))), sink.getvalue().to_pybytes())])

    return run


def _coded(path: str, pattern: str, slices: int, finish, schema: pa.Schema):
    """Of one block: its rows with their ids, by finish(batch, ids, counts, bytes, sizes)."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        own, out, answers = codec(path, pattern), [], {}
        for slice_, payload in zip(part.column("slice").to_pylist(), part.column("payload").to_pylist(), strict=True):
            if slice_ is not None:
                answers[slice_] = payload
        for payload in part.filter(pc.is_null(part.column("slice"))).column("payload"):
            (batch,) = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks().to_batches()
            units = Units(own, batch.column("text"), slices)
            length, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for slice_, a, b in units.slices:
                if (have := answers.get(slice_)) is not None:
                    found = _unpacked(have)
                else:
                    lists = own.encode_units(units.strings(a, b))
                    found = np.fromiter(map(len, lists), np.int64, len(lists)), np.array([i for x in lists for i in x], np.uint32)
                length.append(found[0])
                ids.append(found[1].astype(np.uint32))
            length, flat = np.concatenate(length), np.concatenate(ids)
            at = units.place[units.inverse]
            total = np.concatenate(([0], np.cumsum(length[at])))
            ids, counts = _gathered(flat, (np.cumsum(length) - length)[at], length[at]), np.diff(total[units.first])
            data, sizes = own.decode(ids, counts)
            if not np.array_equal(data, units.raw):
                raise ValueError("ids don't decode to their text")
            out.append(finish(batch, ids, counts, data, sizes))
        return pa.Table.from_batches(out, schema)

    return run


def _through(docs: DataFrame, path: str, pattern: str, finish, schema: str, slices: int | None) -> DataFrame:
    slices = slices or slices_for(small_batches(docs), "text", SLICE)
    sent = docs.select("text").mapInArrow(tidy(_sent(path, pattern, slices)), _ROWS)
    answers = sent.groupBy("slice").applyInArrow(tidy_group(_answered(path, pattern)), _ROWS)
    return docs.mapInArrow(tidy(_texts()), _ROWS).unionByName(answers).groupBy("block").applyInArrow(tidy_group(_coded(path, pattern, slices, finish, to_arrow_schema(StructType.fromDDL(schema)))), schema)


def encoded(docs: DataFrame, path: str, pattern: str, slices: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) without text, with ids (array of int) and decoded (the ids' bytes).

    A null or empty text has no ids. Special tokens aren't known. Other columns are kept, but for columns named ids and
    decoded, which are replaced. Repeated rows are encoded each for itself; of two merges of one rank in a piece the
    left one comes first. An empty table gives an empty one. A text of any length is taken whole: one that is longer
    than a block is a block of its own. path must be readable on every executor.
    """
    names = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "ids array<int>, decoded binary"])

    target = to_arrow_schema(StructType.fromDDL(schema))

    def finish(batch, ids, counts, data, sizes):
        edges = lambda x: pa.array(np.concatenate(([0], np.cumsum(x))), pa.int32())
        lists = pa.ListArray.from_arrays(edges(counts), pa.array(ids.view(np.int32)))
        raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, edges(sizes).buffers()[1], pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, raw], target)

    typed = docs.select(*names, F.col("text").cast("string").alias("text"))
    return _through(typed, path, pattern, finish, schema, slices)


def digests(docs: DataFrame, path: str, pattern: str, slices: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's ids and of the bytes they decode to; rows and odd
    texts are treated as encoded() treats them, and columns but doc_id and text aren't read."""

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def finish(batch, ids, counts, data, sizes):
        hashed = []
        for values, lengths in ((ids.astype("<u4"), counts), (data, sizes)):
            end = np.cumsum(lengths)
            hashed.append([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(end - lengths, end, strict=True)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in hashed)], target)

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _through(typed, path, pattern, finish, schema, slices)
