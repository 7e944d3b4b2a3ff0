"""Substring deduplication by recompression.

Each round renames a document's symbols: neighbours are fused into one new symbol if they are equal (a run), or if the
first belongs to the left and the second to the right half of the round's hashed alphabet (a pair). Whether a boundary
between two symbols stays depends on these two alone, and a new name depends on the fused names alone. So equal substrings
get equal symbols everywhere in the corpus, but for one symbol at either end in each round, without any coordination.

Each window of 35 words takes as its anchor the first symbol of the highest round that lies in it with all that decides
it. Equal windows have equal anchors. Blocks of whole rows send the distinct names of their anchors to slices of the name
space, which answer with those that other blocks have too; only windows on these shared symbols are candidates. A block
sends each distinct candidate once, as 64 bits over the anchor's name and all its words, to a slice that those bits choose,
so the windows of a common anchor spread over all slices. Equal windows within a block are found there. Blocks are written
once, as compressed rows, and dealt out once, to meet the answers of both exchanges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import settled, slices_for, small_batches
from lattica.llm.words import Words, _power, blocks, mix, pack, unpack, windows, words
from lattica.llm.workers import tidy, tidy_group, tidy_pair

WINDOW, ROUNDS = 35, 8
#: Text bytes of one block of the exchange, and text bytes behind one slice of the name space and of the window space.
BLOCK, SLICE = 3 << 20, 8 << 20
#: Bytes of an anchor's name that are sent and compared besides its slice (more only makes fewer vain candidates), and the
#: level at which a block's rows are compressed.
NAME, LEVEL = 5, 9
#: Bytes of a block's rows in one row of the exchange: larger values would each take several regions of the JVM's heap.
PART = 256 << 10
#: Kinds of the exchanges' rows: a block's rows, an answer to a block, a block's question to a slice.
ROWS, ANSWER, ASKED = 0, 1, 2


def anchors(hashes: np.ndarray, first: np.ndarray, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of one row: its first word, its anchor's name and its anchor's first word."""
    n = len(hashes)
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= ends)
    name, place = mix(hashes[at], 900), at.copy()
    alive, lo, hi = np.arange(len(at)), at, at + size
    symbols, spot = hashes, np.arange(n)
    fresh = np.zeros(n, bool)
    fresh[first[:-1][np.diff(first) > 0]] = True
    for r in range(rounds):
        if not len(alive):
            break
        left = (mix(symbols, 300 + r) & np.uint64(1)).astype(bool)
        fused = ((symbols[:-1] == symbols[1:]) | (left[:-1] & ~left[1:])) & ~fresh[1:]
        starts = np.concatenate(([True], ~fused))
        count = np.concatenate(([0], np.cumsum(starts)))
        begin = np.flatnonzero(starts)
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * _power(len(symbols), False), out=total[1:])
        end = np.append(begin[1:], len(symbols))
        symbols = mix((total[end] - total[begin]) * _power(len(symbols), True)[begin], 500 + r)
        fresh, spot = fresh[begin], spot[begin]
        lo, hi = count[lo + 1], count[hi] - 1
        whole = lo < hi
        alive, lo, hi = alive[whole], lo[whole], hi[whole]
        name[alive], place[alive] = mix(symbols[lo], 700 + r), spot[lo]
    return at, name, place


_SENT = "slice long, block binary, kind int, payload binary"
_SENT_ARROW = pa.schema([("slice", pa.int64()), ("block", pa.binary()), ("kind", pa.int32()), ("payload", pa.binary())])
_ANSWERED = "block binary, payload binary"


def _rows(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)


def _packed(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _parts(raw: bytes) -> list[bytes]:
    return [i.to_bytes(4, "little") + raw[a : a + PART] for i, a in enumerate(range(0, len(raw), PART))]


def _unpacked(parts: list[bytes]) -> tuple[pa.RecordBatch, int]:
    """The rows of a block from its parts in any order, and how many equal blocks the parts are from."""
    numbers = [int.from_bytes(p[:4], "little") for p in parts]
    by = dict(zip(numbers, parts, strict=True))
    return pa.ipc.open_stream(b"".join(by[i][4:] for i in range(len(by)))).read_next_batch(), numbers.count(0)


def _by_slice(slice_: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(slice, columns' values there) for each slice."""
    order = np.argsort(slice_, kind="stable")
    slice_, columns = slice_[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.concatenate(([True], slice_[1:] != slice_[:-1], [True]))) if len(slice_) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield (int(slice_[a]), *(c[a:b] for c in columns))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table."""
    at = np.minimum(np.searchsorted(table, x), max(0, len(table) - 1))
    return table[at] == x if len(table) else np.zeros(len(x), bool)


def _ask_names(slices: int):
    """Of each block: its rows, and the distinct names of its anchors by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            raw = _packed(part)
            block = hashlib.blake2b(raw, digest_size=16).digest()
            w = words(part.column("text"))
            name = np.unique(anchors(w.hashes, w.first)[1])
            rows = [(0, block, ROWS, x) for x in _parts(raw)]
            for k, x in _by_slice(((name >> np.uint64(40)) % np.uint64(slices)).astype(np.int64), name):
                rows.append((k, block, ASKED, pack(x, NAME)))
            yield _rows(rows)

    return run


def _answers(blocks_: list[bytes], values: list[np.ndarray], replies: list[np.ndarray]) -> pd.DataFrame:
    """For each question of a slice with values that come twice in the slice, these values' replies."""
    every = np.sort(np.concatenate(values)) if values else np.zeros(0, np.uint64)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    hits = [_among(x, twice) for x in values]
    found = [(block, y[hit].tobytes()) for block, y, hit in zip(blocks_, replies, hits, strict=True) if hit.any()]
    return pd.DataFrame(found, columns=["block", "payload"])


def _shared_names(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: for each block, those of its names that another block has too."""
    values = [unpack(p, NAME) for p in part["payload"]]
    return _answers(list(part["block"]), values, values)


def _ask_windows(slices: int):
    """Of one block and its shared names: the windows that repeat within it, and its distinct windows on shared names."""

    def run(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        shared = np.unique(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(p, "<u8") for p in answers.column("payload").to_pylist())]))
        part, copies = _unpacked(own.column("payload").to_pylist())
        w = words(part.column("text"))
        at, name, _ = anchors(w.hashes, w.first)
        h = windows(w.hashes, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        known = np.full(len(h), copies > 1)  # all windows of blocks that are equal
        known[order] |= same[:-1] | same[1:]
        sent = np.empty(len(h), bool)
        sent[order] = ~same[:-1]
        sent &= _among(name & np.uint64((1 << 8 * NAME) - 1), shared)
        block = key[0].as_py()
        rows = [(int.from_bytes(block[:4], "little") % slices, block, ANSWER, at[known].astype("<u4").tobytes())] if known.any() else []
        full = mix(name[sent], 77) + h[sent]
        for k, x, y in _by_slice(((full >> np.uint64(32)) % np.uint64(slices)).astype(np.int64), full, at[sent]):
            places = y.astype("<u4").view(np.uint8).reshape(-1, 4).T  # in order, so that high bytes are alike
            rows.append((k, block, ASKED, x.astype("<u8").tobytes() + places.tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _repeated(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: for each block, the places of those of its windows that another block has too, and what it knows."""
    asked = part[part["kind"] == ASKED]
    values = [np.frombuffer(p[: len(p) // 12 * 8], "<u8") for p in asked["payload"]]
    places = [np.ascontiguousarray(np.frombuffer(p[len(p) // 12 * 8 :], np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for p in asked["payload"]]
    return pd.concat([part[part["kind"] == ANSWER][["block", "payload"]], _answers(list(asked["block"]), values, places)])


def _cut(part: pa.RecordBatch, w: Words, keep: np.ndarray, mode: str) -> pa.RecordBatch:
    """The rows with the kept words as text, and n_words and n_removed as last columns."""
    row, raw = w.rows, w.raw
    off = np.zeros(part.num_rows + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False), out=off[1:])
    byte = np.zeros(len(raw) + 1, np.int8)
    if mode == "space":
        k = np.flatnonzero(keep)
        last = np.ones(len(k), bool)
        last[:-1] = row[k][1:] != row[k][:-1]
        raw = np.append(raw, np.uint8(32))
        raw[w.ends[k[~last]]] = 32
        byte[w.starts[k]] += 1
        byte[w.ends[k] + ~last] -= 1
        mask = np.cumsum(byte, dtype=np.int8)[:-1] > 0
    else:  # a removed word goes with the white space after it
        k = np.flatnonzero(~keep)
        after = off[1:][row[k]]
        inner = k + 1 < w.first[1:][row[k]]
        after[inner] = w.starts[k[inner] + 1]
        np.add.at(byte, w.starts[k], 1)
        np.add.at(byte, after, -1)
        mask = np.cumsum(byte, dtype=np.int8)[:-1] == 0
    data = raw[: len(mask)][mask]
    total = np.concatenate(([0], np.cumsum(mask)))[off]
    text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(total.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())
    if part.column("text").null_count:
        text = pc.if_else(part.column("text").is_null(), pa.scalar(None, pa.string()), text)
    removed = np.bincount(row[~keep], minlength=part.num_rows).astype(np.int64)
    names = part.schema.names
    columns = [text if c == "text" else part.column(i) for i, c in enumerate(names)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(w.counts.astype(np.int64)), pa.array(removed)], [*names, "n_words", "n_removed"])


def _kept(mode: str):
    """Of one block: its rows without the words that its repeated windows cover."""

    def run(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        rows, copies = _unpacked(own.column("payload").to_pylist())
        w = words(rows.column("text"))
        step = np.zeros(len(w.hashes) + WINDOW + 1, np.int32)
        at = np.unique(np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(p, "<u4") for p in answers.column("payload").to_pylist())])).astype(np.int64)
        step[at] += 1
        step[at + WINDOW] -= 1
        done = _cut(rows, w, np.cumsum(step)[: len(w.hashes)] == 0, mode)
        return pa.Table.from_batches([done] * copies)

    return run


def remove_repeats(docs: DataFrame, mode: str = "space", slices: int | None = None) -> DataFrame:
    """docs(text, ...) with each word removed that a repeated 35-word window covers.

    A window counts as repeated if its words also start anywhere else in docs, the same text included, overlaps too;
    windows are equal if 64 bits of a hash over their words and their common symbol are.
    text becomes the kept words joined by one space (mode "space"), or the text with each removed word and the white
    space after it cut out (mode "cut", which leaves texts without repeats as they are). Adds n_words and n_removed,
    replacing columns of these names; other columns are kept, whatever their names. A null text stays null, with no
    words; an empty one stays empty. A text longer than a block is a block alone. Equal rows are each other's repeats, and
    all stay, with equal results. Without rows there is no result. Row order and ids play no part.
    """
    docs = small_batches(docs).drop("n_words", "n_removed").withColumn("text", F.col("text").cast("string"))
    slices = slices or slices_for(docs, "text", SLICE)
    asked = settled(docs.mapInArrow(tidy(_ask_names(slices)), _SENT), "blocks")
    rows = asked.where(F.col("kind") == ROWS).select("block", "payload").groupBy("block")
    shared = asked.where(F.col("kind") == ASKED).groupBy("slice").applyInPandas(tidy_group(_shared_names), _ANSWERED)
    candidates = rows.cogroup(shared.groupBy("block")).applyInArrow(tidy_pair(_ask_windows(slices)), _SENT)
    found = candidates.groupBy("slice").applyInPandas(tidy_group(_repeated), _ANSWERED)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns), "n_words long", "n_removed long"])
    return rows.cogroup(found.groupBy("block")).applyInArrow(tidy_pair(_kept(mode)), schema)
