from collections import Counter

import numpy as np
import pyarrow as pa

from lattica.llm import recompress
from lattica.llm.words import pack
from tests.llm import plain

SCHEMA = "doc_id long, text string, block string, kind int, slice long, payload binary"


def _found(docs):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"], r["block"], r["kind"]) for r in recompress.remove_repeats(docs).collect())


def test_rows_of_equal_blocks_repeat_each_other(spark):
    """Blocks that are equal are one group of the exchange: no row is lost, and all windows of both go."""
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "b", 1, 2, b"p"), (2, "short text", None, None, None, None), (3, None, "b", 0, 0, b""), (4, "", "c", 2, 9, b"q")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert _found(docs) == Counter({(1, 50, 0, long, "b", 1): 1, (2, 2, 0, "short text", None, None): 1, (3, 0, 0, None, "b", 0): 1, (4, 0, 0, "", "c", 2): 1})
    assert _found(docs.union(docs)) == Counter({(1, 50, 50, "", "b", 1): 2, (2, 2, 0, "short text", None, None): 2, (3, 0, 0, None, "b", 0): 2, (4, 0, 0, "", "c", 2): 2})


def test_passages_across_blocks_and_a_very_long_text(spark):
    """A passage in every partition, each time in other company, one text longer than a block, and one of a single word."""
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*(f"a{k}_{i}" for i in range(k % 7)), *passage, *(f"z{k}_{i}" for i in range(k % 5))]) for k in range(40)]
    texts += [" ".join(f"l{i}" for i in range(900_000)), " ".join(["same"] * 3000), " ".join(f"l{i}" for i in range(70_000, 70_034))]
    docs = spark.createDataFrame([(i, t, "x", 0, 0, b"") for i, t in enumerate(texts)], SCHEMA).repartition(8, "doc_id")
    found = {k[0]: (k[1], k[2]) for k in _found(docs)}
    expected = {i: (len(w), stay.count(False)) for i, (w, stay) in enumerate(plain.without_repeats(texts[:40] + texts[41:]))}
    assert [found[i] for i in range(40)] == [expected[i] for i in range(40)] and all(n == 40 for _, n in list(expected.values())[:40])
    assert found[40] == (900_000, 0) and found[41] == (3000, 3000) and found[42] == (34, 0)


def test_only_shared_symbols_are_candidates():
    """A slice answers a block with the names that another block has, and no others."""
    import pandas as pd

    names = [np.array(x, "<u8") for x in ([1, 2, 3], [3, 4], [4, 5], [6])]
    part = pd.DataFrame([(0, bytes([k]), recompress.ASKED, pack(x, recompress.NAME)) for k, x in enumerate(names)], columns=["slice", "block", "kind", "payload"])
    out = recompress._shared_names((0,), part)
    assert {b: np.frombuffer(p, "<u8").tolist() for b, p in out.itertuples(index=False)} == {b"\0": [3], b"\1": [3, 4], b"\2": [4]}


def test_parts_of_equal_blocks():
    batch = pa.record_batch([pa.array([f"{i * 7919 % 1000003:x}" for i in range(200_000)])], ["a"])
    parts = recompress._parts(recompress._packed(batch))
    assert len(parts) > 2
    for copies in (1, 2):
        got, n = recompress._unpacked(list(reversed(parts)) * copies)
        assert got.equals(batch) and n == copies
