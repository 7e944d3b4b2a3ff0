import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm.components import components
from lattica.llm.jaccard import jaccard_join
from lattica.llm.recompress import anchors, remove_repeats
from lattica.llm.words import Words, blocks, windows, words
from tests.llm import plain


def test_words_match_the_pattern():
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "bc", " ", "\n", "\t", "\x1c", "é", " ", "日"]) for _ in range(r.randrange(30))) for _ in range(200)] + [None, "", "x" * 3_000_000 + " y", " ".join(["word"] * 400_000)]
    w = words(pa.array(texts, pa.string()))
    spans = [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts[: w.first[200]], w.ends, strict=False)]
    assert spans == [x for t in texts[:200] for x in plain.words(t)]
    assert w.counts[-4:].tolist() == [0, 0, 2, 400_000]
    tail = w.hashes[w.first[203] :]
    assert len(set(tail.tolist())) == 1


def test_blocks_follow_rows_alone():
    r = random.Random(3)
    texts = ["x" * r.choice([0, 1, 5, 30, 200]) for _ in range(300)]
    batch = pa.record_batch([pa.array(range(300)), pa.array([t or None for t in texts], pa.string())], ["i", "text"])
    cut = lambda sizes: [batch.slice(a, n) for a, n in sizes]
    ways = [cut([(0, 300)]), cut([(i, 1) for i in range(300)]), cut([(i, 7) for i in range(0, 294, 7)] + [(294, 6)])]
    found = [[b.column("i").to_pylist() for b in blocks(iter(w), "text", 100, 20)] for w in ways]
    assert found[0] == found[1] == found[2] and [i for b in found[0] for i in b] == list(range(300))
    assert all(len(b) <= 20 and (len(b) == 1 or sum(len(texts[i]) for i in b) <= 100) for b in found[0])


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    shared = [r.randrange(50) for _ in range(60)]
    docs = [[r.randrange(50) for _ in range(r.randrange(20))] + shared + [r.randrange(50) for _ in range(r.randrange(20))] for _ in range(4)] + [[1] * 80, [2] * 10]
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    names = np.array([x for d in docs for x in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, name, place = anchors(names, first)
    flat = [x for d in docs for x in d]
    by: dict = {}
    for i, n, p in zip(at.tolist(), name.tolist(), place.tolist(), strict=True):
        assert by.setdefault(tuple(flat[i : i + 35]), (n, p - i)) == (n, p - i)
    assert isinstance(Words, type) and len(windows(names, 35)) == len(flat) - 34


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_all_pairs(spark, seed):
    rows = plain.corpus(seed)
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], plain.SCHEMA + ", component_id string, cls int")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs, 4).collect()}
    assert found == plain.jaccard_components([(r[0], r[1]) for r in rows])


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None), (6, ""), (None, None), (7, "A B C D E F")]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert found == sorted([("None", 2, "3"), ("3", 2, "3"), ("3", 2, "3"), ("5", 0, "5"), ("6", 0, "6"), ("None", 0, "None"), ("7", 2, "3")])
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def test_jaccard_links_through_rows_without_id(spark):
    base = [f"w{i}" for i in range(80)]
    other = [*base[:74], *(f"x{i}" for i in range(6))]  # 70 of 82 shared with base
    third = [*(f"y{i}" for i in range(6)), *other[6:]]  # linked with other, not with base
    rows = [(4, " ".join(base)), (None, " ".join(other)), (2, " ".join(third))]
    found = [(r["doc_id"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()]
    sets = [plain.shingles(t) for _, t in rows]
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert link(0, 1) and link(1, 2) and not link(0, 2)
    assert sorted(found, key=str) == [(2, 2), (4, 2), (None, 2)]


def test_jaccard_of_heavy_tokens(spark, monkeypatch):
    """Documents whose prefixes are all common, joined on tokens of two orders; and one very long text."""
    from lattica.llm import jaccard

    monkeypatch.setattr(jaccard, "HEAVY", 2)
    monkeypatch.setattr(jaccard, "STARS", 0)
    r = random.Random(5)
    common = [plain.sentence(r, "en", 6) for _ in range(9)]
    rows = [(i, " ".join(common[k] for k in sorted(r.sample(range(9), 8)))) for i in range(40)] + [(50, "long " * 400_000 + "end"), (51, "long " * 400_000 + "end")]
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert found == plain.jaccard_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_plain(spark, seed):
    rows = [*plain.corpus(seed), plain.corpus(seed)[3]]
    docs = spark.createDataFrame([(*r, "clash", b"k") for r in rows], plain.SCHEMA + ", n_words string, key binary")
    expected = sorted((r[0], len(w), stay.count(False), " ".join(x for x, s in zip(w, stay, strict=True) if s), plain.cut(r[1], stay)) for r, (w, stay) in zip(rows, plain.without_repeats([r[1] for r in rows]), strict=True) if r[1] is not None)
    kept = {mode: sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(docs, mode).where("text is not null").collect()) for mode in ("space", "cut")}
    assert kept["space"] == [x[:4] for x in expected]
    assert [x[3] for x in kept["cut"]] == [x[4] for x in expected]
    assert sum(x[2] for x in expected) > 100
    null = remove_repeats(docs).where("text is null").collect()
    assert [(r["n_words"], r["n_removed"]) for r in null] == [(0, 0)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_repeat_query_hashes_kept_words(spark, tmp_path):
    from lattica.llm.queries import QUERIES

    rows = plain.corpus(3)
    spark.createDataFrame(rows, plain.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: hashlib.sha256(" ".join(x for x, s in zip(w, stay, strict=True) if s).encode()).hexdigest() for r, (w, stay) in zip(rows, plain.without_repeats([r[1] for r in rows]), strict=True)}
