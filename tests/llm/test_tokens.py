import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattica.llm import bpe, packing
from tests.llm import plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [" ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", "\xa0", "\x85", "　", "a", "the", "ing", "'s", "'ll", "12", "é", "日本", "!!", "###", ".", "\x1c", "😀", "aaaaaaa", "ababab", "́"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def by_units(own, texts):
    """ids and counts of texts, and the bytes that the ids decode to, with the units of one block encoded at once."""
    units = bpe.Units(own, pa.array(texts, pa.string()), 3)
    found = own.encode_units(units.strings(0, len(units.start)))
    at = units.place[units.inverse].tolist()
    ids = [[i for k in at[a:b] for i in found[k]] for a, b in zip(units.first[:-1], units.first[1:], strict=True)]
    return ids, own.decode(np.array([i for x in ids for i in x], np.int64), np.array(list(map(len, ids)), np.int64))[0].tobytes()


def held_against(reference, texts, pattern=public_tokenizers.PATTERN):
    ids, data = by_units(bpe.codec(RANKS, pattern), texts)
    for t, own in zip(texts, ids, strict=True):
        assert own == reference.encode_ordinary(t or ""), repr(t)[:300]
    assert data == "".join(t or "" for t in texts).encode()


def test_bpe_matches_the_library(reference):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(3000)] + ["", None, "   ", "a" * 20_000, " \n" * 50, "ab" * 9_000]
    held_against(reference, texts)
    held_against(reference, ["", None])
    assert public_tokenizers.PATTERN == bpe.KNOWN
    other = r" ?\p{L}{1,3}| ?[^\s\p{L}]+|\s+"
    held_against(tiktoken.Encoding("other", pat_str=other, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}), texts[:800], other)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_bpe_round_trips(reference, texts):
    held_against(reference, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_bpe_without_answers(spark, reference):
    """Texts whose blocks the slices know nothing of, as where an input changes from scan to scan."""
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    path, pattern, schema = RANKS, public_tokenizers.PATTERN, "doc_id long, n long"
    finish = lambda batch, ids, counts, data, sizes: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n"])
    blocks = docs.mapInArrow(bpe._texts(), bpe._ROWS).groupBy("block")
    out = blocks.applyInArrow(bpe._coded(path, pattern, 3, finish, pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])), schema).collect()
    assert {r["doc_id"]: r["n"] for r in out} == {1: len(reference.encode_ordinary("some words here")), 2: 0}


def test_bpe_frames(spark, reference):
    rows = [*plain.corpus(), (900, "long text of words " * 300_000, None, None, 0), (901, "ab" * 200_000, None, None, 0)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, "x") for r in rows], plain.SCHEMA + ", ids string")
    out = {r["doc_id"]: r for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()}
    hashed = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert hashed.keys() == out.keys() and bpe.digests(docs, RANKS, public_tokenizers.PATTERN).count() == len(rows)
    for d, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        assert out[d]["ids"] == ids and bytes(out[d]["decoded"]).decode() == (text or "")
        assert hashed[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and hashed[d]["n_tokens"] == len(ids)
        assert hashed[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def expected_pieces(rows, capacity=packing.CAPACITY):
    tokenizer = Tokenizer.from_file(WORDS)
    out = []
    for d, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), capacity):
            part = ids[p : p + capacity]
            out.append((d, p // capacity, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_packing(found, capacity=packing.CAPACITY):
    sequences = plain.grouped((r["sequence_id"], (r["offset"], r["length"])) for r in found)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    r = random.Random(8)
    texts = [plain.sentence(r, "en", n) for n in (1, 5, 900, 3000, 30_000)] + ["NFC é é", "", None, "a\xa0b 'll x's 12", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|> <| endoftext|>", "×a÷ İx ÉCOLE ßẞ ŉ"]
    rows = [*((x[0], x[1]) for x in plain.corpus()), *((100 + i, t) for i, t in enumerate(texts)), (None, "no id"), (100, "again"), (100, "again")]
    found = packing.packed(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, piece int"), WORDS).collect()
    assert sorted(((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in found), key=str) == expected_pieces(rows)
    assert check_packing(found) == -(-sum(x["length"] for x in found) // packing.CAPACITY)
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


ODD = [" ", "\n", "a", "B", "é", "É", "×", "İ", "'", "'s", "'LL", "12", "!", "...", "日本", "́", "̱", "H", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "ß", "ǅ", "ſ", "Ω", "😀"]


def test_word_tokens_match_the_library():
    r = random.Random(7)
    tokenizer, own = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(25))) for _ in range(4000)] + [None, "", "x" * 1_500_000 + " y"]
    own.table._most = 500  # so that the table is emptied between blocks
    for at in range(0, len(texts), 1000):
        ids, counts = own.encode(pa.array(texts[at : at + 1000], pa.string()))
        edge = np.concatenate(([0], np.cumsum(counts)))
        for t, a, b in zip(texts[at : at + 1000], edge[:-1], edge[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)[:200]


def test_a_plan_that_beats_best_fit():
    counts = {4: 33, 5: 33}  # best fit puts three fives together and wastes their rest; 5 + 5 + 4 + 4 fills a sequence
    best, greedy = packing.plan(counts, 18, 8), packing.Plan(18)
    for length in sorted(counts, reverse=True):
        greedy.best_fit(length, counts[length])
    assert best.sequences < greedy.sequences


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=30))
def test_plans_place_everything(counts):
    made = packing.plan(counts, 100, 4)
    placed = plain.grouped((length, (lo, hi)) for length, lo, hi, _, _ in made.rows)
    for length, count in counts.items():
        ends = sorted(placed[length])
        assert ends[0][0] == 0 and ends[-1][1] == count and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    rows = [{"sequence_id": first + k, "offset": offset, "length": length} for length, lo, hi, first, offset in made.rows for k in range(hi - lo)]
    used = check_packing(rows, 100)
    assert used == made.sequences
    plain_fit = packing.Plan(100)
    for length in sorted(counts, reverse=True):
        plain_fit.best_fit(length, counts[length])
    assert used <= plain_fit.sequences


def test_configurations_cover_demand():
    sizes, counts = [60, 45, 30], [10, 8, 12]
    found = packing.configurations(sizes, counts, 100)
    assert all(sum(s * k for s, k in zip(sizes, c, strict=True)) <= 100 for c, _ in found)
    for i, n in enumerate(counts):
        assert abs(sum(c[i] * t for c, t in found) - n) < 1e-6
