"""Classifier, language ID and media held against plain versions that share no code with them."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from lattica.llm import langid, media, weaklabel
from tests.llm import plain

SYMBOLS = set(b"#*$%&|<>{}[]\\^~=_@")


def plain_votes(text):
    w = plain.words(text)
    raw = " ".join(w).replace(" ", "").encode()
    every = (text or "").encode()
    if len(w) < 20:
        return (0,) * 5
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in every)
    shares = {
        "symbols": sum(b in SYMBOLS for b in raw) / max(1, len(raw)),
        "upper": sum(65 <= b <= 90 for b in every) / max(1, letters),
        "top_word": max(Counter(w).values()) / len(w),
        "digits": sum(48 <= b <= 57 for b in raw) / max(1, len(raw)),
        "adjacent": sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w),
    }
    return tuple(2 if shares[k] <= good else 1 if shares[k] >= bad else 0 for k, (good, bad) in weaklabel.LABELLERS.items())


def plain_posteriors(votes, rounds=100):
    """Expectation-maximisation over documents one by one."""
    p = [0.1 if 1 in v else 0.9 for v in votes]
    for _ in range(rounds):
        prior = (sum(p) + 1) / (len(p) + 2)
        hit = []
        for k in range(len(votes[0])):
            each = []
            for weight in ([1 - x for x in p], p):
                bad = sum(x for x, v in zip(weight, votes, strict=True) if v[k] == 1) + 1
                good = sum(x for x, v in zip(weight, votes, strict=True) if v[k] == 2) + 1
                each.append(bad / (bad + good))
            hit.append((max(each[0], weaklabel.LEAST_HIT), min(each[1], weaklabel.FALSE_ALARM)))
        new = []
        for v in votes:
            low, high = math.log(1 - prior), math.log(prior)
            for k, x in enumerate(v):
                if x:
                    low += math.log(hit[k][0] if x == 1 else 1 - hit[k][0])
                    high += math.log(hit[k][1] if x == 1 else 1 - hit[k][1])
            new.append(1 / (1 + math.exp(min(500, max(-500, low - high)))))
        if max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-9:
            return new
        p = new
    return p


def test_posteriors_match_plain(spark):
    r = random.Random(5)
    junk = [lambda: "### $$$ %%% word " * 30, lambda: plain.sentence(r, "en", 60).upper(), lambda: "spam " * 80, lambda: "12 345 words 6 " * 20]
    rows = [(i, plain.sentence(r, "de", r.randrange(25, 90)) if i % 4 else junk[i // 4 % 4]()) for i in range(120)] + [(500, None), (501, ""), (502, "few words"), (503, "long text of many words " * 40_000)]
    found = {x["doc_id"]: (x["posterior"], x["kept"]) for x in weaklabel.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = dict(zip([d for d, _ in rows], plain_posteriors([plain_votes(t) for _, t in rows]), strict=True))
    assert all(abs(found[d][0] - p) < 1e-6 for d, p in expected.items())
    sure = [d for d, p in expected.items() if p < 0.1 or p > 0.9]
    assert sum(found[d][1] == (expected[d] > 0.5) for d in sure) >= 0.95 * len(sure) > 25


def plain_grams(text):
    letters = [0]
    for c in text or "":
        low = c.lower()
        letters.append((ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0)
    letters.append(0)
    out = []
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b:
            pair = b * 0x9E3779B97F4A7C15 + c * 0xC2B2AE3D27D4EB4F
            for x in (pair, pair + a * 0x165667B19E3779F9 + 0x27D4EB2F165667C5):
                x %= 1 << 64
                out.append((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 49)
    return out


def test_languages_match_plain_bayes(spark):
    r = random.Random(4)
    rows = [(i, plain.sentence(r, lang, r.randrange(1, 30)) + r.choice(["", " É!", "\n12"]), lang if i % 9 else None) for i in range(150) for lang in [r.choice(list(plain.SYLLABLES))]] + [(900, None, "en"), (901, " 1 ", "en")]
    counts = defaultdict(Counter)
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 5 and lang and text is not None:
            counts[lang].update(plain_grams(text))
    total = {k: sum(c.values()) for k, c in counts.items()}
    for x in langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        grams = plain_grams(x["text"])
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        if not grams:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        logs = {k: sum(math.log((counts[k][g] + langid.SMOOTHING) / (total[k] + langid.SMOOTHING * langid.BUCKETS)) for g in grams) for k in counts}
        best = max(logs.values())
        assert logs[x["lang_pred"]] >= best - 1e-3
        share = 1 / sum(math.exp(v - logs[x["lang_pred"]]) for v in logs.values())
        assert abs(x["score"] - share * sum(g in counts[x["lang_pred"]] for g in grams) / len(grams)) < 1e-4


def test_media_match_plain(spark, tmp_path):
    r = random.Random(2)
    texts = ["", None, "a" * 575, "a" * 576, "é" * 288 + "x", plain.sentence(r, "fr", 3000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    for x in media.with_features(media.with_metadata(media.stored(docs.drop("feature"), f"file://{tmp_path}/m"))).collect():
        raw = (texts[x["doc_id"]] or "").encode()
        rows = max(1, -(-len(raw) // 576))
        payload = raw + b"\xff" * (rows * 576 - len(raw))
        values = np.array(list(payload), float)
        bands = [sum(16 * k <= b < 16 * k + 16 for b in payload) * 1000 // len(payload) for k in range(16)]
        assert (x["n_bytes"], x["payload_bytes"], x["width"], x["height"], x["tail_crc32"]) == (len(raw), rows * 576, 576, rows, zlib.crc32(payload[-32:]))
        assert x["feature"] == ",".join(map(str, bands)) + f";{values.mean():.3f};{values.std():.3f}"
