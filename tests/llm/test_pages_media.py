import hashlib
import random
import tarfile
import time
import zlib

import pytest

from lattica.llm import extract, media
from tests.llm import plain

PAGE = """<html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href=x>Home</a> My site</header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies. Please accept them all.</p></div>
<article><h1>A &amp; B</h1><p>First   paragraph&nbsp;of <b>the</b> text,<br>on two lines.<p>Second paragraph, never closed.
<div class="ad banner"><p>Buy this now. It is very cheap indeed.</p></div><ul><li>A listed point of the text.</li></ul></article>
<section class="comments"><p>Great post. I liked it a lot, thank you.</p></section>
<aside><p>Related: other stories. Read them too, please.</p></aside><form><label>Mail</label><input></form>
<footer>&copy; 2020 Someone</footer></body></html>"""


def test_page():
    assert extract.main_text(PAGE) == "A & B\nFirst paragraph of the text, on two lines.\nSecond paragraph, never closed.\nA listed point of the text."


def test_minimum_cut_is_minimal():
    r = random.Random(3)
    for _ in range(400):
        n = r.randrange(1, 9)
        good, bad = ([r.randrange(9) for _ in range(n)] for _ in range(2))
        edges = [(r.randrange(n), r.randrange(n), r.randrange(6)) for _ in range(r.randrange(14))]
        cost = lambda side: sum(b if s else g for g, b, s in zip(good, bad, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, E731
        assert cost(extract.minimum_cut(good, bad, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


@pytest.mark.parametrize("page", ["<div>a " * 20_000, '<a "' * 50_000, "<p>word " * 20_000, "<li>x y" * 20_000, "<", "<!--", "<script>", "</p>" * 1000, "&amp" * 10_000])
def test_hostile_pages_end(page):
    began = time.time()
    extract.main_text(page)
    assert time.time() - began < 20


def test_extracted_frames(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "plain words only, a sentence of them.", "t")]
    out = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["page_id"]: r["text"] for r in out}[2] == "" and out[0]["text"] == out[1]["text"] != ""
    assert extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_images_round_trip():
    r = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000):
        raw = r.randbytes(n)
        payload = media.padded(raw)
        image = media.to_image(payload)
        assert len(payload) % 576 == 0 and payload[: len(raw)] == raw and set(payload[len(raw) :]) <= {255}
        assert media.from_image(image) == payload and media.read_header(image[: media.HEADER])[:2] == (576, len(payload) // 576)
    with pytest.raises(ValueError, match="damaged"):
        media.from_image(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_media(spark, tmp_path):
    rows = [(r[0], r[1], "clash") for r in plain.corpus()] + [(0, "again", "x"), (None, "again", "x"), (5000, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").coalesce(2)
    index = media.stored(docs, f"file://{tmp_path}/shards")
    out = media.with_features(media.with_metadata(index)).collect()
    expected = sorted((str(d), len(raw := (t or "").encode()), hashlib.sha256(p := media.padded(raw)).hexdigest(), zlib.crc32(p[-32:]), len(p), media.feature(p)) for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"], r["feature"]) for r in out) == expected
    assert all(r["width"] * r["height"] == r["payload_bytes"] and r["depth"] == 8 for r in out)
    names = [m.name for p in (tmp_path / "shards").glob("*.tar") for m in tarfile.open(p)]
    assert len(names) < len(rows) and set(names) == {r["media_sha256"] for r in out}
    assert media.with_features(media.stored(docs.limit(0))).count() == 0
