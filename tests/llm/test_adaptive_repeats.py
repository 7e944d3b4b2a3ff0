from lattica.llm import quality


def text(row, repeated):
    """100 words, of which twice `repeated` are in a passage that stands there twice."""
    words = [f"w{row}x{i}" for i in range(100 - repeated)]
    return " ".join(words + words[:repeated])


def test_adaptive_repeats_rule_rejects_what_passes_the_base_rule(spark):
    rows = [(i, text(i, 0), "en", "plain") for i in range(40)] + [(100, text(100, 10), "en", "plain"), (101, text(101, 20), "en", "plain"), (102, text(102, 30), "en", "plain")]
    rows += [(200, text(200, 20), "fr", "few"), (201, text(201, 10), "fr", "few")]  # few documents: the whole corpus's sketch
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [out[i]["n_repeat_words"] for i in (0, 100, 101, 102)] == [0, 20, 40, 60]
    assert not out[101]["base_failed"] and not out[101]["kept"]
    assert not out[200]["base_failed"] and not out[200]["kept"]
    assert out[0]["kept"] and out[100]["kept"] and out[201]["kept"] and out[102]["base_failed"]
