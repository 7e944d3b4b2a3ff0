import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, quality, urlrules, weaklabel
from tests.llm import plain

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def by_sql(rows):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"text": "object", "lang": "object", "source": "object"})
    con.register("frame", frame)
    con.execute("create view documents as select doc_id, text::varchar as text, lang::varchar as lang, source::varchar as source from frame")
    return sorted(map(str, con.sql(f"select {', '.join(COLUMNS)} from ({quality.SQL})").fetchall()))


@pytest.mark.parametrize("keep", [True, False])
def test_quality_matches_sql(spark, keep):
    r = random.Random(6)
    rows = plain.corpus()
    more = [(1000 + i, plain.sentence(r, "en", 80) + ("#" * (i if i > 60 else 0)), "en", "big", 0) for i in range(70)]
    more += [(2000, "a a a b " * 20, "en", "big", 0), (2001, "same line here\n" * 30, "en", "big", 0), (2001, "same line here\n" * 30, "en", "big", 0), (2002, "x\n\nx\n y\n", None, None, 0), (2003, "é日本 " * 60, "en", None, 0)]
    rows = rows + more
    docs = spark.createDataFrame([(*x, "clash") for x in rows], plain.SCHEMA + ", n_lines string")
    out = quality.judged(docs, keep_text=keep)
    assert sorted(str(tuple(x[c] for c in COLUMNS)) for x in out.collect()) == by_sql(rows)
    kept = {x["doc_id"]: x["kept"] for x in out.collect()}
    assert kept[1000] and not kept[1069] and not kept[2001]


def test_quality_of_nothing(spark):
    assert quality.judged(spark.createDataFrame([], plain.SCHEMA)).count() == 0


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame(plain.corpus(), plain.SCHEMA)
    plan = quality.judged(docs)._jdf.queryExecution().toString()
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan += urlrules.judged_urls(pages, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_url_contract(spark):
    urls = [
        ("https://WWW.Example.NET/en/x?y", "www.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://a.net/", "a.net", "/", "net/", "block"),
        ("https://a.net", "a.net", "", None, "allow"),
        ("http://example.com/de/1#t", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("x://y.org/fr/?q", "y.org", "/fr/", "org/fr/", "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://ÄB.net/x\ny", "Äb.net", "/x\ny", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "clash", "h") for i, u in enumerate(urls)] + [(0, urls[0][0], "clash", "h")], "page_id long, url string, verdict string, html string")
    out = urlrules.judged_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(urls) + 1
    for x in out:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == urls[x["page_id"]][1:], x["url"]


def test_mined_url_rules_match_brute_force(spark):
    from itertools import combinations

    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        host, path = r.choice(["spam", "ok", "fine"]), r.choice(["buy", "read", "see"])
        rows.append((i, f"http://{host}.example.com/{path}/{i}?utm=1"))
        bad = host == "spam" or (host == "ok" and path == "buy")
        labels.append((i, 0 if bad and r.random() < 0.97 else 1, None))
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = urlrules.judged_urls(pages, known).collect()
    url, host, path = F.col("url"), urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))
    tokens = {x["page_id"]: frozenset(x["t"]) for x in pages.select("page_id", urlrules.tokens_of(url, host, path).alias("t")).collect()}
    bad = {i for i, q, _ in labels if q == 0}
    count, hits = {}, {}
    for i, t in tokens.items():
        for k in range(1, len(t) + 1):
            for s in combinations(sorted(t), k):
                count[s] = count.get(s, 0) + 1
                hits[s] = hits.get(s, 0) + (i in bad)
    share = len(bad) / len(tokens)

    def strong(s):
        n, p = count[s], hits[s] / count[s]
        z = urlrules.Z
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        return hits[s] / len(tokens) >= urlrules.MIN_SUPPORT and p >= urlrules.MIN_CONFIDENCE and p >= urlrules.MIN_LIFT * share and low >= urlrules.MIN_LIFT * share

    rules = [set(s) for s in count if strong(s)]
    expected = {i: "block" if any(s <= t for s in rules) else "allow" for i, t in tokens.items()}
    assert {x["page_id"]: x["verdict"] for x in out} == expected and set(expected.values()) == {"block", "allow"}


def test_language_held_out_accuracy(spark):
    r = random.Random(3)
    rows = [(i, plain.sentence(r, lang, r.randrange(5, 60)), lang, "clash") for i in range(400) for lang in [r.choice(list(plain.SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identified(docs).where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in out) >= 0.97 * len(out) > 50
    assert all(0 <= x["score"] <= 1 for x in out)
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    same = {x["doc_id"]: x["lang_pred"] for x in langid.identified(changed).where("held_out").collect()}
    assert same == {x["doc_id"]: x["lang_pred"] for x in out}


def test_language_odd_rows(spark):
    rows = [(1, "the ing and her for", "en"), (2, None, "en"), (3, "12 ### \n", "en"), (4, "", None), (None, "the ing", "en"), (6, "ung keit schung", "de"), (6, "ung keit schung", "de"), (7, "the " * 300_000, None)]
    out = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in out}
    assert len(out) == len(rows) and got[2] == got[3] == got[4] == ("und", 0.0) and got[7][0] == "en"
    assert langid.identified(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_expectation_maximisation_finds_the_classes():
    import numpy as np

    r = np.random.default_rng(1)
    good = r.random(4000) < 0.8
    m = len(weaklabel.LABELLERS)
    vote = np.where(good[:, None], 2, np.where(r.random((4000, m)) < 0.6, 1, 2))
    vote[r.random((4000, m)) < 0.2] = 0
    number = (vote * 3 ** np.arange(m - 1, -1, -1)).sum(1)
    assert (weaklabel.votes(number) == vote).all()
    pattern, inverse, count = np.unique(number, return_inverse=True, return_counts=True)
    p, shares, prior = weaklabel.expectation_maximisation(pattern, count)
    assert ((p[inverse] >= 0.5) == good).mean() > 0.95 and abs(prior - 0.8) < 0.05 and shares.shape == (m, 2, 3)


def test_classifier(spark):
    r = random.Random(5)
    junk = [lambda: "### $$$ %%% &&& " * 30, lambda: plain.sentence(r, "en", 60).upper().replace(" ", "!! "), lambda: "spam " * 80]
    rows = [(i, plain.sentence(r, r.choice(list(plain.SYLLABLES)), r.randrange(40, 200)) if i % 5 else junk[i // 5 % 3](), "clash") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "short text", "x"), (1002, "short text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = weaklabel.classified(docs).collect()
    kept = {x["doc_id"]: x["kept"] for x in out}
    assert len(out) == len(rows) and all(kept[i] for i in range(300) if i % 5)
    assert sum(not kept[i] for i in range(0, 300, 5)) >= 54
    assert kept[1002] and all(0 <= x["score"] <= 1 for x in out)
    assert weaklabel.classified(docs.limit(0)).count() == 0
