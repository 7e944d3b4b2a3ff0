"""Mined URL rules that fire through the registered query, and templates of many words."""

import random

from pyspark.sql import functions as F

from lattica.llm import urlrules
from lattica.llm.queries import QUERIES


def test_words_of_hyphenated_paths_make_rules(spark, tmp_path):
    r = random.Random(3)
    calm = ["garden", "river", "bread", "music", "stone"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [r.choice(["casino", "bonus"]) if bad else r.choice(calm), r.choice(calm), r.choice(calm)]
        r.shuffle(words)
        rows.append((i, f"https://site{i % 7}.example.org/en/{'-'.join(words)}_{i}.html", "<p>x"))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()
    assert all((x["verdict"] == "block") == (x["page_id"] % 3 == 0) for x in out)
    assert {tuple(x["matched"]) for x in out if x["matched"]} == {("path:casino",), ("path:bonus",)}


def test_templates_of_many_words_end(spark):
    template = "/".join(f"word{i}x" for i in range(40))
    rows = [(i, f"http://{'spam' if i % 2 else 'fine'}.example.com/{template}/{i}") for i in range(200)] + [(999, "http://a.b/" + "x-" * 100_000)]
    known = [(i, 1 - i % 2, None) for i in range(200)]
    out = urlrules.judged_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    assert {x["page_id"]: x["verdict"] for x in out.collect()} == {i: "block" if i % 2 and i < 999 else "allow" for i, _ in rows}


def test_items_of_equal_transactions_are_one(spark):
    rows = [("1", ["a", "b", "c", "=bad"]), ("2", ["a", "b", "d"]), ("3", ["b", "a", "e", "=bad"])]
    out = urlrules.merged_items(spark.createDataFrame(rows, "id string, items array<string>")).select("id", F.sort_array("items").alias("items")).collect()
    assert {x["id"]: x["items"] for x in out} == {"1": ["=bad", "a", "c"], "2": ["a", "d"], "3": ["=bad", "a", "e"]}
