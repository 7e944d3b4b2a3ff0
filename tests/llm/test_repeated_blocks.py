from collections import Counter

from lattica.llm.jaccard import jaccard_join
from tests.llm import plain


def test_rows_of_equal_blocks_all_stay(spark):
    rows = plain.corpus()[:40]
    docs = spark.createDataFrame(rows, plain.SCHEMA).coalesce(1)
    of = lambda d: Counter(tuple(r) for r in jaccard_join(d).select("doc_id", "n_shingles", "component_id").collect())
    once, twice = of(docs), of(docs.union(docs))
    assert sum(once.values()) == 40 and sum(twice.values()) == 80
    assert twice == Counter({k: 2 * v for k, v in once.items()})
