import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lattica.llm import langid  # noqa: E402
from tests.llm import plain  # noqa: E402
from tests.llm.test_filters import by_sql  # noqa: E402
from tests.llm.test_tokens import check_packing  # noqa: E402


def test_run_matches_plain(spark, tmp_path):
    rows = plain.corpus(11)
    spark.createDataFrame(rows, plain.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    sure = {r["doc_id"]: r["lang_pred"] for r in langid.identified(spark.createDataFrame(rows, plain.SCHEMA)).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    left = [(d, t, lang or sure[d], s, n) for d, t, lang, s, n in rows if d in sure]
    good = {eval(x)[0] for x in by_sql(left) if eval(x)[-1]}
    left = [r for r in left if r[0] in good]
    first = plain.jaccard_components([(r[0], r[1]) for r in left])
    left = [r for r in left if first[r[0]][1] == r[0]]
    texts = {r[0]: plain.cut(r[1], stay) for r, (_, stay) in zip(left, plain.without_repeats([r[1] for r in left]), strict=True)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        expected += [(d, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    assert check_packing(found) == -(-sum(r["length"] for r in found) // 2048)
    assert 0 < len(texts) < len(good) < len(sure)


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(plain.corpus(12), plain.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), "").count() == 0


def test_rows_of_one_id_leave_one(spark):
    text = plain.corpus(13)[0][1]
    rows = [(1, text, "en", "s", 1), (1, "another text of its own", "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, "en", "s", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, plain.SCHEMA), "").collect()
    assert sorted(str(r["doc_id"]) for r in out).count("1") == 1 and {r["doc_id"] for r in out} == {1, None}
