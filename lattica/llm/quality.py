"""Quality rules with thresholds that adapt to each language and source, in DataFrame functions only.

Each text is measured in whole numbers. For every language, source and measure a mergeable quantile sketch, a histogram
of per-mille bins, is counted in one pre-aggregated exchange; merging two sketches adds their counts. A threshold is the
median plus SPREAD times the distance from the 10th percentile to the median, that distance being at least the
measure's slack. Groups with fewer than LEAST documents take the sketch of the whole corpus. Texts are then joined with
their group's thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.tables import settled

#: Java and RE2 classes of the white space that separates words.
GAP = r"[\x09-\x0D ]"
SYMBOLS = r"[#*$%&|<>]"
#: Measure to slack, in thousandths. SPREAD times that of repeats is under the base rule's 500, which all rows here pass.
MEASURES = {"symbols": 10, "upper": 50, "dup_lines": 100, "repeats": 75}
SPREAD, LEAST = 4, 30
_POSITION = 26
_LOW = (1 << _POSITION) - 1


def _repeat_words() -> Column:
    """Words in three-word windows found twice or more: windows are sorted by hash, neighbours compared word by word."""
    gram = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    packed = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: gram(i).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))
    return F.when(F.size("w") >= 3, F.sort_array(packed))


def _covered() -> Column:
    spot = lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")

    def same(x: Column, y: Column) -> Column:
        words = [F.get("w", spot(x) + k) == F.get("w", spot(y) + k) for k in range(3)]
        return (F.shiftright(x, _POSITION) == F.shiftright(y, _POSITION)) & words[0] & words[1] & words[2]

    twice = F.filter("sorted", lambda x, k: F.coalesce(same(x, F.get("sorted", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("sorted", k + 1)), F.lit(False)))
    return F.sort_array(F.transform(twice, spot))


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("w", F.array_remove(F.split(text, f"{GAP}+"), ""))
    out = out.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x09-\x0D ]"))))
    out = out.withColumn("sorted", _repeat_words())
    out = out.withColumn("spots", _covered())
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.regexp_replace(text, f"{GAP}+", "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(F.aggregate("spots", start, step, lambda a: a["sum"]), F.lit(0)),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_lines": F.size("lines"),
    }
    out = out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("w", "lines", "sorted", "spots")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bins() -> dict[str, Column]:
    part = lambda n, of: F.least(F.lit(1000).cast("long"), F.expr(f"{1000} * {n} div greatest({of}, 1)"))
    return {"symbols": part("n_symbols", "word_chars"), "upper": part("n_upper", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Median and 10th percentile of each group's bins, by rank: the least bin with at least that share at or below."""
    every, running = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    ranked = sketch.select(*by, "bin", F.sum("count").over(running).alias("upto"), F.sum("count").over(every).alias("total"))
    least = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), least(50).alias("mid"), least(10).alias("low"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, symbols, upper, dup_lines, repeats): a row for each language and source of rows that passed the base rules."""
    bins = _bins()
    long = rows.where("not base_failed").select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), b.alias("bin")) for m, b in bins.items()))).alias("x"))
    sketch = long.groupBy("lang", "source", "x.measure", "x.bin").count()
    sketch = settled(sketch, "sketch")
    own = _quantiles(sketch, ["lang", "source", "measure"])
    whole = _quantiles(sketch.groupBy("measure", "bin").agg(F.sum("count").alias("count")), ["measure"])
    both = own.join(whole.select("measure", F.col("mid").alias("all_mid"), F.col("low").alias("all_low")), "measure")
    few = F.col("total") < LEAST
    mid, low = F.when(few, F.col("all_mid")).otherwise(F.col("mid")), F.when(few, F.col("all_low")).otherwise(F.col("low"))
    slack = F.create_map(*(F.lit(x) for kv in MEASURES.items() for x in kv))[F.col("measure")]
    limit = mid + SPREAD * F.greatest(mid - low, slack)
    return both.select("lang", "source", "measure", limit.alias("limit")).groupBy("lang", "source").pivot("measure", list(MEASURES)).agg(F.max("limit"))


def judged(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs(text, lang, source, ...) with the measures, base_failed, and kept: false for what fails a base or an adaptive rule.

    A null text has no words and fails. Null languages and null sources are groups of their own. Repeated rows each
    count and get equal verdicts. A text at a threshold is kept. Columns named like the measures are replaced. An
    empty table gives an empty one.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "base_failed", "kept", "w", "lines", "sorted", "spots"]
    rows = measured(docs.drop(*own))
    rows = settled(rows if keep_text else rows.drop("text"), "measured")  # so that texts are measured once
    limits = thresholds(rows)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(m).alias(f"_{m}") for m in MEASURES))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for m, b in _bins().items():
        fine = fine & (b <= F.col(f"_{m}"))
    return joined.withColumn("kept", F.coalesce(~F.col("base_failed") & fine, F.lit(False))).drop("_lang", "_source", *(f"_{m}" for m in MEASURES))


#: The same rows as SQL over documents.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT rid, i, word || chr(1) || lead(word) OVER o || chr(1) || lead(word, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL) WHERE c >= 2),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, coalesce(n.n_lines, 0)::BIGINT AS n_lines
  FROM d JOIN w USING (rid) LEFT JOIN n USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  least(1000, 1000 * n_symbols // greatest(word_chars, 1)) AS symbols, least(1000, 1000 * n_upper // greatest(word_chars, 1)) AS upper_,
  least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)) AS dup_lines, least(1000, 1000 * n_repeat_words // greatest(n_words, 1)) AS repeats FROM m),
s AS (SELECT lang, source, 'symbols' AS measure, 10 AS slack, symbols AS bin FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'upper', 50, upper_ FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', 100, dup_lines FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', 75, repeats FROM b WHERE NOT base_failed),
own AS (SELECT lang, source, measure, slack, count(*) AS total, quantile_disc(bin, 0.5) AS mid, quantile_disc(bin, 0.1) AS low FROM s GROUP BY ALL),
whole AS (SELECT measure, quantile_disc(bin, 0.5) AS mid, quantile_disc(bin, 0.1) AS low FROM s GROUP BY ALL),
t AS (SELECT lang, source, measure, CASE WHEN total < 30 THEN whole.mid + 4 * greatest(whole.mid - whole.low, slack) ELSE own.mid + 4 * greatest(own.mid - own.low, slack) END AS lim
  FROM own JOIN whole USING (measure)),
p AS (SELECT lang, source, max(lim) FILTER (measure = 'symbols') AS a, max(lim) FILTER (measure = 'upper') AS b, max(lim) FILTER (measure = 'dup_lines') AS c,
  max(lim) FILTER (measure = 'repeats') AS d FROM t GROUP BY ALL)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  coalesce(NOT b.base_failed AND symbols <= p.a AND upper_ <= p.b AND dup_lines <= p.c AND repeats <= p.d, false) AS kept
FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source
"""
