"""URL filtering by mined association rules, under explicit host and path rules, in DataFrame functions only.

Labelled pages become transactions: tokens of the URL, and an item for the label. FP-growth mines the frequent token
sets; those whose rule "tokens imply bad" has enough support, confidence and lift, chance allowed for, stay, unless a
subset of their tokens already has as much confidence. Each rule is filed under the rarest of its tokens, so that a URL meets a rule only
through that token, and is then checked for the others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import settled

#: (verdict, rule): a rule is a host, then a path beginning with "/".
EXPLICIT = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.6, 1.5
#: One-sided 99.9 % bound: a rule's confidence must exceed the share of bad pages by MIN_LIFT even at its lower bound.
Z = 3.09
BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first "://", up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules=EXPLICIT) -> Column:
    """(rule, verdict) of the longest explicit rule that fits, null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and words of path segments, parted at hyphens and the like, with digits masked;
    names of query fields."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    segments = F.filter(F.split(F.lower(F.regexp_replace(path, "[0-9]+", "0")), "[-/_.~+,;:!]"), lambda x: x != "")
    fields = F.regexp_extract_all(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("([^=&]+)"), F.lit(1))
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    every = F.concat(F.array(F.concat(F.lit("scheme:"), scheme)), named("host:", F.filter(F.split(host, "[-_.]"), lambda x: x != "")), named("path:", segments), named("field:", F.transform(fields, lambda x: F.regexp_replace(x, "[0-9]+", "0"))))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def merged_items(transactions: DataFrame) -> DataFrame:
    """transactions(id, items) with one item in place of all that occur in the very same transactions, the first of them
    in order. A URL template of many words is one item then, and not two to the power of their number of sets."""
    each = transactions.select("id", F.explode("items").alias("item"))
    where = each.groupBy("item").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("g"))
    shown = where.groupBy("n", "h", "g").agg(F.max(F.col("item") == BAD).alias("bad"), F.min(F.when(F.col("item") != BAD, F.col("item"))).alias("first"))
    named = where.join(shown, ["n", "h", "g"]).select("item", F.when(F.col("item") == BAD, F.col("item")).otherwise(F.col("first")).alias("name"))
    return each.join(named, "item").groupBy("id").agg(F.collect_set("name").alias("items"))


def mined_rules(transactions: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """(tokens, support, confidence) of the rules that imply BAD, from transactions(id, items); subsumed ones are pruned.

    A frequent token occurs in at least a share `support` of the transactions, so there are at most (tokens of the
    average transaction) / support of them, whatever the size of the input.
    """
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(merged_items(transactions))
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= lift))
    p, n = F.col("confidence"), F.round(F.col("support") * transactions.count() / F.col("confidence"))
    lower = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    found = found.where(lower >= lift * p / F.col("lift"))
    found = settled(found.select(F.sort_array("antecedent").alias("tokens"), "support", "confidence"), "rules")
    wide = found.select("tokens", "confidence", F.explode("tokens").alias("token"))
    less = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("as_good"), F.col("tokens")[0].alias("token"))
    worse = wide.join(less, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("as_good") >= F.col("confidence")))
    return found.join(worse.select("tokens").distinct(), "tokens", "left_anti")


def inverted_index(rules: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rules by their rarest token: (token, tokens, support, confidence)."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    often = transactions.select(F.explode("items").alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = each.join(often, "token").groupBy("tokens", "support", "confidence").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    return rarest.select("token", "tokens", "support", "confidence")


def judged_urls(pages: DataFrame, labels: DataFrame, explicit=EXPLICIT, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """pages(page_id, url, ...) with host, path, rule, verdict and the matched tokens and confidence of a mined rule.

    labels(doc_id, quality, toxic) label the page of that page_id: bad if of quality 0 or toxic. A null or odd url has
    an empty host and path, no rule, and is allowed. Null labels and labels of no page teach nothing; a page with
    several label rows counts once for each. Repeated rows get equal verdicts. Without labels nothing is mined, and an
    empty table gives an empty one. A url of any length is read whole. Of several rules that fit, the one of most
    confidence, then support, then the last in order of its tokens is named.
    """
    url = F.col("url").cast("string")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "matched", "confidence", "_tokens", "_found")]
    base = pages.select(*own).withColumn("host", host_of(url)).withColumn("path", path_of(url))
    base = base.withColumn("_tokens", tokens_of(url, F.col("host"), F.col("path"))).withColumn("_found", explicit_rule(F.col("host"), F.col("path"), explicit))
    bad = F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce(F.col("toxic") > 0, F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    taught = base.where("url is not null").select("page_id", "_tokens").join(known, "page_id")
    items = F.when(F.col("bad"), F.concat("_tokens", F.array(F.lit(BAD)))).otherwise(F.col("_tokens"))
    taught = settled(taught.select(F.expr("uuid()").alias("id"), items.alias("items")).where("size(items) > 0"), "transactions")
    index = inverted_index(mined_rules(taught, support, confidence, lift), taught)
    index = settled(index, "index")
    hits = base.select("url", "_tokens", F.explode("_tokens").alias("token")).join(index, "token").where(F.size(F.array_except("tokens", "_tokens")) == 0)
    hits = hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "tokens")).alias("best"))
    out = base.join(hits, "url", "left")
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*(F.col(c) for c in own), "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), F.col("best.tokens").alias("matched"), F.col("best.confidence").alias("confidence"))
