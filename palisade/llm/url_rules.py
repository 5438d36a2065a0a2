"""URL filtering by explicit host and path rules and by mined association rules (DataFrame functions only).

An explicit rule (action, host, path) fits its host and all subdomains if the url's path starts with the rule's; of
those that fit, the longest host and path together wins. Urls that no explicit rule fits are judged by association
rules: FP-growth over the token sets of labelled urls finds combinations that imply a bad label. A combination is kept
if it has enough support and confidence, if bad labels are more frequent with it than without by SURE standard errors
at least, and if no kept part of it is as confident. At matching, an inverted index from each rule's rarest token to the
rule finds candidates among a url's tokens; the whole combination is then verified.

Tokens: `h:` and a host label, `p:` and a directory of the path, `q:` and a query key, each taken once.

Defined cases: a null url, or one without "://", has an empty host and path and no tokens, so no rule fits it and it
is allowed; an empty path has no directories; labels that repeat count once by their worst label, null labels not at
all; without labels nothing is mined. Repeated rows get equal verdicts. Other columns pass through; the struct's name can
be chosen and replaces a column of that name.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialise

#: Rules given for `pages`: action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Mining: support is the larger of a count and a share of the bad urls. SURE allows for the number of combinations tried.
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE, SURE = 20, 0.001, 0.6, 4.0


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules=tuple(RULES)) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null. Where two are equally long, the earlier one wins."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    out = F.lit(None)
    for (action, h, p), fit in reversed([*zip(ranked, fits, strict=True)]):
        out = F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a url; none for a null or one without a host."""
    tag = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = [tag("h:", F.split(host(url), "\\.")), tag("p:", F.slice(F.split(path(url), "/"), 1, F.greatest(F.size(F.split(path(url), "/")) - 1, F.lit(0)))), tag("q:", keys)]
    return F.array_distinct(F.coalesce(F.concat(*parts), F.array().cast("array<string>")))


def mine(urls: DataFrame, labels: DataFrame, url: str = "url", key: str = "page_id", label_key: str = "doc_id", bad: str = "quality = 0 OR toxic = 1", min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, sure: float = SURE) -> DataFrame:
    """Rules (rule_id, items, anchor, support, confidence) from labelled urls; anchor is the rarest item."""
    marks = labels.filter(f"({bad}) IS NOT NULL").groupBy(F.col(label_key).alias("_k")).agg(F.max(F.expr(bad)).alias("_bad"))
    seen = urls.select(F.col(key).alias("_k"), tokens(F.col(url)).alias("_items")).join(marks, "_k").filter(F.size("_items") > 0)
    seen = materialise(seen.select(F.monotonically_increasing_id().alias("_id"), "_bad", "_items"), "labelled-urls")
    each = seen.select("_id", "_bad", F.explode("_items").alias("item"))
    n_bad, n_all = seen.agg(F.count(F.when(F.col("_bad"), 1)), F.count("*")).first()
    least = max(min_count, int(min_support * n_bad))
    spark = urls.sparkSession
    none = spark.createDataFrame([], "rule_id long, items array<string>, anchor string, support long, confidence double")
    if n_bad < least:
        return none
    common = each.groupBy("item").agg(F.count(F.when(F.col("_bad"), 1)).alias("n"), F.count("*").alias("all")).filter(F.col("n") >= least)
    common = materialise(common, "url-items")
    # a row per labelled url and item it shares with a bad one; the arrays are bounded by the tokens of a url
    sets = each.join(common.select("item", "n"), "item").groupBy("_id", "_bad").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "item"))).alias("s"))
    sets = materialise(sets.select("_id", "_bad", F.transform("s", lambda x: x["item"]).alias("items")), "url-sets")
    baskets = sets.filter("_bad").select("items")
    model = FPGrowth(itemsCol="items", minSupport=least / n_bad, minConfidence=1.0).setPredictionCol("_p").fit(baskets)
    found = materialise(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq")), "url-itemsets")
    rare = found.select("items", F.explode("items").alias("item")).join(common, "item")
    found = found.join(rare.groupBy("items").agg(F.min_by("item", F.struct("all", "item")).alias("anchor")), "items")
    # dealt anew, so that their true size is known: written sets are far smaller than exploded ones, and none is broadcast unseen
    hits = _candidates(sets.repartition("_id"), found.select(F.col("items").alias("_rule"), "anchor"), "items")
    kept = hits.groupBy(F.col("_rule").alias("items"), "anchor").agg(F.count(F.when(F.col("_bad"), 1)).alias("support"), F.count("*").alias("n"))
    kept = kept.withColumn("confidence", F.col("support") / F.col("n")).filter((F.col("support") >= least) & (F.col("confidence") >= min_confidence))
    kept = materialise(kept.filter(_sure("support", "n", n_bad, n_all, sure)).drop("n"), "url-rules")
    # pruned: rules of which a smaller kept rule is a part and as confident (found through the same index)
    inner = kept.select(F.col("items").alias("_rule"), "anchor", F.col("confidence").alias("_c"))
    worse = _candidates(kept.select("items", "confidence"), inner, "items").filter((F.size("_rule") < F.size("items")) & (F.col("_c") >= F.col("confidence")))
    kept = kept.join(worse.select("items").distinct(), "items", "left_anti")
    return kept.select(F.xxhash64("items").alias("rule_id"), "items", "anchor", "support", "confidence")


def _candidates(sets: DataFrame, rules: DataFrame, items: str) -> DataFrame:
    """Rows of sets with each rule (columns _rule, anchor) that they hold, through the index from anchors to rules."""
    posted = sets.withColumn("_item", F.explode(items)).join(rules, F.col("_item") == F.col("anchor"))
    return posted.filter(F.size(F.array_except("_rule", items)) == 0).drop("_item")


def _sure(support: str, n: str, n_bad: int, n_all: int, sure: float) -> Column:
    """Whether so many bad urls of n are more than the share of bad ones lets expect, by that many standard errors."""
    share = n_bad / n_all
    return F.col(support) - F.col(n) * share >= sure * F.sqrt(F.col(n) * share * (1 - share))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", given=tuple(RULES), name: str = "_u") -> DataFrame:
    """urls with a struct (host, path, rule, verdict) in the column `name`."""
    columns = [c for c in urls.columns if c != name]
    found = urls.select(F.struct(*(urls[f"`{c}`"] for c in columns)).alias("row"), F.col(key).alias("key"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    found = found.withColumn("given", explicit(F.col("host"), F.col("path"), given))
    open_ = found.filter("given IS NULL").select("key", "url", tokens(F.col("url")).alias("items"))
    hits = _candidates(open_, rules.select(F.col("items").alias("_rule"), "anchor"), "items").select(F.col("key").alias("k"), F.col("url").alias("l")).distinct()
    same = found["key"].eqNullSafe(hits["k"]) & found["url"].eqNullSafe(hits["l"])
    verdict = F.coalesce(F.col("given.action"), F.when(F.col("hit"), "block").otherwise("allow"))
    out = found.join(hits.withColumn("hit", F.lit(True)), same, "left")
    return out.select("row.*", F.struct("host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict")).alias(name))
