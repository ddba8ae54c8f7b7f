"""URL filtering with mined association rules.

A URL is a set of tokens: scheme, labels of the host, its registered ending,
path segments (digits folded), file ending and query keys. Spark's FP-growth
mines token combinations among labelled URLs, each transaction with its label;
a combination is a rule if enough of the bad URLs have it (support, a share of
the bad ones, so good URLs do not dilute it), if most URLs that have it are bad
(confidence), if that is not chance (standard errors above the share of bad
URLs), and if no smaller rule inside it is as sure. Tokens that always come
together count as one while mining, so a fixed set of many tokens does not make
all its subsets. An inverted index, from the token of a rule that fewest URLs
have to the rule, finds the rules that a URL can match; a match needs all of a
rule's tokens.

Fixed rules for hosts and paths come first; the longest that fits decides.

Defined results: a null url, or one without "://", has an empty host and path,
no fixed rule and no tokens, and is allowed; pages of equal url share a
verdict; repeated rows each get a row; an empty table, or one without labels,
gives no mined rules; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

#: (host, path, verdict); fits the host and its subdomains, and paths that start with path.
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BAD = "label=bad"
SCHEMA = "rule_id long, tokens array<string>, confidence double, support double, lift double"


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.005  # of the bad URLs
    min_bad: int = 5
    min_confidence: float = 0.8
    min_errors: float = 3.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host and path together; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # later ones are longer and go first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    fold = lambda x: F.regexp_replace(F.lower(x), r"\d+", "0")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    every = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)))),
        F.transform(labels, lambda x, i: F.concat(F.when(i == F.size(labels) - 1, "end=").otherwise("host="), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path="), fold(x))),
        F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.lower(x))),
    )
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """labelled(url, bad) -> rules (SCHEMA)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    scratch = Scratch(spark)
    rows = scratch.written(labelled.select(tokens(F.col("url")).alias("items"), "bad").filter(F.size("items") > 0).withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")).first()
    if not total["bad"]:
        return spark.createDataFrame([], SCHEMA)
    # Tokens of the same rows, by count and two sums of hashes: the first stands for all of them.
    spread = rows.select("row", "bad", F.explode("items").alias("t"))
    mark = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    kinds = spread.groupBy("t").agg(F.count(F.lit(1)).alias("c"), mark(1).alias("m1"), mark(2).alias("m2"))
    classes = scratch.written(kinds.groupBy("c", "m1", "m2").agg(F.array_sort(F.collect_list("t")).alias("same")).select(F.col("same")[0].alias("t"), "same"), "token-classes")
    baskets = spread.join(classes, "t").groupBy("row").agg(F.collect_list("t").alias("items"), F.first("bad").alias("bad"))
    baskets = scratch.written(baskets.select(F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items")), "baskets")
    support = max(how.min_bad, how.min_support * total["bad"]) / total["n"]
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=how.min_confidence).fit(baskets)
    share, n = total["bad"] / total["n"], F.col("support") / F.col("confidence") * total["n"]
    errors = (F.col("confidence") - share) * F.sqrt(n) / max(1e-9, (share * (1 - share)) ** 0.5)
    sure = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).filter(errors >= how.min_errors if share < 1 else F.lit(True))
    rules = scratch.written(sure.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"), "mined")
    # Pruning: a rule goes if a rule on a part of its tokens is as sure.
    parts = rules.select("tokens", "confidence", F.explode("tokens").alias("t"))
    inside = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("c"), F.col("tokens")[0].alias("t"))
    covered = parts.join(inside, "t").filter((F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    rules = rules.join(covered.select("tokens").distinct(), "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens"))
    whole = rules.select("rule_id", F.explode("tokens").alias("t")).join(classes, "t").groupBy("rule_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("same")))).alias("tokens"))
    out = scratch.written(rules.drop("tokens").join(whole, "rule_id").select("rule_id", "tokens", "confidence", "support", "lift"), "rules")
    scratch.keep(out)
    return out


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url), distinct -> url, rule_id of the surest rule that it matches."""
    one = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("t"))
    posted = urls.select("url", tokens(F.col("url")).alias("have")).select("url", "have", F.explode("have").alias("t"))
    posted = posted.join(one.select("t").distinct(), "t", "left_semi")
    # The index has each rule under the token that fewest URLs have.
    often = posted.groupBy("t").agg(F.count(F.lit(1)).alias("often"))
    keyed = one.join(often, "t", "left").groupBy("rule_id").agg(F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"), F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "t")).alias("k"))
    index = keyed.select("rule_id", F.col("tokens").alias("need"), "confidence", F.col("k.t").alias("t"))
    hits = posted.join(index, "t").filter(F.size(F.array_except("need", "have")) == 0)
    return hits.groupBy("url").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("rule_id"))


def judge(pages: DataFrame, labelled: DataFrame, rules=FIXED_RULES, how: Mining = Mining()) -> DataFrame:
    """pages(page_id, url), labelled(url, bad) -> page_id, host, path, rule, verdict, mined_rule."""
    mined = mine(labelled, how)
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("fixed", verdict)
    hits = matched(base.select("url").filter("url IS NOT NULL").distinct(), mined)
    return base.join(hits, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("fixed", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("rule_id").alias("mined_rule"),
    )


def labelled_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page is labelled by the row of labels with its number: bad if toxic or of no quality."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    one = labels.groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    urls = pages.select("page_id", "url")  # other columns may have any name
    return urls.join(one, urls["page_id"] == one["doc_id"]).select("url", (F.col("bad") == 1).alias("bad"))
