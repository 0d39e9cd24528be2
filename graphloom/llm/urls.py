"""URL filters by association rules (operator 8) [native].

Given rules on hosts and path prefixes label the urls that they cover. Over
these labels the combinations of url tokens that go with a verdict are mined by
growing frequent patterns; rules pruned by support, confidence and redundancy
then judge the urls that no given rule covers. Urls without a matching rule get
the default verdict.

Mining. Spark's FPGrowth lists every frequent itemset: 2**k of them for k path
segments that many urls share. Rules need but the minimal generators, those
itemsets that no smaller one with the same support implies: any other itemset
makes a rule that is as sure without one of its tokens. So the growth is done
here, level by level over weighted distinct baskets, and non-generators are cut
at once: all their extensions are non-generators too, so nothing is lost. Tokens
that always occur together are one item, held by a url that holds any of them
(each would be a rule as good). No number or length of rules is capped; what is
left is bounded by the generators, of which a path shared by many urls has one
for each of its prefixes, whatever its length.

Matching. A rule is filed under its rarest item only, and the rest of it is
looked for in the urls that hold that one.

DataFrame functions only. Nulls: a null url, or one without "://", has an empty
host and path, and no tokens; a null page_id stays. Repeated rows (same page_id
and url) give one row. Ties between mined rules: confidence, support, number of
items, then the tokens themselves decide. An empty table gives an empty one.
Columns other than page_id and url, whatever their names, are not looked at.
Urls of any length are read whole.
"""

from __future__ import annotations

import math
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.7
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the last host label, the others, path segments with numbers made alike, and the depth."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    n = F.size(labels)
    ends = F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)), F.concat(F.lit("depth:"), F.least(F.size(parts), F.lit(6)).cast("string")))
    return F.array_distinct(F.concat(
        F.transform(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), lambda x: F.concat(F.lit("h:"), x)), F.transform(parts, lambda x: F.concat(F.lit("p:"), x)),
        F.when(n > 0, ends).otherwise(F.array().cast("array<string>")),
    ))


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (page_id, url) with host, path and the longest given rule (rule, ruled: its verdict) that fits; null if none does."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).distinct().withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_host = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_list(F.struct(F.col("path").alias("under"), "verdict")).alias("paths"))
    fit = _looked_up(urls.withColumn("suffix", F.explode(suffixes)), by_host, "suffix")
    fits = F.filter("paths", lambda r: F.col("path").startswith(r["under"]))
    found = F.transform(fits, lambda r: F.struct(F.length(F.concat("suffix", r["under"])).alias("n"), F.concat("suffix", r["under"]).alias("rule"), r["verdict"].alias("ruled")))
    best = fit.groupBy("page_id", "url", "host", "path").agg(F.max(F.array_max(found)).alias("b"))
    return best.select("page_id", "url", "host", "path", "b.rule", "b.ruled")


def _looked_up(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """many with the columns of one's row of the same key, or nulls: by broadcast of counted bytes, or with hot keys dealt out."""
    one = tk.shared_checkpoint(many.sparkSession, one)
    near = tk.small(one)
    if near is not one:
        return many.join(near, key, "left")
    many = tk.shared_checkpoint(many.sparkSession, many)
    return tk.skew_join(many, one, tk.shared_checkpoint(many.sparkSession, many.groupBy(key).agg(F.count("*").alias("n"))), [key], "left")


def _items(steps: tk.Steps, baskets: DataFrame, least: int, total: int) -> DataFrame:
    """token, item, n of frequent tokens: tokens of the same baskets are one item, named after the least of them. Those of all baskets go: they tell nothing."""
    held = baskets.select("basket", "w", F.explode("tokens").alias("token"))
    by_token = held.groupBy("token").agg(F.sum("w").alias("n"), F.expr("bit_xor(xxhash64(1, basket))").alias("a"), F.expr("bit_xor(xxhash64(basket, 2))").alias("b"))
    frequent = steps.store(by_token.where((F.col("n") >= least) & (F.col("n") < total)))
    return steps.store(frequent.join(frequent.groupBy("n", "a", "b").agg(F.min("token").alias("item")), ["n", "a", "b"]).select("token", "item", "n"))


def _grown(found: DataFrame, size: int) -> DataFrame:
    """Candidates of size + 1 items: two itemsets (items, in order, and n) that differ in their last, all of whose itemsets of `size` items are there. least: the least n of those."""
    head = found.select(F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last"))
    pairs = head.join(head.withColumnRenamed("last", "next"), "head").where("last < next").select(F.concat("head", F.array("last", "next")).alias("grown"))
    parts = pairs.select("grown", F.explode("grown").alias("x")).select("grown", F.array_remove("grown", F.col("x")).alias("items"))
    return parts.join(found.select("items", "n"), "items").groupBy("grown").agg(F.count("*").alias("parts"), F.min("n").alias("least")).where(f"parts = {size + 1}").select(F.col("grown").alias("items"), "least")


def _counted(baskets: DataFrame, candidates: DataFrame, common: DataFrame) -> DataFrame:
    """(items, ruled, both, least): weights of the baskets that hold each candidate, by verdict. A candidate is looked for where its rarest item is."""
    rarest = candidates.select("items", "least", F.explode("items").alias("item")).join(common, "item").groupBy("items", "least").agg(F.min(F.struct("n", "item"))["item"].alias("key"))
    filed = rarest.groupBy("key").agg(F.collect_list(F.struct("items", "least")).alias("filed"))
    looked = _looked_up(baskets.select("held", "w", "ruled", F.explode("held").alias("key")), filed, "key").where("filed IS NOT NULL")
    fits = F.filter("filed", lambda c: F.size(F.array_except(c["items"], F.col("held"))) == 0)
    return looked.select("w", "ruled", F.inline(fits)).groupBy("items", "ruled", "least").agg(F.sum("w").alias("both"))


def _with_items(baskets: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """baskets (a row each by `keep`, with tokens) with held: distinct items, in order, and named: (item, token) of their tokens."""
    pairs = _looked_up(baskets.select(*keep, F.explode_outer("tokens").alias("token")), items.select("token", "item"), "token")
    grouped = pairs.groupBy(*keep).agg(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("item", "token"))).alias("named"))
    return grouped.withColumn("held", F.array_sort(F.array_distinct(F.transform("named", lambda x: x["item"]))))


def mine(spark: SparkSession, labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules: items, key (the rarest of them), verdict, confidence, support; token, item of the items in rules) from rows with tokens and ruled. Stored tables.

    A rule's support and confidence are those of its items with the verdict; it
    stays if it is surer than the verdict is by itself, and than, or as sure as, no rule without one of its items.
    """
    with tk.Steps(spark) as steps:
        baskets = labelled.groupBy(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "ruled").agg(F.count("*").alias("w"))
        baskets = steps.store(baskets.withColumn("basket", F.monotonically_increasing_id()))
        base = baskets.groupBy("ruled").agg(F.sum("w").alias("of_verdict"))
        total = baskets.agg(F.sum("w")).first()[0] or 0
        least = max(1, math.ceil(min_support * total))
        items = _items(steps, baskets, least, total)
        common = steps.store(items.select("item", "n").distinct())
        baskets = steps.store(_with_items(baskets, items, ["basket", "ruled", "w"]).drop("named").where(F.size("held") > 0))
        candidates, size, levels = common.select(F.array("item").alias("items"), F.lit(total).cast("long").alias("least")), 1, []
        while True:
            counts = _counted(baskets, candidates, common)
            found = steps.store(counts.groupBy("items", "least").agg(F.sum("both").alias("n"), F.collect_list(F.struct("ruled", "both")).alias("verdicts")))
            # a generator has less support than each part of it; one that no verdict is frequent with grows into none that is
            found = steps.store(found.where(F.exists("verdicts", lambda v: v["both"] >= least) & (F.col("n") < F.col("least"))))
            if found.isEmpty():
                break
            levels.append(found)
            candidates, size = steps.store(_grown(found, size)), size + 1
            if candidates.isEmpty():
                break
        every = fold(DataFrame.unionAll, levels) if levels else spark.range(0).select(F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<ruled:string,both:bigint>>").alias("verdicts"))
        rules = every.select("items", "n", F.inline("verdicts")).where(F.col("both") >= least).join(F.broadcast(base), "ruled")  # a row for each verdict
        rules = rules.select("items", F.col("ruled").alias("verdict"), (F.col("both") / F.col("n")).alias("confidence"), (F.col("both") / F.lit(float(total or 1))).alias("support"), "of_verdict")
        rules = steps.store(rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") * float(total or 1) > F.col("of_verdict"))).drop("of_verdict"))
        shorter = rules.where(F.size("items") > 1).select(F.col("items").alias("whole"), "verdict", "confidence", F.explode("items").alias("x"))
        shorter = shorter.select("whole", "verdict", "confidence", F.array_remove("whole", F.col("x")).alias("items"))
        needless = shorter.join(rules.select("items", "verdict", F.col("confidence").alias("sure")), ["items", "verdict"]).where("sure >= confidence").select(F.col("whole").alias("items"), "verdict").distinct()
        rules = rules.join(needless, ["items", "verdict"], "left_anti")
        keyed = rules.select("items", "verdict", F.explode("items").alias("item")).join(common, "item").groupBy("items", "verdict").agg(F.min(F.struct("n", "item"))["item"].alias("key"))
        kept = steps.keep(rules.join(keyed, ["items", "verdict"]).select("items", "key", "verdict", "confidence", "support"))
        return kept, steps.keep(items.join(kept.select(F.explode("items").alias("item")).distinct(), "item", "left_semi").select("token", "item"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, url, host, path, rule, verdict, by ("rule", "mined" or "default"), mined (the tokens that decided), confidence."""
    row = lambda r: F.struct(F.lit(r[0]).alias("host"), F.lit(r[1]).alias("path"), F.lit(r[2]).alias("verdict"))
    given = spark.range(1).select(F.inline(F.array(*[row(r) for r in rules])))
    urls = tk.shared_checkpoint(spark, with_rules(pages, given).withColumn("tokens", url_tokens(F.col("host"), F.col("path"))))
    labelled = urls.where("ruled IS NOT NULL")
    best = "CAST(NULL AS struct<confidence:double,support:double,n:int,rule_tokens:array<string>,verdict:string>)"
    if labelled.isEmpty():
        matched = urls.withColumn("m", F.expr(best))
    else:
        mined, items = mine(spark, labelled, min_support, min_confidence)
        index = mined.groupBy("key").agg(F.collect_list(F.struct("confidence", "support", "items", "verdict")).alias("filed"))
        columns = ["page_id", "url", "host", "path"]
        open_ = _with_items(urls.where("ruled IS NULL"), items, columns).withColumn("key", F.explode_outer("held"))
        fits = F.filter("filed", lambda r: F.size(F.array_except(r["items"], F.col("held"))) == 0)
        # of tokens that are one item, the greatest that the url holds
        token = lambda x: F.array_max(F.transform(F.filter("named", lambda y: y["item"] == x), lambda y: y["token"]))
        found = F.transform(fits, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), F.size(r["items"]).alias("n"), F.array_sort(F.transform(r["items"], token)).alias("rule_tokens"), r["verdict"].alias("verdict")))
        open_ = _looked_up(open_, index, "key").groupBy(*columns).agg(F.max(F.array_max(found)).alias("m")).withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
        matched = labelled.drop("tokens").withColumn("m", F.expr(best)).unionByName(open_)
    by = F.when(F.col("ruled").isNotNull(), "rule").when(F.col("m").isNotNull(), "mined").otherwise("default")
    return matched.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", "m.verdict", F.lit(DEFAULT)).alias("verdict"), by.alias("by"), F.col("m.rule_tokens").alias("mined"), F.col("m.confidence").alias("confidence"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, tk.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "by")
