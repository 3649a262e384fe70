"""URL filters: fixed host/path rules, then association rules mined with Spark's FP-growth.

Every URL is a set of tokens (scheme, host, domain, top-level domain, path words, extension, query
keys). Labelled pages are transactions. Tokens of fewer than the minimum number of bad pages cannot be in
a rule and go; tokens that occur in exactly the same labelled pages are one item (a page has the item if
it has any of them, which is what all the rules over these tokens say together), so a repeated URL of
any length is a few items. FP-growth mines the item combinations of the bad pages; their clean pages are
counted exactly by the inverted index. Rules under the bounds of support (a share of the labelled pages and
an absolute count), confidence, or lift over the share of bad pages go, also those whose confidence may by chance
(Wilson bound) lie under that share, and those that add items to a shorter rule without a gain in
confidence. The inverted index holds every rule under its rarest item: the items of the distinct URL
token sets probe it, and a probe counts only if the whole antecedent is in the set.

Bounds: items number at most (tokens of a page) / (support bound). A third of all pages may share a host:
pages are reduced to distinct token sets before the probe, and the verdicts go back to the pages over a
salted key.

Defined results: a NULL url, or one without ``://``, has empty host and path, no tokens but the
verdict of an empty set (allow); of equally long fitting rules the last in sorted order wins; very long
URLs have as many tokens as words; repeated rows are judged (and, if labelled, counted) row by row;
without labelled bad pages there are no mined rules; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.llm.text import ascii_lower
from procsig.session import cut_lineage
from procsig.sources.tables import table

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT, MIN_LIFT, SALTS = 0.005, 0.6, 5, 2.0, 32
#: Normal quantile of the Wilson bound that a rule's confidence must keep above the share of bad pages.
WILSON_Z = 3.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host in ASCII lower case; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    return (ascii_lower(F.regexp_extract(u, "://([^/?#]*)([^?#]*)", 1)),
            F.regexp_extract(u, "://([^/?#]*)([^?#]*)", 2))


def base_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, sorted; numbers in the path are one token."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(ascii_lower(path), "[/.]+"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(F.col("url"), "://", 1)), F.concat(F.lit("host:"), host),
                F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)), F.concat(F.lit("tld:"), F.element_at(labels, -1))),
        F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("sub:"), x)),
        F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("path:0")).otherwise(F.concat(F.lit("path:"), x))),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def token_items(labelled: DataFrame, min_count: int) -> DataFrame:
    """``labelled(row, tokens, bad)`` -> ``token, item``: tokens of at least ``min_count`` bad pages; those of the same
    pages share an item (the smallest of them)."""
    per = (labelled.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token")
           .agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x1"),
                F.bit_xor(F.xxhash64(F.lit("second"), "row")).alias("x2")).where(F.col("n_bad") >= min_count))
    pages = ["n_bad", "n", "x1", "x2"]
    return per.join(per.groupBy(*pages).agg(F.min("token").alias("item")), pages).select("token", "item")


def with_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """``sets(tokens)``, distinct -> those with any item, with their sorted ``items``."""
    return (sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
            .groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """``labelled(tokens, bad)`` -> (``antecedent, confidence, support`` of the rules that imply bad, over items;
    ``token, item``)."""
    pages = cut_lineage(labelled.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()))
    total = pages.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    n, n_bad = total["n"], total["bad"]
    floor = max(min_count, math.ceil(min_support * n))
    items = cut_lineage(token_items(pages, floor))
    sets = pages.groupBy("tokens").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("clean"))
    known = cut_lineage(sets.join(with_items(sets.select("tokens"), items), "tokens").groupBy("items")
                        .agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")))
    baskets = known.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("bad"))).alias("copy"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, floor / max(n_bad, 1))).fit(baskets)
    mined = cut_lineage(model.freqItemsets.where(F.col("freq") >= floor).select(F.array_sort("items").alias("antecedent"), "freq"))
    clean = (probes(known.where("clean > 0").select(F.col("items").alias("tokens"), "clean"), mined.select("antecedent"))
             .groupBy("antecedent").agg(F.sum("clean").alias("clean")))
    seen = F.col("freq") + F.col("clean")
    z2 = WILSON_Z ** 2
    share = F.col("freq") / seen
    low = (share + z2 / (2 * seen) - WILSON_Z * F.sqrt(share * (1 - share) / seen + z2 / (4 * seen * seen))) / (1 + z2 / seen)
    rules = (mined.join(clean, "antecedent", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
             .select("antecedent", share.alias("confidence"), (F.col("freq") / F.lit(max(n, 1))).alias("support"), low.alias("low"))
             .where((F.col("confidence") >= min_confidence) & (F.col("confidence") * n >= min_lift * n_bad) & (F.col("low") * n > n_bad))
             .drop("low"))
    # A rule goes if a proper part of its items implies bad as surely. Parts are looked up by
    # key, each rule's parts being bounded by the number of its items.
    parts = (rules.select("antecedent", "confidence", F.explode("antecedent").alias("gone"))
             .select("antecedent", "confidence", F.array_remove("antecedent", F.col("gone")).alias("part")))
    weak = (parts.join(rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence")), "part")
            .where("part_confidence >= confidence").select("antecedent").distinct())
    return rules.join(weak, "antecedent", "left_anti"), items


def probes(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(tokens, ...)``, ``rules(antecedent, ...)`` -> a row for every set that holds a whole antecedent."""
    freq = sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    anchors = (rules.select("*", F.explode("antecedent").alias("token")).join(freq, "token", "left")
               .groupBy(*rules.columns).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("a"))
               .select(*rules.columns, F.col("a.token").alias("token")))
    return (sets.select("*", F.explode("tokens").alias("token")).join(anchors, "token")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0).drop("token"))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(tokens)``, distinct -> the sets that contain a rule, with its best confidence."""
    return probes(sets, rules.select("antecedent", "confidence")).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labelled_ids: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> DataFrame:
    """``pages(page_id, url)`` and ``labelled_ids(page_id, bad)`` -> one row per page with its verdict."""
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    p = p.select("page_id", "host", "path", base_rule(F.col("host"), F.col("path"), rules).alias("base"),
                 url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = p.join(labelled_ids, "page_id").select("tokens", "bad")
    mined, items = mine_rules(labelled, min_support, min_confidence, min_count, min_lift)
    sets = with_items(p.select("tokens").distinct(), items)
    hit = match_rules(sets.select(F.col("items").alias("tokens")).distinct(), mined)
    blocked = sets.join(hit.select(F.col("tokens").alias("items"), "confidence"), "items").select("tokens", "confidence")
    salted = blocked.select(F.col("tokens").alias("set"), "confidence",
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    return (p.join(salted, (F.col("tokens") == F.col("set")) & (F.col("salt") == F.col("salt_of")), "left")
            .select("page_id", "host", "path", F.col("base.rule").alias("rule"),
                    F.coalesce("base.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                    F.col("confidence").alias("rule_confidence")))


def page_labels(labels: DataFrame) -> DataFrame:
    """``(page_id, bad)``: bad where any label row of the id has quality 0 or toxic 1."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id"))
            .agg(F.max(bad).alias("bad")))


@register("op10_url_filters")
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, page_labels(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
