"""URL verdicts: listed rules first, then association rules mined from labelled URLs.

Labels are a table of judged URLs, by default those that a listed rule judges.
FP-growth mines combinations of URL tokens (labels of the host, segments of the
path, file endings, query keys) together with the label; combinations that
imply a label with enough support and confidence judge the URLs that no listed
rule fits. Rules match by an
inverted index: each is filed under its rarest token, so a URL meets only rules
that share that token. Equal token sets are matched once.
"""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, free_name

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.8
#: What a URL gets that no rule of either kind fits.
DEFAULT = "allow"
#: So many labels of the host (from its end) and segments of the path (from its beginning) are told apart by position; deeper ones have none.
HOST_LABELS, PATH_PARTS = 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label="


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the remainder; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, F.regexp_extract(rest, r"(?s)^[^?#]*(.*)", 1)


def listed_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of the columns host, path and tail, of all labels and segments; runs of digits count as one sign."""
    labels = F.reverse(F.split("host", r"\."))
    path = F.filter(F.split("path", "/"), lambda x: x != "")
    general = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    ending = F.regexp_extract("path", r"\.([A-Za-z]{1,5})$", 1)
    keys = F.transform(F.filter(F.split(F.regexp_extract("tail", r"^\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    placed = lambda parts, sign, n: F.transform(parts, lambda x, i: F.concat(F.lit(sign), F.when(i < n, i.cast("string")).otherwise(""), F.lit("="), general(x)))
    all_tokens = F.concat(
        placed(labels, "h", HOST_LABELS),
        placed(path, "p", PATH_PARTS),
        F.when(ending != "", F.array(F.concat(F.lit("e="), F.lower(ending)))).otherwise(F.array().cast("array<string>")),
        keys,
    )
    return F.array_sort(F.array_distinct(F.filter(all_tokens, lambda x: x.isNotNull())))


def rule_tokens(rules: tuple[tuple[str, str, str], ...] = RULES) -> list[str]:
    """The tokens that listed rules test: those of their hosts and paths, as tokens() makes them."""
    general = lambda x: re.sub("[0-9]+", "#", x)
    out = set()
    for _, host, path in rules:
        for sign, parts, n in (("h", host.split(".")[::-1], HOST_LABELS), ("p", [x for x in path.split("/") if x], PATH_PARTS)):
            out |= {f"{sign}{i if i < n else ''}={general(x)}" for i, x in enumerate(parts)}
    return sorted(out)


def token_classes(labelled: DataFrame, min_support: float) -> DataFrame:
    """token and item: frequent tokens, and for each the first of those that occur in exactly the same rows.

    At min_support s there are at most (mean tokens of a row) / s frequent
    tokens, however many rows there are. Sets of rows are told apart by 64 bits.
    """
    n = labelled.count()
    h = F.xxhash64("tokens")
    seen = labelled.select(F.explode("tokens").alias("token"), (h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.shiftrightunsigned(h, 32).alias("high"))
    sums = seen.groupBy("token").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).filter(F.col("n") >= min_support * n)
    first = sums.groupBy("n", "low", "high").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return first.select(F.explode("tokens").alias("token"), "item")


def as_items(rows: DataFrame, classes: DataFrame, out: str) -> DataFrame:
    """rows with the classes of their tokens as column out, once each and in order, and out_tokens with (token, item) pairs; other tokens have none."""
    # One row with a map of the frequent tokens, whose number token_classes() bounds.
    known = classes.agg(F.map_from_entries(F.collect_list(F.struct("token", "item"))).alias("token_item"))
    found = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.try_element_at("token_item", t).alias("item")))
    rows = rows.crossJoin(F.broadcast(known)).withColumn(f"{out}_tokens", F.filter(found, lambda x: x["item"].isNotNull())).drop("token_item")
    return rows.withColumn(out, F.array_sort(F.array_distinct(F.col(f"{out}_tokens.item"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules over sets of items: items, verdict, confidence, support and key, the rarest of the items.

    labelled: items (array of strings, each once) and verdict. Every rule of
    more items that is no surer than a rule of some of them is left out.
    """
    baskets = labelled.select(F.array_append("items", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL))
    found = found.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 20).alias("verdict"), "confidence", "support")
    frequency = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rarest = found.select("items", "verdict", F.explode("items").alias("item")).join(frequency, "item").groupBy("items", "verdict").agg(F.min_by("item", F.struct("freq", "item")).alias("key"))
    rules = found.join(rarest, ["items", "verdict"])
    shorter = rules.select(F.col("items").alias("s_items"), F.col("verdict").alias("s_verdict"), F.col("confidence").alias("s_confidence"), F.col("key").alias("s_key"))
    implied = rules.withColumn("item", F.explode("items")).join(shorter, (F.col("item") == F.col("s_key")) & (F.col("verdict") == F.col("s_verdict")) & (F.size("s_items") < F.size("items")) & (F.col("s_confidence") >= F.col("confidence")))
    implied = implied.filter(F.size(F.array_except("s_items", "items")) == 0).select("items", "verdict").distinct()
    return rules.join(implied, ["items", "verdict"], "left_anti")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labels: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pages with host, path, rule, verdict, mined (the URL's tokens that the association rule asks for, if one judged) and confidence.

    labels: url and verdict ("allow" or "block") of URLs to learn from; by
    default the pages that a listed rule judges, with its verdict. Tokens that
    listed rules test are not learned from, so mined rules never restate them.
    Tokens that occur in exactly the same labelled URLs are one item, which each
    of them stands for, so that such tokens multiply no combinations. Of several
    association rules that fit the surest counts, then the one with more
    support, then fewer items, then the first by name. Without labelled URLs
    nothing is mined and DEFAULT holds. Null URLs and those without :// have
    empty hosts and paths, and no rule. Repeated rows stay, an empty table
    stays empty; columns of pages stay, but for those of the same names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    pages = pages.drop("host", "path", "rule", "verdict", "mined", "confidence")
    rule, verdict = listed_rule(rules)
    host, path, tail = split_url(F.col("url"))

    def described(rows: DataFrame) -> DataFrame:
        named = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path"), tail.alias("tail"))
        open_tokens = F.array_except(tokens(), F.array(*map(F.lit, rule_tokens(rules))).cast("array<string>"))
        return named.select("url", "host", "path", rule.alias("rule"), verdict.alias("listed"), open_tokens.alias("tokens"))

    urls = scratch.table("urls", described(pages))
    if labels is None:
        known = pages.select("url").join(urls.filter("listed is not null").select("url", "tokens", F.col("listed").alias("verdict")), "url")
    else:
        known = labels.filter("verdict is not null").select("url", "verdict").join(described(labels).select("url", "tokens"), "url")
    known = scratch.table("known", known.select("tokens", "verdict"))
    classes = scratch.table("classes", token_classes(known, min_support).coalesce(1))
    mined = scratch.table("mined", mine(as_items(known, classes, "items"), min_support, min_confidence).coalesce(1))
    met = as_items(urls.filter("listed is null").select("url", "tokens"), classes, "have").filter(F.size("have") > 0)
    sets = met.select("have").distinct()
    fits = sets.withColumn("key", F.explode("have")).join(mined, "key").filter(F.size(F.array_except("items", "have")) == 0)
    best = fits.groupBy("have").agg(F.min_by(F.struct("items", "verdict", "confidence"), F.struct(-F.col("confidence"), -F.col("support"), F.size("items"), F.col("items"))).alias("best"))
    told = F.transform(F.filter("have_tokens", lambda x: F.array_contains("best.items", x["item"])), lambda x: x["token"])
    met = met.join(best, "have").select("url", "best", told.alias("told"))
    at, got = free_name(pages, "judged_url"), free_name(pages, "judged")
    verdicts = urls.join(met, "url", "left").select(F.col("url").alias(at), F.struct("host", "path", "rule", F.coalesce("listed", "best.verdict", F.lit(DEFAULT)).alias("verdict"), F.col("told").alias("mined"), F.col("best.confidence").alias("confidence")).alias(got))
    verdicts = scratch.table("verdicts", verdicts)  # written, so that both sides are dealt anew and a common URL can be split
    joined = pages.join(verdicts, pages["url"].eqNullSafe(verdicts[at]), "left")
    return joined.select(*(F.col(f"`{c}`") for c in pages.columns), f"`{got}`.*")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"), "confidence")
