"""Quality rules per document, and verdicts on hosts shrunk by an empirical beta prior.

Base rules judge documents by their own text. Failures are then added up by
host; a beta prior fitted to the hosts' rates by the method of moments shrinks
the rate of hosts with few documents; hosts whose shrunken rate is too high
lose all documents. Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import SPACE_CLASS, Scratch, documents, free_name

MIN_WORDS = 10
NGRAM = 5
MAX_REPEAT_PERCENT = 20
#: Hosts above this shrunken rate of failures are rejected.
MAX_HOST_RATE = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _covered(places: Column, width: int) -> Column:
    """Words covered by windows of `width` that begin at the sorted places."""
    gaps = F.zip_with(places, F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def base_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null or empty text has no words and fails. Every column of docs stays but
    for those of the same names. Each row is judged by itself, so repeated rows
    and an empty table need no care.
    """
    docs = docs.drop(*BASE)
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, ls, g, s, p = (free_name(docs, f"rule_{c}") for c in ("words", "lines", "grams", "sorted", "places"))
    out = docs.withColumn(w, words).withColumn(ls, lines)
    n = F.size(w)
    grams = F.when(
        n >= NGRAM + 1,
        F.transform(F.sequence(F.lit(1), n - NGRAM + 1), lambda i: F.xxhash64(*[F.get(F.col(w), i + (k - 1)) for k in range(NGRAM)])),
    )
    out = out.withColumn(g, grams)
    # A stable order by hash keeps equal windows together; their places are those with an equal neighbour.
    out = out.withColumn(s, F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    twice = F.filter(F.col(s), lambda x, i: (F.get(F.col(s), i - 1)["g"] == x["g"]) | (F.get(F.col(s), i + 1)["g"] == x["g"]))
    out = out.withColumn(p, F.array_sort(F.transform(twice, lambda x: x["i"])))
    out = out.withColumn("n_words", n.cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col(p).isNotNull(), _covered(F.col(p), NGRAM)), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(w, ls, g, s, p)


def host_rates(judged: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunken) and host_rejected.

    With rates r of hosts, mean m and variance v, the prior is beta(m k, (1-m) k)
    with k = m (1-m) / v - 1, and k = 0 (no shrinking) where v is 0 or too
    large. A null host is a host of its own; an empty table has no hosts.
    """
    counts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = counts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    prior = prior.select("m", F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(0.0))).otherwise(0.0).alias("k"))
    # One row, whatever the table.
    out = counts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k")))
    return out.select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > max_rate).alias("host_rejected"))


def with_verdicts(judged: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """base_rules() output with host_rate, host_rejected and kept: neither the document nor its host fails.

    Other columns stay. Every row's host must be among hosts; an empty table stays empty.
    """
    judged = judged.drop("host_rate", "host_rejected", "kept")
    name = free_name(judged, "rule_host")
    hosts = hosts.select(F.col("host").alias(name), "host_rate", "host_rejected")
    out = judged.join(hosts, judged[host].eqNullSafe(hosts[name]), "left").drop(name)
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected")))


def apply_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """with_verdicts() of docs, all columns kept.

    The judged rows are written, so that rules are worked out once for hosts
    and documents. Repeated rows count as often as they occur; an empty table
    stays empty.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    judged = scratch.table("judged", base_rules(docs))
    # Written, so that Spark knows its size and need not deal the texts out by host to join it.
    return with_verdicts(judged, scratch.table("hosts", host_rates(judged.select(host, "base_failed"), host, max_rate)), host)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_rules(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text")
    scratch = Scratch(spark, "quality")
    base = scratch.table("base", base)
    return with_verdicts(base, scratch.table("hosts", host_rates(base))).select("doc_id", *BASE, "kept")


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), counted AS (
  SELECT doc_id, source, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM words
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 3)) AS i FROM counted WHERE n_words >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(5) AS t(k) GROUP BY doc_id
), base AS (
  SELECT c.doc_id, c.source, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
         (n_words < 10 OR 100 * coalesce(v.n, 0) > 20 * n_words) AS base_failed
  FROM counted c LEFT JOIN covered v USING (doc_id)
), hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM base GROUP BY source
), prior AS (
  SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts
), rates AS (
  SELECT source, (f + m * k) / (n + k) AS rate
  FROM (SELECT source, n, f, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE 0 END AS k FROM hosts CROSS JOIN prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate > 0.5) AS kept
FROM base JOIN rates ON base.source IS NOT DISTINCT FROM rates.source
"""
