"""Mix sources to target weights by temperature, as whole and partial permutations.

Token shares p of the sources are raised to an exponent t in [0, 1] and
normalised. Bisection finds the largest t whose weights reach the target
entropy, then the smallest t at which no source repeats more often than the
limit allows; the larger of the two holds, as the limit is the harder rule.
Where the budget is the smallest that gives every source a whole permutation,
the smallest source repeats (largest share / its share)^(1 - t) times, and the
limit holds for that.

A source with weight w gets a quota of w * budget tokens, realised as whole
permutations of its documents and one partial permutation. Permutations are
made of blocks: documents fall into blocks by hash, blocks follow each other by
hash, and so do documents within a block. Sums over blocks find the one block
in which a source's quota ends; only documents of that block are ordered one by
one. Blocks fall into groups the same way, so that a source with very many
blocks isn't ordered in one task either.

Built from DataFrame functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import WORD_PATTERN, Scratch, documents, free_name

#: Target entropy as a share of the way from that of the raw shares to that of equal shares.
ENTROPY_GAIN = 0.5
MAX_REPEAT = 4.0
SEED = "mix-1"
#: Bisection steps, and how many of them one job evaluates.
STEPS, STEPS_A_JOB = 40, 5
BLOCK_DOCS = 2000
#: Blocks of a source follow each other in so large groups, of which one is ordered block by block.
GROUP_BLOCKS = 1000
#: Blocks are numbered by so many hex digits of a hash.
DIGITS = 7


def source_tokens(docs: DataFrame) -> DataFrame:
    """source, n_docs and tokens (words) of each source; sources without a word have no share."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def _tree(lo: float, hi: float, depth: int) -> list[float]:
    """The midpoints that `depth` steps of bisection of [lo, hi] can ask for."""
    if not depth:
        return []
    mid = (lo + hi) / 2
    return [mid, *_tree(lo, mid, depth - 1), *_tree(mid, hi, depth - 1)]


def _bisect(shares: DataFrame, good: Column) -> float:
    """The end of [0, 1] at which `good` (an aggregate over sources; true at 0 or at 1 alone) turns, as its good side.

    Several steps share a job, which evaluates every midpoint they can reach.
    """
    def ask(points: list[float]) -> dict[float, bool]:
        grid = shares.withColumn("t", F.explode(F.array(*map(F.lit, points))))
        return {r.t: bool(r.good) for r in grid.withColumn("z", F.pow("p", F.col("t"))).groupBy("t").agg(good.alias("good")).collect()}

    ends = ask([0.0, 1.0])
    if ends.get(0.0, True) and ends.get(1.0, True):
        return math.nan
    lo, hi = 0.0, 1.0
    rising = ends[1.0]
    for _ in range(STEPS // STEPS_A_JOB):
        found = ask(_tree(lo, hi, STEPS_A_JOB))
        for _ in range(STEPS_A_JOB):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if found[mid] == rising else (mid, hi)
    return hi if rising else lo


def temperature_weights(sources: DataFrame, budget: int, entropy_gain: float = ENTROPY_GAIN, max_repeat: float | None = MAX_REPEAT, cover: bool = False) -> tuple[float, DataFrame]:
    """The exponent, and sources with share, weight and quota (tokens of the budget).

    If even the raw shares (t = 1) repeat a source too often, t = 1 holds. With
    cover, the limit holds at the budget of whole_permutations(). Only sums
    over sources and exponents come to the driver.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        empty = sources.filter("false")
        return 1.0, empty.select("*", *(F.lit(0.0).alias(c) for c in ("share", "weight")), F.lit(0).cast("long").alias("quota"))
    shares = sources.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(total))
    raw, n = shares.agg(-F.sum(F.col("p") * F.log("p")), F.count("*")).first()
    target = raw + entropy_gain * (math.log(n) - raw)
    z = F.sum("z")
    entropy = F.log(z) - F.sum(F.col("z") * F.col("t") * F.log("p")) / z
    t = _bisect(shares, entropy >= target)
    t = 1.0 if math.isnan(t) else t
    if max_repeat is not None and cover:
        low = _bisect(shares, F.pow(F.max("p") / F.min("p"), 1 - F.first("t")) <= max_repeat) if max_repeat >= 1 else 1.0
        # Rounded up, as lower exponents repeat more.
        t = t if math.isnan(low) else max(t, math.ceil(low * 1e6) / 1e6)
    elif max_repeat is not None:
        low = _bisect(shares, F.max(F.col("z") / F.col("p")) / z * budget <= max_repeat * total)
        all_at_0 = shares.agg(F.max(1 / F.col("p")) / n * budget <= max_repeat * total).first()[0]
        t = max(t, low) if not math.isnan(low) else t if all_at_0 else 1.0
    t = round(t, 6)
    power = shares.withColumn("z", F.pow("p", F.lit(t)))
    norm = power.agg(F.sum("z")).first()[0]
    out = power.withColumn("weight", F.col("z") / F.lit(norm)).withColumnRenamed("p", "share").drop("z")
    return t, out.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)).cast("long"))


def whole_permutations(weights: DataFrame) -> DataFrame:
    """weights with the quotas of the smallest budget that gives every source one whole permutation."""
    most = weights.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    return weights.withColumn("quota", F.greatest("tokens", F.floor(F.col("weight") * F.lit(float(most)) + F.lit(1e-6)).cast("long")))


def _fraction(digest: Column, parts: Column) -> Column:
    """Which of so many equal parts of all hashes a hash falls in; the order of parts is that of hashes."""
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")
    return F.floor(number * F.greatest(F.ceil(parts), F.lit(1)) / F.lit(16**DIGITS)).cast("long")


def _before(value: str, keys: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def plan_copies(docs: DataFrame, budget: int | None = None, seed: str = SEED, entropy_gain: float = ENTROPY_GAIN, max_repeat: float | None = MAX_REPEAT, cover: bool = False) -> DataFrame:
    """How often each document occurs in the mixture, one row per row of docs: doc_id, source, n_tokens, block, place, n_copies.

    docs: doc_id, source, text; other columns are not read. place orders the
    documents of a source: its permutation. budget: tokens of the mixture, by
    default those of docs. With cover, the budget grows until the source that
    the weights hold back most has one whole permutation, so every document
    occurs; max_repeat holds at that budget. Documents with equal ids share
    their place, and then go by their number of tokens. A document enters a
    partial permutation while the tokens before it are under what is left of
    the quota. Null sources form one source, apart from all others. Texts
    without a word (null ones too) have no tokens; they occur as often as their
    place says. Where a whole source has no word, its documents occur once with
    cover and not at all otherwise. An empty table stays empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    n_tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    rank = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # "=name" or "": names and null can't meet.
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    slim = scratch.table("slim", docs.select("doc_id", source.alias("source"), n_tokens.alias("n_tokens"), rank.alias("rank")))
    sources = scratch.table("sources", source_tokens(slim).coalesce(1))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    _, weights = temperature_weights(sources, total if budget is None else budget, entropy_gain, max_repeat, cover)
    if cover:
        weights = whole_permutations(weights)
    quotas = weights.select("source", (F.col("quota") / F.col("tokens")).cast("long").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest"))
    quotas = sources.select("source", "n_docs").join(quotas, "source", "left")
    quotas = scratch.table("quotas", quotas.fillna({"whole": int(cover), "rest": 0}).coalesce(1))

    placed = slim.join(quotas, "source").withColumn("block", _fraction(F.col("rank"), F.col("n_docs") / BLOCK_DOCS))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("n_docs").alias("n_docs"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.substring("source", 2, 1 << 30), "block"))
    sums = sums.withColumn("digest", digest).withColumn("group", _fraction(F.col("digest"), F.col("n_docs") / (BLOCK_DOCS * GROUP_BLOCKS)))
    sums = scratch.table("sums", sums)
    groups = sums.groupBy("source", "group").agg(F.sum("tokens").alias("group_tokens"), F.first("rest").alias("rest"))
    groups = groups.withColumn("group_before", _before("group_tokens", ["source"], ["group"])).filter("group_before < rest").drop("rest")
    # Groups within the quota need no order; it ends in one group, and in one block of that.
    met = sums.join(groups, ["source", "group"])
    whole = met.filter("group_before + group_tokens <= rest").select("source", "block", F.lit(0).cast("long").alias("room"), F.lit(True).alias("full"))
    ended = met.filter("group_before + group_tokens > rest")
    ended = ended.withColumn("before", F.col("group_before") + _before("tokens", ["source", "group"], ["digest", "block"])).filter("before < rest")
    inside = whole.unionByName(ended.select("source", "block", (F.col("rest") - F.col("before")).alias("room"), (F.col("before") + F.col("tokens") <= F.col("rest")).alias("full")))
    chosen = placed.join(inside, ["source", "block"], "left")
    cols = ["doc_id", "source", "n_tokens", "block", "rank", "whole"]
    cut = chosen.filter("not full").withColumn("before", _before("n_tokens", ["source", "block"], ["rank", "n_tokens"]))
    cut = cut.select(*cols, (F.col("before") < F.col("room")).cast("int").alias("extra"))
    rest = chosen.filter("full or full is null").select(*cols, F.coalesce(F.col("full"), F.lit(False)).cast("int").alias("extra"))
    place = F.concat_ws("-", digest, "rank")
    name = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30))
    return cut.unionByName(rest).select("doc_id", name.alias("source"), "n_tokens", "block", place.alias("place"), (F.col("whole") + F.col("extra")).alias("n_copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_copies(documents(spark, sf_dir))


def expand(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixture: every row of docs as often as the plan, made from docs, has it.

    Plans join by doc_id, source and number of tokens, nulls included. All
    columns of docs stay. Repeated rows share out the copies of their lines in
    the plan; an empty table stays empty.
    """
    names = ["doc", "n", "src", "sum", "rows", "k", "copy"]
    doc, n, src, total, rows, k, copy = (free_name(docs, f"plan_{c}") for c in names)
    n_tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    # Repeated rows have one line each in the plan; as pairs they would multiply, so their copies are added up and dealt out.
    plan = plan.groupBy(F.col("doc_id").alias(doc), F.col("n_tokens").alias(n), F.col("source").alias(src)).agg(F.sum("n_copies").alias(total), F.count("*").alias(rows))
    same = docs["doc_id"].eqNullSafe(plan[doc]) & docs["source"].cast("string").eqNullSafe(plan[src]) & (n_tokens == plan[n])
    joined = docs.join(plan, same, "inner")
    one, twin = joined.filter(F.col(rows) == 1).withColumn(k, F.col(total)), joined.filter(F.col(rows) > 1)
    place = F.row_number().over(Window.partitionBy(doc, n, src).orderBy(F.xxhash64("text")))
    twin = twin.withColumn(k, F.floor(F.col(total) * place / F.col(rows)) - F.floor(F.col(total) * (place - 1) / F.col(rows)))
    both = one.unionByName(twin).filter(F.col(k) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(k).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


OP5_SQL = rf"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, md5('{SEED}|' || doc_id) AS rank FROM documents
), src AS (
  SELECT source, count(*) AS n_docs, sum(n)::BIGINT AS tokens FROM slim GROUP BY source HAVING sum(n) > 0
), tot AS (
  SELECT coalesce(sum(tokens), 0)::BIGINT AS total FROM src
), ps AS (
  SELECT list(tokens / total ORDER BY source) AS p, any_value(total) AS total FROM src, tot
), goal AS (
  SELECT p, total, -list_sum(list_transform(p, lambda x: x * ln(x))) AS raw, ln(len(p)) AS top FROM ps
), ent(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               ln(list_sum(list_transform(p, lambda x: x ** ((lo + hi) / 2))))
               - list_sum(list_transform(p, lambda x: x ** ((lo + hi) / 2) * ((lo + hi) / 2) * ln(x))) / list_sum(list_transform(p, lambda x: x ** ((lo + hi) / 2)))
               >= raw + {ENTROPY_GAIN} * (top - raw) AS ok
        FROM ent, goal WHERE i < {STEPS})
), rep(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(p, lambda x: x ** ((lo + hi) / 2 - 1))) / list_sum(list_transform(p, lambda x: x ** ((lo + hi) / 2))) <= {MAX_REPEAT} AS ok
        FROM rep, goal WHERE i < {STEPS})
), expo AS (
  SELECT round(greatest(
    CASE WHEN raw >= raw + {ENTROPY_GAIN} * (top - raw) - 1e-15 THEN 1.0 ELSE (SELECT lo FROM ent WHERE i = {STEPS}) END,
    CASE WHEN list_max(list_transform(p, lambda x: 1 / x)) / len(p) <= {MAX_REPEAT} THEN 0.0 ELSE (SELECT hi FROM rep WHERE i = {STEPS}) END), 6) AS t
  FROM goal
), w AS (
  SELECT source, n_docs, tokens, floor((tokens / total) ** t / (sum((tokens / total) ** t) OVER ()) * total + 1e-6)::BIGINT AS quota FROM src, tot, expo
), placed AS (
  SELECT doc_id, s.source, n, rank, coalesce(quota // tokens, 0) AS whole, coalesce(quota % tokens, 0) AS rest,
         floor(('0x' || substr(rank, 1, {DIGITS}))::BIGINT * greatest(ceil((count(*) OVER (PARTITION BY s.source)) / {BLOCK_DOCS}), 1) / {16**DIGITS})::BIGINT AS block
  FROM slim s LEFT JOIN w ON s.source IS NOT DISTINCT FROM w.source
), blocks AS (
  SELECT source, block, rest, tokens, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY md5('{SEED}|' || coalesce(source, '') || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, block, any_value(rest) AS rest, sum(n) AS tokens FROM placed GROUP BY source, block)
), walked AS (
  SELECT p.*, b.before, b.tokens, coalesce(sum(n) OVER (PARTITION BY p.source, p.block ORDER BY rank, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inner_before
  FROM placed p JOIN blocks b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block
)
SELECT doc_id, source, n::BIGINT AS n_tokens, block, md5('{SEED}|' || coalesce(source, '') || '|' || block) || '-' || rank AS place,
       (whole + CASE WHEN before >= rest THEN 0 WHEN before + tokens <= rest THEN 1 WHEN inner_before < rest - before THEN 1 ELSE 0 END)::BIGINT AS n_copies
FROM walked
"""
