"""Prepare a training corpus in five stages: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Every stage reads the columns of documents alone, so others may be there under any name, and takes an empty table to an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, documents
from quillspan.llm.jaccard_join import drop_near_duplicates
from quillspan.llm.line_dedup import drop_repeated_lines
from quillspan.llm.mixing import expand, plan_copies
from quillspan.llm.quality_rules import apply_rules
from quillspan.llm.sentencepiece_codec import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their source's verdict reject.

    Null and empty texts have no words and go. Repeated rows are judged alike; a null source is a source of its own.
    """
    return apply_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; n_chars follows the text.

    Null texts stay null, with n_chars 0. Rows of one doc_id are one document, whose lines don't repeat each other; a null id comes last.
    """
    out = drop_repeated_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Of texts without a word (null ones too) one stays, of rows that share a doc_id the longest; rows without a doc_id all stay.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, sources repeated up to their temperature weights.

    Null sources are one source; sources without a word occur once. Repeated rows share out their copies.
    """
    docs = docs.select(*COLUMNS)
    return expand(docs, plan_copies(docs, cover=True)).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to. Null and empty texts have no ids, and the digest of the empty text."""
    import public_tokenizers

    out = encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), ("ids", "decoded"))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(f"stage{k}", docs)
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs


#: SQL can't encode; tests/llm compares the stages with brute force.
ORACLE_SQL = None
