"""Toxicity scores from a factorization machine over hashed terms.

A text is a sparse vector of hashed terms: its words in lower case and their
first letters, which carry over to unseen inflections. The machine adds to the
linear weights of terms the inner products of their factors, so that pairs of
terms count beyond what each says alone. Terms whose frequency differs clearly
between the labels are fitted first, or the machine would learn single texts by
heart; then all terms, on what is left, so that pairs count whose terms tell
nothing alone. It is fitted with numpy on a bounded sample of labelled rows;
scoring streams over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import Scratch, documents, slices

BITS = 18
FACTORS = 8
STEMS = (3, 4, 5)
#: Terms are fitted first if their frequencies differ by so many standard errors; all terms need at least so many texts.
MIN_Z, MIN_TEXTS = 4.0, 4
#: The bounds on labelled rows that a model is fitted on, and on the bytes of their terms (4 a term).
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 12_000, 256 << 20
EPOCHS = 12
THRESHOLD = 0.7
STRIP = b".,;:!?\"'()[]{}<>-_*"


class Terms(dict):
    """The hashed terms of a word, remembered for at most `limit` words; given a mask, its terms alone."""

    def __init__(self, mask: np.ndarray | None = None, limit: int = 300_000):
        super().__init__()
        self.limit, self.mask = limit, mask

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        plain = (word.decode("utf-8", "replace").lower().strip(STRIP.decode()) or "\0")
        hashed = [xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in (plain, *(f"{k}\1{plain[:k]}" for k in STEMS))]
        value = self[word] = tuple(x for x in hashed if self.mask is None or self.mask[x])
        return value

    def of(self, text: bytes) -> np.ndarray:
        """The distinct terms of a text."""
        return np.unique(np.fromiter((t for w in set(text.split()) for t in self[w]), dtype=np.int32))


@dataclass(frozen=True)
class Pace:
    """Steps of linear weights and factors, decay of both, where the sums of squared gradients begin, and the spread of first factors."""

    linear: float
    factors: float
    decay: float
    begin: float
    start: float


TELLING, REST = Pace(0.2, 0.05, 1e-5, 1e-8, 0.02), Pace(0.002, 0.02, 1e-3, 1.0, 0.01)


@dataclass
class Machine:
    """Bias, and linear weights and factors by term; only terms in the mask have any."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mask: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of texts given by their terms in the mask."""
        out = np.full(len(rows), float(self.bias))
        full = np.array([i for i, r in enumerate(rows) if len(r)], dtype=np.int64)
        if len(full):
            terms, begin = _lay(rows, full)
            out[full] += _pairwise(self.linear[terms], self.factors[terms], begin)[0]
        return out


def _lay(rows: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the chosen texts end to end, and where each text begins."""
    n = np.array([len(rows[i]) for i in which])
    return np.concatenate([rows[i] for i in which]), np.cumsum(n) - n


def _pairwise(linear: np.ndarray, factors: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear terms plus all pairs' inner products, and the sums of factors, for each text."""
    first = np.add.reduceat(factors, begin, axis=0)
    second = np.add.reduceat(factors * factors, begin, axis=0)
    return np.add.reduceat(linear, begin) + 0.5 * (first * first - second).sum(axis=1), first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def telling_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Mask of terms whose shares of texts differ by MIN_Z standard errors between the labels."""
    count = [np.zeros(1 << BITS) for _ in range(2)]
    for r, y in zip(rows, labels, strict=True):
        count[int(y)][r] += 1
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    pooled = (count[0] + count[1]) / (n[0] + n[1])
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (np.abs(count[1] / n[1] - count[0] / n[0]) > MIN_Z * error) & (count[0] + count[1] >= MIN_TEXTS)


def frequent_terms(rows: list[np.ndarray]) -> np.ndarray:
    """Mask of terms in at least MIN_TEXTS texts, whatever their labels."""
    return np.bincount(np.concatenate(rows), minlength=1 << BITS) >= MIN_TEXTS


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """A machine over the telling terms, then one over all frequent terms for what the first leaves unexplained; their sum is one machine.

    The second moves in smaller steps and decays faster. Texts that the telling
    terms explain give it no gradient, so it does not learn them by heart.
    """
    mask = frequent_terms(rows)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    first = _descend(rows, labels, telling_terms(rows, labels), np.full(len(rows), bias), epochs, seed, TELLING)
    offset = bias + first.logits([r[first.mask[r]] for r in rows])
    rest = _descend(rows, labels, mask, offset, epochs, seed, REST)
    return Machine(bias + first.bias + rest.bias, first.linear + rest.linear, np.concatenate([first.factors, rest.factors], axis=1), mask)


def _descend(rows: list[np.ndarray], labels: np.ndarray, mask: np.ndarray, offset: np.ndarray, epochs: int, seed: int, pace: Pace) -> Machine:
    """Adagrad on the logistic loss in mini-batches, over the terms in the mask, on top of each text's offset."""
    rng = np.random.default_rng(seed)
    ids = np.flatnonzero(mask)
    place = np.zeros(len(mask), np.int32)
    place[ids] = np.arange(len(ids))
    rows = [place[r[mask[r]]] for r in rows]
    bias, linear, factors = 0.0, np.zeros(len(ids)), rng.normal(0, pace.start, (len(ids), FACTORS))
    g_bias, g_linear, g_factors = pace.begin, np.full(len(ids), pace.begin), np.full((len(ids), FACTORS), pace.begin)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            full = np.array([i for i in part if len(rows[i])], dtype=np.int64)
            blank = [i for i in part if not len(rows[i])]
            error_blank = sigmoid(bias + offset[blank]) - labels[blank]
            error = np.zeros(0)
            if len(full):
                terms, begin = _lay(rows, full)
                v = factors[terms]
                logit, first = _pairwise(linear[terms], v, begin)
                error = (sigmoid(bias + offset[full] + logit) - labels[full]) / len(part)
                which = np.repeat(np.arange(len(full)), np.diff([*begin, len(terms)]))
                used, inv = np.unique(terms, return_inverse=True)
                grad = np.bincount(inv, weights=error[which], minlength=len(used)) + pace.decay * linear[used]
                inner = error[which, None] * (first[which] - v)
                grad_v = np.stack([np.bincount(inv, weights=inner[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + pace.decay * factors[used]
                g_linear[used] += grad * grad
                g_factors[used] += grad_v * grad_v
                linear[used] -= pace.linear * grad / np.sqrt(g_linear[used])
                factors[used] -= pace.factors * grad_v / np.sqrt(g_factors[used])
            grad = error.sum() + error_blank.sum() / len(part)
            g_bias += grad * grad
            bias -= pace.linear * grad / np.sqrt(g_bias)
    wide = np.zeros(len(mask), np.float32), np.zeros((len(mask), FACTORS), np.float32)
    wide[0][ids], wide[1][ids] = linear, factors
    return Machine(bias, *wide, mask)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in slices(batches):
        rows = [terms.of(t or b"").astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "terms"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        terms = Terms(machine.mask)
        for batch in slices(batches):
            rows = [terms.of(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            score = sigmoid(machine.logits(rows))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3. Null ids are not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> Machine:
    """Fit on at most max_rows labelled rows with at most max_bytes of terms, chosen by a hash of their id, none of them held out.

    Null labels and null ids are left out; of repeated labels the largest
    counts, of repeated documents one. Without a row of either label the
    machine gives every text the same score.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    # At most max_rows rows of two numbers: broadcast whatever the corpus.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(_terms_of, "doc_id long, toxic int, terms binary")
    # One row for each id of the sample, however often its document is repeated.
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("terms").alias("terms"))
    rows = Scratch(docs.sparkSession, "toxicity").table("rows", rows)
    # One order over at most max_rows ids and sizes.
    taken = F.sum(F.octet_length("terms")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = rows.select("doc_id", taken.alias("taken")).filter(F.col("taken") <= max_bytes).select("doc_id")
    rows = rows.join(fits, "doc_id", "left_semi").toArrow()
    y = np.asarray(rows.column("toxic").combine_chunks() if rows.num_rows else []).astype(float)
    if not len(y) or y.min() == y.max():
        size = 1 << BITS
        return Machine(0.0 if not len(y) else 4.0 if y.min() else -4.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), np.zeros(size, bool))
    order = np.argsort([xxhash.xxh3_64_intdigest(x.as_py()) for x in rows.column("terms")], kind="stable")
    terms = [np.frombuffer(x.as_py(), "<i4") for x in rows.column("terms")]
    return fit([terms[i] for i in order], y[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs without text, with score between 0 and 1. Null and empty texts get the score of the bias alone.

    A row's score depends on its text alone, so repeated rows have equal scores
    and an empty table stays empty. A column score of docs is replaced, all
    others stay. The machine has a fixed size (2^18 terms), however large the
    corpus.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(_score(shared), ", ".join([*fields, "score double"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score(docs, machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
