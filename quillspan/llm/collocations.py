"""Mine phrases whose words occur together more often than apart, from counts of all phrases up to a length.

Counting follows the vertical partitioning of large suffix trees. Every word
of every piece begins a suffix, cut off at the greatest phrase length. Word
prefixes are dealt to groups, and the suffixes of each group are counted; a
group of more than the memory budget allows is dealt again by prefixes that
are a word longer, as often as need be. Each group builds the subtrees of its
prefixes on its own, from sorted suffixes, and the count of a phrase is the
total of the leaves below its node. Nodes shorter than the prefixes of their
group have parts in several groups, which are added up.

A phrase is frequent only if its words and its neighbouring pairs are. So two
scans count words and pairs before the third makes suffixes, which end where
a frequent phrase can't go on. The filters between the scans are bitmaps of
hashes of a fixed size: a bit is set if the hashes that share it are frequent
together, so they let through too much, never too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import Scratch, WordHashes, documents, mix64, slices

MIN_COUNT, MAX_WORDS, TOP, COVERED_PERCENT = 100, 5, 2000, 100
#: Suffixes that a group may hold; about 200 bytes each in the task that builds its subtrees.
GROUP_ROWS = 1_000_000
#: Groups that first words are dealt to, and how many budgets' worth of groups a small corpus is cut into all the same, for even tasks.
FIRST_GROUPS, LEAST_GROUPS = 1024, 256
#: Bits of the word and the pair filter (2 MB and 8 MB), whatever the corpus.
WORD_BITS, PAIR_BITS = 24, 26
#: Words that a task encodes before it sends what it has counted, and pairs that it gathers from several such chunks.
CHUNK_WORDS, CHUNK_PAIRS = 2_000_000, 4_000_000
#: Bytes of a text that are split at a time.
SPLIT_BYTES = 4 << 20

#: A-Z lower-cased, ends of pieces (.,;:!? and \x0A-\x0D) as \n, blanks as spaces.
_FOLD = bytes(0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b for b in bytes(range(256)).lower())


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, b"\\n" between pieces and b"" where blanks meet, some megabytes at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SPLIT_BYTES)
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\t", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut >= at else len(text)
        yield text[at:end].translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        at = end


class _Chunk:
    """Words of many texts of one language as numbers, -1 between pieces."""

    def __init__(self):
        self.words: dict[bytes, int] = {b"\n": -1, b"": -2}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        known = self.words
        for tokens in _tokens(text):
            for new in set(tokens).difference(known):
                known[new] = len(known) - 2
            ids = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
            ids = ids[ids > -2]
            self.parts.append(ids)
            self.size += len(ids)
        self.parts.append(np.array([-1], np.int32))

    def vocabulary(self) -> list[bytes]:
        return list(self.words)[2:]

    def ids(self, after: int) -> np.ndarray:
        """All numbers, and so many ends of pieces after them."""
        return np.concatenate([*self.parts, np.full(after, -1, np.int32)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Chunk]]:
    """Chunks of about CHUNK_WORDS words; texts are never cut."""
    open_: dict[str, _Chunk] = {}
    for batch in batches:
        for part in slices(iter([batch])):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                chunk = open_.setdefault(lang, _Chunk())
                chunk.add(text)
                if chunk.size >= CHUNK_WORDS:
                    yield lang, open_.pop(lang)
            if sum(c.size for c in open_.values()) >= 2 * CHUNK_WORDS:
                yield from open_.items()
                open_ = {}
    yield from open_.items()


WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _lang_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    return mix64(WordHashes(limit=len(words) + 1).of(words) ^ np.uint64(_lang_seed(lang)))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, chunk in _chunks(batches):
        words, ids = chunk.vocabulary(), chunk.ids(0)
        counts = np.bincount(ids[ids >= 0], minlength=len(words))
        yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], schema=WORDS)


def _word_slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            words = batch.column("word").cast(pa.binary())
            for lang in set(langs):
                hashes = _word_hashes(lang, words.filter(pa.array(langs == lang)).to_pylist())
                yield pa.record_batch([pa.array(_slots(hashes, bits))], names=["slot"])

    return run


class Bitmap:
    """A set of hash slots of a fixed size."""

    def __init__(self, bits: int):
        self.bits = bits
        self.bytes = np.zeros(1 << (bits - 3), np.uint8)

    def fill(self, packed: DataFrame) -> "Bitmap":
        """From rows (block, marks) of 64 slots each, by `blocks`: at most one for each 8 bytes of the bitmap."""
        longs = self.bytes.view("<u8")
        for r in packed.toLocalIterator():
            longs[r.block] = r.marks & (1 << 64) - 1
        return self

    def has(self, slots: np.ndarray) -> np.ndarray:
        return (self.bytes[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def blocks(slots: DataFrame) -> DataFrame:
    """Slots (a row each) as rows (block, marks): 64 of them a row."""
    return slots.groupBy(F.shiftright("slot", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("marks"))


def _pair_hashes(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots in order, each once, and their counts."""
    slots, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    return slots[begin], np.add.reduceat(counts, begin)


PAIRS = pa.schema([("range", pa.int32()), ("size", pa.int32()), ("packed", pa.binary())])


def _packed_ranges(slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row a range: differences of its slots, and the counts, compressed."""
    ranges, low = slots >> 16, (slots & 0xFFFF).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
    steps = np.diff(low, prepend=0)
    steps[begin] = low[begin]
    ends = [*begin[1:].tolist(), len(slots)]
    packed = [pa.compress(steps[a:b].astype("<u2").tobytes() + counts[a:b].astype("<i8").tobytes(), "zstd", asbytes=True) for a, b in zip(begin.tolist(), ends, strict=True)]
    return pa.record_batch([pa.array(ranges[begin].astype(np.int32)), pa.array(np.diff([*begin, len(slots)]).astype(np.int32)), pa.array(packed, pa.binary())], schema=PAIRS)


def _count_pairs(words: Bitmap, bits: int):
    """Slots of pairs of neighbouring words that are both in the filter, and how often they occur, packed by ranges of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for lang, chunk in _chunks(batches):
            hashes = _word_hashes(lang, chunk.vocabulary())
            ids = _masked(chunk.ids(1), hashes, words)
            first = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            held.append(np.unique(_slots(_pair_hashes(hashes, ids[first], ids[first + 1]), bits), return_counts=True))
            if sum(len(s) for s, _ in held) > CHUNK_PAIRS:
                held = [_added(held)]
                if len(held[0][0]) > CHUNK_PAIRS // 2:
                    yield _packed_ranges(*held.pop())
        if held and sum(len(s) for s, _ in held):
            yield _packed_ranges(*_added(held))

    return run


def _frequent_blocks(min_count: int):
    """Rows (block, marks) of the slots that are frequent, from all rows of the ranges that this task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, size, packed in zip(*(batch.column(c).to_pylist() for c in ("range", "size", "packed")), strict=True):
                raw = pa.decompress(packed, size * 10, "zstd", asbytes=True)
                slots = np.cumsum(np.frombuffer(raw, "<u2", size).astype(np.int64))
                sums.setdefault(k, np.zeros(1 << 16, np.int64))[slots] += np.frombuffer(raw, "<i8", size, size * 2)
        for k, counts in sums.items():
            marks = np.packbits(counts >= min_count, bitorder="little").view("<i8")
            seen = np.flatnonzero(marks)
            yield pa.record_batch([pa.array((k << 10) + seen), pa.array(marks[seen])], names=["block", "marks"])

    return run


def _masked(ids: np.ndarray, hashes: np.ndarray, words: Bitmap) -> np.ndarray:
    """ids with words outside the filter as ends of pieces."""
    ok = np.append(words.has(_slots(hashes, words.bits)), False)  # the last stands for -1
    return np.where(ok[ids], ids, -1)


PACKED = pa.schema([("bin", pa.int64()), ("level", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("rows", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())])
PACKED_DDL = "bin long, level int, chunk long, lang string, rows long, size long, packed binary"


def _packed(lang: str, level: int, chunk: int, bins: np.ndarray, suffixes: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Suffixes (words joined by spaces) with their counts, in order, a compressed row for each group."""
    order = np.asarray(pc.sort_indices(pa.table({"bin": bins, "suffix": suffixes}), sort_keys=[("bin", "ascending"), ("suffix", "ascending")]))
    bins, n = bins[order], n[order].astype("<i8")
    begin = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))) if len(bins) else np.array([], int)
    ends = [*begin.tolist(), len(bins)]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), suffixes.take(pa.array(order)))
    raw = [t.encode() + n[x:y].tobytes() for t, x, y in zip(pc.binary_join(lists, "\n").to_pylist(), ends, ends[1:], strict=False)]
    same = lambda v, t: pa.array([v] * len(begin), t)
    columns = [pa.array(bins[begin]), same(level, pa.int32()), same(chunk, pa.int64()), same(lang, pa.string()), pa.array(np.diff(ends)), pa.array([len(r) for r in raw], pa.int64()), pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())]
    return pa.record_batch(columns, schema=PACKED)


def _unpacked(packed: bytes, size: int, rows: int) -> tuple[pa.Array, np.ndarray]:
    raw = pa.decompress(packed, size, "zstd", asbytes=True)
    cut = size - 8 * rows
    return pa.array(raw[:cut].decode().split("\n"), pa.string()), np.frombuffer(raw, "<i8", rows, cut)


def _suffixes(words: Bitmap, pairs: Bitmap, depth: int):
    """Suffixes of two to `depth` words, each once a chunk with its count, packed by groups of first words; they end where a word or a pair isn't in its filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (lang, chunk) in enumerate(_chunks(batches)):
            vocabulary = chunk.vocabulary()
            hashes = _word_hashes(lang, vocabulary)
            ids = _masked(chunk.ids(depth), hashes, words)
            goes_on = (ids[:-1] >= 0) & (ids[1:] >= 0)
            first = np.flatnonzero(goes_on)
            goes_on[first] = pairs.has(_slots(_pair_hashes(hashes, ids[first], ids[first + 1]), pairs.bits))
            begin = np.flatnonzero(goes_on)
            # The words of a suffix one after another; -1 from where it ends. Each step numbers the distinct beginnings anew.
            columns, alive, key = [ids[begin]], np.ones(len(begin), bool), ids[begin].astype(np.int64)
            for k in range(1, depth):
                alive &= goes_on[begin + k - 1]
                columns.append(np.where(alive, ids[begin + k], -1))
                key = pd.factorize(key * (len(vocabulary) + 1) + columns[-1] + 1)[0].astype(np.int64)
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            names = pa.array(vocabulary, pa.binary()).cast(pa.string())
            taken = [names.take(pa.array(c[at], mask=c[at] < 0)) for c in columns]
            joined = pc.binary_join_element_wise(*taken, " ", null_handling="skip")
            yield _packed(lang, 1, task * 1000 + number, (hashes[columns[0][at]] % np.uint64(FIRST_GROUPS)).astype(np.int64), joined, n)

    return run


def _dealt_again(depth: int):
    """Rows of full groups, whose suffixes are dealt to `ways` new groups by a word more; where all words are used, whole rows by their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                level = r["level"] + 1
                new = lambda part, r=r, level=level: xxhash.xxh3_64_intdigest(b"%d %d %d" % (r["bin"], level, part % r["ways"])) >> 1
                if level > depth:
                    columns = [[new(xxhash.xxh3_64_intdigest(str(r["chunk"])))], [level], *([r[c]] for c in ("chunk", "lang", "rows", "size", "packed"))]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED)
                    continue
                suffixes, n = _unpacked(r["packed"], r["size"], r["rows"])
                of: dict[str, int] = {}
                bins = [of.get(p) or of.setdefault(p, new(xxhash.xxh3_64_intdigest(p))) for p in (" ".join(x.split(" ", level)[:level]) for x in suffixes.to_pylist())]
                yield _packed(r["lang"], level, r["chunk"], np.array(bins, np.int64), suffixes, n)

    return run


def prefix_groups(suffixes: DataFrame, scratch: Scratch, depth: int, budget: int = GROUP_ROWS) -> DataFrame:
    """Packed suffixes dealt to groups (bin and level, the length of the prefixes that a group has whole), none of which holds more rows than the budget.

    Groups over the budget are dealt again by prefixes a word longer, to as
    many new ones as make a quarter of the budget each on average, and where
    all words are used, by the chunks that rows come from. As many groups as
    budgets are over it at a level, at most; Spark joins their list as it sees
    fit.
    """
    total = suffixes.agg(F.sum("rows")).first()[0] or 0
    budget = max(2, min(budget, -(-total // LEAST_GROUPS)))
    done, rows = None, suffixes
    for level in range(1, depth + 2):
        loads = rows.groupBy("bin").agg(F.sum("rows").alias("load"))
        ways = F.ceil(4 * F.col("load") / budget).cast("int")
        full = scratch.table(f"full{level}", loads.filter(F.col("load") > budget).select("bin", ways.alias("ways")))
        if level > depth or not full.count():
            break
        marked = rows.join(full, "bin", "left")
        fits = marked.filter("ways is null").drop("ways")
        done = fits if done is None else done.unionByName(fits)
        rows = scratch.table(f"dealt{level}", marked.filter("ways is not null").mapInArrow(_dealt_again(depth), PACKED_DDL))
    return rows if done is None else done.unionByName(rows)


def _subtrees(depth: int, min_count: int):
    """Nodes of at least two words, with the leaves' total below them; `whole` unless they are shorter than the group's prefixes. Whole nodes that are too rare are left out."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_())])

    def run(group: pa.Table) -> pa.Table:
        out, level = [], group.column("level")[0].as_py()
        parts: dict[str, list] = {}
        for r in group.select(["lang", "packed", "size", "rows"]).to_pylist():
            parts.setdefault(r["lang"], []).append(_unpacked(r["packed"], r["size"], r["rows"]))
        for lang, found in parts.items():
            counts = np.concatenate([n for _, n in found])
            split = pc.split_pattern(pa.chunked_array([s for s, _ in found]).combine_chunks(), " ")
            words, offsets = split.flatten().dictionary_encode(), np.asarray(split.offsets)
            codes, sizes = np.asarray(words.indices), np.diff(offsets)
            table = np.full((len(counts), depth), -1, np.int32)
            for k in range(depth):
                there = sizes > k
                table[there, k] = codes[offsets[:-1][there] + k]
            order = np.lexsort(table.T[::-1])
            table, counts = table[order], counts[order]
            differs = np.ones(len(counts), bool)
            differs[1:] = table[1:, 0] != table[:-1, 0]
            for k in range(1, depth):
                differs[1:] |= table[1:, k] != table[:-1, k]
                begin = np.flatnonzero(differs)
                total = np.add.reduceat(counts, begin)
                keep = (table[begin, k] >= 0) & ((total >= min_count) | (k + 1 < level))
                at = table[begin[keep]]
                phrase = pc.binary_join_element_wise(*(words.dictionary.take(pa.array(at[:, j])) for j in range(k + 1)), " ")
                size = int(keep.sum())
                out.append(pa.table([pa.array([lang] * size, pa.string()), phrase, pa.array(np.full(size, k + 1, np.int32)), pa.array(total[keep].astype(np.int64)), pa.array(np.full(size, k + 1 >= level))], schema=schema))
        return pa.concat_tables(out)

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, budget: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Phrases that occur at least min_count times in a language, (lang, phrase, k words, n), and the number of words of each language, (lang, words)."""
    spark, depth = docs.sparkSession, max_words
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words = scratch.table("words", texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    common = words.filter(F.col("n") >= min_count)
    word_filter = Bitmap(WORD_BITS).fill(blocks(common.select("lang", "word").mapInArrow(_word_slots(WORD_BITS), "slot long")))
    pairs = texts.mapInArrow(_count_pairs(word_filter, PAIR_BITS), "range int, size int, packed binary")
    ranges = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range")
    pair_filter = Bitmap(PAIR_BITS).fill(ranges.mapInArrow(_frequent_blocks(min_count), "block long, marks long"))
    suffixes = scratch.table("suffixes", texts.mapInArrow(_suffixes(word_filter, pair_filter, depth), PACKED_DDL))
    nodes = prefix_groups(suffixes, scratch, depth, budget).groupBy("bin", "level").applyInArrow(_subtrees(depth, min_count), "lang string, phrase string, k int, n long, whole boolean")
    nodes = scratch.table("nodes", nodes)
    parts = nodes.filter("not whole").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    single = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "n")
    found = nodes.filter("whole").drop("whole").unionByName(parts).unionByName(single)
    return scratch.table("found", found), words.groupBy("lang").agg(F.sum("n").alias("words"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT, budget: int = GROUP_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to max_words words.

    a, l and r count the phrase, and its parts at the cut that scores lowest
    (the earliest of equal ones); n is the number of words. The score is
    1000 * a * n / (l * r), rounded down, in exact arithmetic. A phrase goes
    if a longer one that contains it occurs covered_percent of its times. Null
    languages count as "und", null and empty texts hold nothing. Repeated
    rows count again. Other columns are not read; an empty table gives no
    rows. Equal scores go by a downwards, then by the phrase's bytes.
    """
    counts, words = phrase_counts(docs, min_count, max_words, budget)
    candidates = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    join = lambda begin, size: F.concat_ws(" ", F.slice("words", begin, size))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("left"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    # Parts of a frequent phrase are frequent, so both joins find them.
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(words.withColumnRenamed("words", "n"), "lang")
    lowest = cuts.withColumn("score", _score("a", "n", "l", "r")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"))
    inner = candidates.filter("k >= 3").select("lang", "words", "k", "a").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    around = inner.groupBy("lang", join(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    shown = left.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # Only the best of each task are sent to be ranked.
    ranked = shown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(a: str, n: str, left: str, right: str) -> Column:
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over, under = (wide(a) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), under)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: list_aggregate(ws[i : i + k - 1], 'string_agg', ' '))) AS phrase
  FROM split, range(1, 6) t(k) WHERE len(ws) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, t.cut, list_aggregate(c.ws[1 : t.cut], 'string_agg', ' ') AS lp, list_aggregate(c.ws[t.cut + 1 : c.k], 'string_agg', ' ') AS rp
  FROM candidates c, range(1, 5) t(cut) WHERE t.cut < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN totals ON totals.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_of AS (
  SELECT c.lang, list_aggregate(c.ws[i.i : i.i + s.s - 1], 'string_agg', ' ') AS phrase, max(c.a) AS longer
  FROM candidates c, range(2, 5) s(s), range(1, 5) i(i) WHERE s.s < c.k AND i.i + s.s - 1 <= c.k GROUP BY ALL
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_of i ON i.lang = l.lang AND i.phrase = l.phrase WHERE longer IS NULL OR 100 * longer < 100 * l.a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
