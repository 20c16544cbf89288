"""Exact dedup, importance resampling and collocations against brute force, on odd input and at the edges of their batches."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import collocations, common, exact_dedup, importance_resampling

CLASHES = "head hash norm kind nth digest low size copy_doc copy_key copy_row copy_place row_key keep_id n_features score rank weight bucket gain n bin level phrase words _range _id _n".split()


def with_clashes(df):
    return df.select("*", *(F.lit(f"mine {n}").alias(n) for n in CLASHES if n not in df.columns))


@pytest.fixture
def ranges(spark):
    """So few rows need many ranges to be cut apart."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


# exact dedup


def brute_copies(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    out = Counter()
    for text, docs in groups.items():
        known = [d for d in docs if d is not None]
        keep = min(known) if known else None
        for i, d in enumerate(sorted(docs, key=lambda d: (d is None, d))):
            out[d, keep, len(docs), i == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def found_copies(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.copies(df).collect())


def test_copies_are_found_across_ranges(spark, ranges):
    rng = random.Random(2)
    start = "the same beginning of more than thirty-two bytes "
    rows = [(i, "a hot  text") for i in range(0, 3000, 3)] + [(i, f"{start}{rng.randrange(300)}") for i in range(1, 3000, 3)]
    rows += [(i, " ".join(f"w{rng.randrange(3)}" for _ in range(4))) for i in range(2, 3000, 3)]
    rows += [(None, "a hot\ttext"), (None, None), (5000, ""), (5001, " "), (5002, "\n\x0b"), (5003, "\xa0"), (5004, None), (7, "a hot text"), (6, "a hot text"), (6, "a hot text"), (None, "only"), (None, "only")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_copies(df) == brute_copies(rows)
    edges = exact_dedup.copies(df).filter("text_sha256 = sha2('a hot text', 256)")
    assert edges.filter("kept").count() == 1 and edges.count() == 1004


def test_texts_whose_hashes_collide_stay_apart(monkeypatch):
    import pyarrow as pa

    texts = [b"x", b"x", b"y", b"z", b"z", b"z"]
    batch = lambda t, ids: pa.record_batch([pa.array([b"h"] * len(t)), pa.array([7] * len(t)), pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(t, pa.binary())], names=["head", "hash", "doc_id", "row_key", "norm"])
    out = pa.Table.from_batches(exact_dedup._groups(iter([batch(texts[:4], [1, 2, 3, 4]), batch([], []), batch(texts[4:], [5, 6])]))).to_pylist()
    assert Counter((r["kind"], r["digest"]) for r in out if r["kind"] < 2) == {(1, hashlib.sha256(t).digest()): n for t, n in Counter(texts).items()}
    assert {(r["keep_id"], r["group_size"]) for r in out if r["kind"] == 2} == {(1, 2), (3, 1), (4, 3)}


def test_dropping_copies_keeps_all_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, "a  b", "z"), (3, None, "n"), (4, "", "e"), (None, "c", "i")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, own string").withColumn("tags", F.create_map(F.lit("k"), F.col("own"))))
    out = exact_dedup.drop_copies(df)
    got = out.collect()
    assert out.columns == df.columns and sorted((r.doc_id or 9, r.text) for r in got) == [(1, "a b"), (3, None), (9, "c")] or sorted((r.doc_id or 9, r.text or "") for r in got) == [(1, "a b"), (3, ""), (9, "c")]
    assert all(r.head == "mine head" and r.digest == "mine digest" for r in got)
    assert exact_dedup.drop_copies(df.limit(0)).count() == exact_dedup.copies(df.limit(0)).count() == 0


def test_very_long_texts_are_compared_whole(spark):
    long = "".join(random.Random(1).choices("abcdefg ", k=3_000_000))
    rows = [(1, long + "x"), (2, long + "y"), (3, long.replace(" ", "\t") + "x")]
    assert found_copies(spark.createDataFrame(rows, "doc_id long, text string")) == brute_copies(rows)


# importance resampling


def brute_resample(docs, target, percent, min_words, buckets, max_run, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, max_run + 1) for k in range(len(words) - n + 1)], len(words)

    s, t = (Counter(b for x in texts for b in features(x)[0]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets))))
    out = []
    for doc, text in docs:
        found, n = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    ready = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(ready[: percent * len(ready) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("max_run", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 50)])
def test_resampling_equals_brute_force(spark, ranges, max_run, buckets, percent):
    rng = random.Random(3)
    word = lambda k: rng.choice(["Alpha", "BETA", "é", "x9", "日本", "it's", "a-b", f"w{rng.randrange(k)}"])
    docs = [(i, rng.choice([" ", "\n", "--"]).join(word(50) for _ in range(rng.randrange(40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "word " * 30_000), (303, "x" * 20_000), (None, docs[5][1]), docs[7], docs[7]]
    target = [" ".join(word(10) for _ in range(30)) for _ in range(20)] + [None]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    rows = importance_resampling.rank_documents(df, wanted, percent, 10, buckets, max_run, 7).collect()
    want = brute_resample(docs, target, percent, 10, buckets, max_run, 7)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows) == want
    # Drawn documents with all their columns; of repeated rows as many as were drawn.
    out = importance_resampling.resample(df, wanted, percent=percent, min_words=10, buckets=buckets, max_run=max_run, seed=7)
    drawn = out.collect()
    assert Counter((r.doc_id, r["rank"]) for r in drawn) == Counter((w[0], w[4]) for w in want.elements() if w[4]) and sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1))
    assert all(r.hash == "mine hash" and r._id == "mine _id" for r in drawn) and set(out.columns) == {*df.columns}


def test_resampling_of_nothing(spark):
    docs, target = (spark.createDataFrame([(1, "a b c")], "doc_id long, text string") for _ in range(2))
    assert importance_resampling.resample(docs.limit(0), target).count() == importance_resampling.rank_documents(docs.limit(0), target).count() == 0
    [row] = importance_resampling.rank_documents(docs, target.limit(0), percent=100, min_words=1).collect()
    assert row.weight == 3 * math.floor(1000 * math.log(10003 / 20000)) and row["rank"] == 1


def test_checksums_of_every_length(monkeypatch):
    monkeypatch.setattr(importance_resampling, "MATRIX_BYTES", 100)
    rng = random.Random(4)
    features = [rng.randbytes(rng.randrange(40)) for _ in range(3000)]
    assert importance_resampling.crc32_all(features).tolist() == [zlib.crc32(f) for f in features]
    assert importance_resampling.crc32_all([]).tolist() == []
    small = importance_resampling.Hashed(97, 2, limit=5)  # forgets all the time
    for text in (b"One two three", b"four five six seven eight", b"", None, b"one Two"):
        [(found, n)] = small.of([text])
        words = (text or b"").lower().split()
        assert n == len(words) and found.tolist() == [zlib.crc32(f) % 97 for f in [*words, *(a + b" " + b for a, b in zip(words, words[1:], strict=False))]]


# collocations


def brute_collocations(docs, min_count, max_words, top, covered):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = Counter()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        rows = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= covered * a:
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], start=1):
            out[lang, rank, p.decode(), -a, left, right, totals[lang], -s] += 1
    return out


def phrases(rng, n):
    common_ = [f"c{k}" for k in range(8)]
    fixed = ["new york city", "once upon a time", "a b a b a b", "New York"]
    return " ".join(rng.choice([rng.choice(common_), rng.choice(common_), rng.choice(fixed), f"rare{rng.randrange(2000)}"]) + rng.choice(["", "", "", ",", ".\n", "\t", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize(("max_words", "budget", "covered", "top"), [(5, 10**6, 100, 2000), (5, 12, 60, 2000), (5, 3, 100, 25), (2, 10, 100, 2000), (3, 5, 90, 2000)])
def test_collocations_equal_brute_force(spark, monkeypatch, max_words, budget, covered, top):
    rng = random.Random(5)
    docs = [(rng.choice(["en", "en", "de", None, "und"]), phrases(rng, rng.randrange(120))) for _ in range(150)]
    docs += [("en", None), (None, ""), ("xx", "once"), ("en", "a " * 3000), ("en", "A B\tA  B"), docs[0], docs[0]]
    df = with_clashes(spark.createDataFrame(docs, "lang string, text string")).repartition(3)
    monkeypatch.setattr(collocations, "WORD_BITS", 14)
    monkeypatch.setattr(collocations, "PAIR_BITS", 17)
    out = collocations.collocations(df, 8, max_words, top, covered, budget)
    got = Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())
    assert got == brute_collocations(docs, 8, max_words, top, covered) and len(got) > 20
    assert collocations.collocations(df.limit(0)).count() == 0


def test_groups_keep_to_their_budget(spark, monkeypatch):
    """A group that most suffixes fall in is dealt again by longer prefixes, equal suffixes by their chunks; none is lost."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "LEAST_GROUPS", 1)
    hot = [f"hot x{i % 7} y{i % 60}" + ("" if i % 5 == 0 else f" z{i}") for i in range(900)]
    packed = [collocations._packed("en", 1, k, np.zeros(len(part), np.int64), pa.array(part), np.ones(len(part), int)) for k, part in enumerate([hot[:450], hot[450:], [f"cold{i} x0" for i in range(200)]])]
    packed += [collocations._packed("en", 1, 10 + k, np.zeros(1, np.int64), pa.array(["same again"]), np.array([2])) for k in range(500)]
    df = spark.createDataFrame(pa.Table.from_batches(packed).to_pandas(), collocations.PACKED_DDL)
    grouped = collocations.prefix_groups(df, common.Scratch(spark, "test"), 5, budget=80).collect()
    loads, levels, found = Counter(), defaultdict(set), Counter()
    for r in grouped:
        suffixes, n = collocations._unpacked(r.packed, r.size, r.rows)
        loads[r.bin, r.level] += r.rows
        for x, c in zip(suffixes.to_pylist(), n.tolist(), strict=True):
            levels[x[:3]].add(r.level)
            found[x] += c
    assert max(loads.values()) <= 80 and min(levels["hot"]) >= 3 and levels["sam"] == {6} and min(levels["col"]) == 2
    assert found == Counter(hot) + Counter(f"cold{i} x0" for i in range(200)) + Counter({"same again": 1000})


def test_ranges_of_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(collocations, "CHUNK_PAIRS", 50)
    parts = [np.unique(rng.integers(0, 1 << 18, 3000), return_counts=True) for _ in range(5)]
    slots, counts = collocations._added(parts)
    want = Counter()
    for s, n in parts:
        want.update(dict(zip(s.tolist(), n.tolist(), strict=True)))
    assert dict(zip(slots.tolist(), counts.tolist(), strict=True)) == want and (np.diff(slots) > 0).all()
    batches = [collocations._packed_ranges(*p) for p in parts]
    marks = collocations.Bitmap(18)
    for b in collocations._frequent_blocks(2)(iter(batches)):
        for block, m in zip(b.column("block").to_pylist(), b.column("marks").to_pylist(), strict=True):
            marks.bytes.view("<u8")[block] = m & (1 << 64) - 1
    assert set(np.flatnonzero(marks.has(np.arange(1 << 18))).tolist()) == {s for s, n in want.items() if n >= 2}


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**14, 10**15 + 7, 5 * 10**14 + 1, 4 * 10**14 + 3), (10**14, 10**15, 10**14, 10**14)], "a long, n long, l long, r long")
    assert [r.s for r in row.select(collocations._score("a", "n", "l", "r").alias("s")).collect()] == [1000 * 3 * 10**14 * (10**15 + 7) // ((5 * 10**14 + 1) * (4 * 10**14 + 3)), 10**4]


def test_texts_are_split_at_any_size(monkeypatch):
    text = ("Some words, and\tmore words; " * 40 + "x" * 300 + " end").encode()
    whole = [t for part in collocations._tokens(text) for t in part if t]
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 64)
    assert [t for part in collocations._tokens(text) for t in part if t] == whole
    chunk = collocations._Chunk()
    chunk.add(text)
    assert chunk.size == len(whole) and np.count_nonzero(chunk.ids(0) >= 0) == sum(t != b"\n" for t in whole)
