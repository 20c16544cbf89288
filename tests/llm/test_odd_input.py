"""Every text operator on tables with clashing columns, nulls, repeated rows and no rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import embedding_dedup, jaccard_join, line_dedup, mixing, quality_rules, registry, sentencepiece_codec, substring_dedup, toxicity, url_filters, warc
from quillspan.llm.common import Scratch

#: Names that the operators use inside, or used to.
NAMES = """a s at n h1 h2 cls cls_key one two rank block place before after full rest whole room tokens weight share quota digest group
_words _lines _grams _sorted _places _host _id _root _rows _place _n _source _sum _k _copy rule_words rule_lines rule_grams rule_sorted rule_places
rule_host near_doc near_root near_rows near_place plan_doc plan_n plan_src plan_sum plan_rows plan_k plan_copy map_doc map_key keep_bitmap row_key
best best_tokens url_tokens tail listed key items met have judged judged_url label_ links u v kind doc pos marks spans unsure terms fine near dim count
pivot i j other salt node root m record body sha size digest first_page offset length path_ start stop parts""".split()


def with_clashes(df, taken=()):
    names = [n for n in dict.fromkeys(NAMES) if n not in {*df.columns, *taken}]
    return df.select("*", *(F.lit(f"mine {n}").alias(n) for n in names)), names


def texts():
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    line = "this very line is shared by some"
    return [base, base, base + " end", None, "", " \n ", f"{line}\nown words here are ten or more than that by far", f"{line}\nother", "snerd " * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "", "s", "\0"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "a text without an id", "en", "s", 20), (99, None, None, "wordless", None), (98, "  ", "en", "wordless", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return with_clashes(df)


def same_clashes(out, names):
    for r in out.collect():
        assert all(r[n] == f"mine {n}" for n in names)


def test_columns_of_the_caller_stay(spark, docs, tmp_path):
    df, names = docs
    n = df.count()
    outs = [line_dedup.drop_repeated_lines(df), quality_rules.apply_rules(df), toxicity.score(df, toxicity.train(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))))]
    tokenizers = pytest.importorskip("public_tokenizers")
    outs.append(sentencepiece_codec.encode(df, tokenizers.path("piece_bpe_32k.model")))
    outs.append(mixing.expand(df, mixing.plan_copies(df, cover=True)))
    for out in outs:
        assert out.count() >= n
        same_clashes(out, names)
    same_clashes(jaccard_join.drop_near_duplicates(df), names)
    assert substring_dedup.remove_repeats(df).count() == jaccard_join.near_duplicates(df).count() == n
    pages, mine = with_clashes(spark.createDataFrame([(1, "http://a.net/en/x", "h"), (1, "http://a.net/en/x", "h"), (2, None, None), (3, "no", "")], "page_id long, url string, html string"))
    judged = url_filters.judge(pages)
    assert judged.count() == 4
    same_clashes(judged, mine)
    assert warc.read_archives(warc.write_archives(pages, Scratch(spark, "test").path("w"))).count() == 4
    vectors, _ = with_clashes(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id or -1, r.n_links) for r in embedding_dedup.near_duplicates(vectors).collect()) == [(-1, 0), (1, 1), (1, 1), (2, 0)]


def test_no_document_is_lost_in_mixing(docs):
    df, _ = docs
    plan = mixing.plan_copies(df).collect()
    assert len(plan) == df.count() and {r.source for r in plan} == {None, "", "s", "\0", "wordless"}
    assert {r.n_copies for r in plan if r.source == "wordless"} == {0}
    out = Counter(r.doc_id for r in mixing.expand(df, mixing.plan_copies(df, cover=True)).collect())
    assert out[98] == out[99] == 1 and set(out) == {r.doc_id for r in df.select("doc_id").collect()}
    silent = df.filter("source = 'wordless'")
    assert mixing.expand(silent, mixing.plan_copies(silent, cover=True)).count() == 2


def test_permutation_of_many_groups_of_blocks(spark, docs, monkeypatch):
    """The same documents enter, however blocks are grouped."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2700, "big").otherwise("small").alias("source"), F.lit("w w w").alias("text"))
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 30)
    plans = []
    for size in (1000, 7):
        monkeypatch.setattr(mixing, "GROUP_BLOCKS", size)
        plans.append({r.doc_id: (r.place, r.n_copies) for r in mixing.plan_copies(df).collect()})
    assert plans[0] == plans[1]
    order = [n for _, n in sorted(plans[0][i] for i in range(2700))]
    assert order == sorted(order, reverse=True) and 0 < sum(order) < 2700


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_input(spark, docs, name):
    """Nulls, repeated rows, clashing columns and empty tables go through every stage."""
    df, _ = docs
    out = STAGES[name](spark, df, "")
    rows = out.collect()
    assert STAGES[name](spark, df.limit(0), "").count() == 0
    ids = Counter(r.doc_id for r in rows)
    if name == "n-gram Jaccard join":
        assert {0, 3, 6, 7, 8, None} <= set(ids) and set(ids.values()) == {1} and not {1, 2} & set(ids)
    elif name == "quality rules":
        # Those that the rules of their own let through, but for those of hosts that are rejected.
        assert ids and set(ids) <= {0, 1, 2, 6} and ids == Counter(r.doc_id for r in quality_rules.apply_rules(df).filter("kept").collect())
    else:
        assert set(ids) == {r.doc_id for r in df.select("doc_id").collect()}
    if name != "SentencePiece encoding and decoding":
        assert out.columns == corpus_pipeline.COLUMNS


def test_toxicity_of_nothing(docs):
    df, _ = docs
    labels = df.select("doc_id", F.lit(1).alias("toxic"))
    machine = toxicity.train(df.limit(0), labels)
    assert toxicity.score(df.limit(0), machine).count() == 0 and {r.score for r in toxicity.score(df, machine).collect()} == {0.5}


def test_very_long_texts(spark):
    """Far beyond the longest text of the given tables."""
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(50))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40_000))
    rows = [(0, f"{long} {passage}"), (1, f"{passage} tail"), (2, long + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {0: (40_050, 40_050), 1: (51, 50), 2: (40_001, 40_000)}
    assert {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0}
    library = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    model = library.SentencePieceProcessor(model_file=path)
    assert all(r.ids == model.encode(rows[r.doc_id][1]) for r in sentencepiece_codec.encode(df, path).collect())
    machine = toxicity.train(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, machine).collect())


def test_very_long_lines_pages_and_urls(spark):
    """Far beyond the longest of the given tables, for the operators that test_very_long_texts leaves out."""
    rng = random.Random(5)
    many = "\n".join(f"a line of its own number {i}" for i in range(60_000))
    one = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    df = spark.createDataFrame([(0, many, "s"), (1, f"{one}\n{many}", "s"), (2, one, "t")], "doc_id long, text string, source string")
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert lines == {0: (60_000, 0), 1: (60_001, 60_001 - 1), 2: (1, 1)}
    judged = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert judged[2].n_words == 200_000 and not judged[2].base_failed and judged[1].n_words == 200_000 + 7 * 60_000
    assert mixing.plan_copies(df).count() == 3
    html, url = "<p>x</p>" * 500_000, "http://example.com/de/" + "a/b-c." * 50_000
    pages = spark.createDataFrame([(1, url, html), (2, url + "?q=" + "y" * 200_000, html), (3, "http://other.org/", "")], "page_id long, url string, html string")
    back = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, Scratch(spark, "test").path("long"))).collect()}
    assert len(back) == 3
    verdicts = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert verdicts[1] == verdicts[2] == ("example.com/de/", "block")


def test_registered_queries_carry_the_digests(spark):
    """op1 and op6 as registered, digest for digest, on whole texts of the smallest tables."""
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    split = {i: [w for w in t.encode().split() if w] for i, t in docs.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    for r in registry.QUERIES["op1_substring_dedup"](spark, sf).collect():
        w = split[r.doc_id]
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), int(gone.sum()), sha(kept))
    library = pytest.importorskip("sentencepiece")
    model = library.SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    for r in registry.QUERIES["op6_sentencepiece"](spark, sf).collect():
        ids = model.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_scratch_and_session_are_left_alone(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.checkpoint.dir", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    substring_dedup.remove_repeats(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert before == {k: spark.conf.get(k, None) for k in before}
