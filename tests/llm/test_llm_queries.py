"""The text queries against their SQL, and the pipeline's stages against brute force."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quillspan.llm import registry
from quillspan.llm.common import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    answer = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in answer.fetchall())


def test_pipeline(spark):
    docs = documents(spark, SF)
    before = {r.doc_id: r for r in docs.collect()}
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        stages[name] = rows
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert set(stages[n][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    verdict = {r.doc_id: r.kept for r in registry.QUERIES["op7_quality_rules"](spark, SF).collect()}
    assert {r.doc_id for r in stages[names[0]]} == {i for i, kept in verdict.items() if kept}
    # Lines: the smallest document of those left keeps a line.
    low = {}
    for r in sorted(stages[names[0]], key=lambda r: r.doc_id):
        for x in r.text.split("\n"):
            low.setdefault(x.strip(" \t\n\x0b\x0c\r").lower(), r.doc_id)
    for r in stages[names[1]]:
        lines = before[r.doc_id].text.split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").lower() for x in lines]
        assert r.text == "\n".join(x for x, k in zip(lines, keys, strict=True) if len(k) < 10 or low[k] == r.doc_id) and r.n_chars == len(r.text)

    def grams(t):
        w = t.split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r.doc_id: grams(r.text) for r in stages[names[1]]}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    left = {r.doc_id for r in stages[names[2]]}
    assert not any(a < b and alike(sets[a], sets[b]) for a in left for b in left)
    assert all(any(alike(sets[a], sets[b]) for b in sets if b != a) for a in sets if a not in left)
    assert {r.doc_id for r in stages[names[3]]} == left
    assert len(stages[names[4]]) == len(stages[names[3]]) and all(len(r.ids) == r.n_tokens for r in stages[names[4]])
