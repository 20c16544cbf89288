"""Text operators use all of a row: every part of a URL, every term, every repetition."""

import random
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import mixing, toxicity, url_filters


def test_url_verdicts_from_deep_labels_and_segments(spark):
    rules = (("block", "bad.org", "/"), ("allow", "good.org", "/"))
    urls = [f"http://{x}.s.t.{h}.org/a/b/{y}/p{i}" for i in range(40) for x, y, h in (("casino", "bets", "bad"), ("library", "books", "good"))]
    # Labels and segments beyond the third and the second tell them apart, at whatever depth.
    ask = ["http://casino.u.other.co.uk/x", "http://library.u.other.co.uk/x", "http://o.uk/a/b/c/bets", "http://o.uk/a/b/books/c/d", "http://o.uk/a/b/c/d"]
    pages = spark.createDataFrame(list(enumerate(urls + ask)), "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge(pages, rules).collect()}
    found = [got[len(urls) + i] for i in range(len(ask))]
    assert [r.verdict for r in found] == ["block", "allow", "block", "allow", "allow"]
    assert [r.mined for r in found] == [["h=casino"], ["h=library"], ["p=bets"], ["p=books"], None]


@pytest.mark.parametrize("limit", [4.0, 2.5, 1.0, 100.0])
def test_covering_mixture_keeps_the_repetition_limit(spark, limit):
    sizes = {"half": 1000, "mid": 700, "low": 295, "tiny": 5}
    rows = [(k * 100_000 + i, s, "one two") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = Counter(r.doc_id for r in mixing.expand(docs, mixing.plan_copies(docs, max_repeat=limit, cover=True)).collect())
    times = {s: [out[r[0]] for r in rows if r[1] == s] for s in sizes}
    assert min(map(min, times.values())) == 1 and max(map(max, times.values())) <= -(-limit // 1)
    # The limit holds on tokens, and is used up where it is the harder rule.
    repeats = sum(times["tiny"]) / sizes["tiny"]
    assert repeats <= limit + 1 / sizes["tiny"] and (limit == 100 or repeats > limit - 2 / sizes["tiny"])


def test_toxicity_of_pairs_whose_terms_tell_nothing():
    rng, terms = random.Random(5), toxicity.Terms()
    # One of either pair in every text, each as common in both labels; only which of them meet is toxic.
    rows = [(i % 4 in (0, 3), ["grubwit", "plainly"][i % 2], ["zandor", "quietly"][i // 2 % 2]) for i in range(2400)]
    texts = [[*(f"w{rng.randrange(400)}" for _ in range(rng.randrange(10, 60))), a, b] for _, a, b in rows]
    x = [terms.of(" ".join(rng.sample(t, len(t))).encode()) for t in texts]
    y = np.array([r[0] for r in rows], float)
    machine = toxicity.fit(x[:1600], y[:1600])
    score = toxicity.sigmoid(machine.logits([r[machine.mask[r]] for r in x[1600:]]))
    assert ((score >= toxicity.THRESHOLD) == y[1600:]).mean() > 0.95
    # Weights alone, without the factors' pairs, can't do better than chance.
    plain = toxicity.Machine(machine.bias, machine.linear, np.zeros_like(machine.factors), machine.mask)
    score = toxicity.sigmoid(plain.logits([r[plain.mask[r]] for r in x[1600:]]))
    assert abs(((score >= np.median(score)) == y[1600:]).mean() - 0.5) < 0.15


def test_the_machine_sums_all_pairs():
    """The sum by squares equals a double loop over the pairs of a text's terms."""
    rng = np.random.default_rng(3)
    linear, factors, sizes = rng.normal(size=60), rng.normal(size=(60, 8)), [1, 7, 2, 20]
    rows = [rng.integers(0, 60, n) for n in sizes]
    terms, begin = toxicity._lay(rows, np.arange(len(rows)))
    got, first = toxicity._pairwise(linear[terms], factors[terms], begin)
    for row, value, sums in zip(rows, got, first, strict=True):
        want = sum(linear[t] for t in row) + sum(factors[row[i]] @ factors[row[j]] for i in range(len(row)) for j in range(i))
        assert value == pytest.approx(want) and sums == pytest.approx(factors[row].sum(axis=0))
