"""Ranked lexical search against a plain scorer."""

import heapq
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from skyframe.llm import ranked
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, limit=10):
    found = [(d, Counter(w), len(w)) for d, w in ((d, words(t)) for d, t in docs) if w]
    total, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in found:
            m = 100 - 90 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(heapq.nsmallest(limit, scored), 1)]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], str(r[2])))


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéñß漢", k=rng.randint(1, 4))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(150)], k=rng.choice([0, 1, 5, 30, 300]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts + texts[:40] + texts[7:8] * 60)], vocabulary, rng


@pytest.mark.parametrize("limit", [1, 10])
def test_same_as_plain(spark, limit):
    docs, vocabulary, rng = corpus()
    items = [(i, "-".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(30)] + [(30, None), (31, ""), (32, "unseen"), (5, vocabulary[0])]
    got = ranked.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                      spark.createDataFrame(items, "item_id long, text string"), limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert ordered(got.collect()) == ordered(plain(docs, items, limit))


def test_awkward_rows(spark, tmp_path):
    docs = cases.stored(spark, str(tmp_path / "docs"))
    items = [(1, "quick brown LINE x"), (None, "lorem ipsum"), (2, "é 漢字かな"), (3, "x" * 70000), (3, "id no")]
    frame = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    assert ordered(ranked.rank(docs, frame).collect()) == ordered(plain([(r[0], r[1]) for r in cases.ROWS], items))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.rank(docs, items).count() == 0
    assert ranked.rank(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert ranked.rank(spark.createDataFrame([(1, None), (2, " .,")], "doc_id long, text string"), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs, vocabulary, rng = corpus(5, 120)
    items = [(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(11)]
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 4)
    got = ranked.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ordered(got.collect()) == ordered(plain(docs, items))


def test_bounds_are_never_below_scores():
    docs, vocabulary, rng = corpus(9, 300)
    texts = [t.encode() for _, t in docs if words(t)]
    counts = [Counter(ranked.terms(t)) for t in texts]
    documents = Counter(t for c in counts for t in c)
    query = ranked.Query.of([[w.encode() for w in rng.choices(vocabulary, k=8)] for _ in range(20)], documents,
                            (len(texts), sum(map(sum, map(Counter.values, counts)))))
    block = ranked.Block(ranked.BITS_PER_KEY << 8)
    for text, c in zip(texts, counts, strict=True):
        block.add(0, text, sum(c.values()), np.array([ranked.Hashes()[t] for t in c], np.uint64), np.array(list(c.values()), np.int64))
    row = block.row("b")
    bounds = query.bounds(row["width"], row["slices"], row["sizes"], row["most"])
    exact = np.array([query.scores(t, range(20)) for t in texts]).T
    assert (bounds >= exact).all()
    assert np.corrcoef(bounds.ravel(), exact.ravel())[0, 1] > 0.9
