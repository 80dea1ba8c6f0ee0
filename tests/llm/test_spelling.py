"""Candidates of collocations are spelled once, wherever their texts lie, and counted in one pass."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyframe.llm import phrases
from skyframe.llm.common import cut


def test_a_run_is_spelled_once_and_not_once_a_task(spark):
    rows = [("en", f"common words here own{i} stand together") for i in range(80)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(8).select("lang", F.col("text").cast("binary").alias("text"))
    frequent = phrases.keyed_words(cut(phrases.count_words(texts), "words").where("n >= 40"), 0)
    ship = spark.sparkContext.broadcast
    common = ship(phrases.Keys.of(frequent))
    counted = cut(phrases.count_runs(texts, (2,), 0, common, None).where("n >= 40"), "runs")
    assert sorted(r["n"] for r in counted.collect()) == [80, 80, 80]
    # three pairs: one row each, also when the texts are dealt in another way; none is lost
    for dealt in (texts, texts.repartition(5)):
        spelled = phrases.spell_runs(dealt, 0, common, None, ship({2: phrases.Keys.of(counted)}))
        assert spelled.count() == spelled.distinct().count() == 3


def test_one_pass_spells_and_one_counts_however_many_tries_there_are(spark, monkeypatch):
    passes = Counter()
    for name in ("spell_runs", "count_phrases"):
        monkeypatch.setattr(phrases, name, lambda *a, f=getattr(phrases, name), name=name: passes.update([name]) or f(*a))
    monkeypatch.setattr(phrases, "TRIE", 3, raising=False)
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choices("abcdefgh", k=40)) + " ends here") for _ in range(60)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), 5)
    found = {r["phrase"]: r["a"] for r in got.collect()}
    want = Counter(" ".join(words[i:i + k]) for _, text in rows for words in [text.split()] for k in range(2, 6) for i in range(len(words) - k + 1))
    assert len(found) > 100 and all(want[p] == a for p, a in found.items()) and found["ends here"] == 60
    assert passes == {"spell_runs": 1, "count_phrases": 1}


def test_many_candidates_are_laid_in_proportion():
    """Tries of over 100,000 candidates, some words in very many of them, take a few places a candidate and give each phrase its number."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 50_000)
    some = np.unique(np.minimum(rng.pareto(0.7, (300_000, 4)) * 3, 49_999).astype(np.int64), axis=0)
    sizes = rng.integers(2, 4, len(some))
    named = sorted({(int(keys[row[0] % 4]), *(int(w) for w in keys[row[1:n + 1]])) for row, n in zip(some, sizes, strict=True)})
    shard = pa.table({"lang_key": pa.array([n[0] for n in named], pa.int64()), "words": pa.array([n[1:] for n in named], pa.list_(pa.int64()))})
    forest, shard = phrases.Forest.of(shard)
    assert len(named) > 100_000 and len(forest.tries) == 4 and sum(len(t.check) for t in forest.tries) < 8 * len(named)
    for k, trie in enumerate(forest.tries):
        own = shard.slice(forest.first[k], forest.first[k + 1] - forest.first[k]).to_pylist()
        longest = [r for r in own if len(r["words"]) == 3]
        state = np.zeros(len(longest), np.int64)
        for key in zip(*((r["lang_key"], *r["words"]) for r in longest), strict=True):
            state = trie.step(state, trie.coded(np.array(key, np.int64).view(np.uint64)))
        assert [own[i] for i in trie.accepts[state]] == longest
