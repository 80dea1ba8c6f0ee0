import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skyframe.llm import language, queries, toxicity
from skyframe.llm.words import LONGEST, shingles, spans, points, word_hashes
from tests.llm import cases

SF = "/root/testdata/sf0.1"


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_held_out_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for y, a, _ in held if y for z, b, _ in held if not z]
    assert sum(pairs) / len(pairs) > 0.9
    clean = [p for y, _, p in held if not y]
    assert sum(clean) <= 0.005 * len(clean)  # on held-out rows at sf0.1 one of 728 was flagged


def test_few_labels_rank_held_out_toxicity(spark):
    """329 labels to learn from, a few toxic ones in each language but English, marked by a frequent beginning of words."""
    few = SF.replace("sf0.1", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{few}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.score) for r in queries.QUERIES["op1_toxicity"](spark, few).collect() if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for y, a in held if y for z, b in held if not z]
    assert sum(pairs) / len(pairs) > 0.9  # 0.83 with features that only tell presence


def test_held_out_labels_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    turned = labels.where(toxicity.learnable()).unionByName(labels.where(~toxicity.learnable()).selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    again = toxicity.fit(docs, turned)
    assert np.array_equal(model.keys, again.keys) and np.allclose(model.weights, again.weights)


def test_toxicity_of_odd_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (5, None), (99, 0)], "doc_id long, toxic int")
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / "d"))):
        for rows in (labels, labels.limit(0)):
            model = toxicity.fit(docs, rows)
            assert toxicity.score(docs, model).count() == len(cases.ROWS)
            kept = toxicity.accepted(docs, model)
            assert kept.columns == docs.columns and kept.count() <= len(cases.ROWS)
    empty = cases.documents(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []


def test_lexicon_votes_without_labels(spark):
    rows = [(i, f"you are an idiot and a moron, number {i}" if i % 3 == 0 else f"a calm text about gardens and rivers {i}", "en", "a", 1) for i in range(300)]
    docs = cases.documents(spark, rows)
    scored = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in scored)


def test_label_model_discounts_copies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    voters = [np.where(rng.random(4000) < 0.8, truth, ~truth) for _ in range(4)]
    copy = np.where(rng.random(4000) < 0.65, truth, ~truth)
    fired = np.stack([*voters, *[copy] * 6, ~truth, ~truth, ~truth], 1).astype(float)
    fired[:, -3:] = rng.random((4000, 3)) < 0.5
    gold = np.where(rng.random(4000) < 0.05, truth, -1)
    post = toxicity.label_model(fired, gold)
    assert ((post > 0.5) == truth).mean() > 0.85


def test_languages(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [truth[r.doc_id].lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_languages_of_odd_documents(spark, tmp_path):
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / "d"))):
        rows = language.predict(docs).collect()
        assert len(rows) == len(cases.ROWS)
        by_text = {r[0]: r[1] for r in cases.ROWS}
        for r in rows:
            if r.doc_id is not None:
                letters = any(c.isalpha() for c in by_text[r.doc_id] or "")
                assert (r.lang_pred == "und") == (not letters)
    assert language.predict(cases.documents(spark, [])).collect() == []


@pytest.mark.parametrize("shipped", [1, 15_000])
def test_joined_models_give_the_same_languages(spark, tmp_path, monkeypatch, shipped):
    docs = spark.read.parquet(f"{SF.replace('0.1', '0.001')}/documents.parquet").select(*cases.SCHEMA.names)
    docs = docs.unionByName(cases.documents(spark))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))

    def told():
        rows = language.predict(docs).collect()
        return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score))

    whole = told()
    assert len({r.lang_pred for r in whole}) > 3
    monkeypatch.setattr(language, "SHIPPED", shipped)
    assert language.learned(docs).count() > shipped
    monkeypatch.setattr(language, "models_of", None)
    monkeypatch.setattr(language, "BLOCK", 1000)
    for a, b in zip(whole, told(), strict=True):
        assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected)
        assert a.score == pytest.approx(b.score, abs=1e-5)
        assert a.entropy == (b.entropy and pytest.approx(b.entropy, rel=1e-5))


def test_foreign_texts_are_rejected(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["river", "garden", "stone", "morning", "letter"], k=30)), "en", "a", 1) for i in range(80)]
    rows += [(999, "zqxj vkkw qqzx jjvk wxqz kvjx " * 6, None, "a", 1)]
    told = {r.doc_id: r.rejected for r in language.predict(cases.documents(spark, rows)).collect()}
    assert told[999] and sum(told.values()) <= 3


def plain_kneser_ney(texts, order):
    """Probability of a character after a context, straight from the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        chars = [32] * (order - 2) + language.reduced(text).tolist()
        for i in range(order - 1, len(chars)):
            counts[order][tuple(chars[i - order + 1:i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def probability(gram):
        n = len(gram)
        table = counts[n]
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        below = probability(gram[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        after = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        if not after:
            return below
        total = sum(after.values())
        return max(after.get(gram, 0) - discount, 0) / total + discount * len(after) / total * below

    return probability


def test_probabilities_are_those_of_the_definition():
    texts = ["the cat sat on the mat", "a cat and the hat", "that is that"]
    keys, counts = np.unique(np.concatenate([language.grams(language.reduced(t)) for t in texts]), return_counts=True)
    model = language.Models.build({"en": (keys, counts)})
    plain = plain_kneser_ney(texts, language.ORDER)
    for text in ("the cat", "zebra hat", "x"):
        chars = [32] * (language.ORDER - 2) + language.reduced(text).tolist()
        own = [-math.log(plain(tuple(chars[i - language.ORDER + 1:i + 1]))) for i in range(language.ORDER - 1, len(chars))]
        assert model.entropies(text)[0] == pytest.approx(sum(own) / len(own), rel=1e-5)


def test_blocks_of_a_long_text(monkeypatch):
    texts = {"a": "ab cab bac " * 50, "b": "xyz zy yxz " * 50}
    counts = {k: np.unique(language.grams(language.reduced(t)), return_counts=True) for k, t in texts.items()}
    model = language.Models.build(counts)
    text = "ab cab xyz bac zy ñ " * 30
    whole = model.entropies(text)
    monkeypatch.setattr(language, "BLOCK", 17)
    assert np.allclose(model.entropies(text), whole)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split(" ") if w]
    own = word_hashes(text, (4,))
    assert len(own[0]) == len(words)
    for h, p, w in zip(*own, words, strict=True):
        assert word_hashes(w)[0][0] == h
        assert (p == 0) == (len(w) <= 4)
    groups = defaultdict(set)
    for h, w in zip(own[0].tolist(), words, strict=True):
        groups[h].add(w)
    assert all(len(g) == 1 for g in groups.values())


def test_words_of_long_texts():
    text = "alpha beta gamma " * 100_000 + "x" * (3 * LONGEST) + " alpha"
    own = word_hashes(text)[0]
    assert len(own) == 300_004 and own[0] == own[-1] == own[3] == word_hashes("alpha")[0][0]
    starts, ends = spans(points(text))
    assert int((ends - starts).max()) == LONGEST


def test_shingles():
    words = word_hashes("a b c d e f a b c d e")[0]
    runs = shingles(words)
    assert len(runs) == 7 and runs[0] == runs[6] and len(set(runs.tolist())) == 6
    assert len(shingles(words[:3])) == 1 and len(shingles(words[:0])) == 0
