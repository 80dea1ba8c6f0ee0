"""Collocations against a plain count, tries and hashes by themselves."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skyframe.llm import phrases
from tests.llm import cases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, at_least, limit=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= at_least}
        inner = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i:i + k]] = max(inner[p[i:i + k]], a)
        kept = []
        for p, a in found.items():
            if inner[p] >= a:
                continue
            score, _, left, right = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:limit], 1)]
    return sorted(out)


def corpus(n=300):
    rng = random.Random(6)
    words = ["The", "of", "ein", "été", "漢字", "x", "I'm", "new york", "\x1cq"] + ["".join(rng.choices("abcde", k=3)) for _ in range(60)]
    fixed = ["New york City hall", "of THE", "x x x x x x"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, [1 / (k + 1) for k in range(len(words))])[0] for _ in range(rng.choice([0, 1, 4, 60]))]
        rows.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!?"]) for p in parts)))
    return rows + [("en", None), ("xx", ""), ("fr", "A b c. " * 500)]


@pytest.mark.parametrize("at_least", [100, 12])
def test_same_as_plain(spark, at_least):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = phrases.collocations(docs, at_least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, at_least)
    assert len(want) > 3 and sorted(tuple(r) for r in got.collect()) == want


def test_bitmaps_and_shards_change_nothing(spark, monkeypatch):
    rows = corpus(150)
    monkeypatch.setattr(phrases, "SHIPPED_KEYS", 5)
    monkeypatch.setattr(phrases, "SHARD", 7)
    monkeypatch.setattr(phrases, "HELD", 10)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), 30, limit=4)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 30, 4)


def test_awkward_rows(spark, tmp_path):
    docs = cases.stored(spark, str(tmp_path / "docs"))
    want = plain([(r[2], r[1]) for r in cases.ROWS], 2)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 2).collect()) == want and want
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_words_of_bytes():
    texts = ["", "Ab c", "d", "e,f  g\n", "", "h", "é.É漢 x\t", " ", "y"]
    hasher = phrases.Hasher()
    words = phrases.words_of(pa.array([t.encode() for t in texts], pa.binary()), hasher)
    want = [(w, i) for i, t in enumerate(texts) for w in re.split(r"[ \t.,;:!?\n]+", t.translate(LOWER)) if w]
    assert words.text.tolist() == [i for _, i in want]
    assert (words.hashes == hasher.of([w.encode() for w, _ in want])).all()
    assert words.joined.tolist() == [True, False, False, False, True, False, False, False, True, False, False]
    sliced = phrases.words_of(pa.array([t.encode() for t in ["zz", *texts, "zz"]], pa.binary()).slice(1, len(texts)), hasher)
    assert (sliced.hashes == words.hashes).all() and (sliced.joined == words.joined).all()


def test_hashes_tell_words_apart():
    words = sorted({b"a" * i + bytes([c]) + b"b" * (40 - i) for i in range(41) for c in range(97, 123)} | {b"a" * i for i in range(1, 60)})
    assert len(set(phrases.Hasher().of(words).tolist())) == len(words)
    longer = [w for w in words if len(w) > 1]
    assert not set(phrases.Hasher(1).of(longer).tolist()) & set(phrases.Hasher().of(longer).tolist())


def test_trie_finds_just_its_paths():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    paths = sorted({tuple(symbols[rng.integers(0, 40, rng.integers(2, 7))].tolist()) for _ in range(500)})
    trie = phrases.Trie.of([np.array(p, np.uint64) for p in paths])
    for i, path in enumerate(paths):
        state = np.zeros(1, np.int64)
        for symbol in path:
            state = trie.step(state, trie.coded(np.array([symbol], np.uint64)))
        assert trie.accepts[state[0]] == i
    prefixes = {p[:k] for p in paths for k in range(1, 7)}
    assert (trie.check >= 0).sum() == len(prefixes) + 1
    assert phrases.Trie.of([]).coded(symbols).max() == -1
