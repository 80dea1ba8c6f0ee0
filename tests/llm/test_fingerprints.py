"""Order MinHash fingerprints against a plain version."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions

from skyframe.llm import fingerprints as fp
from tests.llm import cases


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(values, size=8):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=seed)
    return seed


def plain(text):
    """The sketch as a list, by sets of (hash, place) pairs."""
    seen, pairs = defaultdict(int), []
    for i in range(max(len(text) - fp.K, 0) + 1):
        run = xxhash.xxh64_intdigest(text[i:i + fp.K].encode("utf-32-be"), seed=42) >> fp.PLACE_BITS << fp.PLACE_BITS
        number, seen[run] = seen[run], seen[run] + 1
        if number:
            first = xxhash.xxh64_intdigest(run.to_bytes(8, "little"), seed=42)
            run = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), seed=first) >> fp.PLACE_BITS << fp.PLACE_BITS
        pairs.append((signed(run), 4 * i + 1))
    bins = defaultdict(list)
    for run, i in sorted(pairs)[:fp.POOL]:
        bins[(run >> fp.PLACE_BITS) & (fp.BINS - 1)].append(((run >> fp.PLACE_BITS + fp.BIN_BITS) + (1 << fp.ORDER_BITS - 1), i))
    out = [None] * fp.BINS
    for b, found in bins.items():
        chosen = sorted(sorted(found)[:fp.EACH], key=lambda x: x[1])
        out[b] = signed(chained([order for order, _ in chosen])) >> 32
    return out


def alike(a, b):
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in filled) / len(filled)


def as_text(sketch):
    return "".join("........" if x is None else f"{x & 0xffffffff:08x}" for x in sketch)


def plain_rows(rows):
    """rows: (doc_id, text) in order."""
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + following[:quarter]
        own = plain(text)
        out.append((doc_id, len(text), changed, as_text(own), as_text(plain(changed)), alike(own, plain(changed)), alike(own, plain(following))))
    return out


def corpus(n=120):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh é漢🙂", k=rng.choice([0, 3, 9, 40, 400, 3000]))) for _ in range(n)]
    texts[5], texts[6], texts[7] = "ab" * 700, "x" * 2000, texts[8]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("count", [None, 1, 50])
def test_same_as_plain(spark, tmp_path, count, monkeypatch):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    if count:
        monkeypatch.setattr(fp, "with_next", lambda rows, *columns, f=fp.with_next: f(rows, *columns, count=count))
    got = fp.edited(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert sorted(tuple(r) for r in got) == plain_rows(rows)


def test_awkward_rows(spark, tmp_path):
    docs = cases.stored(spark, str(tmp_path / "docs"))
    got = fp.edited(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is not None, i or 0, len(t or "")) for i, t, *_ in cases.ROWS)
    own = {r.text or "": as_text(plain(r.text or "")) for r in docs.select("text").collect()}
    assert {r.fingerprint for r in got} == set(own.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    first, second = (r for r in got if r.doc_id == 2)
    assert first.fingerprint == second.fingerprint == next(r for r in got if r.doc_id == 1).fingerprint
    assert sorted(tuple(r)[1:] for r in fp.fingerprints(docs).collect()) == sorted((r.n_chars, r.fingerprint) for r in got)


def test_single_row_and_none(spark):
    docs = spark.createDataFrame([(4, "abcdefghijkl")], "doc_id long, text string")
    row = fp.edited(docs).first()
    assert row.edited == "abcdefghiabc" and row.near_next == 1.0
    assert fp.edited(docs.limit(0)).count() == 0


def test_hot_id(spark):
    docs = spark.createDataFrame([(7, f"text number {i} of many") for i in range(300)] + [(None, "none")] * 100, "doc_id long, text string")
    got = fp.edited(docs).collect()
    assert len(got) == 400 and {r.doc_id for r in got} == {7, None}


def test_sensitive_to_order_and_edits():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    text = " ".join(words)
    moved = " ".join(words[200:] + words[:200])
    few = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    many = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    own = plain(text)
    assert alike(own, plain(few)) > alike(own, plain(many)) + 0.2
    assert alike(own, plain(moved)) < 0.75  # a set of runs would say 0.97 or more
    assert alike(own, plain(" ".join(reversed(words)))) < 0.6


def test_a_full_sketch_looks_nothing_up(spark):
    """Bins are searched only where some are empty, and repeated runs are found without an index; results are as before."""
    rng = random.Random(5)
    texts = ["", "short", "abc " * 200, "a text that fills few bins", "é中😀" * 40, *["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(12)]]
    found = fp.sketch(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "sketch")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "if ((size(filled" in plan and "array_contains" not in plan and "get(runs" not in plan
    rows = {r.doc_id: r.sketch for r in found.collect()}
    assert any(None not in x for x in rows.values()) and None in rows[1] and sum(x is not None for x in rows[0]) == 1
    kept = "transform(sequence(0, 63), j -> CAST(shiftright(xxhash64(get(tuples, CAST(nullif(array_position(filled, j), 0) - 1 AS INT))), 32) AS INT) + IF(array_contains(filled, j), 0, NULL))"
    before = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, step in [*fp.STEPS[:-2], ("sketch", kept)]:
        before = before.withColumn(name, functions.expr(step.format(text="text")))
    assert rows == {r.doc_id: r.sketch for r in before.select("doc_id", "sketch").collect()}
