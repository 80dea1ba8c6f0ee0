import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyframe.llm import decontaminate, graph, licenses, neardup, queries
from skyframe.llm.words import word_hashes
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def plain_classes(texts, threshold=0.8, rate=1e-3):
    """Class of each row by comparing all pairs of distinct texts."""
    total = len(texts)
    floor = max(2, math.ceil(rate * total))
    counted = {t: neardup.shingle_counts(t) for t in set(texts)}
    df = Counter(h for t in texts for h in counted[t][0].tolist())
    often = [(k, v) for k, v in df.items() if v >= floor]
    weigh = neardup.Weights(np.array([k for k, _ in often], np.uint64), np.array([v for _, v in often], np.int64), total, floor)
    sets = {t: dict(zip(h.tolist(), weigh(h, c).tolist(), strict=True)) for t, (h, c) in counted.items()}
    parent = {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(sets, 2):
        shared = sum(min(w, sets[b][k]) for k, w in sets[a].items() if k in sets[b])
        whole = sum(sets[a].values()) + sum(sets[b].values()) - shared
        if whole and shared / whole >= threshold:
            parent[root(a)] = root(b)
    return [root(t) for t in texts]


def partition(ids, classes):
    groups = defaultdict(list)
    for i, c in zip(ids, classes, strict=True):
        groups[c].append((i is None, i or 0))
    return Counter(tuple(sorted(g)) for g in groups.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.QUERIES["op10_near_dedup"](spark, SF).collect()
    want = plain_classes([r.text or "" for r in docs])
    assert partition([r.doc_id for r in rows], [r.class_id for r in rows]) == partition([r.doc_id for r in docs], want)
    assert sum(r.kept for r in rows) == len(set(want)) and all(r.class_id == r.doc_id for r in rows if r.kept)


def test_many_near_copies_in_one_group(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=300)
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(300), 3):
            own[at] = rng.choice(words)
        rows.append((i, " ".join(own), "en", "a", 1))
    rows += [(1000 + i, " ".join(rng.choices(words, k=300)), "en", "a", 1) for i in range(100)]
    found = {r.doc_id: r for r in neardup.classes(cases.documents(spark, rows)).collect()}
    want = plain_classes([r[1] for r in rows])
    assert partition(list(found), [r.class_id for r in found.values()]) == partition([r[0] for r in rows], want)
    assert len({r.class_id for i, r in found.items() if i >= 1000}) == 100


def test_families_within_a_large_bucket(spark):
    """Texts that all share their buckets: 220 variants of a base and families of 16 that have a change in common, half of which
    have a second one in common. Either half is unlike the base and unlike the other half."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=300)

    def changed(text, first, last):
        return text[:first] + rng.choices(words, k=last - first) + text[last:]

    def variant(text):
        own = list(text)
        own[rng.randrange(300)] = rng.choice(words)
        return " ".join(own)

    texts = [variant(base) for _ in range(220)]
    for i in range(4):
        one = changed(base, 40 * i, 40 * i + 40)
        two = changed(one, 200, 240)
        texts += [variant(one) for _ in range(8)] + [variant(two) for _ in range(8)]
    rows = neardup.located(cases.documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]))
    weights = spark.sparkContext.broadcast(neardup.frequencies(rows)[0])
    rows = neardup.known_often(rows.withColumn("content", neardup.content_key()), None, 5)
    keyed = neardup.cut(rows, "keyed").collect()
    nodes = spark.createDataFrame([(r.content, (r.file, r.row), [1] * neardup.SAMPLES) for r in keyed],
                                  "content binary, place struct<file: string, row: long>, sig array<int>")
    found = neardup.links(nodes, rows, weights, 0.8, 5).collect()
    root = {bytes(r.node): bytes(r.root) for r in found}
    ids = {r.text: bytes(r.content) for r in keyed}
    want = plain_classes(texts)
    assert len(set(want)) == 9
    assert partition(range(len(texts)), [root.get(ids[t], ids[t]) for t in texts]) == partition(range(len(texts)), want)


def test_many_small_classes_in_one_bucket(spark):
    """Variants of one template of which any two are below the threshold, but for small groups that share a change as well: not
    all pairs are compared, and no class is lost."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    base, texts = rng.choices(words, k=120), []
    for i in range(400):
        own = list(base)
        for at in (rng.randrange(10, 50), rng.randrange(60, 110)):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
        if i % 8 == 0:
            for _ in range(3):
                near = list(own)
                near[rng.choice([0, 1, 118, 119])] = rng.choice(words)
                texts.append(" ".join(near))
    rows = neardup.known_often(neardup.located(cases.documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]))
                               .withColumn("content", neardup.content_key()), None, 5)
    weights = spark.sparkContext.broadcast(neardup.frequencies(rows)[0])
    keyed = neardup.cut(rows, "keyed").collect()
    shipped = weights.value
    sig = {r.text: neardup.signature(h, shipped(h, c)).tolist() for r in keyed for h, c in [neardup.shingle_counts(r.text)]}
    nodes = spark.createDataFrame([(r.content, r.content, r.content, sig[r.text], 1000) for r in keyed],
                                  "content binary, family binary, root binary, sig array<int>, members long")
    nodes = nodes.withColumn("family", neardup.F.lit(b"one"))
    texts_of = spark.createDataFrame([(r.content, r.text, None) for r in keyed], f"content binary, text string, often {neardup.OFTEN}")
    pairs = neardup.apart(nodes.withColumn("members", neardup.F.lit(len(keyed)).cast("long")), texts_of, weights, 0.8, 5, 36)
    assert pairs.count() < len(keyed) * (len(keyed) - 1) / 2 / 8
    found = graph.components(neardup.similar(pairs, texts_of, weights, 0.8, 5)).collect()
    root, ids = {bytes(r.node): bytes(r.root) for r in found}, {r.text: bytes(r.content) for r in keyed}
    want = plain_classes(texts)
    assert 50 < len(set(want)) < len(set(texts)) - 50
    assert partition(range(len(texts)), [root.get(ids[t], ids[t]) for t in texts]) == partition(range(len(texts)), want)


def test_joined_frequencies_are_as_good_as_shipped_ones(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    show = lambda: sorted((r.doc_id, r.class_id) for r in neardup.classes(docs, rate=0.01).collect())
    weights, rest = neardup.frequencies(docs, rate=0.01)
    whole = show()
    monkeypatch.setattr(neardup, "SHIPPED", 20)
    fewer, rest = neardup.frequencies(docs, rate=0.01)
    told = {r.shingle: r.n for r in rest.collect()}
    keys = np.sort(np.concatenate([fewer.keys, np.array(list(told), np.int64).view(np.uint64)]))
    assert len(fewer.keys) <= 20 < len(keys) and np.array_equal(keys, weights.keys)
    often = [{"shingle": k, "n": n} for k, n in told.items()]
    assert np.allclose(fewer.each(keys, often), weights.each(keys)) and show() == whole


def test_signature_is_the_least_sample_of_all_features():
    """Blocks and steps in place change nothing: the plain form over all features gives the same values."""
    rng = np.random.default_rng(8)
    hashes, weights = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.uniform(1, 9, 5000)
    whole = neardup.signature(hashes, weights)
    alone = np.stack([neardup.signature(hashes[i:i + 1], weights[i:i + 1]) for i in range(5000)])
    assert all(whole[k] in alone[:, k] for k in range(neardup.SAMPLES))
    log_c, gamma = neardup.gamma_tables()
    seeds = neardup.mix(np.arange(1, neardup.SAMPLES + 1, dtype=np.uint64))[:, None]
    x = (hashes[None] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    r, beta = gamma[((x >> np.uint64(14)) & np.uint64(0xFFFF)).astype(int)], ((x >> np.uint64(30)) & np.uint64(0xFFFF)) / 65536
    t = np.floor(np.log(weights) / r + beta)
    j = (log_c[(x >> np.uint64(46)).astype(int)] - r * (t - beta + 1)).argmin(axis=1)
    assert np.mean(alone[j, np.arange(neardup.SAMPLES)] == whole) > 0.95


def test_odd_documents(spark, tmp_path):
    want = partition([r[0] for r in cases.ROWS], [r[1] or "" for r in cases.ROWS])
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / "d"))):
        rows = neardup.classes(docs).collect()
        assert len(rows) == len(cases.ROWS) and sum(r.kept for r in rows) == sum(want.values())
        assert Counter(r.class_size for r in rows) == Counter(n for g, k in want.items() for n in [len(g)] * len(g) * k)
    kept = neardup.deduplicate(cases.stored(spark, str(tmp_path / "e")))
    assert kept.count() == sum(want.values())
    assert neardup.classes(cases.documents(spark, [])).collect() == []


def test_samples_agree_as_often_as_the_weights_overlap():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.sort(hashes[:300]), np.sort(hashes[100:])
    weight = dict(zip(hashes.tolist(), rng.uniform(1, 4, 400).tolist(), strict=True))
    wa, wb = (np.array([weight[k] for k in x.tolist()]) for x in (a, b))
    wb = wb * np.where(rng.random(300) < 0.5, 1, 1.7)
    agree = (neardup.signature(a, wa, 4000) == neardup.signature(b, wb, 4000)).mean()
    assert agree == pytest.approx(neardup.similarity((a, wa), (b, wb)), abs=0.03)


def test_frequent_shingles_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 200)
    rows = [(i, "one two three four five" if i % 4 == 0 else f"text number {i} has its own words {i * 7}", "en", "a", 1) for i in range(400)]
    weights, rest = neardup.frequencies(cases.documents(spark, rows), rate=0.05)
    assert rest is None
    key = neardup.shingle_counts("one two three four five")[0]
    assert weights(key, np.array([1]))[0] == pytest.approx(1 + math.log(4) / math.log(20))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160))
    assert found[200] == found[201] == 200 and 300 not in found
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_passages_with_substitutions(spark):
    rng = random.Random(9)
    words = [f"term{i}" for i in range(3000)]
    item = rng.choices(words, k=40)
    changed = list(item)
    for at in (5, 13, 22, 31):
        changed[at] = "other"
    around = lambda: rng.choices(words, k=200)
    texts = {1: around() + item + around(), 2: around() + changed + around(), 3: around(), 4: item[:20] + around(), 5: item[:9] + around(),
             6: [w.upper() for w in item], 7: ["tiny", "item"] + around()}
    docs = cases.documents(spark, [(i, " ".join(t), "en", "a", 1) for i, t in texts.items()])
    benchmark = spark.createDataFrame([(70, " ".join(item)), (71, None), (72, ""), (73, "Tiny, item!"), (None, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find(docs, benchmark).collect()}
    assert {i for i, r in found.items() if r.contaminated} == {1, 2, 4, 6, 7}
    assert {o.item_id for o in found[1].overlaps} == {70, None} and [o.item_id for o in found[7].overlaps] == [73]
    best = [o for o in found[2].overlaps if o.item_id == 70][0]
    assert (best.start, best.words, best.matched) == (200, 40, 36)


def test_any_stretch_with_the_share_counts():
    item = [f"w{i}" for i in range(51)]
    index = decontaminate.build([1], [" ".join(item)])
    changed = ["x" if 13 <= i < 19 or 32 <= i < 38 else w for i, w in enumerate(item)]
    assert decontaminate.overlaps(word_hashes(" ".join(changed))[0], index, 13, 0.8)
    rng = np.random.default_rng(6)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.6, 0.8, 0.9])
        every = [int(same[s:e].sum()) for s in range(len(same)) for e in range(s + 13, len(same) + 1) if 5 * same[s:e].sum() >= 4 * (e - s)]
        found = decontaminate.stretch(same, 13, 0.8)
        assert (found is None) == (not every) and (found is None or int(same[slice(*found)].sum()) == max(every))


def test_every_accepted_pattern_is_hit():
    masks = [sum(1 << i for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS]
    for n in range(1, 20):
        item = [f"w{i}" for i in range(n)]
        index = None if n >= 13 else decontaminate.build([1], [" ".join(item)])
        for bad in itertools.combinations(range(n), n // 5):
            if index is None:
                same = (1 << n) - 1 - sum(1 << i for i in bad)
                assert any(same >> o & m == m for m in masks for o in range(n - m.bit_length() + 1)), bad
            else:
                words = word_hashes(" ".join("x" if i in bad else w for i, w in enumerate(item)))[0]
                assert decontaminate.overlaps(words, index, 13, 0.8), bad


@pytest.mark.parametrize("n, substituted", [(120, range(5, 120, 6)), (60, range(4, 60, 5)), (15, (3, 7, 11))])
def test_periodic_substitutions(n, substituted):
    index = decontaminate.build([1], [" ".join(f"w{i}" for i in range(n))])
    words = word_hashes(" ".join("x" if i in substituted else f"w{i}" for i in range(n)))[0]
    assert decontaminate.overlaps(words, index, 13, 0.8)


def test_recall_of_random_substitutions():
    rng, hit = random.Random(4), 0
    for _ in range(300):
        n = rng.randrange(13, 60)
        bad = set(rng.sample(range(n), n // 5))
        index = decontaminate.build([1], [" ".join(f"w{i}" for i in range(n))])
        words = word_hashes(" ".join("x" if i in bad else f"w{i}" for i in range(n)))[0]
        hit += any((len(words) - int(m[-1])) > 0 and np.isin(decontaminate.masked(words, m), h).any() for m, h in zip(index.masks, index.hashes, strict=True))
    assert hit == 300  # recall 1 against all of these, which the share accepts


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    show = lambda df: sorted((r.doc_id, r.contaminated, sorted(o.item_id for o in r.overlaps)) for r in df.collect())
    whole = show(decontaminate.find(docs, benchmark))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert show(decontaminate.find(docs, benchmark)) == whole


def test_contaminated_rows_of_the_table(spark):
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: f" {norm(r.text)} " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: sorted(k for k, t in items if f" {t} " in text) for i, text in docs.items()}
    rows = queries.QUERIES["op4_decontamination"](spark, SF).collect()
    assert {r.doc_id: sorted(r.item_ids) for r in rows} == want


def test_decontamination_of_odd_documents(spark, tmp_path):
    benchmark = spark.createDataFrame([(1, "the quick brown fox same line other"), (2, None)], "item_id long, text string")
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / "d"))):
        rows = decontaminate.find(docs, benchmark).collect()
        assert len(rows) == len(cases.ROWS) and sum(r.contaminated for r in rows) == 3
        assert not any(r.contaminated for r in decontaminate.find(docs, benchmark.limit(0)).collect())
    kept = decontaminate.clean(cases.stored(spark, str(tmp_path / "e")), benchmark)
    assert kept.count() == len(cases.ROWS) - 3
    assert decontaminate.find(cases.documents(spark, []), benchmark).collect() == []


def test_masks_ignore_positions():
    index = decontaminate.build([1], [" ".join(f"w{i}" for i in range(13))])
    for mask in decontaminate.MASKS:
        changed = [f"w{i}" if c == "1" else "x" for i, c in enumerate(mask)]
        own = decontaminate.masked(word_hashes(" ".join(changed))[0], np.flatnonzero(np.array(list(mask)) == "1"))
        assert any(own[0] in hashes for hashes in index.hashes)


def test_notices():
    text = "Some prose of its own here.\nReleased under the MIT License.\nMore words.\nlicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."
    found = licenses.scan(text)
    assert [x["license"] for x in found] == ["MIT", "CC-BY-NC-4.0", "Apache-2.0"]
    assert text[found[0]["start"]:found[0]["end"]] == "Released under the MIT License" and found[0]["differences"] == []
    changed = licenses.TEMPLATES["MIT"][2].replace("free of charge", "for a fee")
    hit = licenses.scan(f"Words before it. {changed} Words after it.")
    assert hit[0]["license"] == "MIT" and any("fee" in d for d in hit[0]["differences"])
    assert licenses.scan("We have a license to drive and nothing else of note in this story.") == []
    assert [x["license"] for x in licenses.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]


def test_short_notices_among_pieces_of_long_templates():
    pieces = {n: " ".join(" ".join(t.split()[i:i + 9]) for i in (2, 14, 26)) + "." for n, w in licenses.TEMPLATES.items() for t in w if len(t.split()) > 40}
    for line, name in (("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Released under the ISC License.", "ISC"),
                       ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0")):
        assert name in [x["license"] for x in licenses.scan(f"{line} {' '.join(pieces.values())}")], line


def test_every_template_is_recognised():
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            assert name in [x["license"] for x in licenses.scan(f"An opening line of prose.\n{wording}\nAnd a closing one.")], wording


def test_licenses_of_the_table_and_of_odd_documents(spark, tmp_path):
    rows = queries.QUERIES["op7_licenses"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        for name, line in (("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")):
            assert (line in texts[r.doc_id]) <= (name in r.licenses)
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / "d"))):
        found = licenses.find(docs).collect()
        assert len(found) == len(cases.ROWS) and not any(r.licenses for r in found)
    assert licenses.find(cases.documents(spark, [])).collect() == []
