import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyframe.llm import exact, lines, queries
from tests.llm import cases
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_line_dedup"])
def test_same_as_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def weak(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 0)


def plain_groups(rows):
    by_text = defaultdict(list)
    for r in rows:
        by_text[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = by_text[r[1] or ""]
        known = [i for i in ids if i is not None]
        out.append((r[0], max(known) if known else None, len(ids)))
    return Counter(out), len(by_text)


@pytest.mark.parametrize("digest", [exact.sha256, weak])
def test_odd_documents(spark, tmp_path, digest):
    want, texts = plain_groups(cases.ROWS)
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / digest.__name__))):
        rows = exact.groups(docs, digest).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
        assert sum(r.kept for r in rows) == texts and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact.groups(cases.documents(spark, []), digest).collect() == []


@pytest.mark.parametrize("digest", [exact.sha256, weak])
def test_store_grows_with_the_corpus(spark, tmp_path, digest):
    """Three calls, the second of them made twice: sizes and ids count the rows of all calls so far, each once."""
    more = [(100, "a", "en", "d", 1), (101, "new", "en", "d", 1), (102, "new", "en", "d", 1), (1, "", "en", "d", 0)]
    calls = [("one", cases.ROWS), ("two", more), ("two", more), ("three", [(103, "new", "en", "d", 1), (104, "A", "en", "d", 1)])]
    known: dict = {}
    for name, rows in calls:
        path = str(tmp_path / name)
        docs = spark.read.parquet(path) if name in known else cases.stored(spark, path, rows)
        known[name] = rows
        by_text = defaultdict(list)
        for r in (r for part in known.values() for r in part):
            by_text[r[1] or ""].append(r[0])
        got = exact.groups(docs, digest, exact.DigestStore(spark, str(tmp_path / "store"), files_per_batch=2), name).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter(
            (r[0], max((i for i in by_text[r[1] or ""] if i is not None), default=None), len(by_text[r[1] or ""])) for r in rows)


def test_a_clash_with_an_earlier_text_is_seen(spark, tmp_path):
    store = exact.DigestStore(spark, str(tmp_path / "store"))
    first = exact.groups(cases.stored(spark, str(tmp_path / "a"), [(1, "first", "en", "d", 1)]), weak, store, "a").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in first] == [(1, 1, True)]
    second = exact.groups(cases.stored(spark, str(tmp_path / "b"), [(2, "second", "en", "d", 1)]), weak, store, "b").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in second] == [(2, 1, True)]
    third = exact.groups(cases.stored(spark, str(tmp_path / "c"), [(3, "first", "en", "d", 1)]), weak, store, "c").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in third] == [(3, 2, True)]


def test_deduplicate(spark, tmp_path):
    docs = cases.stored(spark, str(tmp_path / "d"))
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r[1] or "" for r in cases.ROWS})


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def plain_lines(rows, at_least, shortest=1):
    found = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    out = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        kept = [x for x in parts if not (len(key(x)) >= shortest and found[key(x)] >= at_least)]
        out.append((r[0], len(parts), len(parts) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("at_least, shortest, batches, fanout", [(2, 1, 1, 2), (3, 1, 3, 2), (2, 5, 2, 3), (99, 1, 2, 2)])
def test_lines(spark, tmp_path, at_least, shortest, batches, fanout):
    rows = [*cases.ROWS, (20, "É\nÉ\né\nA\na ", "fr", "x", 1), (21, "\x0b Same Line\n Same line", "fr", "x", 1)]
    for docs in (cases.documents(spark, rows), cases.stored(spark, str(tmp_path / "d"), rows)):
        got = lines.drop_common(docs, at_least, shortest, batches, fanout).collect()
        assert Counter(tuple(r) for r in got) == plain_lines(rows, at_least, shortest)
    assert lines.drop_common(cases.documents(spark, []), at_least).collect() == []


def test_runs_are_merged_without_shuffle(spark):
    runs = lines.Runs(spark, 3)
    frame = spark.range(1000).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(2).cast("long").alias("n"))
    runs.add(frame)
    left, right = runs.levels[0][0], runs.levels[0][0].alias("b").hint("merge")
    assert "Exchange" not in left.join(right, ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    runs.add(frame)
    assert list(runs.levels) == [1]
    runs.add(frame)
    assert runs.levels[0][0].count() == 0
    runs.add(frame.withColumn("h1", F.col("h1") + 500))
    assert runs.common().count() == 1000


def test_digest_column(spark):
    row = queries.QUERIES["op6_exact_dedup"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").first()
    assert row.text_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_runs_leave_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert lines.drop_common(cases.documents(spark)).count() == len(cases.ROWS)
    assert {t.name for t in spark.catalog.listTables()} == before
