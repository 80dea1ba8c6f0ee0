from collections import defaultdict

import corpus_pipeline
from skyframe.llm import toxicity
from tests.llm import cases
from tests.llm.test_near import plain_classes

SF = "/root/testdata/sf0.001"


def test_against_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = [r for r in docs.collect() if model.score(r.text or "") < 0.5]
    assert len(rows) < docs.count()
    last = {}
    for r in rows:
        if (r.text or "") not in last or r.doc_id > last[r.text or ""].doc_id:
            last[r.text or ""] = r
    rows = list(last.values())
    first = {}
    for r, c in zip(rows, plain_classes([r.text or "" for r in rows]), strict=True):
        if c not in first or r.doc_id < first[c].doc_id:
            first[c] = r
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in first.values() if not any(f" {i} " in f" {norm(r.text)} " for i in items)}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == want
    by_doc, by_sequence = defaultdict(int), defaultdict(int)
    for p in pieces:
        by_doc[p.doc_id] += p.length
        by_sequence[p.sequence_id] += p.length
        assert len(p.ids) == 4 * p.length
    assert all(by_doc[p.doc_id] == p.doc_tokens for p in pieces)
    assert all(n <= 2048 and n & (n - 1) == 0 for n in by_sequence.values())


def test_stages_keep_the_columns(spark, tmp_path):
    docs = cases.stored(spark, str(tmp_path / "0"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k + 1)))
        docs = spark.read.parquet(str(tmp_path / str(k + 1)))
        counts.append(docs.count())
    texts = len({r[1] or "" for r in cases.ROWS})
    assert counts[:2] == [len(cases.ROWS), texts] and counts[3] == texts


def test_empty_documents(spark, tmp_path):
    docs = cases.stored(spark, str(tmp_path / "0"), [], files=1, extra=False)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k + 1)))
        docs = spark.read.parquet(str(tmp_path / str(k + 1)))
        assert docs.count() == 0
