import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyframe.llm import common, packing, queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, expected):
    """expected: (doc_id, ids) of every row; pieces cover each id once and sequences have no gap and no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].sequence_length <= 2048 and at & (at - 1) == 0
    wanted, got = defaultdict(list), defaultdict(list)
    for doc_id, ids in expected:
        wanted[doc_id].append(ids)
    for doc_id, parts in by_doc.items():
        for p in sorted(parts, key=lambda p: p.start):
            assert p.ids_crc32 == zlib.crc32(p.ids)
            got[doc_id].append((p.start, p.ids))
    assert wanted.keys() == got.keys()
    for doc_id, texts in wanted.items():
        if len(texts) == 1:
            assert b"".join(x for _, x in got[doc_id]) == array("I", texts[0]).tobytes()
        assert sum(len(x) // 4 for _, x in got[doc_id]) == sum(map(len, texts))


def collect(docs, **more):
    return packing.pack(docs, **more).withColumn("ids_crc32", F.crc32("ids")).collect()


def test_odd_documents(spark, tmp_path, plain):
    expected = [(r[0], plain(r[1])) for r in cases.ROWS]
    check(collect(cases.documents(spark)), expected)
    check(collect(cases.stored(spark, str(tmp_path / "d")), group_sequences=1), expected)
    assert collect(cases.documents(spark, [])) == []


def test_whole_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(collect(docs), [(r.doc_id, plain(r.text)) for r in docs.collect()])
    rows = queries.QUERIES["op3_packing"](spark, SF).collect()
    assert sum(r.length for r in rows) == sum(len(plain(r.text)) for r in docs.collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\x1c\x85 'sé́ŁΣ1²!<|"))))
def test_parts_encode_like_the_whole(text):
    encode = packing.encoder("word_bpe_49k.json")
    assert encode([text])[0] == array("I", encode.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60))
def test_place(lengths):
    pieces, sizes = packing.place(lengths, 64, 1.0, 0.1)
    filled, spans = [0] * len(sizes), defaultdict(list)
    for i, start, n, sequence, offset in pieces:
        assert offset == filled[sequence] and n > 0
        filled[sequence] += n
        spans[i].append((start, n))
    assert filled == sizes and all(x <= 64 and x & (x - 1) == 0 for x in sizes)
    for i, length in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at
            at += n
        assert at == length


def test_costs_are_balanced():
    lengths = [900] * 20 + [300] * 20 + [50] * 200
    pieces, sizes = packing.place(lengths, 2048, 1.0, 1 / 4096)
    cost = defaultdict(float)
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += n + n * n / 4096
    full = [c for s, c in cost.items() if sizes[s] == 2048]
    assert max(full) < 1.1 * min(full)


def test_a_worker_gives_the_encoder_back(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(16)
    assert packing.pack(docs).count() >= 64

    def held(batch):
        return {"n": [packing.encoder.cache_info().currsize] * batch.num_rows}

    assert {r.n for r in common.map_batches(docs, held, "n long").collect()} == {0}


def test_new_words_are_encoded_many_at_a_time():
    encode = packing.Encoder(packing.encoder("word_bpe_49k.json").file)
    tokenizer, told = encode.tokenizer, []

    class Told:
        def encode_batch_fast(self, texts, **more):
            told.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    encode.tokenizer = Told()
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé'ß7.", k=rng.randint(1, 9))) for _ in range(4000)]
    texts = [" ".join(words[:2000]), "\t".join(words[2000:]) + " Ωmega e\u0301", "", " \n", "it's it'S x''s <|endoftext|>"]
    assert encode(texts) == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert len(told) < 20
