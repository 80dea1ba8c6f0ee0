"""Ranked lexical search over bit-sliced Bloom signatures.

A block holds up to 512 documents of about the same number of distinct terms. Its signature is a bit matrix with one column
for each document and one row for each hash position: the AND of a term's rows is a bitmap that shows every document of
the block that has the term, and a few that have not. A term is also entered under levels, "at least 2, 4, 8, 16
times". For an item the weights of its terms are summed over the bitmaps of each level; times what the level can add to a
score these sums bound the score of every document from above.

A search takes two passes over the blocks. The first reads only signatures and names the documents with the highest
bounds; their exact scores give a score that ten documents reach. The second scores exactly every document whose bound
reaches that score, so none is lost; the texts lie beside their signatures, so nothing is joined."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skyframe.llm.common import folder, small_batches

#: The bytes of a term are the ASCII letters and digits and all beyond ASCII; A to Z count as a to z.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Fixed values of the score.
UNIT, FREE, BOUND = 1_000_000_000, 10, 90
#: Times that a term occurs at least, one level of the signature each.
LEVELS = (1, 2, 4, 8, 16)
PROBES, BITS_PER_KEY = 4, 8
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 22
#: Distinct terms that a task counts before it hands the counts on.
HELD_TERMS = 400_000
#: Items searched in one go; more take two passes over the index for each block of so many.
BLOCK_ITEMS = 1000
#: Documents with the highest bounds that are scored to find what must be reached.
SEEDS = 16
BLOCKS = ("block string, doc_ids array<long>, sizes array<long>, most array<long>, width long, slices binary, texts array<binary>, "
          "counts array<struct<term:string,docs:long>>")
FOUND = "item long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Hashes(dict):
    """64-bit hashes of terms, kept while they fit."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[term] = value = xxhash.xxh3_64_intdigest(term)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slice_rows(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Rows of the terms at a level, one row of ``PROBES`` places for each term."""
    x = mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(width)).astype(np.int64)


class Block:
    """Documents of one size class on their way into a block."""

    def __init__(self, width: int):
        self.width, self.bytes = width, 0
        self.docs: list[tuple] = []

    def add(self, doc_id, text: bytes, size: int, hashes: np.ndarray, often: np.ndarray) -> bool:
        """Whether the block is full now."""
        self.docs.append((doc_id, text, size, hashes, often))
        self.bytes += len(text)
        return len(self.docs) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def slices(self) -> bytes:
        bits = np.zeros((self.width, len(self.docs)), bool)
        of_doc = np.repeat(np.arange(len(self.docs)), [len(d[3]) for d in self.docs])
        hashes, often = np.concatenate([d[3] for d in self.docs]), np.concatenate([d[4] for d in self.docs])
        for level, least in enumerate(LEVELS):
            at = np.flatnonzero(often >= least)
            bits[slice_rows(hashes[at], level, self.width), of_doc[at, None]] = True
        return np.packbits(bits, axis=1).tobytes()

    def row(self, name: str) -> dict:
        return {"block": name, "doc_ids": [d[0] for d in self.docs], "sizes": [d[2] for d in self.docs],
                "most": [int(d[4].max(initial=0)) for d in self.docs], "width": self.width, "slices": self.slices(),
                "texts": [d[1] for d in self.docs], "counts": None}


def build(docs: DataFrame) -> str:
    """Index all rows of ``docs`` and return the folder of the index. Document counts of all terms come from the same pass,
    added up within each task first."""
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], BLOCKS).schema

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        part, number = TaskContext.get().partitionId(), itertools.count()
        known, holders, opened = Hashes(), Counter(), {}

        def told(rows: list[dict]):
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        def counted():
            found = list(holders.items())
            for i in range(0, len(found), 50_000):
                yield told([dict.fromkeys(arrow.names) | {"counts": [{"term": t.decode("utf-8", "replace"), "docs": n} for t, n in found[i:i + 50_000]]}])
            holders.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                often = Counter(words)
                holders.update(often.keys())
                hashes = np.fromiter(map(known.__getitem__, often), np.uint64, len(often))
                times = np.fromiter(often.values(), np.int64, len(often))
                keys = sum(int(np.count_nonzero(times >= least)) for least in LEVELS)
                width = BITS_PER_KEY << max(5, (keys - 1).bit_length())
                block = opened.setdefault(width, Block(width))
                if block.add(doc_id, text, len(words), hashes, times):
                    yield told([opened.pop(width).row(f"{part}-{next(number)}")])
            if len(holders) > HELD_TERMS:
                yield from counted()
        for block in opened.values():
            yield told([block.row(f"{part}-{next(number)}")])
        yield from counted()

    path = folder(spark, "signatures")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(run, out).write.parquet(f"{path}/blocks")
    counts = spark.read.schema(out).parquet(f"{path}/blocks").where("counts IS NOT NULL")
    (counts.select(F.explode("counts").alias("c")).groupBy("c.term").agg(F.sum("c.docs").alias("docs"))
     .write.parquet(f"{path}/terms"))
    return path


@dataclass
class Query:
    """A block of items: hashes and weights of their terms, and which terms each item has."""
    totals: tuple[int, int]
    words: list[bytes]
    weights: np.ndarray
    hashes: np.ndarray
    place: dict[bytes, int]
    items: list[np.ndarray]

    @classmethod
    def of(cls, items: list[list[bytes]], documents: dict[bytes, int], totals: tuple[int, int]) -> Query:
        words = sorted({t for item in items for t in item if documents.get(t)})
        place = {t: i for i, t in enumerate(words)}
        weights = [math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * documents[t] + 1))) for t in words]
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in words], np.uint64)
        return cls(totals, words, np.array(weights, np.int64), hashes, place,
                   [np.array(sorted({place[t] for t in item if t in place}), np.int64) for item in items])

    def shorten(self, size: int) -> int:
        return FREE + BOUND * size * self.totals[0] // self.totals[1]

    def bounds(self, width: int, slices: bytes, sizes: list[int], most: list[int]) -> np.ndarray:
        """(item, document): what the exact score cannot exceed."""
        rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
        lengths = [self.shorten(n) for n in sizes]
        out = np.zeros((len(self.items), len(sizes)), np.int64)
        filled = [i for i, x in enumerate(self.items) if len(x)]
        if not filled:
            return out
        before, below = None, [0] * len(sizes)
        for level, least in enumerate(LEVELS):
            shown = np.bitwise_and.reduce(rows[slice_rows(self.hashes, level, width)], axis=1)
            before = shown if before is None else shown & before
            last = level + 1 == len(LEVELS)
            at_most = [max(least, t if last else min(t, LEVELS[level + 1] - 1)) for t in most]
            reach = [UNIT * t // (1000 * t + 8 * m) for t, m in zip(at_most, lengths, strict=True)]
            # a level that no term of an item shows adds nothing
            some = before.any(axis=1)
            used = [(i, self.items[i][some[self.items[i]]]) for i in filled]
            used = [(i, x) for i, x in used if len(x)]
            if not used:
                break
            flat = np.concatenate([x for _, x in used])
            starts = np.cumsum([0] + [len(x) for _, x in used[:-1]])
            seen = np.unpackbits(before[flat], axis=1, count=len(sizes))
            sums = np.add.reduceat(seen * self.weights[flat, None], starts, axis=0)
            gain = np.array([max(0, a - b) for a, b in zip(reach, below, strict=True)], np.int64)
            out[[i for i, _ in used]] += sums * gain
            below = [max(a, b) for a, b in zip(reach, below, strict=True)]
        return out

    def scores(self, text: bytes, items: np.ndarray) -> list[int]:
        """The exact scores of one document."""
        often = Counter(terms(text))
        m = self.shorten(sum(often.values()))
        worth = {self.place[t]: int(self.weights[self.place[t]]) * (UNIT * often[t] // (1000 * often[t] + 8 * m))
                 for t in often.keys() & self.place.keys()}
        return [sum(worth.get(t, 0) for t in self.items[i].tolist()) for i in items]


def block_rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def after(doc_id: int | None) -> tuple[bool, int]:
    """Sorts ids in descending order, nulls first: of equal scores the smaller id is better and a null id the worst."""
    return (doc_id is not None, 0 if doc_id is None else -doc_id)


def seeds(spark: SparkSession, blocks: DataFrame, query, per_item: int) -> DataFrame:
    """(block, place, item): the documents with the highest bounds for each item."""
    def run(batches):
        q, best = query.value, {}
        for row in block_rows(batches):
            found = q.bounds(row["width"], row["slices"], row["sizes"], row["most"])
            few = min(per_item, found.shape[1])
            top = np.argpartition(-found, few - 1, axis=1)[:, :few]
            for item, places in enumerate(top):
                heap = best.setdefault(item, [])
                for place in places.tolist():
                    entry = (int(found[item, place]), row["block"], place)
                    if entry[0] and (len(heap) < per_item or entry > heap[0]):
                        (heapq.heappush if len(heap) < per_item else heapq.heapreplace)(heap, entry)
        rows = [{"item": i, "bound": b, "block": name, "place": p} for i, heap in best.items() for b, name, p in heap]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.int64()), ("bound", pa.int64()), ("block", pa.string()), ("place", pa.int64())]))

    named = blocks.select("block", "width", "slices", "sizes", "most").mapInArrow(run, "item long, bound long, block string, place long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "place")
    return named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_item).select("block", "place", "item")


def reached(spark: SparkSession, blocks: DataFrame, query, named: DataFrame, limit: int, items: int) -> list[int]:
    """For each item a score that at least ``limit`` documents reach, 1 where the seeds give none."""
    def run(batches):
        q = query.value
        for row in block_rows(batches):
            rows = [{"item": s["item"], "score": q.scores(row["texts"][s["place"]], [s["item"]])[0]} for s in row["seeds"]]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.int64()), ("score", pa.int64())]))

    # at most items * SEEDS rows
    wanted = named.groupBy("block").agg(F.collect_list(F.struct("place", "item")).alias("seeds"))
    scored = blocks.select("block", "texts").join(F.broadcast(wanted), "block").select("texts", "seeds").mapInArrow(run, "item long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    least = {r["item"]: r["score"] for r in scored.withColumn("r", rank).where(F.col("r") == limit).collect()}
    return [max(1, least.get(i, 1)) for i in range(items)]


def best(blocks: DataFrame, query, needed: np.ndarray, limit: int) -> DataFrame:
    """(item, doc_id, score) of each task's best documents, all those scored whose bound reaches what is needed."""
    def run(batches):
        q, heaps = query.value, {}
        for row in block_rows(batches):
            found = q.bounds(row["width"], row["slices"], row["sizes"], row["most"])
            open_, places = np.nonzero(found.T >= needed)
            for place, which in itertools.groupby(zip(open_.tolist(), places.tolist(), strict=True), key=lambda x: x[0]):
                items = [i for _, i in which]
                for item, score in zip(items, q.scores(row["texts"][place], items), strict=True):
                    if score >= needed[item]:
                        heap = heaps.setdefault(item, [])
                        entry = (score, *after(row["doc_ids"][place]))
                        if len(heap) < limit:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [{"item": i, "doc_id": -d if known else None, "score": s} for i, heap in heaps.items() for s, known, d in heap]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return blocks.select("doc_ids", "sizes", "most", "width", "slices", "texts").mapInArrow(run, FOUND)


def search(spark: SparkSession, index: str, items: DataFrame, limit: int = 10, per_item: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` highest-scoring documents of each row of ``items`` (item_id, text), with a
    score above 0; equal scores by ascending id, null ids last. Items without a term, or with none that a document has, get
    no row; rows that repeat an item are items of their own. Items are read block by block."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{index}/blocks").where("block IS NOT NULL")
    words = spark.read.parquet(f"{index}/terms")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    total = blocks.select(F.sum(F.size("sizes")).alias("n"), F.sum(size).alias("terms")).first()
    out, rows = None, items.select("item_id", "text").toLocalIterator()
    while (some := list(itertools.islice(rows, BLOCK_ITEMS))) or out is None:
        ids = [r["item_id"] for r in some]
        wanted = [sorted(set(terms((r["text"] or "").encode()))) for r in some]
        asked = spark.createDataFrame([(t.decode("utf-8", "replace"),) for t in sorted({t for x in wanted for t in x})], "term string")
        # at most the terms of one block of items
        documents = {r["term"].encode(): r["docs"] for r in words.join(F.broadcast(asked), "term").collect()}
        query = spark.sparkContext.broadcast(Query.of(wanted, documents, (total["n"] or 0, total["terms"] or 1)))
        needed = reached(spark, blocks, query, seeds(spark, blocks, query, max(per_item, limit)), limit, len(ids))
        found = best(blocks, query, np.array(needed, np.int64), limit)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def rank(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """Index ``docs`` (doc_id, text) and search it for ``items`` (item_id, text), see ``search``.

    Null texts have no term and are never found; neither are empty ones. Every row is a document of its own, so repeated rows
    are ranked each. No documents or no items: no rows. Other columns are not read."""
    return search(docs.sparkSession, build(docs), items, limit)
