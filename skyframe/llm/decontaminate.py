"""Benchmark decontamination by spaced seeds.

A mask is a row of word positions of which some are ignored; a window's hash under it covers the others, so windows that
differ only at ignored positions have the same hash. The hashes of all benchmark windows are joined with those of all
document windows. Around each hit the item is laid over the document; of all stretches that are long enough and of which enough
words agree, the one with the most matches is taken."""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from skyframe.llm.common import cut, fresh, located, lookup, map_batches
from skyframe.llm.words import BASE, mix, word_hashes

#: The masks, 6 positions each. By enumeration one of them hits every placement of substitutions in at most a fifth
#: of 13 to 25 words; a longer stretch with that share has a part of 13 to 25 words that has it too.
MASKS = ("1111011", "110000010111", "1110001011", "1101111")
#: Words from which on an item is entered by the masks; shorter ones have masks of their whole length.
SHORT = 13
#: Words of the benchmark that are shipped to the tasks at once; a larger benchmark takes one pass for each block.
BLOCK_WORDS = 2_000_000
OVERLAPS = "array<struct<item_id:long,start:long,words:long,matched:long>>"


@dataclass
class Index:
    """Sorted window hashes of a block of items with the places they stand for, and a bitmap of their top bits."""
    masks: list[np.ndarray]
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]
    items: list[np.ndarray]
    item_ids: list[int | None]


def masked(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hash of every window of the words under a mask (the positions that count)."""
    n = len(words) - int(mask[-1])
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for at in mask:
        out = out * np.uint64(BASE) + words[at:at + n]
    return mix(out)


def build(item_ids: list, texts: list[str]) -> Index:
    """Items of fewer than ``SHORT`` words are matched whole, by masks of their own length for all substitutions in at most
    a fifth of the words."""
    items = [word_hashes(t)[0] for t in texts]
    masks = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
    lengths = [None] * len(masks)
    for n in sorted({len(w) for w in items if 0 < len(w) < SHORT}):
        made = [np.array(kept) for kept in itertools.combinations(range(n), n - n // 5)]
        masks, lengths = masks + made, lengths + [n] * len(made)
    index = Index(masks, [], [], [], items, item_ids)
    for k, mask in enumerate(masks):
        hashes, places = [], []
        for i, words in enumerate(items):
            if len(words) >= SHORT if lengths[k] is None else len(words) == lengths[k]:
                own = masked(words, mask)
                hashes.append(own)
                places.append(np.stack([np.full(len(own), i), np.arange(len(own))], 1))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        where = np.concatenate(places) if places else np.empty((0, 2), np.int64)
        order = np.argsort(flat, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[flat >> np.uint64(44)] = True
        index.hashes.append(flat[order])
        index.places.append(where[order])
        index.filters.append(bits)
    return index


def stretch(same: np.ndarray, least_words: int, least_share: float) -> tuple[int, int] | None:
    """Bounds of the stretch of at least ``least_words`` words with the most matches of those of which at least ``least_share``
    agree, without substitutions at its ends where it is long enough; None if there is none."""
    n = len(same)
    if n < least_words:
        return None
    matches = np.concatenate(([0], np.cumsum(same)))
    sums = matches - least_share * np.arange(n + 1)
    # for each start the furthest end that has the share: the last one whose later sums reach the start's
    later = np.maximum.accumulate(sums[::-1])
    ends = n - np.searchsorted(later, sums - 1e-9, "left")
    starts = np.arange(n + 1)
    gain = np.where(ends - starts >= least_words, matches[ends] - matches, -1)
    start = int(gain.argmax())
    if gain[start] < 0:
        return None
    end = int(ends[start])
    while end - start > least_words and not same[end - 1]:
        end -= 1
    while end - start > least_words and not same[start]:
        start += 1
    return start, end


def overlaps(words: np.ndarray, index: Index, least_words: int, least_share: float) -> list[dict]:
    """The best overlap with each item that counts, in the order of the items."""
    tried, best = set(), {}
    for mask, hashes, places, bits in zip(index.masks, index.hashes, index.places, index.filters, strict=True):
        if not len(hashes):
            continue
        own = masked(words, mask)
        at = np.flatnonzero(bits[own >> np.uint64(44)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
        for position, first, last in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for item, offset in places[first:last].tolist():
                shift = position - offset
                if (item, shift) in tried:
                    continue
                tried.add((item, shift))
                text = index.items[item]
                a, b = max(0, -shift), min(len(text), len(words) - shift)
                same = text[a:b] == words[a + shift:b + shift]
                if (found := stretch(same, min(least_words, len(text)), least_share)) is None:
                    continue
                s, e = found
                matched = int(same[s:e].sum())
                if item not in best or matched > best[item][2]:
                    best[item] = (s + a + shift, e - s, matched)
    return [{"item_id": index.item_ids[i], "start": s, "words": n, "matched": m} for i, (s, n, m) in sorted(best.items())]


def blocks(benchmark: DataFrame):
    """The benchmark's indexes, one for each block of a bounded number of words."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / (4 * BLOCK_WORDS)))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)))
    for k in range(count):
        found = keyed.where(F.col("block") == k).orderBy("item_id", "text").toArrow()
        yield build(found.column("item_id").to_pylist(), found.column("text").to_pylist())


def scan(rows: DataFrame, index, least_words: int, least_share: float) -> DataFrame:
    """``rows`` (doc_id, file, row, text) with their overlaps in place of the text."""
    def run(batch):
        doc_id, file, row, texts = batch.columns
        return {"doc_id": doc_id, "file": file, "row": row,
                "overlaps": [overlaps(word_hashes(t)[0], index.value, least_words, least_share) for t in texts.to_pylist()]}

    return map_batches(rows, run, f"doc_id long, file string, row long, overlaps {OVERLAPS}")


def find(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, least_share: float = 0.8) -> DataFrame:
    """(doc_id, contaminated, overlaps, file, row), one row for each row of ``docs``: with each item the best overlap of at
    least ``least_words`` words (or the whole of a shorter item) of which at least ``least_share`` agree, in words.

    Null and empty texts, on either side, match nothing; null or repeated ids pass through; equal items are reported each;
    without items nothing is contaminated; no rows: no rows. Other columns are not read."""
    rows = located(docs).select(F.col("doc_id").cast("long"), "file", "row", F.coalesce("text", F.lit("")).alias("text"))
    context, todo = docs.sparkSession.sparkContext, blocks(benchmark)
    index, following = next(todo), next(todo, None)
    if following is None:
        found = scan(rows, context.broadcast(index), least_words, least_share)
    else:  # one pass for each block of the benchmark, so that a task holds one index; it is given up once its hits are stored
        parts = []
        while index is not None:
            sent = context.broadcast(index)
            parts.append(cut(scan(rows, sent, least_words, least_share).where(F.size("overlaps") > 0), "overlaps"))
            sent.unpersist()
            index, following = following, next(todo, None)
        hits = functools.reduce(DataFrame.unionByName, parts)
        hits = cut(hits.groupBy("file", "row").agg(F.array_sort(F.flatten(F.collect_list("overlaps"))).alias("overlaps")), "overlaps")
        found = rows.drop("text").join(lookup(hits), ["file", "row"], "left").withColumn(
            "overlaps", F.coalesce("overlaps", F.array().cast(OVERLAPS)))
    return found.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), "overlaps", "file", "row")


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, least_share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns. ``docs`` must be a file scan."""
    file, row = fresh(docs, "file"), fresh(docs, "row")
    hit = find(docs, benchmark, least_words, least_share).where("contaminated").select(F.col("file").alias(file), F.col("row").alias(row))
    meta = docs.metadataColumn("_metadata")
    return docs.join(lookup(cut(hit, "contaminated")), (meta["file_path"] == F.col(file)) & (meta["row_index"] == F.col(row)), "left_anti")
