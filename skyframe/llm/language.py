"""Language identification with interpolated Kneser-Ney models over characters.

Texts are reduced to lower-case letters with single blanks between words. For each language the n-grams of all learnable
rows are counted; lower orders count the distinct characters before an n-gram, and each order is interpolated with the next
lower one by an absolute discount taken from its counts of counts. The models are sorted arrays of n-gram hashes with the
log-probabilities of all languages side by side. A text gets the language with the lowest cross-entropy a character, and is
rejected if that entropy is far above what the language's own rows have.

The counts are a stored table of all n-grams. Up to ``SHIPPED`` of them the models are built from it and shipped whole. Beyond
that the discounts, continuation counts and probabilities are Spark aggregates and joins over the whole table, worked out for
every n-gram of the texts; the ``SHIPPED`` most common ones are shipped and the others joined (``joined_costs``). Both ways
use every n-gram and give the same entropies."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyframe.llm.common import cut, fits, located, lookup, map_batches, small_batches
from skyframe.llm.words import points

ORDER = 4
#: N-grams of the longest order that may be shipped to every task, each with a cost for every language; the others are joined.
SHIPPED = 2_000_000
BLOCK = 1 << 22
BLANK = 32
ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """For each code point: itself in 16 bits if it is a letter (those beyond 16 bits share values), else a blank."""
    out = np.full(0x110000, BLANK, np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i & 0xFFFF if i & 0xFFFF else 1
    return out


def reduced(text: str) -> np.ndarray:
    """The text's letters with single blanks between words and at both ends; empty if there is no letter."""
    mapped = np.concatenate(([BLANK], letters()[points(text.lower())], [BLANK])).astype(np.uint16)
    blank = mapped == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    out = mapped[keep]
    return out if len(out) > 2 else out[:0]


def grams(chars: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Keys of the n-grams that end at each character after the first; the text is preceded by blanks. A key holds
    the characters in 16 bits each, the last one lowest."""
    padded = np.concatenate((np.full(max(0, order - 2), BLANK, np.uint16), chars)).astype(np.uint64)
    n = len(chars) - 1
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | padded[k:k + n]
    return out


def scrambled(keys: np.ndarray) -> np.ndarray:
    """A bijection that spreads keys evenly, so a table is entered by its top bits."""
    x = keys * ODD
    return (x ^ (x >> np.uint64(32))) * ODD


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of the (lang, text) rows: counts of the longest order, summed in blocks before the shuffle."""
    small_batches(rows.sparkSession)
    out = rows.sparkSession.createDataFrame([], "lang string, gram long, n long").schema
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                for i in range(0, len(keys), 100_000):
                    k = keys[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)),
                                                      pa.array(counts[i:i + 100_000].astype(np.int64))], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chars = reduced(text)
                if len(chars):
                    held.setdefault(lang, []).append(grams(chars))
                    size += len(chars)
            if size >= BLOCK:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return rows.mapInArrow(run, out).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Level:
    """One order of one language: n-gram keys (sorted) with their probabilities, contexts with their backing-off share."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower: "Level | None", alphabet: int):
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        self.discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.keys, self.lower, self.alphabet = keys, lower, alphabet
        context = keys >> np.uint64(16)
        self.contexts, at, kinds = np.unique(context, return_inverse=True, return_counts=True)
        totals = np.bincount(at, weights=counts, minlength=len(self.contexts))
        self.back = self.discount * kinds / totals
        self.direct = (counts - self.discount) / totals[at]

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the last characters of the keys after the others; a character never seen counts as one more in the alphabet."""
        below = self.lower.probability(keys & ((np.uint64(1) << np.uint64(self.lower.width)) - np.uint64(1))) if self.lower \
            else np.full(len(keys), 1 / (self.alphabet + 1))
        context = keys >> np.uint64(16)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        share = np.where(self.contexts[at] == context, self.back[at], 1.0)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.direct[at], 0.0) + share * below

    width = 64


def levels(keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Level:
    """The interpolated orders of a language from the counts of its longest n-grams."""
    tables = [(keys, counts)]
    for n in range(order - 1, 0, -1):
        # continuation counts: in how many kinds of longer n-grams does this one end
        shorter, kinds = np.unique(tables[-1][0] & ((np.uint64(1) << np.uint64(16 * n)) - np.uint64(1)), return_counts=True)
        tables.append((shorter, kinds))
    alphabet, level = len(tables[-1][0]), None
    for n, (k, c) in enumerate(reversed(tables), 1):
        level = Level(k, c, level, alphabet)
        level.width = 16 * n
    return level


@dataclass
class Models:
    """Sorted scrambled n-gram hashes with the negative log-probabilities of every language; n-grams that no language has
    are worked out from the levels."""
    langs: list[str]
    levels: list[Level]
    hashes: np.ndarray
    costs: np.ndarray
    entry: np.ndarray

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> "Models":
        langs = sorted(counts)
        made = [levels(*counts[lang]) for lang in langs]
        every = np.unique(np.concatenate([counts[lang][0] for lang in langs])) if langs else np.empty(0, np.uint64)
        order = np.argsort(scrambled(every))
        hashes = scrambled(every)[order]
        costs = np.stack([-np.log(m.probability(every[order])) for m in made], 1).astype(np.float32) if langs else np.empty((0, 0), np.float32)
        entry = np.searchsorted(hashes, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        return cls(langs, made, hashes, costs, entry)

    def entropies(self, text: str) -> np.ndarray | None:
        """Cross-entropy a character under each language; None for a text without a letter."""
        chars = reduced(text)
        if not len(chars) or not self.langs:
            return None
        total, n = np.zeros(len(self.langs)), len(chars) - 1
        for i in range(0, n, BLOCK):
            first = max(0, i - ORDER + 2)
            keys = grams(chars[first:i + BLOCK + 1])[i - first:]
            if first:
                assert i - first == ORDER - 2
            total += self._costs(keys)
        return total / n

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        hashes = scrambled(keys)
        at = self.entry[hashes >> np.uint64(48)]
        last = len(self.hashes) - 1
        while True:
            behind = self.hashes[np.minimum(at, last)] < hashes
            behind &= at < last
            if not behind.any():
                break
            at = at + behind
        at = np.minimum(at, last)
        known = self.hashes[at] == hashes
        total = self.costs[at[known]].sum(0, dtype=np.float64)
        missing = keys[~known]
        if len(missing):
            total = total + np.array([-np.log(level.probability(missing)).sum() for level in self.levels])
        return total


def learnable(column: str = "doc_id") -> Column:
    """Rows that may be learned: crc32 of the id's text modulo 4 is not 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4, F.lit(0)) != 2


def learned(docs: DataFrame) -> DataFrame:
    """The stored (lang, gram, n) of the text and non-null language of all learnable rows."""
    rows = docs.where(F.col("lang").isNotNull() & learnable()).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    return cut(count_grams(rows), "grams")


def models_of(counts: DataFrame) -> Models:
    """Models from a count table of at most ``SHIPPED`` rows."""
    table = counts.toArrow()
    langs = table.column(0).to_numpy(zero_copy_only=False).astype(str)
    keys, n = table.column(1).to_numpy().view(np.uint64), table.column(2).to_numpy()
    found = {}
    for lang in sorted(set(langs.tolist())):
        mine = langs == lang
        order = np.argsort(keys[mine])
        found[lang] = keys[mine][order], n[mine][order]
    return Models.build(found)


def suffix(gram: str, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1))


def context(gram: str) -> Column:
    """All characters of an n-gram but the last."""
    return F.shiftrightunsigned(gram, 16)


def by_language(table: DataFrame, key: str, value: str, langs: list[str]) -> DataFrame:
    """(key, ``value`` as an array with a place for each language, null where it has none)."""
    return table.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("held")).select(
        key, F.array(*[F.col("held")[lang] for lang in langs]).alias(value))


def stored_levels(counts: DataFrame, langs: list[str]) -> list[tuple[DataFrame, DataFrame, int]]:
    """For each order, shortest first: the direct probabilities (gram, direct) and the backing-off shares (ctx, back), as
    arrays over the languages."""
    tables = [counts.select("lang", "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        shorter = tables[-1].groupBy("lang", suffix("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables.append(cut(shorter, f"grams-{order}"))
    out = []
    for table in reversed(tables):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = table.groupBy("lang").agg(
            F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
        discounts = lookup(cut(discounts, "discounts"))
        contexts = table.groupBy("lang", context("gram").alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = cut(contexts.join(discounts, "lang"), "contexts")
        direct = table.withColumn("ctx", context("gram")).join(contexts, ["lang", "ctx"]).select(
            "lang", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("direct"))
        back = contexts.select("lang", "ctx", (F.col("discount") * F.col("kinds") / F.col("total")).alias("back"))
        out.append((cut(by_language(direct, "gram", "direct", langs), "direct"), cut(by_language(back, "ctx", "back", langs), "back")))
    return out


def joined_costs(counts: DataFrame, wanted: DataFrame, langs: list[str]) -> DataFrame:
    """The stored (gram, n, costs) of the distinct n-grams ``wanted`` (gram, n): the negative log-probability under each
    language. Each order joins the probabilities of the next lower one."""
    alphabet = {r.lang: r.n for r in counts.select("lang", suffix("gram", 1).alias("c")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    unseen = F.array(*[F.lit(1 / (alphabet[lang] + 1)) for lang in langs])
    below = None
    for order, (direct, back) in enumerate(stored_levels(counts, langs), 1):
        asked = wanted.select(suffix("gram", order).alias("gram")).distinct() if order < ORDER else wanted.select("gram")
        asked = asked.withColumn("ctx", context("gram")).withColumn("shorter", suffix("gram", order - 1))
        asked = asked.join(direct, "gram", "left").join(back, "ctx", "left")
        asked = asked.withColumn("below", unseen) if below is None else asked.join(
            below.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter")
        one = F.array(*[F.coalesce(F.col("direct")[i], F.lit(0.0)) + F.coalesce(F.col("back")[i], F.lit(1.0)) * F.col("below")[i]
                        for i in range(len(langs))])
        below = cut(asked.select("gram", one.alias("p")), f"probabilities-{order}")
    costs = F.transform("p", lambda p: (-F.log(p)).cast("float"))
    return cut(below.join(wanted, "gram").select("gram", "n", costs.alias("costs")), "costs")


def text_grams(rows: DataFrame) -> DataFrame:
    """The stored (file, row, grams, times): the n-grams of each text with their counts, in one row for each ``BLOCK`` of it."""
    def run(batch):
        out: dict[str, list] = {"file": [], "row": [], "grams": [], "times": []}
        for file, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = grams(chars) if len(chars := reduced(text)) else np.empty(0, np.uint64)
            for i in range(0, len(keys), BLOCK):
                found, times = np.unique(keys[i:i + BLOCK], return_counts=True)
                for name, value in zip(out, (file, row, found.view(np.int64), times), strict=True):
                    out[name].append(value)
        return out

    return cut(map_batches(rows.select("file", "row", "text"), run, "file string, row long, grams array<long>, times array<long>"), "text-grams")


def entropies_by_join(rows: DataFrame, counts: DataFrame, langs: list[str]) -> DataFrame:
    """(file, row, costs) of the (file, row, text) rows with a letter: cross-entropy a character under each language, like
    ``Models.entropies``, with models of any size. Tasks add up the costs of the n-grams that are shipped; the rest meet the
    stored costs in a join, so the n-grams that most texts hold are no hot keys of it."""
    held = text_grams(rows)
    pairs = held.select(F.explode(F.arrays_zip("grams", "times")).alias("x")).groupBy("x.grams").agg(F.sum("x.times").alias("n"))
    stored = joined_costs(counts, cut(pairs.select(F.col("grams").alias("gram"), "n"), "wanted"), langs)
    common = stored.orderBy(F.desc("n"), "gram").limit(SHIPPED).toArrow()
    keys = common.column(0).to_numpy()
    order = np.argsort(keys)
    costs = np.array(common.column(2).combine_chunks().flatten(), np.float32).reshape(len(keys), len(langs))[order]
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], costs))

    def run(batch):
        keys, costs = shared.value
        out: dict[str, list] = {"length": [], "part": [], "rest": [], "times": []}
        for found, times in zip(batch.column(2), batch.column(3), strict=True):
            found, times = found.values.to_numpy(), times.values.to_numpy()
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = keys[at] == found
            values = (int(times.sum()), times[hit] @ costs[at[hit]].astype(np.float64), found[~hit], times[~hit])
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return {"file": batch.column(0), "row": batch.column(1), **out}

    parts = cut(map_batches(held, run, "file string, row long, length long, part array<double>, rest array<long>, times array<long>"), "parts")
    rare = parts.select("file", "row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("file", "row", F.col("x.rest").alias("gram"), "x.times")
    each = range(len(langs))
    rare = rare.join(stored.select("gram", "costs"), "gram").select(
        "file", "row", F.lit(0).cast("long").alias("length"), F.transform("costs", lambda c: F.col("times") * c.cast("double")).alias("part"))
    return (parts.select("file", "row", "length", "part").unionByName(rare).groupBy("file", "row")
            .agg(F.sum("length").alias("length"), *[F.sum(F.col("part")[i]).alias(f"c{i}") for i in each])
            .select("file", "row", F.array(*[F.col(f"c{i}") / F.col("length") for i in each]).alias("costs")))


def predict(docs: DataFrame, models: Models | None = None, sharpness: float = 1.0, deviations: float = 4.0) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for each row of ``docs``.

    ``score`` is the softmax over the languages of their total log-likelihoods, over at most 64 characters' worth of
    evidence, so it falls for short or mixed texts. ``rejected``: the entropy lies more than ``deviations`` standard
    deviations above the mean of the learnable rows that have the language. A null text or one without a letter is
    ``und`` with score 0; null or repeated ids pass through; without learnable rows all is ``und``; no rows: no rows.
    Columns besides ``doc_id``, ``text`` and ``lang`` are not read. The models are learned from ``docs`` unless given."""
    if models is None:
        counts = learned(docs)
        models = models_of(counts) if fits(counts, SHIPPED) else None
    scored = cut(scored_by_models(docs, models, sharpness) if models else scored_by_join(docs, counts, sharpness), "languages")
    usual = scored.where(F.col("lang") == F.col("lang_pred")).groupBy("lang_pred").agg(
        (F.avg("entropy") + deviations * F.coalesce(F.stddev("entropy"), F.lit(0.0))).alias("most"))
    return scored.join(lookup(cut(usual, "entropies")), "lang_pred", "left").select(
        "doc_id", "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") > F.col("most"), F.lit(True)).alias("rejected"))


def scored_by_models(docs: DataFrame, models: Models, sharpness: float) -> DataFrame:
    """(doc_id, lang, lang_pred, score, entropy) by shipped models; ``lang`` only of learnable rows."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    texts = docs.select(F.col("doc_id").cast("long"), F.when(learnable(), F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batch):
        langs, scores, least = [], [], []
        for text in batch.column(2).to_pylist():
            costs = shared.value.entropies(text)
            if costs is None:
                langs.append("und"), scores.append(0.0), least.append(None)
                continue
            best = int(costs.argmin())
            evidence = sharpness * min(64, len(text))
            langs.append(shared.value.langs[best])
            scores.append(float(1 / np.exp(-evidence * (costs - costs[best])).sum()))
            least.append(float(costs[best]))
        return {"doc_id": batch.column(0), "lang": batch.column(1), "lang_pred": langs, "score": scores, "entropy": least}

    return map_batches(texts, run, "doc_id long, lang string, lang_pred string, score double, entropy double")


def scored_by_join(docs: DataFrame, counts: DataFrame, sharpness: float) -> DataFrame:
    """The same from the stored counts, of any size."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    rows = located(docs, "lang")
    texts = rows.select("file", "row", F.coalesce("text", F.lit("")).alias("text"))
    told = rows.select(F.col("doc_id").cast("long"), F.when(learnable(), F.col("lang")).alias("lang"), "file", "row",
                       F.least(F.lit(64), F.length(F.coalesce("text", F.lit("")))).alias("evidence"))
    best = F.array_min("costs")
    odds = F.aggregate("costs", F.lit(0.0), lambda total, c: total + F.exp(-sharpness * F.col("evidence") * (c - best)))
    return told.join(cut(entropies_by_join(texts, counts, langs), "entropies"), ["file", "row"], "left").select(
        "doc_id", "lang", F.coalesce(F.get(F.array(*map(F.lit, langs)), (F.array_position("costs", best) - 1).cast("int")), F.lit("und")).alias("lang_pred"),
        F.coalesce(1 / odds, F.lit(0.0)).alias("score"), best.alias("entropy"))
