"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = occurrences times inverse document frequency. Its
signature has 64 consistent weighted samples: two documents agree on a sample with a probability equal to their weighted
Jaccard similarity. Signatures are banded; pairs from a band are verified by their weighted Jaccard similarity.

Equal texts are one node. Members of a bucket are compared with its pivot first; only what is still in different classes then
is compared with each other, in large families by what members have that most of the family lacks and the reverse (``links``).

The document frequency of a shingle counts all documents. Its inverse is 1 for a shingle in every document and 2 for one
in at most ``rate`` of them, logarithmic between; so only shingles above that rate need exact counts, and there are at most
(shingles a document) / ``rate`` of those, whatever the corpus. They are found in two passes: one names every shingle that
reaches half the rate in some block of documents, the next counts those. The most common ones are shipped to the tasks; where
there are more than ``SHIPPED``, the others are joined to the documents that hold them."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.llm.common import content_key, cut, fits, fresh, located, lookup, map_batches, small_batches
from skyframe.llm.graph import components
from skyframe.llm.words import mix, shingles, word_hashes

BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Members of a family up to which those in different classes are compared by buckets.
SMALL = 200
#: Documents that a block has at least (where the corpus has them) and shingles at which it is closed.
BLOCK_DOCS, BLOCK_SHINGLES = 4000, 1 << 22
#: Frequent shingles that are shipped to every task (16 bytes each); beyond it the less common ones are joined.
SHIPPED = 2_000_000
OFTEN = "array<struct<shingle:long,n:long>>"


def shingle_counts(text: str, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(word_hashes(text)[0], width), return_counts=True)


class Weights:
    """Inverse document frequencies: exact for the given frequent shingles and those told with a text (``often``), 2 for all others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, floor: int):
        order = np.argsort(keys)
        self.total, self.floor = total, floor
        self.keys, self.idf = keys[order], self.inverse(counts[order])

    def inverse(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.log(self.total / counts) / math.log(self.total / self.floor) if self.total > self.floor else np.full(len(counts), 2.0)

    def each(self, hashes: np.ndarray, often: list[dict] | None = None) -> np.ndarray:
        weight = np.full(len(hashes), 2.0)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            weight[hit] = self.idf[at[hit]]
        if often and len(hashes):
            known = np.array([x["shingle"] for x in often], np.int64).view(np.uint64)
            weight[np.searchsorted(hashes, known)] = self.inverse(np.array([x["n"] for x in often]))
        return weight

    def __call__(self, hashes: np.ndarray, counts: np.ndarray, often: list[dict] | None = None) -> np.ndarray:
        return self.each(hashes, often) * counts


def _block_counts(docs: DataFrame, width: int, least, only=None) -> DataFrame:
    """(shingle, n): documents of a block that hold the shingle, where ``least(documents of the block)`` or more do.
    ``only``: a broadcast sorted array of the shingles that count."""
    small_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "shingle long, n long").schema
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, size, n = [], 0, 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            few = counts >= least(n)
            keys, counts = keys[few], counts[few]
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 100_000].view(np.int64)), pa.array(counts[i:i + 100_000].astype(np.int64))],
                                                 schema=schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = np.unique(shingles(word_hashes(text)[0], width))
                if only is not None:
                    known = only.value
                    found = found[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found]
                held.append(found)
                size, n = size + len(found), n + 1
            if size >= 2 * BLOCK_SHINGLES:  # the first half goes, so that what is left at the end is no small rest
                half = n // 2
                rest, held, n = held[half:], held[:half], half
                yield from flush()
                held, n = rest, len(rest)
                size = sum(map(len, held))
        if size:
            yield from flush()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, out)


def frequencies(docs: DataFrame, width: int = 5, rate: float = 1e-3) -> tuple[Weights, DataFrame | None]:
    """Document frequencies of the shingles in more than ``rate`` of all documents (and at least two): those to be shipped, and
    a stored table (shingle, n) of the less common ones if there are more than ``SHIPPED``."""
    context, total = docs.sparkSession.sparkContext, docs.count()
    blocks = docs.select("text").coalesce(max(1, total // BLOCK_DOCS))
    floor = max(2, math.ceil(rate * total))
    part = floor / (2 * max(1, total))
    named = (_block_counts(blocks, width, lambda n: max(1, math.ceil(part * n)))
             .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= floor / 2).select("shingle"))
    named = cut(named, "named")
    rest = None
    if fits(named, SHIPPED):
        keys = np.sort(named.toArrow().column(0).to_numpy().view(np.uint64))
        if not len(keys):
            return Weights(keys, np.empty(0, np.int64), total, floor), None
        shipped = (_block_counts(blocks, width, lambda n: 1, context.broadcast(keys))
                   .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= floor))
    else:
        counted = cut(_block_counts(blocks, width, lambda n: 1).groupBy("shingle").agg(F.sum("n").alias("n"))
                      .where(F.col("n") >= floor), "frequent")
        bound = counted.orderBy(F.desc("n")).limit(SHIPPED).agg(F.min("n")).first()[0] if counted.count() > SHIPPED else 0
        shipped, rest = counted.where(F.col("n") > bound), counted.where(F.col("n") <= bound)
    found = shipped.toArrow()
    return Weights(found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy(), total, floor), rest


def known_often(keyed: DataFrame, rest: DataFrame | None, width: int) -> DataFrame:
    """``keyed`` (content, text and more) with ``often``: the shingles of a text that are frequent but not shipped. No shingle of
    ``rest`` can be hot, as those in the most documents are shipped."""
    if rest is None:
        return keyed.withColumn("often", F.lit(None).cast(OFTEN))

    def hold(batch):
        texts = batch.column(1).to_pylist()
        return {"content": batch.column(0), "shingles": [shingle_counts(t, width)[0].view(np.int64) for t in texts]}

    held = map_batches(keyed.select("content", "text"), hold, "content binary, shingles array<long>")
    often = (held.select("content", F.explode("shingles").alias("shingle")).join(rest, "shingle")
             .groupBy("content").agg(F.collect_set(F.struct("shingle", "n")).alias("often")))
    return keyed.join(cut(often, "often"), "content", "left")


@functools.cache
def gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1): logarithms at 2^18 places, values at 2^16."""
    def quantiles(n):
        p = (np.arange(n) + 0.5) / n
        lo, hi = np.zeros(n), np.full(n, 60.0)
        for _ in range(60):
            x = (lo + hi) / 2
            below = 1 - (1 + x) * np.exp(-x) < p
            lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        return (lo + hi) / 2

    return np.log(quantiles(1 << 18)).astype(np.float32), quantiles(1 << 16).astype(np.float32)


def signature(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Consistent weighted samples (Ioffe 2010) as 32-bit values. For feature and sample, the random r and c are
    Gamma(2, 1) and beta uniform, all taken from one 64-bit hash through quantile tables."""
    log_c, gamma = gamma_tables()
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64))[:, None]
    log_w = np.log(weights).astype(np.float32)
    best = np.full(samples, np.inf, np.float32)
    chosen, level = np.zeros(samples, np.int64), np.zeros(samples, np.float32)
    every = np.arange(samples)
    for i in range(0, len(hashes), 512):  # what a step works on stays in the processor's cache
        x = hashes[None, i:i + 512] ^ seeds
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        r = gamma.take(((x >> np.uint64(14)) & np.uint64(0xFFFF)).view(np.int64), mode="clip")
        beta = ((x >> np.uint64(30)) & np.uint64(0xFFFF)).astype(np.float32)
        beta *= np.float32(1 / 65536)
        t = log_w[None, i:i + 512] / r
        t += beta
        np.floor(t, out=t)
        x >>= np.uint64(46)
        a = log_c.take(x.view(np.int64), mode="clip")
        beta -= t
        beta -= np.float32(1)
        beta *= r
        a += beta
        j = a.argmin(axis=1)
        value = a[every, j]
        better = value < best
        best = np.where(better, value, best)
        chosen = np.where(better, j + i, chosen)
        level = np.where(better, t[every, j], level)
    out = mix(hashes[chosen] + level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0


def sketches(keyed: DataFrame, weights, width: int) -> DataFrame:
    """(doc_id, file, row, content, sig): every row with its signature, null for a text without a word."""
    def sketch(batch):
        sigs = []
        for text, often in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            hashes, counts = shingle_counts(text, width)
            sigs.append(signature(hashes, weights.value(hashes, counts, often)) if len(hashes) else None)
        return {**{name: batch.column(k) for k, name in enumerate(("doc_id", "file", "row", "content"))}, "sig": sigs}

    rows = keyed.select("doc_id", "file", "row", "content", "text", "often")
    return cut(map_batches(rows, sketch, "doc_id long, file string, row long, content binary, sig array<int>"), "sketches")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, content), one row for each band of a node."""
    bands = [F.xxhash64(F.lit(b), F.slice("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)]
    return nodes.where("sig IS NOT NULL").select("content", F.explode(F.array(*bands)).alias("bucket"))


def shared_only(members: DataFrame, name: str) -> DataFrame:
    """(bucket, content, size) of the buckets that have more than one member."""
    placed = cut(members, name)
    sizes = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"{name}-sizes")
    return cut(placed.join(lookup(sizes), "bucket"), f"{name}-shared")


def pivots(inside: DataFrame) -> DataFrame:
    """(content, pivot): with whom each member of a bucket is compared.

    A node's degree is the sum of its buckets' sizes, which is highest for the text that many others vary. A node's home is
    the member of its buckets with the highest degree; a bucket's pivot is the home of its members with the highest degree.
    So the buckets of one family have one pivot, even those it is not in."""
    degrees = cut(inside.groupBy("content").agg(F.sum("size").alias("degree")), "degrees")
    ranked = cut(inside.join(degrees, "content").select("bucket", "content", F.struct("degree", "content").alias("rank")), "ranked")
    top = cut(ranked.groupBy("bucket").agg(F.max("rank").alias("top")), "top")
    home = cut(ranked.join(lookup(top), "bucket").groupBy("content").agg(F.max("top").alias("home")), "homes")
    pivot = cut(ranked.join(lookup(home), "content").groupBy("bucket").agg(F.max("home").alias("pivot")), "pivot")
    return ranked.join(lookup(pivot), "bucket").select("content", F.col("pivot.content").alias("pivot")).where("content != pivot").distinct()


def similar(pairs: DataFrame, texts: DataFrame, weights, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    sides = [texts.select(F.col("content").alias(k), F.struct("text", "often").alias(f"text_{k}")) for k in "ab"]
    both = cut(pairs, "pairs").join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")

    def compare(batch):
        known = {}

        def weighted(key, text):
            if key not in known:
                hashes, counts = shingle_counts(text["text"], width)
                known[key] = hashes, weights.value(hashes, counts, text["often"])
            return known[key]

        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        found = [similarity(weighted(ka, xa), weighted(kb, xb)) for ka, kb, xa, xb in zip(a, b, ta, tb, strict=True)]
        return {"a": batch.column(0), "b": batch.column(1), "similarity": found}

    return cut(map_batches(both, compare, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold).select("a", "b"), "similar")


def links(nodes: DataFrame, keyed: DataFrame, weights, threshold: float, width: int) -> DataFrame:
    """(node, root): the classes of the texts that are similar to another one of their bucket.

    All members of a bucket are compared with its pivot, and what is similar forms classes. Pairs of a bucket that are still in
    different classes are compared where their signatures agree about as often as similar texts' do. A family are the
    buckets that pivots connect; in one of more than ``SMALL`` members such pairs are found by ``apart``."""
    inside = shared_only(buckets(nodes), "buckets")
    wanted = inside.select("content").distinct().join(nodes, "content").select("content", "place.file", "place.row")
    texts = cut(keyed.select("file", "row", "text", "often").join(lookup(cut(wanted, "wanted")), ["file", "row"]).select("content", "text", "often"), "texts")
    stars = cut(pivots(inside).select(*pair("content", "pivot")).distinct(), "stars")
    found = similar(stars, texts, weights, threshold, width)
    roots = components(found)
    families = components(stars).select(F.col("node").alias("content"), F.col("root").alias("family"))
    placed = families.join(lookup(roots), F.col("content") == F.col("node"), "left").select("content", "family", F.coalesce("root", "content").alias("root"))
    placed = cut(placed, "placed")
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("members"), (F.min("root") != F.max("root")).alias("open"))
    open_ = cut(placed.join(lookup(cut(sizes.where("open"), "families")), "family").join(nodes.select("content", "sig"), "content")
                .select("content", "family", "root", "sig", "members"), "open")
    # at the threshold, 4.5 standard deviations below the expected agreement
    least = math.floor(SAMPLES * threshold - 4.5 * math.sqrt(SAMPLES * threshold * (1 - threshold)))
    few = cut(inside.select("bucket", "content").join(open_.where(F.col("members") <= SMALL).drop("family", "members"), "content"), "few")
    large = open_.where(F.col("members") > SMALL)
    more = met(few, "bucket", least)
    if not large.isEmpty():
        more = more.unionByName(apart(large, texts, weights, threshold, width, least)).distinct()
    return components(found.unionByName(similar(more, texts, weights, threshold, width)))


def met(members: DataFrame, key: str, least: int, more: Column | None = None) -> DataFrame:
    """(a, b): pairs that have a key in common, are in different classes and agree in at least ``least`` samples."""
    x, y = members.alias("x"), members.alias("y")
    agree = F.size(F.filter(F.zip_with("x.sig", "y.sig", lambda i, j: i == j), lambda same: same)) >= least
    pairs = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.content") < F.col("y.content")) & (F.col("x.root") != F.col("y.root"))
                   & (F.lit(True) if more is None else more) & agree)
    return pairs.select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()


def apart(large: DataFrame, texts: DataFrame, weights, threshold: float, width: int, least: int) -> DataFrame:
    """(a, b): pairs of a family's members that may be similar though in different classes, without comparing all with all.

    Let m be the shingles that more than half of the family hold (a shingle's second occurrence counts as another one). What x
    lacks of m and what it has beyond m are its features, of weight l and h. Then w(x) = w(m) - l + h, and x and y share
    w(m) - l(x) - l(y) plus the weight of the features they have in common. With s = threshold / (1 + threshold) and
    cost = (1 - s) l + s h they are similar exactly if cost(x) + cost(y) - common <= (1 - 2 s) w(m). So

    * members whose costs alone do are all similar to the member with the least cost, which is the pair that is returned;
    * any other similar pair has features in common that weigh at least ``need`` = cost + least cost - (1 - 2 s) w(m). Features
      are sorted by how many members have them, rarest first: the rarest one in common is followed by features of at least
      that weight, so only such features of a member are keys, and pairs meet at a key.

    A feature of one member alone is no key. Where no shingle is held by most, this is prefix filtering of the whole sets."""
    s = threshold / (1 + threshold)

    def expand(batch):
        out = []
        for text, often in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            hashes, counts = shingle_counts(text, width)
            place = np.concatenate([np.arange(n) for n in counts]) if counts.max(initial=0) > 1 else np.zeros(len(hashes), np.int64)
            keys = mix(np.repeat(hashes, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            weigh = np.repeat(weights.value.each(hashes, often), counts)
            out.append([{"f": f, "w": w} for f, w in zip(keys.view(np.int64).tolist(), weigh.tolist(), strict=True)])
        return {"content": batch.column(0), "family": batch.column(1), "members": batch.column(4), "sets": out}

    rows = large.join(texts, "content").select("content", "family", "text", "often", "members")
    sets = cut(map_batches(rows, expand, "content binary, family binary, members long, sets array<struct<f:long,w:double>>"), "sets")
    each = sets.select("content", "family", "members", F.explode("sets").alias("x")).select("content", "family", "members", "x.f", "x.w")
    counts = cut(each.groupBy("family", "f").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max("members").alias("members"))
                 .where("n > 1"), "counts")
    most = counts.where(F.col("n") * 2 > F.col("members"))
    most = cut(most.groupBy("family").agg(F.collect_list(F.struct("f", "w")).alias("most"),
                                          F.sum("w").alias("whole")), "most")
    # a family's list is about as long as one of its texts, so it is shipped for a bounded number of families only
    joined = sets.join(lookup(most, 1000), "family", "left").select("content", "family", F.coalesce("whole", F.lit(0.0)).alias("whole"), "most", "sets")

    def differ(batch):
        out = {name: [] for name in ("lacked", "beyond", "cost")}
        pick = lambda items, name, kind: np.array([x[name] for x in items], kind)
        for held, own in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            theirs, mine = pick(held or [], "f", np.int64), pick(own, "f", np.int64)
            lacks, more = ~np.isin(theirs, mine), ~np.isin(mine, theirs)
            out["lacked"].append(theirs[lacks])
            out["beyond"].append(mine[more])
            out["cost"].append(float((1 - s) * pick(held or [], "w", float)[lacks].sum() + s * pick(own, "w", float)[more].sum()))
        return {**{name: batch.column(k) for k, name in enumerate(("content", "family", "whole"))}, **out}

    costed = cut(map_batches(joined, differ, "content binary, family binary, whole double, lacked array<long>, beyond array<long>, cost double"), "costed")
    centre = cut(costed.groupBy("family").agg(F.min(F.struct("cost", "content")).alias("centre")), "centre")
    known = costed.join(lookup(centre), "family").withColumn("need", F.col("cost") + F.col("centre.cost") - (1 - 2 * s) * F.col("whole"))
    near = known.where((F.col("need") <= 1e-9) & (F.col("content") != F.col("centre.content"))).select(*pair("content", "centre.content"))
    keys = (known.select("content", "family", "need", "cost", F.explode("beyond").alias("f"), F.lit(False).alias("lacks"))
            .unionByName(known.select("content", "family", "need", "cost", F.explode("lacked").alias("f"), F.lit(True).alias("lacks"))))
    shared = keys.join(counts, ["family", "f"]).withColumn("n", F.when(F.col("lacks"), F.col("members") - F.col("n")).otherwise(F.col("n"))).where("n > 1")
    later = Window.partitionBy("family", "content").orderBy("n", "f").rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy("family", "content")
    prefix = shared.select("content", "family", "f", "need", "cost", F.sum("w").over(later).alias("left"), F.sum("w").over(total).alias("all")).where(F.col("left") >= F.col("need") - 1e-9)
    limits = costed.select("content", F.col("whole"))
    at = cut(prefix.select("content", F.xxhash64("family", "f").alias("key"), "cost", "all").join(limits, "content")
             .join(large.select("content", "root", "sig"), "content"), "prefix")
    enough = F.col("x.cost") + F.col("y.cost") - F.least("x.all", "y.all") <= (1 - 2 * s) * F.col("x.whole") + 1e-9
    return met(at, "key", least, enough).unionByName(near).distinct()


def pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, rate: float = 1e-3) -> DataFrame:
    """(doc_id, class_id, class_size, class_texts, kept, file, row), one row for each row of ``docs``.

    Classes are the connected components of equal texts and of texts whose weighted Jaccard similarity is at least
    ``threshold``. ``class_id`` is the smallest id in the class (null if all are null); the row that carries it stays, of
    repeated rows the one stored first. Null counts as empty; texts without a word are alike only if equal; a text of fewer
    words than ``width`` is one shingle. No rows: no rows. Columns besides ``doc_id`` and ``text`` are not read."""
    rows = located(docs)
    context = docs.sparkSession.sparkContext
    shipped, rest = frequencies(docs, width, rate)
    weights = context.broadcast(shipped)
    keyed = known_often(rows.select("doc_id", "file", "row", content_key().alias("content"), F.coalesce("text", F.lit("")).alias("text")), rest, width)
    all_rows = sketches(keyed, weights, width)
    nodes = cut(all_rows.groupBy("content").agg(F.min(F.struct("file", "row")).alias("place"), F.max("sig").alias("sig")), "nodes")
    found = links(nodes, keyed, weights, threshold, width)
    classed = cut(all_rows.join(lookup(found), F.col("content") == F.col("node"), "left").select(
        "doc_id", "file", "row", "content", F.coalesce("root", "content").alias("class")), "classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("first")
    texts = classed.groupBy("class", "content").agg(F.count(F.lit(1)).alias("n"), first)
    sizes = cut(texts.groupBy("class").agg(F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("class_texts"), F.min("first").alias("first")), "sizes")
    stays = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    return classed.join(sizes, "class").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "class_texts",
                                               stays.alias("kept"), "file", "row")


def deduplicate(docs: DataFrame, **more) -> DataFrame:
    """One row of each class, with all its columns. ``docs`` must be a file scan (see ``located``)."""
    meta = docs.metadataColumn("_metadata")
    file, row = fresh(docs, "file"), fresh(docs, "row")
    dropped = cut(classes(docs, **more).where(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row)), "dropped")
    return docs.join(lookup(dropped), (meta["file_path"] == F.col(file)) & (meta["row_index"] == F.col(row)), "left_anti")
