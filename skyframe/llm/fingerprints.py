"""Order MinHash fingerprints of texts, in built-in functions only.

Every run of ``K`` code points is numbered by its occurrence, so a repeated run counts as often as it stands in the text. The
pairs of run and number are hashed; the hashes fall into ``BINS`` bins, and of each bin the ``EACH`` smallest are selected,
put back into text order and hashed as a tuple. Two fingerprints agree in a bin when the same runs are minimal there in
the same order, so their likeness falls with edits and with moved text, which a set of runs would not notice.

One sorted array of 64-bit values does the work for a text: the upper bits are a hash, the lower ones the position, so equal
runs stand side by side in text order. Bins are filled from the ``POOL`` smallest pairs; a bin that these do not fill keeps a
shorter tuple, one they do not reach is empty."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.llm.common import located

K, BINS, EACH, POOL = 8, 64, 2, 448
#: Bits of a value: bin, order within the bin, position. A place beyond 2^25 bytes, 8,388,608
#: code points, runs over into the hash, which keeps equal texts equal.
BIN_BITS, ORDER_BITS, PLACE_BITS = 6, 33, 25
PLACE, ORDER = (1 << PLACE_BITS) - 1, (1 << ORDER_BITS) - 1

#: Each step reads columns of the steps before and is a projection of its own, so that nothing is worked out twice.
STEPS = (
    ("points", "encode(coalesce({text}, ''), 'UTF-32')"),
    # the outer lambda holds the bytes once; a column would be copied out of its row for every run. A place is the offset in bytes
    ("runs", f"sort_array(flatten(transform(array(points), p -> transform(sequence(1, greatest(octet_length(p) - {4 * K}, 0) + 1, 4), "
             f"i -> (xxhash64(substring(p, i, {4 * K})) & {~PLACE}) + i))))"),
    # each run beside the one before: an element that a lambda looks up by its index costs more
    ("again", f"array_compact(zip_with(slice(runs, 2, size(runs)), runs, (v, u) -> IF(shiftright(v ^ u, {PLACE_BITS}) = 0, v, NULL)))"),
    ("heads", f"filter(transform(again, (v, i) -> IF(shiftright(v, {PLACE_BITS}) = shiftright(get(again, i - 1), {PLACE_BITS}), -1, i)), i -> i >= 0)"),
    ("numbered", "flatten(transform(heads, (b, r) -> transform(slice(again, b + 1, coalesce(get(heads, r + 1), size(again)) - b), "
                 f"(v, o) -> (xxhash64(v & {~PLACE}, o + 1) & {~PLACE}) | (v & {PLACE}))))"),
    ("pool", f"slice(sort_array(concat(array_except(slice(runs, 1, {POOL} + size(again)), again), numbered)), 1, {POOL})"),
    ("binned", f"sort_array(transform(pool, v -> shiftleft((shiftright(v, {PLACE_BITS}) & {BINS - 1}) - {BINS // 2}, {64 - BIN_BITS}) "
               f"| shiftleft(shiftright(v, {PLACE_BITS + BIN_BITS}) + {1 << ORDER_BITS - 1}, {PLACE_BITS}) | (v & {PLACE})))"),
    ("starts", f"filter(transform(binned, (q, i) -> IF(i = 0 OR shiftright(q, {64 - BIN_BITS}) != shiftright(get(binned, i - 1), {64 - BIN_BITS}), "
               "i, -1)), i -> i >= 0)"),
    ("tuples", f"transform(starts, (b, r) -> transform(sort_array(transform(slice(binned, b + 1, least({EACH}, coalesce(get(starts, r + 1), size(binned)) - b)), "
               f"q -> shiftleft(q & {PLACE}, {ORDER_BITS}) | (shiftrightunsigned(q, {PLACE_BITS}) & {ORDER}))), c -> c & {ORDER}))"),
    ("filled", f"transform(starts, b -> CAST(shiftright(get(binned, b), {64 - BIN_BITS}) + {BINS // 2} AS INT))"),
    ("hashed", "transform(tuples, t -> CAST(shiftright(xxhash64(t), 32) AS INT))"),
    # most texts fill all bins, so nothing is looked for
    ("{out}", f"IF(size(filled) = {BINS}, hashed, transform(sequence(0, {BINS - 1}), j -> get(hashed, CAST(nullif(array_position(filled, j), 0) - 1 AS INT))))"),
)


def sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: an array of one integer for each bin, null for an empty one. A text below ``K`` code points,
    null counting as empty, is one run. The names of ``STEPS`` must be free in ``df``."""
    kept = df.columns
    for name, step in STEPS:
        df = df.withColumn(name.format(out=out), F.expr(step.format(text=text)))
    return df.select(*kept, out)


def shown(sketch: Column | str) -> Column:
    """A sketch as text: eight hexadecimal digits for each bin, dots for an empty one."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.coalesce(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lit("........"))), ""))


def likeness(a: str, b: str) -> Column:
    """The share of the bins filled in either sketch that agree, 0 to 1."""
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    same = F.size(F.filter(bins, lambda j: F.get(a, j) == F.get(b, j)))
    filled = F.size(F.filter(bins, lambda j: F.get(a, j).isNotNull() | F.get(b, j).isNotNull()))
    return same / filled


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint), one row for each row of ``docs``. Null texts are empty; null and repeated ids pass through;
    equal texts have equal fingerprints; no rows: no rows. Other columns are not read."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sketch(rows, "text", "sketch").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), shown("sketch").alias("fingerprint"))


def ranges(rows: DataFrame, count: int) -> list:
    """The first key (doc_id, f, row) of each of at most ``count`` ranges of about as many rows, in order."""
    dealt = rows.select("doc_id", "f", "row").repartitionByRange(count, "doc_id", "f", "row")
    return sorted((tuple(r["first"]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "f", "row")).alias("first")).collect()),
                  key=lambda k: (k[0] is not None, k[0] or 0, *k[1:]))


def numbered_range(firsts: list) -> tuple[Column, Column]:
    """The number of the range that a row's key is in, found in two steps, and whether the row is the first of it."""
    step = max(1, math.isqrt(len(firsts)))
    chunks = [firsts[i:i + step] for i in range(0, len(firsts), step)]
    kind = "struct<doc_id:bigint,f:bigint,row:bigint>"
    fields = lambda k: dict(zip(("doc_id", "f", "row"), k, strict=True))
    nested = F.from_json(F.lit(json.dumps([[fields(k) for k in c] for c in chunks])), f"array<array<{kind}>>")
    coarse = F.from_json(F.lit(json.dumps([fields(c[0]) for c in chunks])), f"array<{kind}>")
    key = F.struct("doc_id", "f", "row")
    chunk = F.size(F.filter(coarse, lambda k: k <= key)) - 1
    place = F.size(F.filter(F.get(nested, chunk), lambda k: k <= key)) - 1
    return chunk * step + place, F.get(F.get(nested, chunk), place) == key


def with_next(rows: DataFrame, *columns: str, count: int | None = None) -> DataFrame:
    """``rows`` (doc_id, file, row and others) with ``next_<column>``: that column of the row that follows in ascending ``doc_id``, the
    first row's for the last one. Ties are ordered by place; null ids come first.

    Rows go to ranges of about as many rows, so no id is hot; the first row of a range also closes the range before."""
    spark = rows.sparkSession
    placed = rows.withColumn("f", F.xxhash64("file")).drop("file")
    count = count or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 50_000)
    firsts = ranges(placed, count)
    if not firsts:
        return placed.drop("f", "row").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    number, is_first = numbered_range(firsts)
    before = F.pmod(F.col("range") - 1, F.lit(len(firsts)))
    own, closing = F.struct("range", F.lit(False).alias("closing")), F.struct(before.alias("range"), F.lit(True).alias("closing"))
    dealt = (placed.withColumn("range", number).withColumn("first", is_first)
             .withColumn("at", F.explode(F.when(F.col("first"), F.array(own, closing)).otherwise(F.array(own)))).drop("range", "first"))
    order = Window.partitionBy("at.range").orderBy("at.closing", "doc_id", "f", "row")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("NOT at.closing").drop("f", "row", "at")


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of ``docs``.

    ``edited`` is the text whose last quarter (rounded down) of code points is replaced by the first as many of the next document,
    or all of it where that is shorter; ``near_edited`` and ``near_next`` compare the fingerprint with that of the edited text
    and of the next document. The next one of the last is the first, so a single row follows itself. Null texts are empty;
    rows that repeat an id are ordered by where they are stored; no rows: no rows. Other columns are not read."""
    rows = located(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    both = with_next(sketch(rows, "text", "sketch"), "text", "sketch").withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    left = F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    changed = both.withColumn("edited", F.concat(left, F.substring("next_text", F.lit(1), quarter)))
    compared = sketch(changed, "edited", "edited_sketch")
    return compared.select("doc_id", "n_chars", "edited", shown("sketch").alias("fingerprint"), shown("edited_sketch").alias("edited_fingerprint"),
                           likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
