"""Collocations: phrases of two to five words that stand together more often than their parts would by chance.

Four passes over the texts, all in Spark tasks over Arrow batches:

1. words are counted for each language;
2. neighbours that are both frequent are counted by the hash of the pair, an upper bound for the pair;
3. where all neighbours in a row reach the least count, their runs of three to five words are counted by hash too. What
   reaches the least count in 2 and 3 are the candidates; by Apriori no other phrase can be frequent, since a frequent
   phrase has only frequent parts;
4. the candidates, spelled in one more pass, become double-array tries, one for each so many first words. They are broadcast
   together; for each trie numpy advances the states of all positions of a batch that begin there at once, level by level, and counts the
   accepting states, and the counts of all batches are added up. These counts are by words, not by hashes of phrases. Only
   candidates that one driver cannot hold are cut into shards, a pass over the texts for each.

In tries and texts a word stands for itself by 64 bits of hash; frequent words with equal hashes are told apart by another seed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from skyframe.llm.common import cut, small_batches

#: Bytes that end a piece, and that part words in it.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 5
#: Words, pairs and runs that a task holds before it hands their counts on.
HELD = 400_000
#: Keys that are shipped as they are, 8 bytes each, and the words of the bitmap that stands for more, 32 MB.
SHIPPED_KEYS, BITMAP = 2_000_000, 1 << 22
#: Candidates in one trie, about; in a large one a place for the many children of a state is hard to find.
TRIE = 32_768
#: Candidates counted in one pass over the texts, some 150 bytes each on the driver and 60 in a task; more take a pass for each so many.
SHARD = 3_000_000
#: Phrases whose counts go together, and parts in which the tasks' counts are added up first.
CHUNK, PARTS = 1024, 64
WORD, BREAK = 0, 2
#: Places of a trie looked at in one go for a state's children, and children up to which states get their places in draws, all at once.
WINDOW, DRAWN = 256, 16
KINDS = np.array([BREAK if c in ENDS else 1 if c in BLANKS else WORD for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPLIT = bytes(32 if KINDS[c] else LOWER[c] for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of the words in an array of bytes: a polynomial in the bytes, by a base that follows from the seed."""

    def __init__(self, seed: int = 0):
        self.base = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * seed) % (1 << 64) | 1)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        sizes = ends - starts
        longest = int(sizes.max())
        if longest > len(self.powers):
            self.powers = np.full(longest + 1, self.base, np.uint64)
            self.powers[0] = 1
            self.powers = np.cumprod(self.powers, dtype=np.uint64)
        first = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        values = (data[np.repeat(starts, sizes) + inside].astype(np.uint64) + np.uint64(1)) * self.powers[inside]
        return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))

    def of(self, words: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.empty(0, np.int64)
        return self(data, ends - np.array([len(w) for w in words], np.int64), ends)


@dataclass
class Words:
    """The words of some texts in a row: hash, whether a piece goes on after it, and number of the text."""
    hashes: np.ndarray
    joined: np.ndarray
    text: np.ndarray


def words_of(texts: pa.Array, hasher: Hasher) -> Words:
    """All words of a binary array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kinds = KINDS[data]
    inside = kinds == WORD
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here = np.zeros(len(data) + 1, bool)
    ends_here[1:] = inside
    ends_here[:-1] &= ~inside
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    starts_here[cuts] |= inside[cuts]
    ends_here[cuts] |= inside[cuts] & (cuts > 0) & inside[cuts - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    # a piece ends between two words that have a break or the end of a text between them
    breaks = np.concatenate(([0], np.cumsum(kinds == BREAK)))
    text = np.searchsorted(offsets, starts, "right") - 1
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (text[1:] == text[:-1])
    return Words(hasher(LOWER[data], starts, ends), joined, text)


def gathered(keys: np.ndarray, counts: np.ndarray | None, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts (None: ones) and the smallest of its owners."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[:len(keys)]
    if not len(first):
        return keys, np.empty(0, np.int64), owners
    sums = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts[order], first)
    return keys[first], sums, np.minimum.reduceat(owners[order], first)


class Held:
    """Counts and smallest owners of 64-bit keys, merged whenever they become many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, owners: np.ndarray) -> None:
        self.parts.append(gathered(keys, None, owners))
        self.rows += len(self.parts[-1][0])
        if self.rows > 4 * HELD:
            self.merge()

    def merge(self) -> None:
        self.parts = [gathered(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.rows = len(self.parts[0][0])

    def take(self):
        """All counts so far, a batch at a time."""
        if self.parts:
            self.merge()
            (keys, counts, owners), = self.parts
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield {"key": keys[part].view(np.int64), "n": counts[part], "owner": owners[part]}
        self.parts, self.rows = [], 0


def map_counts(df: DataFrame, start, schema: str) -> DataFrame:
    """``mapInArrow`` with ``start()`` giving two functions: one takes a batch, one gives what has been counted."""
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        take, give = start()

        def told(last):
            for columns in give(last):
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

        for batch in batches:
            take(batch)
            yield from told(False)
        yield from told(True)

    return df.mapInArrow(run, out)


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, lower-cased. ``texts`` has lang (string) and text (binary), without nulls."""
    def start():
        counts: dict[str, Counter] = {}

        def take(batch):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.translate(SPLIT).split())

        def give(last):
            if last or sum(map(len, counts.values())) > HELD:
                for lang, found in counts.items():
                    yield {"lang": [lang] * len(found), "word": list(found.keys()), "n": list(found.values())}
                counts.clear()
        return take, give

    return map_counts(texts, start, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def lang_keys(langs: list[str], seed: int) -> np.ndarray:
    return Hasher(seed + 1).of([lang.encode() for lang in langs])


@dataclass
class Keys:
    """A set of 64-bit keys: sorted, with their owners if they have some, or beyond ``SHIPPED_KEYS`` a bitmap of ``BITMAP`` words,
    which holds a few more."""
    keys: np.ndarray | None
    bits: np.ndarray | None = None
    owners: np.ndarray | None = None

    def __getstate__(self):
        return {"keys": self.keys, "bits": self.bits, "owners": self.owners}

    @cached_property
    def buckets(self) -> np.ndarray:
        """For each beginning of a key (``shift``: the bits after it) the first key that has it or a larger one."""
        return np.searchsorted(self.keys >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    @cached_property
    def shift(self) -> np.uint64:
        return np.uint64(64 - max(1, len(self.keys).bit_length()))

    def places(self, values: np.ndarray) -> np.ndarray:
        """The place of each value among the keys, -1 where it is none. Hashes lie evenly, so few keys begin alike."""
        if not len(self.keys):
            return np.full(len(values), -1)
        top = (values >> self.shift).astype(np.int64)
        at = self.buckets[top].astype(np.int64)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        out = np.where(found == values, at, -1)
        rest = np.flatnonzero((found < values) & (at < len(self.keys)))
        at, end, wanted = at[rest] + 1, self.buckets[top[rest] + 1], values[rest]
        for _ in range(8):
            on = at < end
            if not on.all():
                rest, at, end, wanted = rest[on], at[on], end[on], wanted[on]
            if not len(rest):
                return out
            found = self.keys[at]
            hit = found == wanted
            out[rest[hit]] = at[hit]
            on = found < wanted
            rest, at, end, wanted = rest[on], at[on] + 1, end[on], wanted[on]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        out[rest] = np.where(self.keys[at] == wanted, at, -1)
        return out

    @classmethod
    def of(cls, df: DataFrame) -> Keys:
        if df.count() <= SHIPPED_KEYS:
            found = df.select("key", *({"owner"} & set(df.columns))).toArrow()
            keys, *owners = (np.array(c.to_numpy(), np.int64) for c in found.columns)
            keys, at = np.unique(keys.view(np.uint64), return_index=True)
            return cls(keys, None, owners[0][at] if owners else None)
        word, bit = F.shiftright("key", 6).bitwiseAND(BITMAP - 1), F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
        found = df.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(BITMAP, np.int64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        return cls(None, bits.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            words = self.bits[((values >> np.uint64(6)) & np.uint64(BITMAP - 1)).astype(np.int64)]
            return (words >> (values & np.uint64(63))) & np.uint64(1) == 1
        return self.places(values) >= 0


def owners_of(words: Words) -> np.ndarray:
    """For each word a hash of its text's words in their order, which does not depend on where the text is stored."""
    if not len(words.text):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, words.text[1:] != words.text[:-1]])
    sizes = np.diff(np.r_[first, len(words.text)])
    place = np.arange(len(words.text)) - np.repeat(first, sizes)
    sums = np.add.reduceat(mix(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return np.repeat(mix(sums).view(np.int64), sizes)


def batch_words(batch: pa.RecordBatch, hasher: Hasher, seed: int) -> tuple[Words, np.ndarray]:
    """The words of a batch (lang, text), and each word's language as a key."""
    words = words_of(batch.column(1), hasher)
    langs = batch.column(0).dictionary_encode()
    keys = lang_keys(langs.dictionary.to_pylist(), seed)
    return words, keys[langs.indices.to_numpy()][words.text] if len(words.text) else np.empty(0, np.uint64)


def runs(hashes: np.ndarray, alive: np.ndarray, lang: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a run of ``length`` words starts whose neighbours are all alive, and the runs' hashes."""
    ok = alive[:len(alive) - length + 2].copy()
    for k in range(1, length - 1):
        ok &= alive[k:len(alive) - length + 2 + k]
    at = np.flatnonzero(ok)
    key = lang[at] + np.uint64(length)
    for k in range(length):
        key = mix(key) * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    return at, mix(key)


def count_runs(texts: DataFrame, lengths: tuple[int, ...], seed: int, common, pairs) -> DataFrame:
    """(length, key, n, owner): runs of words by hash, of which all words are in ``common`` and, from three words on, all neighbours in
    ``pairs``; broadcast ``Keys``. The owner is the smallest ``owners_of`` of the texts that hold the run."""
    def start():
        hasher, held = Hasher(seed), {n: Held() for n in lengths}

        def take(batch):
            words, lang = batch_words(batch, hasher, seed)
            frequent = common.value.has(mix(words.hashes ^ lang))
            alive = words.joined[:-1] & frequent[:-1] & frequent[1:]
            if pairs is not None:
                at, keys = runs(words.hashes, alive, lang, 2)
                alive[at] = pairs.value.has(keys)
            owners = owners_of(words)
            for n in lengths:
                if len(words.hashes) >= n:
                    at, keys = runs(words.hashes, alive, lang, n)
                    held[n].add(keys, owners[at])

        def give(last):
            for n, counts in held.items():
                if last or counts.rows > HELD:
                    for part in counts.take():
                        yield {"length": np.full(len(part["n"]), n, np.int64)} | part
        return take, give

    told = map_counts(texts, start, "length long, key long, n long, owner long")
    return told.groupBy("length", "key").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


def spell_runs(texts: DataFrame, seed: int, common, pairs, wanted) -> DataFrame:
    """(lang_key, words) of the runs whose key is in ``wanted`` (broadcast ``Keys`` for each length), each by the text that
    owns it, so about once in all; beyond ``SHIPPED_KEYS`` about once a task. Neighbours in longer runs are in ``pairs`` or, where
    that is None, in what is wanted of length 2, if anything is."""
    def start():
        hasher, told, fresh, names = Hasher(seed), {}, [], set()

        def take(batch):
            words, lang = batch_words(batch, hasher, seed)
            frequent = common.value.has(mix(words.hashes ^ lang))
            alive = words.joined[:-1] & frequent[:-1] & frequent[1:]
            if pairs is not None:
                at, keys = runs(words.hashes, alive, lang, 2)
                alive[at] = pairs.value.has(keys)
            owners = owners_of(words)
            for length, own in sorted(wanted.value.items()):
                if len(words.hashes) < length:
                    continue
                at, keys = runs(words.hashes, alive, lang, length)
                if own.bits is None:
                    places = own.places(keys)
                    if length == 2 and pairs is None:
                        alive[at] = places >= 0
                    known = told.setdefault(length, np.zeros(len(own.keys), bool))
                    hit = np.flatnonzero(places >= 0)
                    hit = hit[~known[places[hit]]]
                    if own.owners is not None:
                        hit = hit[own.owners[places[hit]] == owners[at[hit]]]
                    places, first = np.unique(places[hit], return_index=True)
                    known[places] = True
                    at = at[hit[first]]
                    rows = np.stack([lang[at], *(words.hashes[at + k] for k in range(length))], 1)
                else:
                    held = own.has(keys)
                    if length == 2 and pairs is None:
                        alive[at] = held
                    at = at[held]
                    rows = np.unique(np.stack([lang[at], *(words.hashes[at + k] for k in range(length))], 1), axis=0)
                    new = [i for i, row in enumerate(rows) if (name := row.tobytes()) not in names and not names.add(name)]
                    rows = rows[new]
                if len(rows):
                    fresh.append(rows.view(np.int64))

        def give(last):
            for rows in fresh:
                ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] - 1)
                yield {"lang_key": rows[:, 0], "words": pa.ListArray.from_arrays(ends, np.ascontiguousarray(rows[:, 1:]).ravel())}
            fresh.clear()
            if len(names) > HELD:
                names.clear()
        return take, give

    return map_counts(texts, start, "lang_key long, words array<long>")


@dataclass
class Trie:
    """A double array: the child of state s by symbol c is base[s] + c if its check is s. Symbols are places in ``symbols``, the
    sorted keys of languages and words; the first symbol of a path is the language. ``accepts`` holds, for the states that end a
    phrase, its number, -1 for others."""
    symbols: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray

    @classmethod
    def of(cls, paths: list[np.ndarray]) -> Trie:
        """``paths``: for each phrase the keys of its language and words, no two alike."""
        sizes = np.array([len(p) for p in paths], np.int64)
        return cls.laid(*coded_paths(np.concatenate(paths) if paths else np.empty(0, np.uint64), sizes))

    @classmethod
    def laid(cls, symbols: np.ndarray, codes: np.ndarray) -> Trie:
        """``codes``: for each phrase the places of its keys in ``symbols``, -1 after its end.

        The states are found level by level first. Then each state's children get places: those of many children one state after the
        other, at the first free places that fit; those of up to ``DRAWN`` children in draws, all states of as many children at once:
        what was drawn twice or is taken is drawn anew; single children fill what is free."""
        width, node, count = max(len(symbols), 1), np.zeros(len(codes), np.int64), 1
        parents, edges = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for level in range(codes.shape[1]):
            alive = np.flatnonzero(codes[:, level] >= 0)
            found, which = np.unique(node[alive] * width + codes[alive, level], return_inverse=True)
            parents.append(found // width)
            edges.append(found % width)
            node[alive] = count + which.ravel()
            count += len(found)
        parent, edge = np.concatenate(parents), np.concatenate(edges)
        size = 2 * count + 16
        check, place = np.full(size + width, -1, np.int32), np.zeros(count, np.int64)
        check[0] = 0
        # the children of a state follow each other, as the states of a level are in the order of their parents
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])[:len(parent)]
        fan = np.diff(np.r_[first, len(parent)])
        # children k have the number k + 1, as the root is 0; marked with 0, their check follows when all have places
        def put(groups: np.ndarray, at: np.ndarray) -> None:
            """The children of ``groups``, all of as many, go to ``at``."""
            check[at] = 0
            place[1 + first[groups][:, None] + np.arange(at.shape[1])] = at

        def fitted(group: int, cursor: int) -> int:
            nonlocal check
            own = edge[first[group]:first[group] + fan[group]]
            while True:
                # the smallest symbol goes to a free place; all others must be free too
                if cursor + WINDOW + width > len(check):
                    check = np.concatenate([check, np.full(len(check) + WINDOW + width, -1, np.int32)])
                free = cursor + np.flatnonzero(check[cursor:cursor + WINDOW] < 0)
                fits = (check[free[:, None] + (own - own[0])[None, :]] < 0).all(axis=1)
                if fits.any():
                    put(np.array([group]), (free[np.argmax(fits)] + own - own[0])[None, :])
                    return cursor
                cursor += WINDOW

        cursor, rng = 1, np.random.default_rng(count)
        wide = np.flatnonzero(fan > DRAWN)
        for group in wide[np.argsort(-fan[wide], kind="stable")].tolist():
            cursor = fitted(group, cursor)
        for n in range(DRAWN, 1, -1):
            left = np.flatnonzero(fan == n)
            for _ in range(60):
                if not len(left):
                    break
                free = np.flatnonzero(check[:size] < 0)
                some = left[:max(64, len(free) // (4 * n))]
                own = edge[first[some][:, None] + np.arange(n)]
                at = free[rng.integers(0, len(free), len(some))][:, None] + own - own[:, :1]
                good = np.flatnonzero((check[at] < 0).all(axis=1))
                flat = at[good].ravel()
                order = np.argsort(flat, kind="stable")
                twice = order[1:][flat[order][1:] == flat[order][:-1]]
                good = np.delete(good, np.unique(twice // n))
                put(some[good], at[good])
                left = np.concatenate([np.delete(some, good), left[len(some):]])
            for group in left.tolist():
                cursor = fitted(group, cursor)
        single = np.flatnonzero(fan == 1)
        put(single, np.flatnonzero(check < 0)[:len(single)][:, None])
        base, accepts = np.zeros(len(check), np.int32), np.full(len(check), -1, np.int32)
        check[place[1:]] = place[parent]
        base[place[parent[first]]] = place[1 + first] - edge[first]
        accepts[place[node]] = np.arange(len(codes))
        used = int(place.max()) + 1
        return cls(symbols, base[:used].copy(), check[:used].copy(), accepts[:used].copy())

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states' children by the symbols (-1: no symbol), -1 where there is none."""
        to = self.base[states] + symbols
        ok = (symbols >= 0) & (to >= 0) & (to < len(self.check))
        to = np.where(ok, to, 0)
        return np.where(ok & (self.check[to] == states) & (to > 0), to, -1)

    @cached_property
    def index(self) -> Keys:
        return Keys(self.symbols)

    def coded(self, keys: np.ndarray) -> np.ndarray:
        return self.index.places(keys)

    def reached(self, words: Words, lang: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The states reached from the positions ``at``, length by length, each as often as it is reached."""
        states = self.step(np.zeros(len(at), np.int64), self.coded(lang[at]))
        while len(at):
            on = states >= 0
            at, states = at[on], states[on]
            states = self.step(states, self.coded(words.hashes[at]))
            alive = states >= 0
            at, states = at[alive], states[alive]
            yield states
            on = words.joined[at]
            at, states = at[on] + 1, states[on]


def coded_paths(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and a row of their places for each path, -1 after its end; ``keys`` has the paths one after the other."""
    symbols = np.unique(keys)
    codes = np.full((len(sizes), int(sizes.max(initial=0))), -1, np.int32)
    first = np.cumsum(sizes) - sizes
    codes[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(keys)) - np.repeat(first, sizes)] = Keys(symbols).places(keys)
    return symbols, codes


def summed(table: pa.Table) -> np.ndarray:
    """The sum of the arrays of counts in a group; they have one length."""
    counts = table.column("counts").combine_chunks()
    return counts.flatten().to_numpy().reshape(len(counts), -1).sum(axis=0)


def shard_codes(shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``coded_paths`` of phrases (lang_key, words)."""
    words = shard.column("words").combine_chunks()
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1
    keys = np.empty(int(sizes.sum()), np.uint64)
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(keys), bool)
    inside[begins] = False
    keys[begins] = shard.column("lang_key").to_numpy().view(np.uint64)
    keys[inside] = words.flatten().to_numpy().view(np.uint64)
    return coded_paths(keys, sizes)


@dataclass
class Forest:
    """Tries of phrases by their language and first word, as many as a power of two; ``first`` numbers each trie's phrases on."""
    tries: list[Trie]
    first: np.ndarray

    @classmethod
    def of(cls, shard: pa.Table) -> tuple[Forest, pa.Table]:
        """The tries of phrases (lang_key, words), and the phrases in the order of their numbers."""
        several = 1 << max(0, (len(shard) - 1) // TRIE).bit_length()
        heads = pc.list_element(shard.column("words"), 0).to_numpy().view(np.uint64)
        home = cls.homes(heads, shard.column("lang_key").to_numpy().view(np.uint64), several)
        order = np.argsort(home, kind="stable")
        first = np.searchsorted(home[order], np.arange(several + 1))
        shard = shard.take(pa.array(order)).combine_chunks()
        return cls([Trie.laid(*shard_codes(shard.slice(a, b - a))) for a, b in zip(first[:-1], first[1:], strict=True)], first), shard

    @staticmethod
    def homes(heads: np.ndarray, lang: np.ndarray, several: int) -> np.ndarray:
        return ((heads ^ lang) & np.uint64(several - 1)).astype(np.uint16 if several <= 1 << 16 else np.uint32)

    def reached(self, words: Words, lang: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(trie, states reached in it) from any position from which a piece goes on."""
        at = np.flatnonzero(words.joined)
        home = self.homes(words.hashes[at], lang[at], len(self.tries))
        order = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[order], np.arange(len(self.tries) + 1))
        for k, trie in enumerate(self.tries):
            for states in trie.reached(words, lang, at[order[ends[k]:ends[k + 1]]]):
                yield k, states


def count_phrases(texts: DataFrame, shard: pa.Table, seed: int) -> DataFrame:
    """(lang_key, words, n) of a shard's phrases (lang_key, words) that occur.

    A task tells its counts as arrays, one for each run of ``CHUNK`` phrases; they are added up in two steps, so that a group is some
    hundredths of the tasks' arrays at most."""
    forest, shard = Forest.of(shard)
    ship = texts.sparkSession.sparkContext.broadcast
    shipped, spelled = ship(forest), ship(shard)

    def start():
        from pyspark import TaskContext

        forest = shipped.value
        hasher, total = Hasher(seed), [np.zeros(len(trie.check), np.int64) for trie in forest.tries]
        part = TaskContext.get().partitionId() % PARTS

        def take(batch):
            for k, states in forest.reached(*batch_words(batch, hasher, seed)):
                np.add.at(total[k], states, 1)

        def give(last):
            if last and any(t.any() for t in total):
                counts = np.zeros(forest.first[-1], np.int64)
                for first, trie, reached in zip(forest.first, forest.tries, total, strict=False):
                    states = np.flatnonzero(trie.accepts >= 0)
                    counts[first + trie.accepts[states]] = reached[states]
                for i in range(0, len(counts), 100 * CHUNK):
                    chunks = [counts[k:k + CHUNK] for k in range(i, min(i + 100 * CHUNK, len(counts)), CHUNK)]
                    yield {"chunk": [i // CHUNK + k for k in range(len(chunks))], "part": [part] * len(chunks), "counts": chunks}
        return take, give

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([summed(table)], pa.list_(pa.int64()))})

    def name(table: pa.Table) -> pa.Table:
        counts, first = summed(table), table.column("chunk")[0].as_py() * CHUNK
        found = np.flatnonzero(counts)
        own = spelled.value.take(pa.array(first + found)).combine_chunks()
        words = own.column("words").combine_chunks()
        ends = np.cumsum(np.r_[0, words.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int32)
        return pa.table({"lang_key": own.column("lang_key").cast(pa.int64()), "words": pa.ListArray.from_arrays(ends, words.flatten().cast(pa.int64())), "n": counts[found]})

    told = map_counts(texts, start, "chunk long, part long, counts array<long>")
    parts = told.groupBy("chunk", "part").applyInArrow(add, "chunk long, counts array<long>")
    return parts.groupBy("chunk").applyInArrow(name, "lang_key long, words array<long>, n long")


def keyed_words(words: DataFrame, seed: int) -> DataFrame:
    """``words`` (lang, word, n) with the hashes of language and word, and the key of both."""
    def run(batches):
        hasher = Hasher(seed)
        for batch in batches:
            langs, found = lang_keys(batch.column(0).to_pylist(), seed), hasher.of(batch.column(1).to_pylist())
            keys = [pa.array(k.view(np.int64)) for k in (langs, found, mix(found ^ langs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=["lang", "word", "n", "lang_key", "word_key", "key"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word binary, n long, lang_key long, word_key long, key long")


def candidates(texts: DataFrame, frequent: DataFrame, at_least: int, seed: int) -> DataFrame | None:
    """(lang_key, words) of the runs of 2 to ``LONGEST`` words that can reach ``at_least``, by the keys of their words; None: no run can."""
    ship = texts.sparkSession.sparkContext.broadcast
    common, pairs, wanted = ship(Keys.of(frequent)), None, {}
    for lengths in ((2,), tuple(range(3, LONGEST + 1))):
        counted = cut(count_runs(texts, lengths, seed, common, pairs).where(F.col("n") >= at_least), "runs")
        if counted.isEmpty():
            break
        wanted |= {n: Keys.of(counted.where(F.col("length") == n)) for n in lengths}
        pairs = pairs or ship(wanted[2])
    return cut(spell_runs(texts, seed, common, None, ship(wanted)).distinct(), "spelled") if wanted else None


def frequent_phrases(docs: DataFrame, at_least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 1 to ``LONGEST`` words that occur ``at_least`` times (lang_key, words, n), their words (lang_key, word_key, lang, word),
    and for each language the number of all words (lang, total)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = cut(count_words(texts), "words")
    for seed in range(16):
        frequent = cut(keyed_words(counted.where(F.col("n") >= at_least), seed), "frequent")
        if frequent.select("lang_key", "word_key").distinct().count() == frequent.count():
            break
    phrases = frequent.select("lang_key", F.array("word_key").alias("words"), "n")
    spelled = candidates(texts, frequent, at_least, seed)
    if spelled is not None:
        shards = -(-spelled.count() // SHARD)
        for k in range(shards):
            # at most about SHARD rows
            shard = spelled.where(F.pmod(F.xxhash64("lang_key", "words"), F.lit(shards)) == k).toArrow()
            exact = count_phrases(texts, shard, seed).where(F.col("n") >= at_least)
            phrases = phrases.unionByName(cut(exact, "phrases"))
    return phrases, frequent.select("lang_key", "word_key", "lang", "word"), counted.groupBy("lang").agg(F.sum("n").alias("total"))


def collocations(docs: DataFrame, at_least: int = 100, share: int = 100, limit: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``limit`` phrases of 2 to ``LONGEST`` words.

    ``a`` counts the phrase, at least ``at_least`` times; of all cuts into a first part (``l``) and a rest (``r``) the one with the lowest
    score floor(1000*a*n / (l*r)) counts, the first of equal ones, ``n`` being all words of the language. A phrase inside a longer
    one that has ``share`` percent of its count is dropped. Order: score and ``a`` descending, phrase by its bytes. Null texts
    are empty, a null language is ``und``; every row is a text of its own, so repeated rows count again; no frequent phrase: no
    row. Columns besides ``lang`` and ``text`` are not read. Two words are held to be the same if 64 bits of hash are; where that befalls
    frequent words of a language another seed is taken."""
    phrases, words, totals = frequent_phrases(docs, at_least)
    phrases = cut(phrases, "phrases")
    several = phrases.where(F.size("words") > 1).select("lang_key", "words", F.col("n").alias("a"))
    inside = several.withColumn("sub", F.explode(F.expr(
        "filter(flatten(transform(sequence(2, size(words)), w -> transform(sequence(1, size(words) - w + 1), i -> slice(words, i, w)))), s -> size(s) < size(words))")))
    covered = inside.groupBy("lang_key", F.col("sub").alias("words")).agg(F.max("a").alias("longer"))
    kept = several.join(covered, ["lang_key", "words"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {share} * a")).drop("longer")

    spelled = kept.select("lang_key", "words", F.posexplode("words").alias("at", "word_key")).join(words, ["lang_key", "word_key"])
    named = spelled.groupBy("lang_key", "words").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("w")))), lambda x: x["w"]), " ").alias("phrase"))
    parts = phrases.select("lang_key", "words", "n")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cuts = cuts.withColumn("head", F.expr("slice(words, 1, k)")).withColumn("tail", F.expr("slice(words, k + 1, size(words) - k)"))
    cuts = (cuts.join(parts.select("lang_key", F.col("words").alias("head"), F.col("n").alias("l")), ["lang_key", "head"])
            .join(parts.select("lang_key", F.col("words").alias("tail"), F.col("n").alias("r")), ["lang_key", "tail"])
            .join(named, ["lang_key", "words"]).join(F.broadcast(totals), "lang"))
    score = F.expr("CAST((CAST(1000 AS DECIMAL(38, 0)) * a * total) DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "x.l", "x.r", F.col("total").alias("n"), "x.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
