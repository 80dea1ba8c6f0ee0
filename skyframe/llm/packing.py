"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n^2`` (attention stays inside a piece).
Within a group of documents, pieces in descending length go to the sequence with the lowest cost so far that has
token capacity left; a piece longer than that capacity is cut there. The capacities of a group add up to its tokens:
full sequences, and for the rest sequences whose lengths are powers of two, so nothing is padded.

A group is a run of documents of one input partition with about ``group_sequences`` sequences of tokens, so the work
has no shuffle, memory is bounded by one group and one document, and no key can be hot."""

from __future__ import annotations

import heapq
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyframe.llm.common import kept, small_batches

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, ids binary")
#: Separators at which str.split cuts although the tokenizer's pattern has them as ordinary characters.
ODD_BREAKS = re.compile("[\x1c-\x1f]")


class Memo:
    """What was worked out for recent keys: two generations of at least ``keep`` entries, used ones staying young."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not known; the others are young afterwards."""
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys.difference(young):
            if key in old:
                young[key] = old[key]
            else:
                out.append(key)
        return out


class Encoder:
    """Token ids of texts as little-endian 32-bit values.

    The vocabulary's pattern never matches across white space, and neither normal form nor lower-casing looks
    beyond it, so a text's ids are those of its white-space-separated parts in a row. Parts repeat: what was encoded is
    kept for a while. Parts of plain Latin characters, to which the normal form does nothing, are taken apart further by
    the vocabulary's own pattern, since words without their punctuation and case repeat even more; a text of nothing else is
    taken apart at once. New words are encoded many at a time, as one text of words between spaces: the last token of each is
    one of those that end a word."""

    PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
    PLAIN_TEXT = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
    #: Fixed value: the pattern of the vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, file: str, keep_parts: int = 250_000, keep_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.file, self.tokenizer = file, Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.parts, self.words = Memo(keep_parts), Memo(keep_words)
        text = open(file, encoding="utf-8").read()
        same = self.PATTERN in text.replace("\\\\", "\\")
        pattern = self.PATTERN
        for kind in ("L", "N"):  # named character by character among the plain ones, which re matches faster than a property
            pattern = pattern.replace(rf"\p{{{kind}}}", "".join(c for c in map(chr, range(0x180)) if self.PLAIN.match(c) and regex.match(rf"\p{{{kind}}}", c)))
        self.split = re.compile(pattern).findall if same else None
        suffix, vocabulary = json.loads(text)["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        from array import array

        out = []
        for i in range(0, len(texts), 20_000):
            out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str], at_once: int = 1000) -> list[bytes]:
        import numpy as np

        if self.ends is None:
            return self._encode(words)
        out = []
        for i in range(0, len(words), at_once):
            some = words[i:i + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.dtype("<u4"))
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(some) or ends[-1] != ids.nbytes:
                out += self._encode(some)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def _learn(self, parts: set[str]) -> None:
        missing = self.parts.missing(parts)
        plain = {p: self.split(p.lower()) for p in missing if self.PLAIN.fullmatch(p)} if self.split else {}
        self._known(set().union(*plain.values()))
        get = self.words.young.__getitem__
        self.parts.young.update((p, get(w[0]) if len(w) == 1 else b"".join(map(get, w))) for p, w in plain.items())
        other = [p for p in missing if p not in plain]
        self.parts.young.update(zip(other, self._encode(other), strict=True))

    def _known(self, words: set[str]) -> None:
        missing = self.words.missing(words)
        self.words.young.update(zip(missing, self._encode_words(missing), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.split(t.lower()) if self.split and self.PLAIN_TEXT.fullmatch(t) else None for t in texts]
        split = [None if words is not None or ODD_BREAKS.search(t) else t.split() for t, words in zip(texts, plain, strict=True)]
        self._learn(set().union(*filter(None, split)))
        self._known(set().union(*filter(None, plain)))
        get, word = self.parts.young.__getitem__, self.words.young.__getitem__
        return [b"".join(map(word, words)) if words is not None else self._encode([t])[0] if parts is None else b"".join(map(get, parts))
                for t, words, parts in zip(texts, plain, split, strict=True)]


@kept
def encoder(name: str) -> Encoder:
    """One encoder for each worker process while it packs; ``name`` is a path or the name of a public vocabulary file."""
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Encoder(name)


def place(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document index, start, length, sequence, offset) and the lengths of the sequences."""
    sizes: list[int] = []
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append((i, start, capacity, len(sizes), 0))
            sizes.append(capacity)
            start += capacity
        if n > start:
            rest.append((start - n, i, start))
    left = sum(-x[0] for x in rest)
    heap: list[tuple[bool, float, int, int]] = []
    for _ in range(left // capacity):
        heap.append((False, 0.0, len(sizes), 0))
        sizes.append(capacity)
    short = left % capacity
    for bit in reversed(range(short.bit_length())):
        if short >> bit & 1:
            heap.append((True, 0.0, len(sizes), 0))
            sizes.append(1 << bit)
    heapq.heapify(heap)
    rest.sort()
    for negative, i, start in rest:
        n = -negative
        while n:
            tail, cost, sequence, filled = heap[0]
            take = min(n, sizes[sequence] - filled)
            pieces.append((i, start, take, sequence, filled))
            if filled + take == sizes[sequence]:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (tail, cost + linear * take + quadratic * take * take, sequence, filled + take))
            start, n = start + take, n - take
    return pieces, sizes


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 1,
         linear: float = 1.0, quadratic: float = 1 / 4096, group_sequences: int = 512) -> DataFrame:
    """Pieces of the tokenised documents with their sequence and place in it; ``ids`` holds the piece's token ids.

    Null and empty texts are the end id alone. Null or repeated ids are passed through, every row is a document
    of its own; a row beyond the capacity is cut into full sequences and a rest. No row: no piece. Sequence ids are
    unique and follow from the input partition. Columns besides ``doc_id`` and ``text`` are not read."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA).schema
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        encode = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 33
        ids, held, tokens = [], [], 0

        def flush():
            nonlocal base
            pieces, sizes = place([len(x) // 4 for x in held], capacity, linear, quadratic)
            for i in range(0, len(pieces), 4096):
                part = pieces[i:i + 4096]
                doc, start, length, sequence, offset = zip(*part, strict=True)
                columns = [[ids[d] for d in doc], start, length, [len(held[d]) // 4 for d in doc], [base + s for s in sequence],
                           offset, [sizes[s] for s in sequence],
                           [held[d][4 * a:4 * (a + n)] for d, a, n in zip(doc, start, length, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            base += len(sizes)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                held.append(found + end)
                tokens += len(held[-1]) // 4
                if tokens >= capacity * group_sequences:
                    yield from flush()
                    ids, held, tokens = [], [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, out)
