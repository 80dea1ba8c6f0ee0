"""Secrets by grammar inference.

Fixed patterns label credentials in the corpus. For each kind a prefix tree of a bounded sample of them is folded into
a probabilistic automaton: states whose symbol and end frequencies agree within the Hoeffding bound, and whose
successors do, are merged (the ALERGIA procedure). A further automaton learns ordinary long tokens. Every candidate
token of the corpus is then scored by the log-likelihood of its format under the automata, against the ordinary one."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from skyframe.llm.common import cut, map_batches

BASE_KINDS = ("assign", "access", "hex")
SLACK = 0.2
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+")
FOUND = ("doc_id long, base array<struct<kind:string,start:long,end:long,value:string>>, "
         "other array<struct<start:long,end:long,value:string>>")
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def base_spans(text: str) -> list[dict]:
    """Spans of the fixed patterns by start, then kind; a match that fails its length is dropped, not retried."""
    out = [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], BASE_KINDS.index(x[0])))
    return [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in out]


def other_tokens(text: str, base: list[dict]) -> list[dict]:
    """Tokens of 8 characters and more outside the fixed patterns that hold a digit and a letter: the candidates."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
            continue
        while k < len(base) and base[k]["end"] <= m.start():
            k += 1
        if any(b["start"] < m.end() and b["end"] > m.start() for b in base[k:k + 3]):
            continue
        out.append({"start": m.start(), "end": m.end(), "value": token})
    return out


def symbols(token: str) -> str:
    """The format of a token: letters of hexadecimal digits, other letters by case and digits become classes."""
    return token.translate(CLASSES)


CLASSES = {ord(c): s for cs, s in (("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "z"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"),
                                   ("0123456789", "0")) for c in cs}


class Automaton:
    """A probabilistic automaton folded from the prefix tree of labelled strings. ``alpha`` is the level of the
    compatibility test: the smaller, the more states are merged."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends, self.total = [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            self._insert(s)
        self._fold()

    def _insert(self, s: str) -> None:
        state = 0
        self.total[0] += 1
        for c in s:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(int))
                self.ends.append(0)
                self.total.append(0)
            self.count[state][c] += 1
            state = self.next[state][c]
            self.total[state] += 1
        self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            # from here on the bound is above any difference: counts below a tree node are no larger than its own
            if not self.total[p] or self.total[q] <= self.bound ** 2:
                continue
            if self._differ(self.ends[p], self.total[p], self.ends[q], self.total[q]):
                return False
            for c in {*self.next[p], *self.next[q]}:
                if self._differ(self.count[p].get(c, 0), self.total[p], self.count[q].get(c, 0), self.total[q]):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _merge(self, red: int, blue: int) -> None:
        """Fold the tree below ``blue`` into ``red``; the arc to ``blue`` has been turned already."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.total[p] += self.total[q]
            for c, to in self.next[q].items():
                self.count[p][c] += self.count[q][c]
                if c in self.next[p]:
                    todo.append((self.next[p][c], to))
                else:
                    self.next[p][c] = to

    def _fold(self) -> None:
        red = [0]
        while True:
            mine = set(red)
            blue = next(((p, c, q) for p in red for c, q in sorted(self.next[p].items()) if q not in mine), None)
            if blue is None:
                self.states = len(red)
                return
            p, c, q = blue
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._merge(r, q)
                    break
            else:
                red.append(q)

    def table(self) -> dict:
        """Reachable states with log-probabilities, as plain values to ship."""
        order, seen = [0], {0: 0}
        for p in order:
            for q in self.next[p].values():
                if q not in seen:
                    seen[q] = len(order)
                    order.append(q)
        alphabet = 70
        return {"arcs": [{c: (seen[q], math.log((self.count[p][c] + 0.05) / (self.total[p] + 0.05 * alphabet)))
                          for c, q in self.next[p].items()} for p in order],
                "end": [math.log((self.ends[p] + 0.05) / (self.total[p] + 0.05 * alphabet)) for p in order],
                "floor": [math.log(0.05 / (self.total[p] + 0.05 * alphabet)) for p in order]}


def rate(table: dict, token: str) -> float:
    """Log-likelihood of the token's format per symbol; an unknown symbol costs the floor and keeps the state."""
    state, total = 0, 0.0
    arcs, floor = table["arcs"], table["floor"]
    s = symbols(token)
    for c in s:
        step = arcs[state].get(c)
        if step is None:
            total += floor[state]
        else:
            state, total = step[0], total + step[1]
    return (total + table["end"][state]) / (len(s) + 1)


def learn(found: DataFrame, sample: int, alpha: float, longest: int) -> dict:
    """Automata by kind from at most ``sample`` labelled credentials of each kind and as many ordinary tokens, those
    with the smallest hashes of distinct values of at most ``longest`` characters (folding takes up to the cube of a format's
    length); values are learned whole. An empty model without credentials. A fifth of a kind's credentials is kept out of its automaton: their lowest rates, less
    ``SLACK``, tell which rate a credential has at least. ``shortest``: the least length of a learned credential."""
    labelled = found.select(F.explode("base").alias("x")).select("x.kind", "x.value")
    plain = found.select(F.explode("other.value").alias("value")).select(F.lit("").alias("kind"), "value")
    model: dict = {"kinds": {}, "plain": None}
    for kind in (*BASE_KINDS, ""):
        source = labelled.where(F.col("kind") == kind) if kind else plain
        chosen = source.select("value").where(F.length("value") <= longest).distinct()
        values = [r[0] for r in chosen.orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
        if not values:
            continue
        held = values[::5] if kind and len(values) >= 20 else []
        kept_out = set(held)
        table = Automaton([symbols(v) for v in values if v not in kept_out], alpha).table()
        if kind:
            least = float(np.quantile([rate(table, v) for v in held or values], 0.02)) - SLACK
            model["kinds"][kind] = {"table": table, "least": least, "shortest": min(map(len, values))}
        else:
            model["plain"] = table
    return model


def lead(model: dict, kind: str, token: str) -> float:
    """Between 0 and 1: how far the likelihood of the token's format under the kind's automaton, per symbol, is above the
    ordinary one's; 0 if the kind has not been learned."""
    if kind not in model["kinds"]:
        return 0.0
    plain = rate(model["plain"], token) if model["plain"] else -3.0
    return 1 / (1 + math.exp(-8 * (rate(model["kinds"][kind]["table"], token) - plain)))


def judge(model: dict, token: str, margin: float) -> float:
    """Score of a token under the best automaton; 0 if it is shorter than all learned credentials, or its format less
    likely than nearly all of them or not ``margin`` above the ordinary one."""
    best = 0.0
    for name, kind in model["kinds"].items():
        if len(token) >= kind["shortest"] and rate(kind["table"], token) >= kind["least"]:
            score = lead(model, name, token)
            if score >= 1 / (1 + math.exp(-8 * margin)):
                best = max(best, score)
    return best


def find(docs: DataFrame, sample: int = 2000, alpha: float = 0.05, margin: float = 0.1, longest: int = 256) -> DataFrame:
    """(doc_id, spans) for each row: kind, start and end in code points (end exclusive) and score. Spans of the fixed
    patterns all come, with the score of their value under their kind's automaton; tokens whose format the automata accept
    follow as kind ``format``; all by start, then kind.

    Null and empty texts have none; null or repeated ids pass through; no rows: no rows. Without labelled credentials
    nothing is learned and only the fixed patterns remain; longer credentials than ``longest`` are not learned from but scored
    like all others, and a kind that has no others scores 0. Columns besides ``doc_id`` and ``text`` are not read."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def scan(batch) -> dict:
        found = batch.column(1).to_pylist()
        base = [base_spans(t) for t in found]
        return {"doc_id": batch.column(0), "base": base, "other": [other_tokens(t, b) for t, b in zip(found, base, strict=True)]}

    stored = cut(map_batches(texts, scan, FOUND), "secrets")
    model = stored.sparkSession.sparkContext.broadcast(learn(stored, sample, alpha, longest))

    def score(batch) -> dict:
        out = []
        for base, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans = [{"kind": b["kind"], "start": b["start"], "end": b["end"],
                      "score": lead(model.value, b["kind"], b["value"])} for b in base]
            for o in other:
                if (p := judge(model.value, o["value"], margin)) > 0:
                    spans.append({"kind": "format", "start": o["start"], "end": o["end"], "score": p})
            spans.sort(key=lambda s: (s["start"], (*BASE_KINDS, "format").index(s["kind"])))
            out.append(spans)
        return {"doc_id": batch.column(0), "spans": out}

    return map_batches(stored, score, SPANS)
