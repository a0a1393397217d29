"""Secret scan: all rules compiled into one minimal automaton over bytes.

Rule patterns are parsed into a nondeterministic automaton, made deterministic by subset construction
and minimised by partition refinement. The result is one flat transition array; texts are read once,
byte by byte, for all rules together. Bytes that lead from every state to the start (line ends, for
one) cut a batch of texts into some thousand lanes, which numpy moves forward together. Only where the array reports the end of some match do two small
automata of that rule run: backwards to the leftmost start, forwards to the longest end.

Spans are leftmost and do not overlap within a kind. A match that is too short is dropped, but its
characters stay used up, as with an ordinary left-to-right search.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm.common import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    least: int = 1           # shorter values are dropped
    assigned: bool = False   # what counts is the value after the first : or =


RULES = (
    SecretRule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 16),
    SecretRule("hex", r"[0-9a-f]{32,}", 32),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
BASE = ("assign", "access", "hex")

# A lane holds at least LANE bytes, a slice about SLICE bytes; below FEW lanes plain steps are faster.
LANE, LANES, FEW, SLICE = 256, 8192, 24, 8 << 20


class Nfa:
    """Thompson automaton of one pattern: literals, classes, escapes, groups, |, ?, *, +, {m,n} and (?i:...)."""

    def __init__(self, pattern: str) -> None:
        self.free: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.text, self.at, self.fold = pattern, 0, False
        self.start, self.end = self._either()
        if self.at != len(pattern):
            raise ValueError(f"bad pattern at {self.at}: {pattern}")

    def _state(self) -> int:
        self.free.append([])
        self.step.append([])
        return len(self.free) - 1

    def _more(self, text: str) -> bool:
        return self.text.startswith(text, self.at)

    def _either(self) -> tuple[int, int]:
        begin, end = self._state(), self._state()
        while True:
            a, b = self._row()
            self.free[begin].append(a)
            self.free[b].append(end)
            if not self._more("|"):
                return begin, end
            self.at += 1

    def _row(self) -> tuple[int, int]:
        begin = last = self._state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            here = self.at
            a, b = self._atom()
            after, (low, high) = self.at, self._times()
            done = self.at
            copies = [(a, b)]
            while len(copies) < max(low, high or 1, 1):
                self.at = here
                copies.append(self._atom())
            self.at = max(after, done)
            ends = [last] if low == 0 else []
            for k, (a, b) in enumerate(copies):
                self.free[last].append(a)
                last = b
                if k + 1 >= low:
                    ends.append(b)
            if high is None:
                self.free[copies[-1][1]].append(copies[-1][0])
            out = self._state()
            for x in ends:
                self.free[x].append(out)
            last = out
        return begin, last

    def _times(self) -> tuple[int, int | None]:
        if self.at < len(self.text) and self.text[self.at] in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.text[self.at - 1]]
        if found := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
            self.at = found.end()
            low = int(found[1])
            return low, (int(found[3]) if found[3] else None if found[2] else low)
        return 1, 1

    def _byte(self) -> int:
        if not self._more("\\"):
            self.at += 1
            return ord(self.text[self.at - 1])
        if self._more("\\x"):
            self.at += 4
            return int(self.text[self.at - 2:self.at], 16)
        self.at += 2
        return ord(self.text[self.at - 1])

    def _atom(self) -> tuple[int, int]:
        if self._more("("):
            fold = self.fold
            for mark in ("(?i:", "(?:", "("):
                if self._more(mark):
                    self.at, self.fold = self.at + len(mark), fold or "i" in mark
                    break
            inner = self._either()
            self.at, self.fold = self.at + 1, fold
            return inner
        if self._more("["):
            self.at += 1
            negate = self._more("^")
            self.at += negate
            values: set[int] = set()
            while not self._more("]"):
                low = high = self._byte()
                if self._more("-") and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._byte()
                values |= set(range(low, high + 1))
            self.at += 1
            values = set(range(256)) - values if negate else values
        else:
            values = {self._byte()}
        if self.fold:
            values |= {ord(c) for v in values if chr(v).isascii() for c in (chr(v).lower(), chr(v).upper())}
        a, b = self._state(), self._state()
        self.step[a].append((frozenset(values), b))
        return a, b

    def reverse(self) -> Nfa:
        """The automaton of the reversed strings."""
        back = object.__new__(Nfa)
        back.free, back.step = [[] for _ in self.free], [[] for _ in self.step]
        for x, targets in enumerate(self.free):
            for y in targets:
                back.free[y].append(x)
        for x, moves in enumerate(self.step):
            for values, y in moves:
                back.step[y].append((values, x))
        back.start, back.end = self.end, self.start
        return back


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]`` is the next state; states are multiples of 256, the accepting ones from ``accept`` on."""

    table: tuple[int, ...]
    start: int
    accept: int
    dead: int                             # a state that is never left, -1 if there is none
    rules: tuple[tuple[int, ...], ...]    # of each accepting state


def compile_automaton(nfas: list[Nfa], anywhere: bool) -> Automaton:
    """Subset construction over the union of ``nfas``, then minimisation. ``anywhere``: matches may begin at any byte."""
    free: list[list[int]] = [[]]
    step: list[list[tuple[frozenset[int], int]]] = [[]]
    ends: dict[int, int] = {}
    for k, nfa in enumerate(nfas):
        shift = len(free)
        free += [[x + shift for x in row] for row in nfa.free]
        step += [[(v, x + shift) for v, x in row] for row in nfa.step]
        free[0].append(nfa.start + shift)
        ends[nfa.end + shift] = k
    sets = sorted({v for row in step for v, _ in row}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    class_of = [kinds.setdefault(tuple(b in v for v in sets), len(kinds)) for b in range(256)]
    sample = [class_of.index(c) for c in range(len(kinds))]

    def closed(states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for y in free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(x for x in seen if step[x] or x in ends or x == 0)

    first = closed([0])
    number, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for byte in sample:
            target = closed({y for x in state for v, y in step[x] if byte in v} | ({0} if anywhere else set()))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    moves = np.array(rows)
    accepts = [tuple(sorted({ends[x] for x in s if x in ends})) for s in order]
    labels = {a: k for k, a in enumerate(sorted(set(accepts)))}
    part = np.array([labels[a] for a in accepts])
    while True:  # states stay together while all their moves lead to the same parts
        _, finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    leader = {int(p): k for k, p in reversed(list(enumerate(part)))}
    ranked = sorted(leader, key=lambda p: (bool(accepts[leader[p]]), leader[p]))
    place = {p: k for k, p in enumerate(ranked)}
    table = tuple(place[int(part[moves[leader[p]][class_of[b]]])] * 256 for p in ranked for b in range(256))
    plain = sum(not accepts[leader[p]] for p in ranked)
    dead = [k for k in range(plain) if set(table[k * 256:k * 256 + 256]) == {k * 256}]
    return Automaton(table, place[int(part[0])] * 256, plain * 256, dead[0] * 256 if dead else -1,
                     tuple(accepts[leader[p]] for p in ranked[plain:]))


@dataclass(frozen=True)
class Scanner:
    rules: tuple[SecretRule, ...]
    array: np.ndarray        # the combined automaton's table
    resets: np.ndarray       # of each byte: whether it leads from every state to the start
    between: bytes           # such a byte, put between texts
    combined: Automaton
    backward: tuple[Automaton, ...]
    forward: tuple[Automaton, ...]

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, states) where the combined automaton accepts; one pass over the bytes."""
        table, auto = self.array, self.combined
        cuts = np.flatnonzero(self.resets[data]) + 1
        wanted = np.arange(0, len(data), max(LANE, len(data) // LANES))
        at = np.searchsorted(cuts, wanted[1:])
        starts = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]]]))
        starts = starts[starts < len(data)]
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state = np.full(len(starts), auto.start, np.int32)
        places, states = [], []
        step, live = 0, len(starts)
        while live:
            live = int(np.searchsorted(-sizes, -step))  # lanes longer than step
            if live < FEW:
                break
            here = starts[:live] + step
            state[:live] = now = table[state[:live] + data[here]]
            hit = now >= auto.accept
            if hit.any():
                places.append(here[hit])
                states.append(now[hit])
            step += 1
        for lane in range(live):  # the rest of a few long lanes
            now, begin = int(state[lane]), int(starts[lane])
            for place, byte in enumerate(data[begin + step:begin + sizes[lane]].tobytes(), begin + step):
                now = auto.table[now + byte]
                if now >= auto.accept:
                    places.append([place])
                    states.append([now])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places, states = np.concatenate(places), np.concatenate(states)
        order = np.argsort(places, kind="stable")
        return places[order], states[order]

    def find_all(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule number, end) in bytes, in order of start and rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) < SLICE):
                size += len(texts[end]) + 1
                end += 1
            part = texts[begin:end]
            firsts = np.cumsum([0] + [len(t) + 1 for t in part])
            joined = np.frombuffer(self.between.join(part) + self.between, np.uint8)
            places, states = self.ends(joined)
            of = np.searchsorted(firsts, places, side="right") - 1
            for text in np.unique(of).tolist():
                mine = of == text if len(of) < 64 else slice(*np.searchsorted(of, [text, text + 1]))
                out[begin + text] = self._spans(part[text], (places[mine] - firsts[text]).tolist(), states[mine].tolist())
            begin = end
        return out

    def _spans(self, data: bytes, places: list[int], states: list[int]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        used = [0] * len(self.rules)
        for at, state in zip(places, states):
            for k in self.combined.rules[(state - self.combined.accept) >> 8]:
                if at < used[k]:
                    continue
                start = self._leftmost(k, data, at, used[k])
                if start < 0:
                    continue
                used[k] = end = self._longest(k, data, start)
                if self._value(k, data[start:end]) >= self.rules[k].least:
                    out.append((start, k, end))
        return sorted(out)

    def _leftmost(self, k: int, data: bytes, at: int, floor: int) -> int:
        auto, found = self.backward[k], -1
        state = auto.start
        while at >= floor:
            state = auto.table[state + data[at]]
            if state == auto.dead:
                break
            if state >= auto.accept:
                found = at
            at -= 1
        return found

    def _longest(self, k: int, data: bytes, at: int) -> int:
        auto, found = self.forward[k], at
        state = auto.start
        while at < len(data):
            state = auto.table[state + data[at]]
            at += 1
            if state == auto.dead:
                break
            if state >= auto.accept:
                found = at
        return found

    def _value(self, k: int, match: bytes) -> int:
        if not self.rules[k].assigned:
            return len(match)
        value = re.split(rb"[:=]", match, maxsplit=1)[1].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'"))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule number, end) in code points."""
        datas = [t.encode("utf-8") for t in texts]
        return [_points(data, found) for data, found in zip(datas, self.find_all(datas))]


def _points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    place, byte, point = {}, 0, 0
    for x in sorted({p for a, _, b in found for p in (a, b)}):
        point += len(data[byte:x].decode("utf-8"))
        byte = x
        place[x] = point
    return [(place[a], k, place[b]) for a, k, b in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...] = RULES) -> Scanner:
    """Compile the rules. The arrays grow with the rules alone and travel inside the tasks."""
    nfas = [Nfa(r.pattern) for r in rules]
    combined = compile_automaton(nfas, True)
    array = np.array(combined.table, np.int32)
    resets = (array.reshape(-1, 256) == combined.start).all(axis=0)
    if not resets.any():
        raise ValueError("some byte must occur in no rule: texts are put apart by it")
    between = b"\n" if resets[10] else bytes([int(np.flatnonzero(resets)[0])])
    return Scanner(rules, array, resets, between, combined,
                   tuple(compile_automaton([n.reverse()], False) for n in nfas),
                   tuple(compile_automaton([n], False) for n in nfas))


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text",
         rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(key, found): the array of (kind, start, end) of every row, by start, then in the order of the rules.

    Offsets are code points, ends exclusive. Null counts as empty; repeated rows each come back.
    """
    compiled = scanner(rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    narrow = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            spans = compiled.spans([x or "" for x in batch.column(1).to_pylist()])
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["_key", "found"])

    kind = narrow.schema["_key"].dataType.simpleString()
    return narrow.mapInArrow(work, f"_key {kind}, found array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("_key", key)


def redact(documents: DataFrame, text: str = "text", chars: str = "n_chars", mark: str = "[SECRET]",
           rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``documents`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark.

    ``chars``, if the table has that column, gets the new number of code points where a text changed.
    All other values and all rows stay; null texts stay null.
    """
    compiled = scanner(rules)

    at = documents.columns.index(text)

    def clean(value: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]]) if at else value

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            old = batch.column(at).to_pylist()
            spans = compiled.spans([x or "" for x in old])
            new = [None if x is None else clean(x, found) for x, found in zip(old, spans)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            count = batch.schema.get_field_index(chars)
            if count >= 0:
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(count).to_pylist(), old, new)]
                batch = batch.set_column(count, batch.schema.field(count), pa.array(sizes, batch.schema.field(count).type))
            yield batch

    return documents.mapInArrow(work, documents.schema)


def op7_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base kinds, and all spans as text, of every document."""
    found = F.col("found")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def of(*kinds: str) -> Column:
        return F.filter(found, lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = joined(of(*BASE))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(found).alias("spans"))
