"""SentencePiece encoding with the N best segmentations, and decoding.

All segmentations of a text into pieces form a lattice. A forward Viterbi pass gives the best score up to every
place; the search for the N best then runs backwards from the end as A*, with these scores as its heuristic. They are exact,
so paths leave the agenda in order of their true totals.

Two exact short cuts make this fit for whole corpora. A text is cut wherever no piece of the vocabulary holds the
two neighbouring characters: no edge of the lattice crosses such a place, so the lattice is a chain of small ones, and equal
segments are searched once per task. And only the segments whose second-best path is closest can take part in the N best
of the chain.

Text is taken as it is (no normalisation), with the usual space in front. Characters without a piece become byte pieces
at a fixed penalty each; so does the space mark itself where it stands in a text. Decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import itertools
import sys
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
STAND_IN = "\U0010ffff"   # for the mark inside texts; another character is taken where a text holds this one
N_BEST = 4
PENALTY = 10.0            # how far an unknown character lies below the lowest piece
SLICE = 2 << 20           # characters cut at a time
CACHED = 1 << 19
SHORT, AT_ONCE = 32, 1 << 18   # longest segments that are searched together, and their characters at a time

Path = tuple[float, tuple[int, ...]]


@dataclass
class Segment:
    ids: bytes
    score: float
    gap: float        # to the second-best path, inf if there is none


class Lattice:
    """Vocabulary and search of one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [-1] * 256
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = k
                self.bytes_of[k] = bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.pieces[piece] = (k, float(model.get_score(k)))
                self.bytes_of[k] = piece.replace(MARK, " ").encode("utf-8")
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces")
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - PENALTY
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.suffixes = {p[n:] for p in self.pieces for n in range(len(p))}
        long = [p for p in self.pieces if len(p) > 1]
        letters = sorted({c for p in long for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        place = {c: k for k, c in enumerate(letters, 1)}
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in long:
            for a, b in itertools.pairwise(p):
                self.joined[place[a], place[b]] = True
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self._build_trie()
        self.known: dict[str, Segment] = {}
        self.stand_in = STAND_IN

    def ending(self, text: str, end: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """The edges of the lattice that end at a place, short ones first: (start, ids, score). They are found anew each time, so
        a text of any length needs no table of them."""
        for start in range(end - 1, -1, -1):
            part = text[start:end]
            if found := self.pieces.get(part):
                yield start, (found[0],), found[1]
            elif start == end - 1:
                raw = (MARK if part == self.stand_in else part).encode("utf-8")
                yield start, tuple(self.byte_ids[b] for b in raw), self.unknown
            if part not in self.suffixes:
                return

    def forward(self, text: str) -> list[float]:
        """Viterbi: the best score up to every place."""
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[start] + score for start, _, score in self.ending(text, end)))
        return best

    def _best_edge(self, text: str, best: list[float], end: int) -> tuple[int, tuple[int, ...], float]:
        """The edge that the best path up to a place ends with, of equal ones that with the least ids."""
        return min((e for e in self.ending(text, end) if best[e[0]] + e[2] == best[end]), key=lambda e: e[1])

    def n_best(self, text: str, n: int) -> list[Path]:
        """The n best (score, ids) of a text, best first; of equal scores those that leave the best path least, then nearest to the end.

        What stands on the agenda is a path from the end to some place; its total is known, as the Viterbi scores are exact. One that
        leaves the agenda follows the best edges to the start at once, and of the edges it passes by there the n that cost least join the agenda: no
        others can be among the n best. So the agenda holds n * n entries, and a path is a few turns off the best edges, not a copy.
        """
        best = self.forward(text)
        agenda: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        out: list[Path] = []
        while agenda and len(out) < n:
            cost, turns = heapq.heappop(agenda)
            taken = {-place: start for place, start in turns}
            place, score, ids = len(text), 0.0, []
            passed: list[tuple[float, tuple[int, int]]] = []   # the n least, as a heap with the worst on top
            last = -turns[-1][0] if turns else len(text) + 1
            while place:
                chosen = self._best_edge(text, best, place)
                if place in taken:
                    chosen = next(e for e in self.ending(text, place) if e[0] == taken[place])
                elif place < last:
                    for start, _, own in self.ending(text, place):
                        if start != chosen[0]:
                            entry = (-(best[place] - best[start] - own), (place, -start))
                            if len(passed) < n:
                                heapq.heappush(passed, entry)
                            elif entry > passed[0]:
                                heapq.heapreplace(passed, entry)
                ids.append(chosen[1])
                score += chosen[2]
                place = chosen[0]
            for less, (end, start) in passed:
                heapq.heappush(agenda, (cost - less, (*turns, (-end, -start))))
            out.append((score, tuple(itertools.chain.from_iterable(reversed(ids)))))
        return out

    def segment(self, text: str) -> Segment:
        """Best path, and how far the second best lies below: the best over all edges that are not on the best path."""
        best, size = self.forward(text), len(text)
        path: list[tuple[int, ...]] = []
        on = np.full(size + 1, -1, np.int64)
        place = size
        while place:
            start, ids, _ = self._best_edge(text, best, place)
            on[place] = start
            path.append(ids)
            place = start
        after, second = [float("-inf")] * size + [0.0], float("-inf")
        for end in range(size, 0, -1):
            for start, _, score in self.ending(text, end):
                after[start] = max(after[start], after[end] + score)
                if on[end] != start:
                    second = max(second, best[start] + score + after[end])
        ids = np.array(list(itertools.chain.from_iterable(reversed(path))), "<u4").tobytes()
        return Segment(ids, best[-1], best[-1] - second)

    def _build_trie(self) -> None:
        """The prefixes of all pieces as arrays: node * characters + character, sorted, and the node each leads to."""
        characters = sorted({c for p in self.pieces for c in p})
        self.character = np.zeros(0x110000, np.int64)
        self.character[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        number = {prefix: k for k, prefix in enumerate(["", *sorted(self.prefixes)])}
        self.dead = len(number)
        keys = [(number[p[:-1]] * (len(characters) + 1) + int(self.character[ord(p[-1])]), k) for p, k in number.items() if p]
        self.steps, self.leads = (np.array(x, np.int64) for x in zip(*sorted(keys)))
        self.node_score, self.node_id = np.full(self.dead + 1, -np.inf), np.full(self.dead + 1, 1 << 40)
        for piece, (k, score) in self.pieces.items():
            self.node_score[number[piece]], self.node_id[number[piece]] = score, k
        self.width = len(characters) + 1
        self.single = {p for p in self.pieces if len(p) == 1}
        self.longest = max(map(len, self.pieces))

    def learn(self, names: list[str]) -> None:
        """Put the best path of each segment into ``known``; short segments of known characters many at a time."""
        groups: dict[int, list[str]] = {}
        for name in names:
            if len(name) <= SHORT and self.single.issuperset(name):
                groups.setdefault(len(name), []).append(name)
            else:
                self.known[name] = self.segment(name)
        for size, group in groups.items():
            for k in range(0, len(group), AT_ONCE // size):
                self._learn_equal(group[k:k + AT_ONCE // size], size)

    def _learn_equal(self, group: list[str], size: int) -> None:
        """As ``segment`` for segments of one length, each step for all of them."""
        m = len(group)
        own = self.character[np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(m, size)].T
        scores: dict[tuple[int, int], np.ndarray] = {}
        ids: dict[tuple[int, int], np.ndarray] = {}
        for start in range(size):
            node = np.zeros(m, np.int64)
            live = np.arange(m)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                step = node[live] * self.width + own[end - 1, live]
                at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                there = self.steps[at] == step
                node[live] = np.where(there, self.leads[at], self.dead)
                live = live[there]
                if not len(live):
                    break
                scores[start, end], ids[start, end] = self.node_score[node], self.node_id[node]
        best, after = np.full((size + 1, m), -np.inf), np.full((size + 1, m), -np.inf)
        best[0], after[size] = 0, 0
        into: list[list[int]] = [[s for s in range(size) if (s, e) in scores] for e in range(size + 1)]
        for end in range(1, size + 1):
            for start in into[end]:
                np.maximum(best[end], best[start] + scores[start, end], out=best[end])
        for end in range(size, 0, -1):
            for start in into[end]:
                np.maximum(after[start], after[end] + scores[start, end], out=after[start])
        place, second, tokens = np.full(m, size), np.full(m, -np.inf), np.full((size, m), -1)
        for end in range(size, 0, -1):
            here = place == end
            chosen, first = np.full(m, 1 << 40), np.zeros(m, np.int64)
            for start in into[end]:
                better = here & (best[start] + scores[start, end] == best[end]) & (ids[start, end] < chosen)
                chosen[better], first[better] = ids[start, end][better], start
            tokens[end - 1][here], place = chosen[here], np.where(here, first, place)
            for start in into[end]:
                total = best[start] + scores[start, end] + after[end]
                np.maximum(second, np.where(here & (first == start), -np.inf, total), out=second)
        used = (tokens >= 0).T
        data, ends = tokens.T[used].astype("<u4").tobytes(), np.cumsum(used.sum(1)) * 4
        for name, a, b, score, gap in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), best[size].tolist(), (best[size] - second).tolist()):
            self.known[name] = Segment(data[a:b], score, gap)

    def segments(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The segments of all texts in order, and where each text's begin; texts have their mark in front."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        own = self.letter[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joined[own[:-1], own[1:]]
        cut[bounds] = True
        widths = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        places = np.concatenate([[0], np.cumsum(widths)])[cut].astype(np.int32)
        array = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(joined.encode("utf-8")))
        return array.dictionary_encode(), np.cumsum(cut)[bounds] - 1

    def encode_all(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, float, list[Path]]]:
        """For each text the best ids, their score and the n best (score, ids as bytes of unsigned 32-bit numbers)."""
        if any(self.stand_in in t for t in texts):
            used = set("".join(texts)) | {c for p in self.pieces for c in p}
            self.stand_in = next(c for c in map(chr, range(0x10FFFF, 0xFFFF, -1)) if c not in used)
            self.known.clear()
        marked = [MARK + t.replace(MARK, self.stand_in).replace(" ", MARK) for t in texts]
        coded, bounds = self.segments(marked)
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > CACHED:
            self.known.clear()
        known = self.known
        self.learn([name for name in names if name not in known])
        found = [known[name] for name in names]
        ids = np.frombuffer(b"".join(f.ids for f in found), "<u4")
        sizes = np.array([len(f.ids) // 4 for f in found], np.int64)
        firsts = np.cumsum(sizes) - sizes
        scores, gaps = np.array([f.score for f in found]), np.array([f.gap for f in found])
        codes = coded.indices.to_numpy()
        for a, b in itertools.pairwise(bounds.tolist()):
            own = codes[a:b]
            counts = sizes[own]
            ends = np.cumsum(counts)
            best = ids[np.repeat(firsts[own] - ends + counts, counts) + np.arange(int(ends[-1]))]
            score = float(scores[own].sum())
            yield best, score, self._chain(best, score, own, ends, gaps, names, n)

    def _chain(self, best: np.ndarray, score: float, own: np.ndarray, ends: np.ndarray, gaps: np.ndarray, names: list[str], n: int) -> list[Path]:
        """The n best of a chain of segments: combinations of alternatives at the n - 1 places of least gap."""
        gap = gaps[own]
        near = np.argsort(gap, kind="stable")[:n - 1] if len(gap) <= 64 else _least(gap, n - 1)
        places = sorted(int(p) for p in near if np.isfinite(gap[p]))
        options = [[(self.known[names[own[p]]].score - s, np.array(i, "<u4").tobytes()) for s, i in self.n_best(names[own[p]], n)] for p in places]
        # The n least sums of all options follow from the n least of the options before.
        sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for option in options:
            sums = heapq.nsmallest(n, [(cost + o[0], (*way, k)) for cost, way in sums for k, o in enumerate(option)])
        ways = [way for _, way in sums]
        data, out = best.tobytes(), []
        for way in ways:
            parts, at = [], 0
            for p, option, k in zip(places, options, way):
                begin, end = (int(ends[p - 1]) if p else 0) * 4, int(ends[p]) * 4
                parts += [data[at:begin], option[k][1] if k else data[begin:end]]
                at = end
            out.append((score - sum(o[k][0] for o, k in zip(options, way)), b"".join([*parts, data[at:]])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text that was encoded."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.table[np.repeat(self.firsts[ids] - ends + n, n) + np.arange(total)].tobytes()[1:]


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest values, earlier places first among equal ones."""
    if n < 1:
        return np.empty(0, np.int64)
    bound = np.partition(values, n - 1)[n - 1]
    below = np.flatnonzero(values < bound)
    return np.concatenate([below, np.flatnonzero(values == bound)[:n - len(below)]])


def _slices(texts: list[str]) -> Iterator[list[str]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < SLICE):
            size += len(texts[end])
            end += 1
        yield texts[begin:end]
        begin = end


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(documents: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text", n: int = N_BEST) -> DataFrame:
    """(key, ids, score, n_best): best ids of every row, and the n best as (score, ids), best first.

    Null counts as empty; the empty text is one space piece. Repeated rows each come back.
    """
    return _encoded(documents, model or default_model(), key, text, n, digest=False)


def decode(encoded: DataFrame, model: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows with ``ids``; null ids give a null text."""
    path = model or default_model()
    rows = encoded.select(F.col(key).alias("_key"), "ids")
    kind = rows.schema["_key"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        for batch in batches:
            texts = [None if x is None else lattice.decode(np.array(x, np.int64)).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_key", "text"])

    return rows.mapInArrow(work, f"_key {kind}, text string").withColumnRenamed("_key", key)


def _encoded(documents: DataFrame, path: str, key: str, text: str, n: int, digest: bool) -> DataFrame:
    rows = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    value = pa.int64() if digest else pa.list_(pa.int32())
    best_type = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_crc32" if digest else "ids", value)]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        for batch in batches:
            out: list[tuple] = []
            for part in _slices(batch.column(1).to_pylist()):
                for source, (ids, score, best) in zip(part, lattice.encode_all(part, n)):
                    names = ("score", "n_tokens", "ids_crc32" if digest else "ids")
                    listed = [dict(zip(names, (s, len(i) // 4, zlib.crc32(i) if digest else np.frombuffer(i, "<u4").tolist()))) for s, i in best]
                    if digest:
                        out.append((len(ids), zlib.crc32(ids.tobytes()), score, listed, lattice.decode(ids) == source.encode("utf-8")))
                    else:
                        out.append((ids.tolist(), score, listed))
            types = [pa.int64(), pa.int64(), pa.float64(), best_type, pa.bool_()] if digest else [value, pa.float64(), best_type]
            columns = zip(*out) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["_key", *fields])

    if digest:
        fields = ["n_tokens", "ids_crc32", "score", "n_best", "decoded"]
        schema = f"_key {kind}, n_tokens long, ids_crc32 long, score double, n_best array<struct<score:double,n_tokens:long,ids_crc32:long>>, decoded boolean"
    else:
        fields = ["ids", "score", "n_best"]
        schema = f"_key {kind}, ids array<int>, score double, n_best array<struct<score:double,n_tokens:long,ids:array<int>>>"
    return rows.mapInArrow(work, schema).withColumnRenamed("_key", key)


def op2_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ids and the N best of every document as digests; ``decoded``: decoding gave the text back."""
    return _encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), "doc_id", "text", N_BEST, digest=True)
