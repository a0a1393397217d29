"""Packing of tokenised documents into fixed sequences by cutting-stock column generation.

1. Tasks tokenise whole texts and cut every document into pieces of full length and one rest.
2. A histogram of the rests over ``CLASSES`` length classes (rounded up) is all the planner sees, so its
   size does not grow with the corpus.
3. A linear program picks how often to use each pattern of classes that fits one sequence. It starts
   from one-class patterns; a knapsack dynamic program over the dual prices adds the best new pattern
   until none is worth it (or the proven gap is below ``GAP``). Rounded-down counts are kept, the few
   rests left over are placed by best fit.
4. Pieces are ranked within their class; ranks fill the pattern slots, slots give sequence and offset.

Only the pieces' numbers are shuffled, never texts or ids.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.llm.common import slices, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 4096
CLASSES = 512
SALTS = 256
GAP = 0.001
END = 2
CACHED = 1 << 20
#: Closing marks; the apostrophe is not among them, as it may join letters to a token.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class ChunkEncoder:
    """Token ids of many texts, encoding each distinct white-space chunk once.

    Right for tokenizers whose pre-tokenizer never joins characters across white space and drops it, parts
    letters from what follows them, and ignores the case of ASCII letters.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)   # ids that end a word
        if suffix := model.get("end_of_word_suffix"):
            self.closing[[n for piece, n in model["vocab"].items() if piece.endswith(suffix)]] = True
        self.parts: dict[str, bytes] = {}   # ids of folded words and of what follows them

    def _learn(self, fresh: list[str]) -> None:
        """Put the ids of ``fresh`` into ``parts``; words of letters go many to a line."""
        words = [w for w in fresh if w.isalpha()]
        self._encode_each([w for w in fresh if not w.isalpha()])
        lines = [words[k:k + 256] for k in range(0, len(words), 256)]
        for k in range(0, len(lines), 64):
            part = lines[k:k + 64]
            for line, found in zip(part, self.tokenizer.encode_batch_fast([" ".join(x) for x in part], add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                ends = [0, *((np.flatnonzero(self.closing[ids]) + 1) * 4).tolist()]
                if len(ends) != len(line) + 1:  # some word became several
                    self._encode_each(line)
                    continue
                data = ids.tobytes()
                self.parts.update((w, data[a:b]) for w, a, b in zip(line, ends, ends[1:]))

    def _encode_each(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.parts[word] = np.array(found.ids, "<u4").tobytes()

    def _parted(self, chunks: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct parts, and for each chunk the numbers of its word and of its closing marks (0: none).

        A chunk of letters and closing marks falls into these two; any other stays whole.
        """
        whole = pc.match_substring(chunks, "<|")  # perhaps a special token, which is not folded
        folded = pc.if_else(whole, chunks, pc.ascii_lower(chunks))
        heads = pc.utf8_rtrim(folded, characters=MARKS)
        # The letter with a dot above is the only one whose lower case is two characters.
        plain = pc.and_not(pc.and_not(pc.utf8_is_alpha(heads), whole), pc.match_substring(heads, "\u0130"))
        heads = pc.if_else(plain, heads, folded).dictionary_encode()
        names = ["", *heads.dictionary.to_pylist()]
        sizes = pc.binary_length(folded).to_numpy() - pc.binary_length(heads.dictionary).to_numpy()[heads.indices.to_numpy()]
        tails = np.zeros(len(chunks), np.int64)
        numbers: dict[str, int] = {}
        marked = np.flatnonzero(sizes)
        for at, size, text in zip(marked.tolist(), sizes[marked].tolist(), folded.take(pa.array(marked)).to_pylist()):
            tails[at] = numbers.setdefault(text[-size:], len(names) + len(numbers))
        return [*names, *numbers], heads.indices.to_numpy() + 1, tails

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        parts, heads, tails = self._parted(coded.dictionary)
        if len(self.parts) + len(parts) > CACHED:
            self.parts.clear()
        known = self.parts
        self._learn([p for p in parts if p not in known])
        encoded = [known[p] for p in parts]
        ids = np.frombuffer(b"".join(encoded), "<u4")
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        firsts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = np.column_stack([heads[codes[a:b]], tails[codes[a:b]]]).reshape(-1)
            own = own[sizes[own] > 0]
            n = sizes[own]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(n) else 0
            yield ids[np.repeat(firsts[own] - ends + n, n) + np.arange(total)]


def pieces(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
           length: int = LENGTH, end: int = END) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, salt): full pieces and the rest of every document.

    Every document is its ids followed by ``end``, so a null or empty text is one piece of one token.
    Repeated rows each give their pieces. ``salt`` spreads rows evenly.
    """
    narrow = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = narrow.schema[key].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, line = ChunkEncoder(tokenizer), 0
        for batch in slices(batches, 1):
            rows: list[tuple[int, int, int, int, int]] = []
            for row, ids in enumerate(encoder.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                rows += [(row, a, min(length, len(ids) - a), zlib.crc32(ids[a:a + length].tobytes()), len(ids))
                         for a in range(0, len(ids), length)]
            table = np.array(rows, np.int64).reshape(-1, 5)
            salts = (np.arange(len(table)) + line) % SALTS
            line += len(table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), *[pa.array(table[:, k]) for k in range(1, 5)],
                 pa.array(salts, pa.int32())],
                names=["_key", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt int"
    return narrow.mapInArrow(work, schema).withColumnRenamed("_key", key)


Pattern = tuple[tuple[int, int], ...]  # (class, how many), largest class first


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack with repetition: the pattern of highest total price."""
    useful = np.flatnonzero(prices > 1e-12)
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = useful[np.argsort(sizes[useful])]
    own, value = sizes[order], prices[order]
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(own, room, side="right"))
        best[room], choice[room] = best[room - 1], -1
        if fits:
            gains = best[room - own[:fits]] + value[:fits]
            top = int(gains.argmax())
            if gains[top] > best[room]:
                best[room], choice[room] = gains[top], order[top]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def plan(demand: dict[int, int], capacity: int = CLASSES, gap: float = GAP) -> list[tuple[Pattern, int]]:
    """(pattern, how often) covering ``demand`` (class -> pieces) exactly; a class is its size."""
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], float)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    for step in range(20 * len(sizes) + 200):
        amounts = np.maximum(inverse @ need, 0)
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        value, fresh = _best_pattern(prices, sizes, capacity)
        if value <= 1 + 1e-9 or 1 - 1 / value < gap:
            break
        move = inverse @ fresh
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, amounts / move, np.inf)
        out = int(ratio.argmin())
        columns[:, out] = fresh
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
    chosen: Counter[Pattern] = Counter()
    left = need.astype(np.int64)
    for k, amount in enumerate(np.floor(np.maximum(inverse @ need, 0) + 1e-6).astype(np.int64)):
        counts = columns[:, k].astype(np.int64)
        used = counts > 0
        times = min(int(amount), int((left[used] // counts[used]).min()))
        if times:
            left -= times * counts
            chosen[_pattern(sizes, counts)] += times
    for counts in _best_fit(sizes, left, capacity):
        chosen[_pattern(sizes, counts)] += 1
    return sorted(chosen.items(), reverse=True)


def _pattern(sizes: np.ndarray, counts: np.ndarray) -> Pattern:
    return tuple((int(sizes[k]), int(counts[k])) for k in np.flatnonzero(counts)[::-1])


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The rests that rounding leaves: largest first, each where the least room remains."""
    rooms: list[int] = []
    bins: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fitting = [(room, b) for b, room in enumerate(rooms) if room >= sizes[k]]
            if fitting:
                b = min(fitting)[1]
            else:
                b = len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
                rooms.append(capacity)
            bins[b][k] += 1
            rooms[b] -= int(sizes[k])
    return bins


def _slots(chosen: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """Class -> rows (first rank, first sequence, pieces a sequence, first slot in a sequence)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, times in chosen:
        slot = 0
        for size, count in pattern:
            out.setdefault(size, []).append((ranks[size], sequence, count, slot))
            ranks[size] += times * count
            slot += count
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(cut: DataFrame, length: int = LENGTH, classes: int = CLASSES) -> DataFrame:
    """Add sequence_id, offset and padded_length to stored ``pieces``.

    ``padded_length`` is the sequence's own length if that is a power of two, else ``length``.
    """
    if length % classes:
        raise ValueError("classes must divide the sequence length")
    cut = cut.withColumn("_class", F.ceil(F.col("length") / (length // classes)).cast("int"))
    sizes = cut.groupBy("_class", "salt").count()
    histogram: Counter[int] = Counter()
    for row in sizes.groupBy("_class").agg(F.sum("count").alias("n")).collect():  # at most ``classes`` rows
        histogram[row["_class"]] = row["n"]
    whole = histogram.pop(classes, 0)
    chosen = plan(histogram, classes) + ([(((classes, 1),), whole)] if whole else [])
    slots = _slots(chosen)
    before = Window.partitionBy("_class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_class", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "salt").orderBy(F.desc("length"), *[c for c in cut.columns if c not in ("length", "salt", "_class")])
    # At most classes * SALTS rows of three numbers, whatever the corpus.
    ranked = (cut.withColumn("_rank", F.row_number().over(inside) - 1)
              .join(F.broadcast(offsets), ["_class", "salt"])
              .withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_before", "salt"))
    names = ranked.columns

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(names.index("_class")).to_numpy()
            ranks = batch.column(names.index("_rank")).to_numpy()
            sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for size in np.unique(kinds).tolist():
                own = kinds == size
                table = slots[size]
                first, base, count, at = table[np.searchsorted(table[:, 0], ranks[own], side="right") - 1].T
                sequence[own] = base + (ranks[own] - first) // count
                slot[own] = at + (ranks[own] - first) % count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)],
                                             names=[*names, "sequence_id", "_slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, _slot long")
    row = Window.partitionBy("sequence_id")
    earlier = row.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("length").over(row)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
            .withColumn("_total", total.cast("long"))
            .withColumn("padded_length", F.when(F.col("_total").bitwiseAND(F.col("_total") - 1) == 0, F.col("_total"))
                        .otherwise(F.lit(length).cast("long")))
            .drop("_class", "_rank", "_slot", "_total"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequences: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_length)."""
    return pack(stored(pieces(documents, tokenizer or default_tokenizer()), "pieces"))


def op9_packing_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
