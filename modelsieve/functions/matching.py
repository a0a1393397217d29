"""Find every match of a rule set in chunks of bytes.

A chunk row carries ``content`` (bytes), ``base_offset`` (file offset of its
first byte) and ``own_start``/``own_len`` (the part of ``content`` this chunk
answers for; the bytes around it are shared context). A match belongs to the
chunk its first byte lies in, so chunking neither loses nor doubles a match.

Two steps keep the bulk of the data inside the JVM:

1. each rule has an *anchor*, a literal every match must contain; a chunk is
   kept for a rule only if the anchor occurs in it (plain substring search, or
   one pass of an automaton over all anchors of a large catalogue);
2. the few surviving (chunk, rule) pairs are matched with ``re`` in an Arrow
   batch, which yields byte offsets in one linear pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.automaton import Literals
from modelsieve.functions.once import computed_once

MANY_RULES = 500     # beyond this a plan with an expression per anchor costs more than it saves; one automaton finds all anchors
LOOK = -1            # stands for the rules that the automaton of a task finds
CHUNK_COLUMNS = ["artifact_id", "chunk_no", "base_offset", "own_start", "own_len", "file_len", "content"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    regex: str
    anchor: str | None          # literal contained in every match; None: always match
    ignore_case: bool = True
    text: bool = False          # match as Latin-1 text (Unicode classes), not as bytes


def widest(rule: Rule) -> int | None:
    """Most non-blank bytes a match can have; None if there is no bound. Blank runs do not count: shared context extends over them."""
    parser = re._parser
    flags = (re.IGNORECASE if rule.ignore_case else 0) | re.MULTILINE

    def blank(items) -> bool:
        return all(op is parser.IN and all(k is parser.CATEGORY and v is parser.CATEGORY_SPACE for k, v in value)
                   or op is parser.LITERAL and chr(value) in " \t\n\r\x0b\x0c" for op, value in items)

    def width(items) -> float:
        total = 0.0
        for op, value in items:
            if op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
                low, high, inner = value
                own = 0.0 if blank(inner) else width(inner)
                total += own and (float("inf") if high is parser.MAXREPEAT else own * high)
            elif op is parser.BRANCH:
                total += max(width(v) for v in value[1])
            elif op is parser.SUBPATTERN:
                total += width(value[-1])
            elif op in (parser.ASSERT, parser.ASSERT_NOT):
                # What is looked at beyond the match must be there as well.
                total += width(value[1])
            elif op is parser.ATOMIC_GROUP:
                total += width(value)
            elif op is parser.AT:
                continue
            else:
                total += float("inf") if op in (parser.GROUPREF, parser.GROUPREF_EXISTS) else 1
        return total

    found = width(parser.parse(rule.regex, flags))
    return None if found == float("inf") else int(found)


def shared_context(rules: Sequence[Rule], least: int = 64 << 10) -> int:
    """Bytes neighbouring chunks must share so that no match of ``rules`` is lost at a border.

    A rule without a bound raises: chunks of a file cannot answer for it.
    """
    most = 0
    for rule in rules:
        bound = widest(rule)
        if bound is None:
            raise ValueError(f"rule {rule.rule_id} can match any number of bytes; bound its repetitions, so that chunks can share enough")
        most = max(most, bound)
    return max(least, most + 2)


def whole_content(df: DataFrame) -> DataFrame:
    """View a table with one ``content`` per artifact as single-chunk rows."""
    return df.withColumns({
        "chunk_no": F.lit(0), "base_offset": F.lit(0).cast("bigint"), "own_start": F.lit(0),
        "own_len": F.octet_length("content"), "file_len": F.octet_length("content").cast("bigint")})


def match_offsets(rules: Sequence[Rule]):
    """UDF (content, base_offset, own_start, own_len, rule numbers) -> matches found."""
    flags = [(re.IGNORECASE if r.ignore_case else 0) | re.MULTILINE for r in rules]
    always, of_anchor, literals = [], [], None
    if len(rules) > MANY_RULES:
        # Anchors are looked for in folded text; those of rules that heed case are looked for once more.
        by_anchor: dict[bytes, list[int]] = {}
        for k, rule in enumerate(rules):
            (always if rule.anchor is None else by_anchor.setdefault(rule.anchor.encode("latin-1").lower(), [])).append(k)
        literals, of_anchor = Literals(list(by_anchor)), list(by_anchor.values())

    kind = pa.list_(pa.struct([("rule", pa.int32()), ("start", pa.int64())]))

    @F.arrow_udf("array<struct<rule:int,start:bigint>>")
    def offsets(content: pa.Array, base: pa.Array, own_start: pa.Array, own_len: pa.Array, wanted: pa.Array) -> pa.Array:
        compiled: dict[int, re.Pattern] = {}
        rows = []
        # one chunk's bytes at a time are copied out of the batch
        for cells in zip(content, base, own_start, own_len, wanted):
            data, first, lo, size, ids = (c.as_py() for c in cells)
            found = []
            if literals is not None and len(ids) and ids[0] == LOOK:
                ids = sorted([*always, *(k for word in literals.found(data.lower()) for k in of_anchor[word]
                                         if rules[k].ignore_case or rules[k].anchor.encode("latin-1") in data)])
            for k in ids:
                rule = rules[k]
                if k not in compiled:
                    source = rule.regex if rule.text else rule.regex.encode("latin-1")
                    compiled[k] = re.compile(source, flags[k])
                subject = data.decode("latin-1") if rule.text else data
                for match in compiled[k].finditer(subject):
                    if lo <= match.start() < lo + size:
                        found.append({"rule": int(k), "start": int(first) + match.start()})
            rows.append(found)
        return pa.array(rows, kind)

    return offsets


def with_candidates(chunks: DataFrame, rules: Sequence[Rule], out: str = "_rules") -> DataFrame:
    """Add the numbers of the rules whose anchor occurs in the chunk.

    Only substring search: the folded text is computed once per chunk, and only
    when some rule ignores case.
    """
    if len(rules) > MANY_RULES:
        return chunks.withColumn(out, F.array(F.lit(LOOK)))
    tests = []
    for k, rule in enumerate(rules):
        if rule.anchor is None:
            tests.append(F.lit(k))
        elif rule.ignore_case:
            tests.append(F.when(F.contains(F.col("_folded"), F.lit(rule.anchor.lower())), k))
        else:
            tests.append(F.when(F.contains(F.col("content"), F.lit(rule.anchor.encode("latin-1"))), k))
    if any(r.ignore_case and r.anchor is not None for r in rules):
        chunks = computed_once(chunks, _folded=F.lower(F.decode(F.col("content"), "ISO-8859-1")))
    return computed_once(chunks, **{out: F.array_compact(F.array(*tests))}).drop("_folded")


def find_matches(chunks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(artifact_id, rule_no, rule_id, offset), one row per match."""
    rules = list(rules)
    narrowed = with_candidates(chunks, rules).filter(F.size("_rules") > 0)
    hits = narrowed.select("artifact_id", F.explode(match_offsets(rules)(
        "content", "base_offset", "own_start", "own_len", "_rules")).alias("h"))
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    return hits.select("artifact_id", F.col("h.rule").alias("rule_no"),
                       F.get(ids, F.col("h.rule")).alias("rule_id"), F.col("h.start").alias("offset"))
