"""Chat formatting from event logs.

A conversation is a log of events (conv_id, seq, kind, turn, slot, role, text):

* ``open`` starts message (turn, slot) with a role;
* ``delta`` appends text to it;
* ``edit`` replaces its text;
* ``regenerate`` drops its text so far, and all later messages opened so far.

Folding partitions by message, so a conversation of any length spreads over tasks; only the sequence numbers of
regenerations are carried along a conversation in order. Messages render on their own as

    ### role: text</turn>

with control strings inside roles and texts escaped, so that the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
EXTRA = -7      # id of the conversation that op3's query adds

MESSAGE = ["conv_id", "turn", "slot"]
_TEXT = re.compile(r"\\|</turn>|(?<=#)#")
_ROLE = re.compile(r"\\|</turn>|(?<=#)#|[:\n]")
_PLAIN = {"\\": "\\\\", "</turn>": "<\\/turn>", "#": "\\#", ":": "\\c", "\n": "\\n"}
_BACK = {"\\": "\\", "/": "/", "#": "#", "c": ":", "n": "\n"}
_SEGMENT = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.DOTALL)


def escape_text(text: str) -> str:
    return _TEXT.sub(lambda m: _PLAIN[m[0]], text)


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: _PLAIN[m[0]], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, slot, role, text): the final messages. ``seq`` may be of any type that sorts.

    Messages without an ``open`` event that counts are none. Null texts and roles are empty; null turns sort first.
    """
    def last(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("seq")))

    resets = events.filter("kind = 'regenerate'").groupBy(*MESSAGE).agg(F.max("seq").alias("_reset"))
    opened = events.filter("kind = 'open'").select(*MESSAGE).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in MESSAGE]

    def named(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c: f"_{c}" for c in MESSAGE})

    before = (opened.join(named(resets), same, "left").select(*MESSAGE, "_reset")
              .withColumn("_before", F.max("_reset").over(order)))
    messages = events.groupBy(*MESSAGE).agg(
        last("open").alias("_opened"), last("edit").alias("_edited"),
        F.max_by(F.when(F.col("kind") == "open", F.coalesce("role", F.lit(""))), F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        # The pieces of one text, which has to fit a row anyway.
        F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("_parts"))
    met = messages.join(named(before), same)

    def later(seq: Column, bound: str, itself: bool = False) -> Column:
        return F.col(bound).isNull() | (seq >= F.col(bound) if itself else seq > F.col(bound))

    alive = F.filter("_parts", lambda p: later(p["seq"], "_before") & later(p["seq"], "_reset")
                     & (later(p["seq"], "_edited", True) | ~later(F.col("_edited"), "_reset") | ~later(F.col("_edited"), "_before")))
    text = F.array_join(F.transform(F.array_sort(alive), lambda p: p["text"]), "")
    return met.filter(later(F.col("_opened"), "_before")).select(*MESSAGE, "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, slot, formatted, loss_start, loss_end): each message's part of its conversation's text.

    The parts of a conversation in order of turn and slot are its formatted text. The loss mask covers code points
    ``loss_start`` to ``loss_end`` (end exclusive) of the part: the text of assistant messages, else nothing.
    """
    schema = pa.schema([("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                body, lead = escape_text(text or ""), f"{OPEN}{escape_role(role or '')}{MIDDLE}"
                rows.append((f"{lead}{body}{CLOSE}", len(lead), len(lead) + len(body) if role == TRAINED else len(lead)))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + made, names=[*MESSAGE, *schema.names])

    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in MESSAGE)
    return messages.select(*MESSAGE, "role", "text").mapInArrow(work, f"{kinds}, formatted string, loss_start long, loss_end long")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the messages in a formatted text; fails on anything else."""
    out, at = [], 0
    while at < len(formatted):
        found = _SEGMENT.match(formatted, at)
        if not found:
            raise ValueError(f"no message at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text.

    A digest over a whole conversation is a chain, so its parts pass through one task in order, one at a time.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss, counts = (), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        out: list[tuple] = []

        def close() -> None:
            if now:
                out.append((now[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def batch_of(rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
            types = [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        first = pa.int64()
        for batch in batches:
            first = batch.column(0).type
            for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now != (conv,):
                    close()
                    now, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, text in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    counts[0] += 1
                masked = unescape(formatted[start:end])
                loss.update(masked.encode())
                counts[1] += len(masked)
                counts[2] += len(formatted)
            if out:
                yield batch_of(out, first)
                out = []
        close()
        if out:
            yield batch_of(out, first)

    ordered = (rendered.select(*MESSAGE, "formatted", "loss_start", "loss_end").repartition("conv_id")
               .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in MESSAGE]))
    return ordered.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Logs that lead to the given (conv_id, turn, role, text): texts streamed in halves, after drafts that are edited or
    regenerated. Rows of one turn, repeated rows included, are messages of their own, by role and text."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    slot = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("slot", slot)
    half = (F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def step(n: int, kind: str, value: Column | None = None) -> Column:
        return F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), (F.lit("") if value is None else value).alias("text"))

    streamed = F.array(step(0, "open"), step(1, "delta", first), step(2, "delta", second))
    retried = F.array(step(0, "open"), step(1, "delta", F.lit("A draft.")), step(2, "regenerate"), step(3, "delta", first), step(4, "delta", second))
    edited = F.array(step(0, "open"), step(1, "delta", second), step(2, "edit", first), step(3, "delta", second))
    way = F.when(F.col("role") == TRAINED, retried).when(F.col("slot") % 2 == 0, streamed).when(F.length("text") % 2 == 0, edited).otherwise(streamed)
    return (rows.withColumn("_e", F.explode(way))
            .select("conv_id", F.struct("turn", "slot", F.col("_e.step").alias("step")).alias("seq"), F.col("_e.kind").alias("kind"),
                    "turn", "slot", "role", F.col("_e.text").alias("text")))


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Log, fold, render, read back: one row per conv_id (a null id is one conversation)."""
    return digests(render(fold(as_events(conversations))))


def op3_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA, 0, "user", said), (EXTRA, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return formatted_digests(rows.unionByName(extra))


SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
    SELECT *, regexp_replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '#', '\#'), '(^|[^#])\\#', '\1#', 'g') AS safe
    FROM rows),
messages AS (SELECT *, '### ' || role || ': ' || safe || '</turn>' || chr(10) AS formatted FROM escaped)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(formatted))::BIGINT AS formatted_chars
FROM messages GROUP BY conv_id
"""
