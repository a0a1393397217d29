"""Template injection: dangerous free names in {% %} and {{ }} blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
DANGEROUS_NAMES = ["system", "os", "subprocess", "__class__", "__subclasses__", "globals"]
TEMPLATE_SCORE = 9.8
TEMPLATE_VECTOR = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"

BLOCKS = r"(?s)\{%.*?%\}|\{\{.*?\}\}"
QUOTED = r"""(?s)'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
# Words that are not free names: attributes, filters, tests, and the targets of
# assignments or keyword arguments.
BOUND = r"\.\s*\w+|\|\s*\w+|\bis\s+(?:not\s+)?\w+|\b\w+\s*=(?!=)"
# A statement block stands on its own only for these; others need a closing
# block and are passed over, as each block is looked at alone.
STANDALONE = r"(?s)^\{%[-+]?\s*(?:set|include|import|from|extends)\b"


def template_blocks(df: DataFrame) -> DataFrame:
    """(artifact_id, block): the distinct blocks of each artifact. Blocks may be
    long, so ``content`` must be the whole text, not a chunk."""
    text = F.decode("content", "ISO-8859-1")
    kept = df.filter(F.contains(F.col("content"), F.lit(b"{{")) | F.contains(F.col("content"), F.lit(b"{%")))
    return kept.select("artifact_id", F.explode(F.array_distinct(
        F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0)))).alias("block"))


def iter_blocks(read, size: int = 1 << 20):
    """The blocks of a stream, as one search through the whole text gives them, holding no more than the open block.

    ``read(n)`` returns the next bytes, none at the end.
    """
    buffer, at, ended = b"", 0, False
    closings = {b"{%": b"%}", b"{{": b"}}"}
    while True:
        starts = [(i, mark) for mark in closings if (i := buffer.find(mark, at)) >= 0]
        if starts:
            start, mark = min(starts)
            end = buffer.find(closings[mark], start + 2)
            while end < 0 and not ended:
                more = read(size)
                ended = not more
                # only the new bytes can hold the end; the longer the block, the larger the next piece
                here = max(start + 2, len(buffer) - 1)
                buffer, size = buffer + more, min(2 * size, 64 << 20)
                end = buffer.find(closings[mark], here)
            if end >= 0:
                yield buffer[start:end + 2]
                at = end + 2
            else:
                del closings[mark]     # the rest holds no such closing
                at = start
            continue
        if ended:
            return
        more = read(size)
        ended = not more
        buffer, at = buffer[max(at, len(buffer) - 1):] + more, 0


def template_injection(df: DataFrame) -> DataFrame:
    """One critical finding per distinct block that asks for a dangerous name."""
    return block_findings(template_blocks(df))


def block_findings(blocks: DataFrame) -> DataFrame:
    """Findings on (artifact_id, block) rows, distinct per artifact."""
    block = F.col("block")
    inner = F.regexp_replace(F.regexp_replace(block, QUOTED, " 0 "), BOUND, " ")
    names = F.array_sort(F.array_intersect(
        F.regexp_extract_all(inner, F.lit(r"\b[A-Za-z_]\w*"), F.lit(0)),
        F.array(*[F.lit(n) for n in DANGEROUS_NAMES])))
    return (blocks
            .filter(block.startswith("{{") | block.rlike(STANDALONE))
            .withColumn("names", names).filter(F.size("names") > 0)
            .select("artifact_id", F.lit("ssti_risk").alias("type"),
                    F.lit("command_injection").alias("category"), F.lit(0).cast("bigint").alias("offset"),
                    F.lit("critical").alias("severity"), F.lit(TEMPLATE_SCORE).alias("cvss_score"),
                    F.lit(TEMPLATE_VECTOR).alias("cvss_vector"),
                    F.concat(F.lit("Template injection risk, dangerous names requested: "),
                             F.array_join("names", ", ")).alias("desc"),
                    "block"))
