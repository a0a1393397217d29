import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from modelsieve.llm import op3_chat as op
from tests.conftest import SF

PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "### user: ", "</turn>", "</turn>\n", "<", "/turn>", ":", "\n", "é", "a", "\\/", "\\n", ""]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_escaping_is_reversible(messages):
    text = "".join(f"### {op.escape_role(r)}: {op.escape_text(t)}</turn>\n" for r, t in messages)
    assert op.parse(text) == messages
    assert text.count("</turn>") == text.count("###") == len(messages)


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, messages in by.items():
        messages.sort()
        loss = "".join(t for _, _, r, t in messages if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in messages).encode()).hexdigest()
        out[conv] = (len(messages), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    assert got(op.op3_chat_events(spark, SF)) == expected(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_odd_rows(spark):
    long = "### </turn>é\\" * 100_000
    rows = [(1, 1, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (1, None, "assistant", "first"), (None, 5, "a:b\n", "t"), (None, None, None, None),
            (2, 3, "assistant", long), (2, 3, "assistant", ""), (2, -4, "system", "####")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, slot int, kind string")
    assert got(op.formatted_digests(table)) == expected(rows)
    assert op.formatted_digests(table.limit(0)).count() == 0


def plain_fold(events):
    """The log replayed one event at a time."""
    messages = {}
    for _, kind, turn, role, text in sorted(events):
        if kind == "open":
            messages[turn] = [role, messages.get(turn, ["", ""])[1]]
        elif turn in messages:
            if kind == "delta":
                messages[turn][1] += text
            elif kind == "edit":
                messages[turn][1] = text
            else:
                messages[turn][1] = ""
                messages = {t: m for t, m in messages.items() if t <= turn}
    return {t: tuple(m) for t, m in messages.items()}


def test_fold_equals_replay(spark):
    import random
    rng = random.Random(8)
    logs, rows = {}, []
    for conv in range(150):
        turn, log = 0, [(0, "open", 0, "user", "")]
        for seq in range(1, rng.randrange(2, 25)):
            kind = rng.choice(["open", "delta", "delta", "edit", "regenerate"])
            if kind == "open":
                turn += 1
            elif kind == "regenerate":
                turn = rng.randrange(turn + 1)
            log.append((seq, kind, turn, rng.choice("ab"), rng.choice(["x", "y", "zz"])))
        logs[conv] = log
        rows += [(conv, s, k, t, 1, r, x) for s, k, t, r, x in log]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, slot int, role string, text string")
    found = defaultdict(dict)
    for r in op.fold(events).collect():
        found[r["conv_id"]][r["turn"]] = (r["role"], r["text"])
    assert dict(found) == {c: plain_fold(log) for c, log in logs.items()}
