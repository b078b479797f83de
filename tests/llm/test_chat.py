"""Chat formatting against a plain fold of the log, and round trips of the template."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

DATA = "/root/testdata/sf0.001"
LOG = "conv_id long, seq long, message string, kind string, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "[", "<", "]", ">", "/s>", "INST]", "a", "\n", "é", " "]), max_size=12).map("".join))
def test_escaping_comes_back_and_hides_controls(text):
    hidden = chat.escaped(text)
    assert chat.unescaped(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a[/ROLE]"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "[", "<", "x"]), max_size=5).map("".join)), max_size=5))
def test_turns_come_back(turns):
    assert list(chat.turns_of("<s>" + "".join(chat.rendered(*t)[0] for t in turns))) == turns


def folded(log):
    """Conversations as lists of (role, text), by one pass over the log of each."""
    out = {}
    for conv in {e[0] for e in log}:
        live = {}
        rank = chat.KINDS.index
        mine = sorted((e for e in log if e[0] == conv), key=lambda e: (e[1], e[2], rank(e[3]), e[4] is not None, e[4] or "", e[5] is not None, e[5] or ""))
        place, dropped = {}, set()
        for _, seq, m, *_ in mine:
            place.setdefault(m, (seq, m))
        for _, seq, m, kind, role, text in mine:
            now = live.setdefault(m, ["", ""])
            if kind == "start":
                now[0] = role or ""
            elif kind == "delta":
                now[1] += text or ""
            elif kind == "edit":
                now[1] = text or ""
            else:
                now[1] = ""
                dropped |= {x for x, at in place.items() if at > place[m] and at[0] < seq}
        turns = [tuple(live[m]) for m in sorted(live, key=place.get) if m not in dropped]
        if turns:
            out[conv] = turns
    return out


def digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def got(events, **kw):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.formatted(events, **kw)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    log = []
    for conv in (1, 2, None):
        for seq in rng.sample(range(400), 60 if conv == 1 else 25):
            kind = rng.choices(chat.KINDS, [3, 1, 0.4, 6])[0]
            log.append((conv, seq, f"m{rng.choice([seq // 12, rng.randrange(30)])}", kind, rng.choice(["user", "assistant", "tool", None]) if kind == "start" else None, rng.choice(["a", "</s>", "[INST]", "", None, "[\\SYS]"])))
    log += [log[3], log[3]]
    rng.shuffle(log)
    events = spark.createDataFrame(log, LOG).selectExpr("*", "1 AS part", "'x' AS at", "2 AS size")
    want = {c: digest(t) for c, t in folded(log).items()}
    assert got(events) == want
    assert got(events, part_chars=30) == want  # conversations in many parts
    assert got(events, part_chars=700) == want  # some whole, some in parts


def test_edits_and_regenerations(spark):
    log = [
        (1, 1, "a", "start", "user", None), (1, 2, "a", "delta", None, "hel"), (1, 3, "a", "delta", None, "lo"),
        (1, 4, "b", "start", "assistant", None), (1, 5, "b", "delta", None, "bad"), (1, 6, "c", "start", "user", None), (1, 7, "c", "delta", None, "no"),
        (1, 8, "b", "regenerate", None, None), (1, 9, "b", "delta", None, "good"), (1, 10, "d", "start", "user", None), (1, 11, "d", "delta", None, "x"), (1, 12, "d", "edit", None, "thanks"),
    ]
    row = chat.formatted(spark.createDataFrame(log, LOG)).first()
    assert row["formatted"] == "<s>[INST]hello[/INST]good</s>[INST]thanks[/INST]"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == ["good"]


def test_odd_logs(spark):
    assert got(spark.createDataFrame([], LOG)) == {}
    for bad in ((1, None, "a", "delta", None, "x"), (1, 1, None, "delta", None, "x"), (1, 1, "a", "other", None, "x"), (1, 1, "a", None, None, "x")):
        with pytest.raises(Exception, match="an event must have"):
            got(spark.createDataFrame([bad], LOG))
    long = "word " * 300_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (2, 0, "assistant", long)]
    rows = got(chat.events_of(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS n", "'y' AS message")))
    assert rows == {1: digest([("user", long), ("assistant", ""), ("assistant", "")]), 2: digest([("", "x"), ("assistant", long)])}


def test_query_reads_back_every_conversation(spark):
    from tidemark.llm.queries import LLM_QUERIES

    rows = {r["conv_id"]: r for r in LLM_QUERIES["op13_event_sourced_chat"](spark, DATA).collect()}
    convs = {}
    for r in sorted(spark.read.parquet(f"{DATA}/conversations.parquet").collect(), key=lambda r: r["turn"]):
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    convs[-1] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    assert {c: digest(t) for c, t in convs.items()} == {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in rows.items()}
    assert all(r["formatted_chars"] > r["loss_chars"] for r in rows.values())
