"""Chat formatting from an event log.

A log has events (conv_id, seq, message, kind, role, text). ``start`` opens a message, ``delta`` adds text to it, ``edit``
replaces its text, ``regenerate`` empties it and drops what was said after it. The log is partitioned by conversation,
sorted by ``seq`` and folded; a task holds one conversation at a time. Conversations whose log is longer than
``PART_CHARS`` characters, however long, are folded in two levels instead:

1. The events of a message, sorted, are folded into its text and the place of its last cut. The key is (conversation,
   message), so a conversation with a third of all events is spread over its messages.
2. Whether a message outlives the cuts before it follows from the running latest cut of the earlier messages, and its
   place in the output from a running sum of lengths; both are scans in two levels over narrow rows.
3. Parts of about ``PART_CHARS`` characters are rendered, each by itself.

The template marks turns by control strings and text that holds one gets a backslash after its first character, or one
more where backslashes stand there, which is undone on reading:

    <s>  [SYS]system[/SYS]  [INST]user[/INST]  assistant</s>  [ROLE]other[/ROLE]text[/TEXT]

Defined results: null texts and roles are empty; a delta without text adds nothing; events of a message before its start
are folded too (its role is that of the last start, none: empty); an event of another kind, or without seq or message,
fails the query; events that share a seq are ordered by kind (start, edit, regenerate, delta), role and text, messages
that begin at one seq by their name; repeated events count each; a null conv_id is a conversation; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import running, width_for
from .common import staged, table

KINDS = ("start", "edit", "regenerate", "delta")
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TEXT]")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: A control string with any number of backslashes after its first character.
_PLAIN = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"
#: Characters of a part; a turn stands in one part whole.
PART_CHARS = 1 << 20
#: Names of long conversations that are sent to every task; more are joined by a shuffle.
SENT_LONG = 100_000


def escaped(text: str) -> str:
    return re.sub(_PLAIN, r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return re.sub(_ESCAPED, r"\1\2\3", text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """(a turn as it stands in the output, where its text begins and ends)."""
    before, after = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}.get(role) or (f"[ROLE]{escaped(role)}[/ROLE]", "[/TEXT]")
    body = escaped(text)
    return before + body + after, len(before), len(before) + len(body)


_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TEXT\]|(?P<assistant>.*?)</s>", re.S)


def turns_of(formatted: str):
    """(role, text) of the turns of a part, in order."""
    for m in _TURN.finditer(formatted, 3 if formatted.startswith("<s>") else 0):
        role = m.lastgroup
        yield (unescaped(m["role"]), unescaped(m["text"])) if role == "text" else (role, unescaped(m[role]))


def events_of(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log: each row is a message, started, then streamed in one delta.

    Turns of a conversation that share a number stand in the order of the MD5 of role and text; a null number comes first.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.md5(F.to_json(F.struct("role", "text"))).alias("digest"))
    copied = rows.groupBy("conv_id", "turn", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # narrow, texts stay where they are
    if copied.isEmpty():
        alike = rows.withColumn("n", F.lit(1).cast("long"))
    else:
        alike = rows.groupBy("conv_id", "turn", "role", "text", "digest").agg(F.count(F.lit(1)).alias("n"))
    step = lambda kind, role, text, at: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"), F.lit(at).alias("at"))
    none = F.lit(None).cast("string")
    steps = F.array(step("start", F.col("role"), none, 0), step("delta", none, F.col("text"), 1))
    keyed = alike.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    made = keyed.select("conv_id", "turn", F.concat_ws("/", F.col("turn").cast("string"), "digest", F.format_string("%012d", "__copy")).alias("message"), F.explode(steps).alias("e"))
    return made.select("conv_id", (F.coalesce("turn", F.lit(-(1 << 60))) * 2 + F.col("e.at")).alias("seq"), "message", "e.kind", "e.role", "e.text")


OUT = "part long, formatted string, n_turns long, loss array<struct<start:long,end:long>>, whole boolean"


def _checked(seq, message, kind) -> None:
    if seq is None or message is None or kind not in KINDS:
        raise ValueError(f"an event must have a seq, a message and a kind of {KINDS}, not {kind!r}")


def _parts_batch(rows, kind):
    """Rows (conv_id, part, turns, whether the part is the whole conversation), each turn a (role, text), as an Arrow batch."""
    import pyarrow as pa

    texts, spans = [], []
    for _, part, turns, _ in rows:
        pieces, loss, size = (["<s>"], [], 3) if part == 0 else ([], [], 0)
        for role, text in turns:
            turn, start, end = rendered(role, text)
            if role == "assistant":
                loss.append({"start": size + start, "end": size + end})
            pieces.append(turn)
            size += len(turn)
        texts.append("".join(pieces))
        spans.append(loss)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array(texts, pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array(spans, kinds), pa.array([r[3] for r in rows], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "formatted", "n_turns", "loss", "whole"])


def _fold_whole(batches):
    """Sorted events of whole conversations to one part each. Holds one conversation at a time."""
    kind, key, live, gone, made, size = None, None, {}, {}, [], 0

    def closed():
        turns = [(m["role"], "".join(m["text"])) for _, m in sorted(live.items(), key=lambda x: (x[1]["at"], x[0]))]
        return (key[0], 0, turns, True)

    for rows in batches:
        kind = rows.schema.field("conv_id").type
        for conv, message, seq, what, role, text in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "message", "seq", "kind", "role", "text")], strict=True):
            _checked(seq, message, what)
            if key != (conv,):
                if live:
                    made.append(closed())
                key, live, gone = (conv,), {}, {}
            if size > 1 << 24 or len(made) >= 2_000:
                yield _parts_batch(made, kind)
                made, size = [], 0
            size += len(text or "")
            if what == "regenerate":  # a cut holds even if its message is gone
                at = live[message]["at"] if message in live else gone.get(message, seq)
                for m in [m for m, x in live.items() if (x["at"], m) > (at, message) and x["at"] < seq]:
                    gone[m] = live.pop(m)["at"]
            if message in gone:
                continue
            now = live.setdefault(message, {"at": seq, "role": "", "text": []})
            if what == "start":
                now["role"] = role or ""
            elif what == "delta":
                now["text"].append(text or "")
            else:
                now["text"] = [text or ""] if what == "edit" else []
    if live:
        made.append(closed())
    if made:
        yield _parts_batch(made, kind)


def _fold(batches):
    """Sorted events to a row per message: place, last cut, role, text. Holds one message at a time."""
    import pyarrow as pa

    kinds, made, size = None, [], 0
    key, now = None, None

    def closed():
        return (*key, now["at"], now["cut"], now["role"], "".join(now["text"]))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], ["conv_id", "message", "at", "cut", "role", "text"])

    for rows in batches:
        kinds = [rows.schema.field("conv_id").type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for conv, message, seq, kind, role, text in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "message", "seq", "kind", "role", "text")], strict=True):
            _checked(seq, message, kind)
            if now is None or key != (conv, message):
                if now is not None:
                    made.append(closed())
                    size += len(made[-1][-1])
                key, now = (conv, message), {"at": seq, "cut": None, "role": "", "text": []}
            if kind == "start":
                now["role"] = role or ""
            elif kind == "delta":
                now["text"].append(text or "")
            elif kind == "edit":
                now["text"] = [text or ""]
            else:
                now["text"], now["cut"] = [], seq
            if size > 1 << 24 or len(made) >= 10_000:
                yield batch(made)
                made, size = [], 0
    if now is not None:
        yield batch([*made, closed()])


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, at, role, text) of the messages that outlive all cuts; ``at``, then ``message`` is their order.

    A cut at ``seq`` s of a message drops the messages that begin after it and before s, even if it has itself been
    dropped; later events of a dropped message do not bring it back.
    """
    conv = dict(events.dtypes)["conv_id"]
    folded = staged(_ordered(events, "conv_id", "message").mapInArrow(_fold, f"conv_id {conv}, message string, at long, cut long, role string, text string"), "messages")
    narrow = folded.select("conv_id", "message", "at", "cut")
    if narrow.where("cut IS NOT NULL").isEmpty():
        return folded.drop("cut")
    seen = running(narrow, ["conv_id"], ["at", "message"], width_for(narrow, ["conv_id"], "at"), latest=("max_before", F.col("cut")))
    gone = seen.where("latest > at").select(F.col("conv_id").alias("__conv"), F.col("message").alias("__message"))
    return folded.join(gone, folded["conv_id"].eqNullSafe(gone["__conv"]) & (folded["message"] == gone["__message"]), "left_anti").drop("cut")


def _render(batches):
    """Sorted messages of long conversations to a row per part. Holds one part at a time."""
    kind, key, turns = None, None, []
    for rows in batches:
        kind = rows.schema.field("conv_id").type
        for conv, part, role, text in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")], strict=True):
            if key != (conv, part):
                if key is not None:
                    yield _parts_batch([(*key, turns, False)], kind)
                key, turns = (conv, part), []
            turns.append((role, text))
    if key is not None:
        yield _parts_batch([(*key, turns, False)], kind)


def _ordered(events: DataFrame, *keys: str) -> DataFrame:
    """Events by ``keys``, sorted by seq and, of one seq, by message and kind."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    rows = events.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "message", rank, "role", "text")


def in_parts(events: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``formatted`` of conversations of any length, in parts."""
    alive = messages(events)
    conv = dict(alive.dtypes)["conv_id"]
    sizes = alive.select("conv_id", "message", "at", (F.length("role") + F.length("text") + 16).cast("long").alias("size"))
    placed = running(sizes, ["conv_id"], ["at", "message"], width_for(sizes, ["conv_id"], "at"), before=("sum_before", F.col("size")))
    part = F.floor(F.coalesce("before", F.lit(0)) / part_chars).cast("long")
    places = placed.select(F.col("conv_id").alias("__conv"), F.col("message").alias("__message"), part.alias("part"))
    turns = alive.join(places, alive["conv_id"].eqNullSafe(places["__conv"]) & (alive["message"] == places["__message"])).select("conv_id", "part", "at", "message", "role", "text")
    laid = turns.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at", "message")
    return laid.mapInArrow(_render, f"conv_id {conv}, {OUT}")


def formatted(events: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, n_turns, loss: array of start, end in code points of ``formatted``, whole).

    ``whole`` parts are conversations; the parts of a long one are numbered from 0, with gaps after long turns.
    """
    conv = dict(events.dtypes)["conv_id"]
    sizes = events.groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("role"), F.lit(0)) + 16).alias("size"))
    long = staged(sizes.where(F.col("size") > part_chars).select(F.col("conv_id").alias("__long")), "long")
    n = long.count()
    whole = lambda rows: _ordered(rows, "conv_id").mapInArrow(_fold_whole, f"conv_id {conv}, {OUT}")
    if not n:
        return whole(events)
    named = F.broadcast(long) if n <= SENT_LONG else long
    split = lambda how: events.join(named, events["conv_id"].eqNullSafe(named["__long"]), how)
    return whole(split("left_anti")).unionByName(in_parts(split("left_semi"), part_chars))


def _read_back(batches):
    """Sorted parts to a row per conversation: digests of what the parts hold."""
    import hashlib

    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind, key, now, made = None, None, None, []

    def closed():
        return key[0], now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]

    def batch(rows):
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(6)], names)

    for rows in batches:
        kind = rows.schema.field("conv_id").type
        for conv, text, loss in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")], strict=True):
            if key != (conv,):
                if key is not None:
                    made.append(closed())
                key, now = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text):
                now[0] += 1
                now[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescaped(text[span["start"] : span["end"]])
                now[2] += len(said)
                now[3].update(said.encode())
            now[4] += len(text)
        if len(made) >= 10_000:
            yield batch(made)
            made = []
    if key is not None:
        yield batch([*made, closed()])


def digests(parts: DataFrame) -> DataFrame:
    """A row per conversation read back from its parts, one part at a time: turns, text under the loss mask, length.

    Whole conversations are read where they lie; the parts of long ones are brought together in order.
    """
    conv = dict(parts.dtypes)["conv_id"]
    read = lambda rows: rows.mapInArrow(_read_back, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read(parts.where("whole")).unionByName(read(parts.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")))


def op13_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(staged(formatted(events_of(turns.unionByName(planted))), "formatted"))
