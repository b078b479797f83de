"""Settings files in the part of YAML that such files use, one file a row.

Maps and lists by indentation, maps and lists in brackets, plain and quoted scalars, folded (``>``) and kept (``|``) texts,
comments. Anchors, tags, several documents and keys that are not plain are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s'"\[\]{},#&*!|>%@`-][^:#]*?|-[^\s:#][^:#]*?))\s*:(?:\s+|$)""")
_NUMBER = re.compile(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?")
_WORDS = {"": None, "null": None, "~": None, "true": True, "false": False, ".inf": float("inf"), "-.inf": float("-inf"), ".nan": float("nan")}


def _bare(line: str) -> str:
    """A line without its comment; a ``#`` within quotes is none."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("&", "*", "!", "%", "@", "`"):
        raise ValueError(f"no settings value: {text!r}")
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        import json

        return json.loads(text)
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if _NUMBER.fullmatch(text):
        return float(text) if re.search(r"[.eE]", text) else int(text)
    return text


def _flow(text: str, at: int = 0):
    """(value, place after it) of a value in brackets."""
    closing = {"[": "]", "{": "}"}[text[at]]
    out, at = ([] if closing == "]" else {}), at + 1

    def item(at: int):
        while at < len(text) and text[at] in " \t":
            at += 1
        if at < len(text) and text[at] in "[{":
            return _flow(text, at)
        m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*?)\s*(?=[,\]}]|:\s|$)""").match(text, at)
        return _scalar(m[1]), m.end()

    while True:
        while at < len(text) and text[at] in " \t,":
            at += 1
        if at >= len(text):
            raise ValueError(f"brackets are not closed: {text!r}")
        if text[at] == closing:
            return out, at + 1
        value, at = item(at)
        if closing == "}":
            if text[at : at + 1] != ":":
                raise ValueError(f"a key without a value: {text!r}")
            out[value], at = item(at + 1)
        else:
            out.append(value)


def parsed(text: str):
    """The value of a settings text."""
    raw = text.split("\n")
    lines = [(len(x) - len(x.lstrip(" ")), x.strip(), i) for i, x in enumerate(map(_bare, raw)) if x.strip() and x.strip() != "---"]
    at = 0

    def texts(folded: bool, indent: int, first: int):
        """A text block below a line."""
        nonlocal at
        found, i = [], first
        while i < len(raw) and (not raw[i].strip() or len(raw[i]) - len(raw[i].lstrip(" ")) > indent):
            found.append(raw[i].strip() if folded else raw[i])
            i += 1
        while at < len(lines) and lines[at][2] < i:
            at += 1
        while found and not found[-1].strip():
            found.pop()
        if folded:
            return re.sub(r"(?<=\S) (?=\S)", " ", " ".join(x or "\n" for x in found)).replace(" \n ", "\n") + "\n"
        cut = min((len(x) - len(x.lstrip(" ")) for x in found if x.strip()), default=0)
        return "\n".join(x[cut:] for x in found) + "\n"

    def value(rest: str, indent: int, number: int):
        nonlocal at
        if rest[:1] in ("[", "{"):
            while True:  # brackets may go on over lines
                try:
                    return _flow(rest)[0]
                except ValueError:
                    if at >= len(lines):
                        raise
                    rest, at = f"{rest} {lines[at][1]}", at + 1
        if rest[:1] in (">", "|"):
            return texts(rest[0] == ">", indent, number + 1)
        if rest:
            while at < len(lines) and lines[at][0] > indent and rest[:1] not in "\"'":  # a plain text may go on too
                rest, at = f"{rest} {lines[at][1]}", at + 1
            return _scalar(rest)
        below = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
        return block(lines[at][0]) if below else None

    def block(indent: int):
        nonlocal at
        listed = lines[at][1] == "-" or lines[at][1].startswith("- ")
        out = [] if listed else {}
        while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")) == listed:
            _, line, number = lines[at]
            if listed:
                rest = line[1:].strip()
                m = _KEY.match(rest)
                if m and rest[:1] not in ("[", "{"):  # a map that begins beside the dash
                    lines[at] = (indent + len(line) - len(rest), rest, number)
                    out.append(block(lines[at][0]))
                    continue
                at += 1
                out.append(value(rest, indent, number))
                continue
            m = _KEY.match(line)
            if not m:
                raise ValueError(f"line {number + 1} is no setting: {line!r}")
            key = next(g for g in m.groups() if g is not None)
            if key in out:
                raise ValueError(f"line {number + 1} repeats {key!r}")
            at += 1
            out[key] = value(line[m.end() :].strip(), indent, number)
        return out

    if not lines:
        return None
    if lines[0][1][:1] in ("[", "{"):
        return _flow(" ".join(x[1] for x in lines))[0]
    made = block(lines[0][0])
    if at < len(lines):
        raise ValueError(f"line {lines[at][2] + 1} is indented as nothing above it: {lines[at][1]!r}")
    return made


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of all settings files below a path, each as a JSON text that ``from_json`` reads with a schema."""

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            made = [json.dumps(parsed(x.as_py())) for x in batch.column("value")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.string())], ["path", "json"])

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.mapInArrow(run, "path string, json string")


def settings(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> dict:
    """One settings file as a dictionary; a name of ``needed`` that it lacks is an error."""
    import json

    row = documents(spark, path).first()
    out = (json.loads(row["json"]) if row else None) or {}
    lacking = [n for n in needed if out.get(n) is None]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return out
