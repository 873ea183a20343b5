"""Repair of nearly valid JSON: one pass over lexical tokens, then strict decoding."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Python's constants in JSON, and the repairs in the order of reports.
LITERALS = {"True": "true", "False": "false", "None": "null"}
REPAIRS = ("single quotes", "Python literals", "unquoted keys", "trailing commas", "unclosed final brace or bracket")

_TOKEN = re.compile(r"""(?P<string>"(?:\\.|[^"\\])*")|(?P<cut>"(?:\\.|[^"\\])*\\?$)|(?P<single>'(?:\\.|[^'\\])*')|(?P<open>'.*)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<space>\s+)|(?P<mark>.)""", re.DOTALL)
_CLOSER = {"{": "}", "[": "]"}


def _requoted(token: str) -> str:
    inside = re.sub(r"""\\(.)|(")""", lambda m: '\\"' if m[2] else "'" if m[1] == "'" else m[0], token[1:-1], flags=re.DOTALL)
    return f'"{inside}"'


def repaired(text: str) -> tuple[str, Counter, bool]:
    """(text, repairs made, whether the original looks cut off)."""
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text)]
    solid = [i for i, (kind, _) in enumerate(tokens) if kind != "space"]
    follows = dict(zip(solid, [*solid[1:], None], strict=True))
    out, made, stack = [], Counter(), []
    depth, cut, mismatched, before = 0, False, False, ""
    for i, (kind, token) in enumerate(tokens):
        after = tokens[follows[i]][1] if kind != "space" and follows[i] is not None else ""
        if kind == "single":
            token = _requoted(token)
            made["single quotes"] += 1
        elif kind in ("cut", "open"):
            cut = kind == "cut"
        elif kind == "word":
            if token in LITERALS:
                token = LITERALS[token]
                made["Python literals"] += 1
            if before in ("{", ",") and after == ":":
                token = f'"{token}"'
                made["unquoted keys"] += 1
        elif kind == "mark":
            if token == "," and after in ("", "}", "]"):
                made["trailing commas"] += 1
                before = token
                continue
            if token in _CLOSER:
                stack.append(_CLOSER[token])
                depth += 1
            elif token in ("}", "]"):
                depth -= 1
                if stack and stack[-1] == token:
                    stack.pop()
                else:
                    mismatched = True
        if kind != "space":
            before = token
        out.append(token)
    fixed = "".join(out)
    if stack and not mismatched and not cut:
        made[REPAIRS[-1]] = len(stack)
        fixed = fixed.rstrip() + "".join(reversed(stack))
    return fixed, made, cut or depth > 0


def values_of(text: str) -> list | None:
    """The JSON values that make up the text with white space between them, or None."""
    decoder, found, at = json.JSONDecoder(), [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            return None
        found.append(value)
    return found


def heal_line(line: str, is_last: bool) -> tuple[list[str], list[str], str | None]:
    """(lines, repairs, error) for one line of JSON: itself, repaired, split, dropped if it is a cut last line, or kept with an error."""
    if not line.strip():
        return [line], [], None
    try:
        json.loads(line)
        return [line], [], None
    except json.JSONDecodeError as error:
        fault = f"column {error.colno}: {error.msg}"
    fixed, made, truncated = repaired(line)
    repairs = [f"{name} ({made[name]})" for name in REPAIRS if made[name]]
    values = values_of(fixed)
    if values and len(values) == 1:
        return [fixed], repairs, None
    if values:
        return [json.dumps(v, ensure_ascii=False) for v in values], [*repairs, f"concatenated objects split into {len(values)}"], None
    if is_last and truncated:
        return [], ["truncated last line dropped"], None
    return [line], [], fault


def heal_document(text: str) -> tuple[str, list[str], str | None]:
    """The same for a whole JSON document; several values become an array."""
    try:
        json.loads(text)
        return text, [], None
    except json.JSONDecodeError as error:
        fault = f"line {error.lineno} column {error.colno}: {error.msg}"
    fixed, made, _ = repaired(text)
    repairs = [f"{name} ({made[name]})" for name in REPAIRS if made[name]]
    values = values_of(fixed)
    if values and len(values) == 1:
        return fixed, repairs, None
    if values:
        return json.dumps(values, ensure_ascii=False, indent=1) + "\n", [*repairs, f"concatenated objects wrapped into an array of {len(values)}"], None
    return text, [], fault


def heal_lines(df: DataFrame, number: str = "line_no", line: str = "line") -> DataFrame:
    """(line_no, part, line, repairs, error): the repaired lines; a dropped line has part -1 and a null line."""
    last = df.filter(F.length(F.trim(line)) > 0).agg(F.max(number).alias("m")).first()["m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, text in zip(batch.column(number).to_pylist(), batch.column(line).to_pylist(), strict=True):
                lines, repairs, error = heal_line(text or "", n == last)
                rows += [(n, p, x, repairs, error) for p, x in enumerate(lines)] or [(n, -1, None, repairs, error)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["line_no", "part", "line", "repairs", "error"])

    return df.select(F.col(number).cast("long").alias(number), line).mapInArrow(run, "line_no long, part long, line string, repairs array<string>, error string")
