"""Secret scans: every rule in one pass over the bytes by a combined deterministic automaton.

The pass runs from the last byte to the first, over the automaton of all mirrored rules: after each byte its state
tells which rules have a match that starts there (run forwards, it would have many times the states, as every rule
that ends in a run of characters stays open beside all others). From the first start that no earlier match of the
rule covers, the rule's own automaton walks as far as it accepts: so spans are leftmost, longest and without
overlaps, and all of them come from transition arrays.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.arrow_docs import bounded_batches, frugal, slices, utf8
from millrace.llm.lockstep import LANES_BYTES
from millrace.llm.regex_automaton import Automaton, compile_rules


@dataclass(frozen=True)
class Rule:
    """kind: name in results; pattern: what a span matches; least: characters that a span must have to count, or, with
    ``tail``, that must follow from where it could first end; any_case: letters match in either case.

    A match that is too short still covers its place. Where no longer match can begin inside a short one, the
    bound may stand in the pattern, which spares the starts of common short ones.
    """

    kind: str
    pattern: str
    least: int = 1
    tail: bool = False
    any_case: bool = False


#: The base rules first, in the order that results list them; then the rules this method adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, tail=True, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3


@lru_cache(4)
def automata(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, tuple[Automaton, ...]]:
    """The automaton of all mirrored rules, and for each rule one that begins at a given place."""
    listed = [(r.pattern, r.any_case) for r in rules]
    return compile_rules(listed, backwards=True), tuple(compile_rules([x], anchored=True) for x in listed)


class Scanner:
    """Spans of all rules in texts."""

    def __init__(self, compiled: tuple[Automaton, tuple[Automaton, ...]], rules: tuple[Rule, ...]):
        self.starts, own = compiled
        self.walks = [a.walker() for a in own]
        self.rules = rules

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end) in code points, rule by rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        started = self.starts.hits(np.frombuffer(b"\xff" + b"\xff".join(texts), np.uint8)[::-1])[::-1][1:]
        places = np.flatnonzero(started)
        if not len(places):
            return out
        owner = np.searchsorted(begins, places, side="right") - 1
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(owner)).tolist(), strict=True):
            i = int(owner[a])
            out[i] = self._of_text(texts[i], places[a:b] - begins[i], started[places[a:b]])
        return out

    def _of_text(self, text: bytes, places: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, int]]:
        point = None if text.isascii() else np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
        spans = []
        for k, (rule, walk) in enumerate(zip(self.rules, self.walks, strict=True)):
            starts = places[masks >> np.uint32(k) & np.uint32(1) == 1].tolist()
            at = 0
            while at < len(starts):
                start = starts[at]
                first, end = walk(text, start)
                if end - (first - 1 if rule.tail else start) >= rule.least:
                    spans.append((start, k, end) if point is None else (int(point[start]), k, int(point[end])))
                at = bisect_left(starts, end, at + 1)
        return spans


def _written(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Spans are written kind:start:end in code points, end exclusive, by start and then by the table's order,
    comma-joined; base_sha256 digests those of the three base rules only. Null, empty and clean texts have
    counts of 0, empty spans and the digest of the empty string. Rows repeat as they do in the input. Other
    columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(automata(rules))  # some hundred states: bounded by the rules

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table.value, rules)
        for batch in slices(batches, text, LANES_BYTES):
            counts, base, full = [], [], []
            for spans in scanner.spans(utf8(batch.column(text))):
                counts.append([sum(k == i for _, k, _ in spans) for i in range(BASE)])
                base.append(hashlib.sha256(_written([s for s in spans if s[1] < BASE], rules).encode()).hexdigest())
                full.append(_written(spans, rules))
            columns = list(zip(*counts, strict=True)) or [()] * BASE
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(c, pa.int64()) for c in columns], pa.array(base, pa.string()), pa.array(full, pa.string())],
                [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
