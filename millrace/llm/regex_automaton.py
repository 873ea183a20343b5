"""Rules of a small regex language compiled into one minimal deterministic automaton over bytes.

Patterns may hold literals, [classes], (groups|alternatives), ?, *, +, {n}, {n,} and {n,m}, and \\xHH or escaped
characters; all of ASCII. The automaton looks for every rule at every place at once: after each byte, its
state tells which rules have a match that ends there. That of the reversed rules, run from the last byte to the
first, tells where matches start, and one that begins at a single place tells how far a match reaches from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from millrace.llm.lockstep import scan


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def node(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self):
        atom = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                inside, self.at = self.text[self.at : self.text.index("}", self.at)], self.text.index("}", self.at) + 1
                low, _, high = inside.partition(",")
                bounds = (int(low), int(low) if "," not in inside else int(high) if high else None)
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            atom = ("rep", atom, *bounds)
        return atom

    def atom(self):
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.text!r}")
            return inner
        if c == "[":
            return ("set", self.char_class())
        return ("set", self.cased({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def char_class(self) -> frozenset[int]:
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            found |= set(range(low, high + 1))
        self.take()
        return self.cased(found)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            found = found | {ord(chr(x).swapcase()) for x in found if chr(x).isalpha()}
        return frozenset(found)


def _reversed(tree):
    """The tree of the mirrored pattern."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(part) for part in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "seq" else parts)


def _build(nfa: _Nfa, tree, start: int) -> int:
    """Wire ``tree`` in from ``start``; the node where it ends."""
    kind = tree[0]
    if kind == "set":
        end = nfa.node()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "seq":
        for part in tree[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.node()
        for option in tree[1]:
            first = nfa.node()
            nfa.free[start].append(first)
            nfa.free[_build(nfa, option, first)].append(end)
        return end
    _, inner, low, high = tree
    for _ in range(low):
        start = _build(nfa, inner, start)
    end = nfa.node()
    nfa.free[start].append(end)
    if high is None:
        first = nfa.node()
        nfa.free[start].append(first)
        last = _build(nfa, inner, first)
        nfa.free[last] += [first, end]
    else:
        for _ in range(high - low):
            start = _build(nfa, inner, start)
            nfa.free[start].append(end)
    return end


@dataclass
class Automaton:
    """class_of: byte -> symbol; next: state * width + symbol -> state; accepts: state -> bit mask of rules."""

    class_of: np.ndarray
    width: int
    next: np.ndarray
    accepts: np.ndarray

    def hits(self, data: np.ndarray) -> np.ndarray:
        """For each byte, the rules with a match that ends there. Byte 0xFF ends every match."""

        def step(states, symbols):
            states = self.next[states + symbols]
            return states, self.accepts[states // self.width] if self._wide else self.accepts[states]

        return scan(self.class_of[data], 0, step, 0, self.accepts.dtype)

    _wide: bool = True

    def walker(self) -> Callable[[bytes, int], tuple[int, int]]:
        """For an anchored automaton: (data, start) -> the first and the last place where a match from there may end, or (-1, -1)."""
        class_of, next_, accepts = self.class_of.tolist(), self.next.tolist(), self.accepts.tolist()
        stuck = {s for s in set(next_) if not accepts[s] and set(next_[s : s + self.width]) == {s}}

        def walk(data: bytes, start: int) -> tuple[int, int]:
            state, first, last = 0, -1, -1
            for at in range(start, len(data)):
                state = next_[state + class_of[data[at]]]
                if accepts[state]:
                    last = at + 1
                    if first < 0:
                        first = last
                elif state in stuck:
                    break
            return first, last

        return walk

    def premultiplied(self) -> Automaton:
        """States numbered by the place of their row, which saves a product for each byte."""
        accepts = np.zeros(len(self.accepts) * self.width, self.accepts.dtype)
        accepts[:: self.width] = self.accepts
        return Automaton(self.class_of, self.width, self.next * np.int32(self.width), accepts, False)


def compile_rules(rules: list[tuple[str, bool]], backwards: bool = False, anchored: bool = False) -> Automaton:
    """One automaton for ``(pattern, any_case)`` rules: subset construction, then minimisation.

    ``backwards`` mirrors the rules, for bytes read from the last to the first; ``anchored`` has matches begin at the first byte only.
    """
    nfa = _Nfa()
    root = nfa.node()
    ends = []
    for pattern, any_case in rules:
        parser = _Parser(pattern, any_case)
        tree = parser.alternatives()
        if parser.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} from {parser.at}")
        first = nfa.node()
        nfa.free[root].append(first)
        ends.append(_build(nfa, _reversed(tree) if backwards else tree, first))
    sets = {s for moves in nfa.moves for s, _ in moves}
    marks = [tuple(b in s for s in sets) for b in range(128)] + [(False,) * len(sets)] * 128
    numbers: dict[tuple, int] = {(False,) * len(sets): 0}
    class_of = np.array([numbers.setdefault(m, len(numbers)) for m in marks], np.int32)
    width = len(numbers)
    one_of = [int(np.flatnonzero(class_of == k)[0]) for k in range(width)]
    closure = []
    for n in range(len(nfa.moves)):
        seen, todo = 1 << n, [n]
        while todo:
            for m in nfa.free[todo.pop()]:
                if not seen >> m & 1:
                    seen |= 1 << m
                    todo.append(m)
        closure.append(seen)
    to = [[0] * width for _ in nfa.moves]
    busy = 0
    for n, moves in enumerate(nfa.moves):
        for s, m in moves:
            busy |= 1 << n
            for k in range(width):
                if one_of[k] in s:
                    to[n][k] |= closure[m]
    first = closure[root]
    states, table, at = {first & (busy | sum(1 << e for e in set(ends))): 0}, [], 0
    order = list(states)
    keep = busy | sum(1 << e for e in set(ends))
    while at < len(order):
        rows = [0 if anchored else first & keep] * width
        members, left = [], order[at] & busy
        while left:
            low = left & -left
            members.append(to[low.bit_length() - 1])
            left ^= low
        for k in range(width):
            joined = rows[k]
            for m in members:
                joined |= m[k]
            joined &= keep
            if joined not in states:
                states[joined] = len(order)
                order.append(joined)
            rows[k] = states[joined]
        table.append(rows)
        at += 1
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if s >> e & 1) for s in order], np.uint32)
    return _minimised(np.array(table, np.int32), accepts, class_of, width)


def _minimised(table: np.ndarray, accepts: np.ndarray, class_of: np.ndarray, width: int) -> Automaton:
    """States that no text tells apart become one: blocks are split by their rows of blocks until none splits."""
    block = np.unique(accepts, return_inverse=True)[1]
    count = block.max() + 1
    while True:
        rows = np.column_stack([block, block[table]])
        finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() + 1 == count:
            break
        block, count = finer, finer.max() + 1
    names = np.full(count, -1)
    names[block[0]] = 0
    fresh = 1
    for b in block:
        if names[b] < 0:
            names[b] = fresh
            fresh += 1
    block = names[block]
    one = np.zeros(count, np.int64)
    one[block[::-1]] = np.arange(len(block))[::-1]
    return Automaton(class_of, width, block[table[one]].astype(np.int32).reshape(-1), accepts[one]).premultiplied()
