"""Counting byte-pair tokens with a deterministic transducer built from a vocabulary file.

The last token of the encoding of a prefix determines that encoding: it is the one vocabulary entry t ending
the prefix for which the encoding of the prefix without t ends with a token that t may follow, that is, the
two together encode to just those two. So a state need hold, for each start inside the word from which some
token may still grow, the trie node reached, the last token before that start and the count of tokens there.
Counts are relative to the newest prefix, which leaves finitely many states; each transition carries the
change of the count, the number of tokens it emits (a merge emits a negative number). States are made when
first reached. Tables that outgrow their bound are dropped, and the text is counted in halves; words that alone
outgrow it, and very long ones, go to the plain encoder.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from millrace.llm.state_maps import totals

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Cells of a table, of five bytes each.
MOST_CELLS = 30_000_000
#: Bytes of a word that the transducer takes: longer ones make a state for nearly each byte, which no other text meets.
LONGEST_WORD = 1024


class TableFull(Exception):
    """A new state would not fit into MOST_CELLS."""


def byte_letters() -> dict[str, int]:
    """Character by which the vocabulary writes each byte: itself if printable, else from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """Next states and emitted counts for the bytes of a word; symbol = 2 * byte class + (1 on the last byte)."""

    def __init__(self, model: dict):
        of = byte_letters()
        end = model["end_of_word_suffix"]
        self.tokens: dict[tuple, int] = {}

        def symbols(token: str) -> tuple:
            ended = token.endswith(end)
            body = token[: -len(end)] if ended else token
            out = [of[c] for c in body]
            if ended and out:
                out[-1] += 256
            return tuple(out)

        self.spelled: list[tuple | None] = [None] * (max(model["vocab"].values()) + 1)
        for token, number in model["vocab"].items():
            spelled = symbols(token)
            self.spelled[number] = spelled
            self.tokens.setdefault(spelled, number)
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for number, spelled in enumerate(self.spelled):
            node = 0
            for s in spelled or ():
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][s]
            if spelled and self.token_at[node] < 0:
                self.token_at[node] = number
        self.follows: dict[tuple[int, int], bool] = {}
        self.class_of = np.zeros(256, np.uint16)
        self.byte_of: list[int] = [-1]
        self.width = 128
        self.restart()

    def restart(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.numbers = [first], {first: 0}
        self.next = np.full(1024 * self.width, -1, np.int32)
        self.emit = np.zeros(1024 * self.width, np.int8)
        self.next[0:2] = 0

    def encode(self, spelled: tuple) -> list[int]:
        """Plain byte-pair encoding of one word's symbols."""
        parts = [self.tokens[(s,)] for s in spelled]
        while len(parts) > 1:
            best = min((self.ranks.get(p, (1 << 30, -1)) for p in zip(parts, parts[1:], strict=False)), default=(1 << 30, -1))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.ranks.get((parts[i], parts[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        key = (before, token)
        if key not in self.follows:
            if len(self.follows) > 500_000:
                self.follows.clear()
            head = () if before < 0 else self.spelled[before]
            self.follows[key] = self.encode(head + self.spelled[token]) == ([token] if before < 0 else [before, token])
        return self.follows[key]

    def add_bytes(self, used: np.ndarray) -> None:
        """Give a class to each byte in ``used`` that has none yet."""
        new = [b for b in used.tolist() if not self.class_of[b]]
        for b in new:
            self.class_of[b] = len(self.byte_of)
            self.byte_of.append(b)
        if 2 * len(self.byte_of) > self.width:
            self.width = -(-2 * len(self.byte_of) // 32) * 32
            self.restart()

    def _make(self, cell: int) -> None:
        state, symbol = divmod(cell, self.width)
        s = self.byte_of[symbol >> 1]
        last = bool(symbol & 1)
        grown, best = [], None
        for node, before, count in self.states[state]:
            child = self.children[node].get(s + 256 * last)
            if child is None:
                continue
            token = self.token_at[child]
            if best is None and token >= 0 and self.may_follow(before, token):
                best = (token, count + 1)
            if not last and self.children[child]:
                grown.append((child, before, count))
        if best is None:
            raise ValueError("the vocabulary lacks a byte")
        if last:
            self.next[cell], self.emit[cell] = 0, best[1]
            return
        after = (*((node, before, count - best[1]) for node, before, count in grown), (0, best[0], 0))
        number = self.numbers.get(after)
        if number is None:
            if (len(self.states) + 1) * self.width > MOST_CELLS:
                raise TableFull
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
            if (number + 1) * self.width > len(self.next):
                more = len(self.next) // 2
                self.next = np.concatenate([self.next, np.full(more, -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros(more, np.int8)])
            self.next[number * self.width : number * self.width + 2] = 0
        self.next[cell], self.emit[cell] = number, best[1]

    def step(self, states: np.ndarray, symbols: np.ndarray):
        cells = states * self.width + symbols
        after = self.next[cells]
        while (after < 0).any():
            for cell in np.unique(cells[after < 0]).tolist():
                self._make(cell)
            after = self.next[cells]
        return after, self.emit[cells]

    def totals(self, symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Tokens emitted by the first ``stop`` symbols for each of ``stops``; words end before those."""
        try:
            return totals(symbols, stops, 0, self.step, 0)
        except TableFull:
            self.restart()
        ends = np.flatnonzero((symbols[:-1] == 0) | (symbols[:-1] & 1 == 1)) + 1  # here a state does not depend on what came before
        if not len(ends):
            spelled = tuple(self.byte_of[x >> 1] + 256 * (x & 1) for x in symbols.tolist() if x)
            return np.full(len(stops), len(self.encode(spelled)) if spelled else 0, np.int64)
        middle = int(ends[np.argmin(np.abs(ends - len(symbols) // 2))])
        left = self.totals(symbols[:middle], np.append(stops[stops <= middle], middle))
        right = self.totals(symbols[middle:], stops[stops > middle] - middle)
        return np.concatenate([left[:-1], left[-1] + right])


class TokenCounter:
    """Token counts of whole texts for a tokenizer file of the word-end byte-pair kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = WordTransducer(spec["model"])
        self.letters = {b: c for c, b in byte_letters().items()}
        self.library = Tokenizer.from_file(path)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        self.kind = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        self.kind[[9, 10, 11, 12, 13, 0x85]] = SPACE
        self.lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), np.uint32, 0x110000)

    def _plain(self, text: str) -> tuple[str, int]:
        """The text as the splitter sees it but for lower case, and the number of special tokens cut out."""
        found = 0
        if self.special and "<|" in text:
            text, found = self.special.subn("\n", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("İ", "i̇")
        return text, found

    def _word_ends(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(white space?, last of its word?) for each code point. Words: contractions, runs of letters, single digits, runs of others."""
        kind = self.kind[points]
        space = kind == SPACE
        first = np.ones(len(points), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):
            tail = np.concatenate([points, np.zeros(2, points.dtype)])
            opens = np.ones(len(quotes), bool)
            later = quotes > 0
            opens[later] = kind[quotes[later] - 1] != OTHER
            a, b = tail[quotes + 1], tail[quotes + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for which, size in ((one & opens, 2), (two & opens, 3)):
                at = quotes[which]
                first[at + 1] = False
                ends = at + size
                ends = ends[ends < len(points)]
                first[ends] = True
        last = np.ones(len(points), bool)
        last[:-1] = first[1:] | space[1:]
        return space, last

    def count(self, texts: list[str]) -> np.ndarray:
        """int64 counts, one for each text."""
        if not texts:
            return np.zeros(0, np.int64)
        plain, special = zip(*map(self._plain, texts), strict=True)
        lengths = np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain))
        points = np.frombuffer("".join(t + "\n" for t in plain).encode("utf-32-le"), np.uint32)
        points = self.lower[points]
        space, last = self._word_ends(points)
        if len(points) and points.max() >= 0x80:
            widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
            ends = np.cumsum(widths)
            final = np.zeros(len(raw), bool)
            final[ends - 1] = last
            space = np.repeat(space, widths)
            stops = ends[np.cumsum(lengths) - 1]
        else:
            raw, final, stops = points.astype(np.uint8), last, np.cumsum(lengths)
        self.words.add_bytes(np.flatnonzero(np.bincount(raw[~space], minlength=256)))
        symbols = self.words.class_of[raw] * np.uint16(2) + final
        symbols[space] = 0
        counts = np.array(special, np.int64) + self._long_words(raw, symbols, stops)
        return counts + np.diff(self.words.totals(symbols, stops), prepend=0)

    def _long_words(self, raw: np.ndarray, symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each text the tokens of its words of more than LONGEST_WORD bytes, which become white space in ``symbols``."""
        found = np.zeros(len(stops), np.int64)
        ends = np.flatnonzero((symbols == 0) | (symbols & 1 == 1)) + 1
        begins = np.concatenate([[0], ends[:-1]])
        for a, b in zip(*[x[ends - begins > LONGEST_WORD].tolist() for x in (begins, ends)], strict=True):
            word = raw[a:b].tobytes().decode("latin-1").translate(self.letters)
            found[np.searchsorted(stops, b)] += len(self.library.model.tokenize(word))
            symbols[a:b] = 0
        return found
