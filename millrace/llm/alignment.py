"""Alignment of two tokenizers' tokens over the same bytes.

A transducer reads both token rows at once. Its state is which side leads and the bytes of the leader that the other
side has not matched yet; it takes the next token of the side that lags. Transitions are remembered by state and
token. An empty residue closes a group: both sides end at the same byte. The token that is taken overlaps the last
token of the leader, so each step but a group's first makes one link.

Texts are cut where both tokenizers part them whatever comes before or after: at a single space or line end between two
characters that are not white space, and before marks that follow a letter. The first side's splitter always parts there; the second
side's tokens never hold the two bytes beside the cut, which its vocabulary shows. So both sides end at a cut and a group never crosses
it, and a worker remembers each piece with its groups and links.

How often a pair of ids is linked is counted over the whole corpus. A worker takes documents in batches of bounded
size; a batch's distinct pairs leave it as rows with their counts, all else goes into the shared folder as one block.
The corpus-wide counts come back to the batch by a join on the pairs, and each batch is finished from its block.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.arrow_docs import bounded_batches, frugal, frugal_group, slices, utf8
from millrace.llm.bpe_automaton import byte_letters
from millrace.session import scratch, settle

#: Bytes of text in a batch, unless one document alone has more, and distinct pieces that end one early.
BATCH_BYTES = 16 << 20
BATCH_PIECES = 500_000
#: After a batch that leaves a worker with this many pieces, or with so many bytes of them, it keeps the batch's repeated ones.
KEPT_PIECES = 300_000
KEPT_BYTES = 32 << 20
#: Transitions that a worker remembers.
KEPT_STEPS = 1 << 18

START, MISMATCH = 0, -1
_STOP, _CUT, _BARE = b"\xfe", b"\xff", b"\xfd"  # never part of UTF-8; the last one leads a piece that no space comes before
#: The splitter of byte-level tokenizers (fixed).
SPLITTER = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Bytes that may stand beside a cut. White space beyond ASCII, and the mark that stands for a space in pieces, begin with C2, E1, E2 or E3.
_SEEN = np.zeros(256, bool)
_SEEN[33:127] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xE1, 0xE2, 0xE3]] = True
_AFTER = _SEEN.copy()
_AFTER[0x80:0xFD] = True
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER_C3 = np.zeros(256, bool)  # second bytes of letters that begin with C3
_LETTER_C3[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_MARK = _SEEN & ~_LETTER
_MARK[48:58] = False


class SuffixTransducer:
    """Steps through the tokens of two sides, spelled as bytes: ``spelled`` [0] and [1] give a token's bytes."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.spelled = (a, b)
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # the side to take from, what the other side has in front
        self.numbers = {self.states[0]: START}
        self.steps: dict[int, int] = {}

    def _number(self, state: tuple[int, bytes]) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _step(self, state: int, token: int) -> int:
        side, rest = self.states[state]
        own = self.spelled[side][token]
        if len(own) < len(rest):
            return self._number((side, rest[len(own) :])) if rest.startswith(own) else MISMATCH
        if not own.startswith(rest):
            return MISMATCH
        return self._number((1 - side, own[len(rest) :])) if len(own) > len(rest) else START

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """(for each group, tokens of both sides up to its end; links as a << 32 | b), or None where the bytes differ."""
        if len(self.steps) > KEPT_STEPS:
            self._forget()
        steps, states = self.steps, self.states
        i = j = state = START
        groups, links = [], []
        while state != START or i < len(a):
            if states[state][0] == 0:
                if i == len(a):
                    return None
                key = state << 32 | a[i]
                i += 1
            else:
                if j == len(b):
                    return None
                key = state << 32 | b[j]
                j += 1
            if state != START:
                links.append(a[i - 1] << 32 | b[j - 1])
            state = steps.get(key)
            if state is None:
                state = steps[key] = self._step(key >> 32, key & 0xFFFFFFFF)
            if state == MISMATCH:
                return None
            if state == START:
                groups.append((i, j))
        return (groups, links) if j == len(b) else None


class Pieces(dict):
    """Number of each piece, a text's part between cuts, with what is known of it under its number."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        spelled_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            spelled_a[number] = bytes(of[c] for c in token)
        self.encode_a = self._quick(json.loads(self.a.to_str()), spelled_a) or (lambda text: self.a.encode(text, add_special_tokens=False).ids)
        self.b = SentencePieceProcessor(model_file=b_path)
        spelled_b, self.joined = [], np.zeros((256, 256), bool)  # pairs of bytes that some token of the second side holds
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            spelled_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            at = np.frombuffer(spelled_b[-1], np.uint8)
            self.joined[at[:-1], at[1:]] = True
        self.transducer = SuffixTransducer(spelled_a, spelled_b)
        self.lead = self.b.encode("\n")  # the added space and a line end, which no token joins to what follows
        self.bare = not self.joined[10].any() and len(self.lead) == 2
        self.forget()

    @staticmethod
    def _quick(spec: dict, spelled: list[bytes]):
        """The same ids by ranks, which is three times faster, if the file is a byte-level one whose merges stand in the order of their ids."""
        model, split = spec["model"], spec["pre_tokenizer"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if spec["normalizer"] or split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model["end_of_word_suffix"] or model["ignore_merges"]:
            return None
        if len(spelled) != 256 + len(merges) or any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=SPLITTER, mergeable_ranks={t: i for i, t in enumerate(spelled)}, special_tokens={}).encode_ordinary

    def forget(self, but: np.ndarray | None = None) -> None:
        """Forget all pieces but those of these numbers; their numbers change."""
        kept = []
        if but is not None:
            named = list(self)
            for i in but[but > 1].tolist():
                kept.append((named[i], tuple(c[i] for c in self.sizes), self.written[i], self.links[self.link_ends[i - 1] : self.link_ends[i]]))
        self.clear()
        self.sizes = [array("q"), array("q"), array("q")]  # tokens of both sides, groups; no tokens where the bytes differ
        self.written: list[bytes] = []
        self.link_ends, self.links = array("q"), array("q")
        self.bytes = 0
        for piece in [(_STOP, (0, 0, 0), b"", []), (b"", (0, 0, 0), b"", []), *kept]:
            self._add(*piece)

    def _add(self, piece: bytes, sizes: tuple[int, int, int], written: bytes, links: list[int] | array) -> None:
        self[piece] = len(self.written)
        for column, size in zip(self.sizes, sizes, strict=True):
            column.append(size)
        self.written.append(written)
        self.links.extend(links)
        self.link_ends.append(len(self.links))
        self.bytes += len(piece) + len(written)

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of the pieces of all texts, 0 between texts and 1 for an empty text."""
        pieces = self.cut(texts)
        known = list(map(self.get, pieces))
        if None not in known:
            return np.array(known, np.int64)
        new = list({p for p, n in zip(pieces, known, strict=True) if n is None})
        bare = [p[:1] == _BARE for p in new]
        words = [(p[1:] if b else p).decode("utf-8", "replace") for p, b in zip(new, bare, strict=True)]
        found = self.b.encode([f"\n{w}" if b else w for w, b in zip(words, bare, strict=True)], num_threads=1)
        spelled = self.transducer.spelled[0]
        for piece, b, word, ids in zip(new, bare, words, found, strict=True):
            one = self.encode_a(word if b else f" {word}")
            right = b"".join([spelled[i] for i in one]) == (piece[1:] if b else b" " + piece) and (not b or ids[:2] == self.lead)
            aligned = self.transducer.align(one, ids[2:] if b else ids) if right else None
            if aligned is None:
                self._add(piece, (0, 0, 0), b"", [])
                continue
            groups, links = aligned
            other, parts, i, j = ids[2:] if b else ids, [], 0, 0
            for to_i, to_j in groups:
                parts.append(f"{one[i]}|{other[j]};" if to_i == i + 1 and to_j == j + 1 else f"{','.join(map(str, one[i:to_i]))}|{','.join(map(str, other[j:to_j]))};")
                i, j = to_i, to_j
            self._add(piece, (len(one), len(other), len(groups)), "".join(parts).encode(), links)
        return np.array(list(map(self.__getitem__, pieces)), np.int64)

    def cut(self, texts: list[bytes]) -> list[bytes]:
        """The pieces of all texts, with _STOP between texts; an empty text is an empty piece. The space before a piece is not part of it."""
        joined = bytearray((_CUT + _STOP + _CUT).join(texts))
        data = np.frombuffer(joined, np.uint8)

        def parted(at: np.ndarray) -> np.ndarray:
            """Those of the places that have characters other than white space on both sides."""
            before = data[at - 1]
            beyond = (before >= 0x80) & (before < 0xFD) & (data[at - 2] != 0xC2) & ~_LEADS[data[at - 3]]
            return at[_AFTER[data[at + 1]] & (_SEEN[before] | beyond)]

        spaces = parted(np.flatnonzero(data[3:-1] == 32) + 3)
        spaces = spaces[~self.joined[data[spaces - 1], 32]]
        if self.bare:
            lines = parted(np.flatnonzero(data[3:-1] == 10) + 3)
            marks = np.flatnonzero(_MARK[data[2:]]) + 2
            before = data[marks - 1]
            marks = marks[_LETTER[before] | _LETTER_C3[before] & (data[marks - 2] == 0xC3)]
            places = np.concatenate([lines, marks])
            places = places[~self.joined[data[places - 1], data[places]]]
            data[spaces] = _CUT[0]
            places.sort()
            joined = np.insert(data, np.repeat(places, 2), np.tile(np.frombuffer(_CUT + _BARE, np.uint8), len(places))).tobytes()
        else:
            data[spaces] = _CUT[0]
        return bytes(joined).split(_CUT)


@lru_cache(1)
def pieces_of(a_path: str, b_path: str) -> Pieces:
    return Pieces(a_path, b_path)


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def _to_block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Batch:
    """Documents of a batch: finished columns, and the numbers of their pieces."""

    def __init__(self, pieces: Pieces, with_groups: bool):
        self.pieces, self.with_groups = pieces, with_groups
        self.tables: list[pa.RecordBatch] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: pa.Array, texts: list[bytes]) -> None:
        numbers = self.pieces.numbers(texts)
        stops = np.flatnonzero(numbers == 0)
        starts = np.concatenate([[0], stops + 1])
        ends = np.append(stops, len(numbers))
        sizes = [np.array(c, np.int64)[numbers] for c in self.pieces.sizes]
        good = sizes[0] > 0
        good[stops] = True
        known = np.logical_and.reduceat(good, starts)
        n_a, n_b, n_groups = (np.add.reduceat(s, starts) * known for s in sizes)
        listed, digests, groups = numbers.tolist(), [], []
        for a, b, fits in zip(starts.tolist(), ends.tolist(), known.tolist(), strict=True):
            text = b"".join(map(self.pieces.written.__getitem__, listed[a:b]))[:-1] if fits else b""
            digests.append(hashlib.sha256(text).hexdigest() if fits else "")
            groups.append(text if self.with_groups else None)
        taken = np.where(known, ends - starts, 0)
        self.held.append(numbers[np.repeat(known, np.diff(np.append(starts, len(numbers)))) & (numbers != 0)])
        columns = [keys, *[pa.array(c) for c in (n_a, n_b, n_groups, n_a + n_b - n_groups, taken)], pa.array(digests, pa.string()), pa.array(groups, pa.binary())]
        self.tables.append(pa.RecordBatch.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "taken", "sha256", "groups"]))
        self.size += sum(map(len, texts))

    def full(self) -> bool:
        return self.size >= BATCH_BYTES or len(self.pieces.written) >= BATCH_PIECES

    def close(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(block, distinct pairs ascending, their counts); the batch is empty then."""
        pieces = self.pieces
        numbers = np.concatenate(self.held)
        counts = np.bincount(numbers, minlength=len(pieces.written))
        used = np.flatnonzero(counts)
        used = used[np.argsort(-counts[used], kind="stable")]  # frequent ones get small numbers
        local = np.zeros(len(counts), np.int64)
        local[used] = np.arange(len(used))
        ends = np.array(pieces.link_ends, np.int64)
        sizes = np.diff(ends, prepend=0)[used]
        at = np.repeat(ends[used] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        pairs, where = np.unique(np.array(pieces.links, np.int64)[at], return_inverse=True)
        linked = np.bincount(where, weights=np.repeat(counts[used], sizes), minlength=len(pairs)).astype(np.int64)
        docs = pa.Table.from_batches(self.tables).combine_chunks().to_batches()[0]
        block = {"docs": _to_block(docs), "words": _planes(local[numbers]), "sizes": _planes(sizes), "links": _planes(where)}
        block = _to_block(pa.RecordBatch.from_arrays([pa.array([v], pa.large_binary()) for v in block.values()], list(block)))
        self.tables, self.held, self.size = [], [], 0
        if len(pieces.written) > KEPT_PIECES or pieces.bytes > KEPT_BYTES:
            pieces.forget(used[counts[used] > 2][: KEPT_PIECES // 2])
        return block, pairs, linked


def _finish(block: bytes, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of a block with n_best and count_sum; ``counts`` and ``best`` are of its pairs, ascending."""
    data = {k: v[0] for k, v in pa.ipc.open_stream(block).read_all().to_pydict().items()}
    docs = pa.ipc.open_stream(data["docs"]).read_all().combine_chunks().to_batches()[0]
    words, sizes, links = (_unplaned(data[k]) for k in ("words", "sizes", "links"))
    taken = docs.column("taken").to_numpy()
    sums = []
    for value in (best, counts):
        out = np.zeros(len(taken), np.int64)
        if len(words):
            of_piece = np.add.reduceat(value[links], np.cumsum(sizes) - sizes)
            out[taken > 0] = np.add.reduceat(of_piece[words], (np.cumsum(taken) - taken)[taken > 0])
        sums.append(pa.array(out))
    groups = docs.column("groups").cast(pa.string())
    return pa.RecordBatch.from_arrays([*[docs.column(k) for k in ("key", "n_a", "n_b", "n_groups", "n_links")], *sums, docs.column("sha256"), groups], ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every row of ``docs``.

    ``a_path`` is a byte-level tokenizer of the tokenizers library, which reads a space and the text; ``b_path`` a
    sentencepiece model that adds the space by itself and keeps all white space. Special strings in texts are plain text. ``groups`` lists
    ids as ``a1,a2|b1;a3|b2``, a group ending where tokens of both sides end at the same byte. n_links counts pairs
    of token occurrences that share a byte; count_sum sums, over a document's links, how many links of the whole
    corpus hold the same two ids, and n_best counts those whose count is the highest of all pairs with that b id,
    ties included. A text that is null or empty, or whose tokens do not spell its bytes on either side, has zeros
    and '' and adds no links. Rows repeat and count as they do in the input; null keys are kept. Empty tables give no rows. Other columns are
    not read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "alignments")
    kind = docs.schema[key].dataType.simpleString()
    batch_schema = pa.schema([("batch", pa.int64()), ("block", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(a_path, b_path)
        held, out, part, made = _Batch(pieces, with_groups), None, TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal out, made
            out = out or files.NewFile(folder, ".blocks")
            block, pairs, counts = held.close()
            place = f"{out.name}:{out.write(block)}:{len(block)}"
            number = part << 32 | made
            made += 1
            columns = [np.full(len(pairs) + 1, number), [place, *[None] * len(pairs)], [None, *pairs.tolist()], [None, *counts.tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch_schema, strict=True)], schema=batch_schema)

        for batch in slices(batches, text):
            held.add(batch.column(key), utf8(batch.column(text)))
            if held.full():
                yield flush()
        if held.size or held.tables:
            yield flush()
        if out:
            out.close()

    @frugal_group
    def finish(table: pa.Table) -> pa.Table:
        place = table.column("block").drop_null()[0].as_py()
        pairs = table.filter(table.column("pair").is_valid()).sort_by("pair")
        name, offset, size = place.split(":")
        system, path = files.at(folder)
        with system.open_input_file(f"{path}/{name}") as handle:
            block = handle.read_at(int(size), int(offset))
        done = _finish(block, pairs.column("n").to_numpy(), pairs.column("best").to_numpy())
        done = done.rename_columns([key, *done.schema.names[1:]])
        return pa.Table.from_batches([done if with_groups else done.select(done.schema.names[:-1])])

    bounded_batches(spark)
    dealt = settle(docs.select(key, text).mapInArrow(gather, "batch long, block string, pair long, n long"), "links")
    own = dealt.filter("pair IS NOT NULL")
    counts = settle(own.groupBy("pair").agg(F.sum("n").alias("all")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = counts.groupBy("b").agg(F.max("all").alias("most"))
    judged = counts.join(most, "b").select("pair", F.col("all"), (F.col("all") == F.col("most")).cast("long").alias("best"))
    found = own.join(judged, "pair").select("batch", "block", "pair", F.col("all").alias("n"), "best")
    blocks = dealt.filter("pair IS NULL").select("batch", "block", "pair", "n", F.lit(0).cast("long").alias("best"))
    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return found.unionByName(blocks).groupBy("batch").applyInArrow(finish, schema)
