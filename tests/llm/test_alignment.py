"""Alignment of two tokenizers against whole-text encodings and byte offsets."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import alignment  # noqa: E402
from millrace.llm.bpe_automaton import byte_letters  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def plain(rows):
    """Both libraries over whole texts; groups and links by byte offsets."""
    a, b, of = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_letters()
    a.encode_special_tokens = True
    found, counts = [], Counter()
    for key, text in rows:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        sa = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
        sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or not b"".join(sa) == b"".join(sb) == b" " + text.encode():
            found.append((key, [], [], [], []))
            continue
        ea, eb = list(accumulate(map(len, sa))), list(accumulate(map(len, sb)))
        links, j = [], 0
        for i, end in enumerate(ea):
            start = end - len(sa[i])
            while eb[j] <= start:
                j += 1
            k = j
            while k < len(ib) and eb[k] - len(sb[k]) < end:
                links.append((ia[i], ib[k]))
                k += 1
        ends = sorted(set(ea) & set(eb))
        groups = [([x for x, e in zip(ia, ea) if s < e <= t], [x for x, e in zip(ib, eb) if s < e <= t]) for s, t in zip([0, *ends], ends)]
        counts.update(links)
        found.append((key, ia, ib, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for key, ia, ib, groups, links in found:
        written = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((key, len(ia), len(ib), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if ia else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


PARTS = ["the", "Don't", "élan", "ÉTÉ,", "naïve…", "日本語", "👍🏽", "é", "x1y22", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "a▁b", "tokenization", "ſ", " ", " ", "　", "\u0085", "\x1c", "\x00", "\x7f", "  ", "   ", "\n", "\r\n", "\t", " ", ". ", "?!", "'s", "«", "»", "ﬁ", "Ω", "12345", "ǅ", "▁x", "﻿", "क्षि"]


def mixed(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", " ", " "]) for _ in range(n))


def test_pieces_join_to_whole_texts(spark):
    rng = random.Random(5)
    rows = [(i, mixed(rng, rng.randrange(1, 30))) for i in range(900)] + [(1000 + i, p) for i, p in enumerate(PARTS)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "  "), (2004, " a"), (2005, "a "), (2006, "the " * 5000), (2007, "x" * 3000), (2008, "é" * 900), (7, "same"), (7, "same"), (None, "the same"), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_a", F.lit("own")).withColumn("pair", F.lit(1)).repartition(3)
    assert got(alignment.align_tokenizers(docs, A, B)) == plain(rows)


def test_batches_of_any_size(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "betamax", "gamma,", "délta", "zz▁"][: 4 + (i % 9 == 0)]) for _ in range(rng.randrange(40)))) for i in range(60)]
    want = plain(rows)
    pieces = alignment.Pieces(A, B)
    batch = alignment._Batch(pieces, True)
    import pyarrow as pa

    blocks = []
    for a in range(0, 60, 7):
        batch.add(pa.array([i for i, _ in rows[a : a + 7]]), [t.encode() for _, t in rows[a : a + 7]])
        if a % 2:
            blocks.append(batch.close())
            pieces.forget()
    blocks.append(batch.close())
    counts = Counter()
    for _, pairs, n in blocks:
        counts.update(dict(zip(pairs.tolist(), n.tolist())))
    most = Counter()
    for pair, n in counts.items():
        most[pair & 0xFFFFFFFF] = max(most[pair & 0xFFFFFFFF], n)
    import numpy as np

    out = []
    for block, pairs, _ in blocks:
        n = np.array([counts[p] for p in pairs.tolist()], np.int64)
        best = np.array([counts[p] == most[p & 0xFFFFFFFF] for p in pairs.tolist()], np.int64)
        for r in alignment._finish(block, n, best).to_pylist():
            assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "")
            out.append(tuple(r.values())[:-1])
    assert sorted(out, key=repr) == want


def test_transducer():
    t = alignment.SuffixTransducer([b"ab", b"c", b"abcd"], [b"a", b"bc", b"bcd", b"x"])
    assert t.align([0, 1], [0, 1]) == ([(2, 2)], [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1])
    assert t.align([2, 1], [0, 2]) is None  # one side ends before the other
    assert t.align([0], [3]) is None and t.align([], []) == ([], []) and t.align([], [1]) is None


def test_empty_and_null_tables(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], SCHEMA)
    assert got(alignment.align_tokenizers(nulls, A, B)) == plain([(1, None), (2, "")])
    groups = alignment.align_tokenizers(spark.createDataFrame([(1, "the cat")], SCHEMA), A, B, with_groups=True).first()
    assert groups["groups"].count("|") == groups["n_groups"] and hashlib.sha256(groups["groups"].encode()).hexdigest() == groups["groups_sha256"]
