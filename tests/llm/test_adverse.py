"""The ten operators on adverse rows: long lines and words, hot tokens, ties, repeats, clashing names; all against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import millrace.llm  # noqa: E402
from millrace.llm import decontaminate, line_dedup, packing, quality_rules, secret_scan, shingle_join, state_maps, token_files, warc  # noqa: E402
from millrace.llm.bpe_automaton import TokenCounter  # noqa: E402
from millrace.llm.regex_automaton import compile_rules  # noqa: E402
from millrace.session import scratch  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def prose(rng, n, most=3000):
    return [f"w{rng.randrange(most)}x" for _ in range(n)]


# 1


def test_a_token_of_all_documents(spark):
    rng = random.Random(1)
    shared = prose(rng, 30)
    rows = [(i, " ".join(shared + prose(rng, 60))) for i in range(120)] + [(200 + i, " ".join(shared * 3)) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(9), 4, 85)[0].collect()}
    assert got == {i: i if i < 200 else 200 for i, _ in rows}


def test_cells_are_counted_once_a_run():
    cells, counts = shingle_join.counted_cells(np.array([3, 3, 5, 9, 9, 9], np.uint64))
    assert cells.tolist() == [3, 5, 9] and counts.tolist() == [2, 1, 3]
    cells, counts = shingle_join.counted_cells(np.array([3, 3, 5], np.uint64), np.array([4, 1, 7]))
    assert cells.tolist() == [3, 5] and counts.tolist() == [5, 7]


# 2


def test_token_files_with_clashing_columns(spark, library):
    rows = [(2, "one two"), (1, None), (2, "one two"), (3, "three")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("own")).withColumn("start", F.lit(7)).withColumn("file", F.lit(None).cast("string"))
    folder = scratch(spark, "tokens")
    index = token_files.write_tokens(df, folder, BPE, end=2)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_files.read_tokens(token_files.with_starts(index), folder).collect())
    assert got == sorted((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)


# 4


def test_quality_of_long_and_repeated_texts(spark):
    long = " ".join(["the"] + [f"word{i}" if i % 3 else "of" for i in range(120_000)])
    rows = [(1, long), (2, "b " * 50_000), (3, long), (3, long)]
    got = Counter((r["doc_id"], r["quality"]["kept"], r["quality"]["m"]["n_words"], r["quality"]["m"]["n_repeat_words"]) for r in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(1, True, 120_001, 0): 1, (2, False, 50_000, 50_000): 1, (3, True, 120_001, 0): 2})


# 5


def test_payloads_longer_than_a_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_READ", 2000)
    rng = random.Random(1)
    pages = [(i, f"u{i}", "".join(chr(rng.randrange(33, 900)) for _ in range(4000 if i % 3 else 10))) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = scratch(spark, "warc")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(warc.write_archives(df, folder), folder, with_payload=True).collect()}
    assert got == {i: h for i, _, h in pages}


# 6


@pytest.mark.parametrize(("chunk", "lead"), [(16, 1), (32, 4), (1024, 48)])
def test_state_maps_of_any_chunks(library, monkeypatch, chunk, lead):
    monkeypatch.setattr(state_maps, "CHUNK", chunk)
    monkeypatch.setattr(state_maps, "LEAD", lead)
    rng = random.Random(chunk)
    texts = ["-" * 900 + " " + "=-" * 300, "".join(rng.choice("abcdefgh") for _ in range(3000)), "ab" * 400 + "é" * 300, *(" ".join(prose(rng, 40)) for _ in range(30)), ""]
    assert TokenCounter(BPE).count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_composes_maps():
    rng = np.random.RandomState(0)
    for lanes in (1, 2, 7, 16):
        to, counts = rng.randint(0, 3, (3, lanes)), rng.randint(-2, 9, (3, lanes))
        row, before = state_maps.scanned(to, counts)
        at, n = 0, 0
        for lane in range(lanes):
            assert (row[lane], before[lane]) == (at, n)
            at, n = to[at, lane], n + counts[at, lane]


def test_words_without_an_end(library):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    counter = TokenCounter(BPE)
    assert counter.count([text, "a b", text[:1024], text[:1025]]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, "a b", text[:1024], text[:1025])]
    assert len(counter.words.states) < 5000


def test_tables_are_bounded_within_a_scan(library, monkeypatch):
    monkeypatch.setattr("millrace.llm.bpe_automaton.MOST_CELLS", 60_000)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(300)) for _ in range(5)]
    counter = TokenCounter(BPE)
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(counter.words.states) * counter.words.width <= 60_000


# 7


def test_long_lines_that_share_their_halves(spark):
    rng = random.Random(4)
    half = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(i, half + "".join(rng.choice("abcdefgh ") for _ in range(4000))) for i in range(60)]
    rows += [(100 + i, t[:5000] + "##" + t[5000:]) for i, t in rows[:10]]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), line_dedup.CLASSES, 1).filter("n_removed > 0").collect()}
    assert got == set(range(100, 110))


def test_many_lines_in_one_document(spark):
    lines = [f"line number {i} of a long list of lines that differ {i * i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines + ["and its own words, as any document has some"]))], SCHEMA)
    got = {r["doc_id"]: (r["n_lines"], r["text"]) for r in line_dedup.dedup_lines(df, line_dedup.CLASSES, 1).collect()}
    assert got[2] == (20_001, "and its own words, as any document has some")


def test_letters_refuse_no_near_line(spark):
    rng, rows = random.Random(6), []
    for _ in range(400):
        a = [rng.choice("eanirtsoldhuxé ") for _ in range(rng.randrange(130, 140))]
        b = list(a)
        for _ in range(rng.randrange(0, 14)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("eatzé")]
        rows.append(("".join(a), "".join(b)))
    side = lambda c: F.struct(F.col(c).alias("line"), *line_dedup._side(F.col(c), F.length(c), line_dedup.CLASSES))
    df = spark.createDataFrame(rows, "a string, b string").select(side("a").alias("x"), side("b").alias("y"))
    near = line_dedup._near(F.col("x.line"), F.col("y.line"), F.col("x.n"), F.col("y.n"), line_dedup.CLASSES)
    may = line_dedup._may_be_near(F.col("x"), F.col("y"))
    counted = Counter((r[0], r[1]) for r in df.select(near, may).collect())
    assert counted[(True, False)] == 0 and counted[(True, True)] > 50 and counted[(False, False)] > 20


# 8


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 5)
    rng = random.Random(5)
    docs = [(i, np.array([rng.randrange(1000) for _ in range(rng.choice([33, 34, 40, 200, 1]))], np.uint32)) for i in range(400)]
    got, held = {}, 0
    for sequence in packing.pack_stream(iter(docs), 64):
        size = sum(len(p[2]) for p in sequence)
        held += size != 64
        assert size == 64 or size & (size - 1) == 0
        for key, start, ids, whole in sequence:
            got.setdefault(key, []).append((start, ids.tolist()))
            assert whole == len(docs[key][1])
    assert held <= 6
    assert {k: sum((x for _, x in sorted(v)), []) for k, v in got.items()} == {k: ids.tolist() for k, ids in docs}


def test_packing_of_repeated_rows_and_null_keys(spark, library):
    rows = [(1, "a b c")] * 3 + [(None, "d e")] * 2 + [(2, None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), BPE, end=2, size=16).collect()
    want = Counter()
    for i, t in rows:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want


# 9


def all_pairs(items, docs, share):
    """Every item in every document, by the least edit distance over all places."""
    words = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    found = set()
    for d, text in docs:
        region = words(text)
        for i, item in items:
            own = words(item)
            row = [0] * (len(region) + 1)
            for k, w in enumerate(own, 1):
                new = [k]
                for j, x in enumerate(region, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != x)))
                row = new
            if own and min(row) <= int(share * len(own)):
                found.add((d, i))
    return found


@pytest.mark.parametrize("kind", ["change", "insert", "delete", "mixed", "long words"])
def test_items_against_all_pairs(spark, kind):
    rng = random.Random(len(kind))
    items = [(i, " ".join("".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(2, 11))) for _ in range(rng.randrange(12, 50)))) for i in range(30)]
    docs = []
    for d in range(90):
        w = items[d % 30][1].split()
        allowed = int(0.2 * len(w)) + (d % 5 == 0)  # some have one edit too many
        if kind == "long words":
            for at in sorted(range(len(w)), key=lambda k: -len(w[k]))[:allowed]:
                w[at] = "changed"
        else:
            for _ in range(allowed):
                act, at = rng.choice(["change", "insert", "delete"]) if kind == "mixed" else kind, rng.randrange(len(w))
                w[at : at + (act != "insert")] = [] if act == "delete" else ["altered" + str(rng.randrange(50))]
        docs.append((d, " ".join(prose(rng, 50) + w + prose(rng, 50))))
    found = decontaminate.find_items(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got, want = {(r["doc_id"], r["item_id"]) for r in found.collect()}, all_pairs(items, docs, 0.2)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) >= 60


def test_items_that_repeat_and_tie(spark):
    text = "the quick brown animal jumps over eleven lazy sleepers beside the wide river"
    items = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text + " again"), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"before {text} between {text} after"), (7, "nothing of it"), (None, text), (8, None)], SCHEMA)
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start_word"], r["end_word"]) for r in decontaminate.find_items(docs, items).collect()}
    assert got == {(7, 1, 0, 1, 14), (7, 2, 0, 1, 14), (7, None, 1, 1, 14), (None, 1, 0, 0, 13), (None, 2, 0, 0, 13), (None, None, 1, 0, 13)}
    named = docs.withColumn("gone", F.lit(1)).withColumn("mark", F.lit("x"))
    kept = decontaminate.without_items(named, items)
    assert kept.columns == named.columns and {r["doc_id"] for r in kept.collect()} == {None, 8}


def test_columns_with_the_operators_own_names(spark):
    rows = [(1, " ".join(["the river and a mill"] + [f"word{i} of the" for i in range(30)]))]
    for stage, names in ((quality_rules.keep_good, ["quality", "__quality"]), (shingle_join.one_of_each, ["gone", "__gone"]), (line_dedup.dedup_lines, ["of_doc", "own_text", "places"])):
        df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(n) for n in names])
        out = stage(df).collect()
        assert len(out) == 1 and all(out[0][n] == "own" for n in names)


# 10


def test_added_rules_against_a_matcher():
    rng = random.Random(9)
    parts = ["ghp_", "gho_" + "b2" * 18, "xoxb-", "1-2-3-" * 4, "AIza", "x_-" * 12, "eyJ", "eyJhbG.eyJzdW.", "sig", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "f0" * 17, "token=", "é", " ", "AKIA", "A1B2C3D4"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(600)]
    got = secret_scan.Scanner(secret_scan.automata(), secret_scan.RULES).spans([t.encode() for t in texts])
    for text, spans in zip(texts, got, strict=True):
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            pattern = rule.pattern.replace("(password|", "(?:password|") if rule.tail else rule.pattern
            for m in re.finditer(pattern[: -len("[A-Za-z0-9+/_.=-]+")] + "([A-Za-z0-9+/_.=-]+)" if rule.tail else pattern, text, re.A | (re.I if rule.any_case else 0)):
                if len(m[1] if rule.tail else m[0]) >= rule.least:
                    want.append((m.start(), k, m.end()))
        assert sorted(spans) == sorted(want), text


def test_spans_come_from_the_automata_alone():
    with open(secret_scan.__file__) as f:
        source = f.read()
    assert not re.search(r"^\s*(?:import|from) re\b", source, re.M)
    forward, mirrored = compile_rules([("ab+c", False)]), compile_rules([("ab+c", False)], backwards=True)
    data = np.frombuffer(b"xabbc abc\xff", np.uint8)
    assert np.flatnonzero(forward.hits(data)).tolist() == [4, 8]
    assert np.flatnonzero(mirrored.hits(data[::-1])[::-1]).tolist() == [1, 6]


def test_nothing_in_the_package_uses_local_checkpoints():
    import os

    folder = os.path.dirname(millrace.llm.__file__)
    for name in os.listdir(folder):
        if name.endswith(".py"):
            with open(os.path.join(folder, name)) as f:
                assert "localCheckpoint" not in f.read()
