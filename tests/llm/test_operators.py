"""The ten operators against plain versions on small rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import contextlib
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import decontaminate, line_dedup, packing, quality_rules, repeats, secret_scan, shingle_join, token_counts, token_files, warc  # noqa: E402
from millrace.llm.bpe_automaton import TokenCounter  # noqa: E402
from millrace.llm.packing import SumOfSquares  # noqa: E402
from millrace.llm.piece_encoder import PieceEncoder, encoder  # noqa: E402
from millrace.session import scratch, settle  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def words(rng, n, most=400):
    return " ".join(f"w{rng.randrange(most)}x" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, odd rows; ids are not in order of the list."""
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(5, 160))) for i in range(60)]
    passage = words(rng, 70)
    base = words(rng, 200)
    rows += [(100 + i, base) for i in range(12)]
    for i in range(25):
        w = base.split()
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, words(rng, 40) + " " + passage + " " + words(rng, 40)) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "Two words"), (406, "two WORDS"), (407, words(rng, 20000)), (408, "é" * 80), (409, "é" * 80 + "ü")]
    rows.append(rows[3])  # a repeated row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def plain_components(rows, size, threshold):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "threshold"), [(4, 85), (5, 80)])
def test_jaccard_components(docs, size, threshold):
    classes, links = shingle_join.jaccard_components(docs.withColumn("component_id", F.lit(1)).withColumn("n", F.lit("x")), size, threshold)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()}
    assert got == plain_components(corpus(), size, threshold)
    assert classes.count() == docs.count()
    assert links.filter("x >= y").count() == 0


def test_jaccard_of_nothing(spark):
    classes, links = shingle_join.jaccard_components(empty(spark))
    assert classes.count() == links.count() == 0
    assert shingle_join.one_of_each(empty(spark)).count() == 0


def test_one_of_each_keeps_columns_and_null_ids(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (None, "a b c d e f", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, twin string")
    kept = shingle_join.one_of_each(df)
    assert kept.columns == df.columns
    assert {(r["doc_id"], r["twin"]) for r in kept.collect()} == {(1, "x"), (3, "z"), (None, "n")}


# 2


def test_token_files_round_trip(spark, docs, library):
    folder = scratch(spark, "t")
    index = token_files.write_tokens(docs, folder, BPE, end=2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(token_files.with_starts(index), folder).collect())
    at, want = 0, []
    for i, t in sorted(corpus(), key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_read_only_what_is_asked(spark, docs, library):
    folder = scratch(spark, "t")
    token_files.write_tokens(docs, folder, BPE, end=2, partitions=6)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_documents(spark, folder, [403, 7]).collect()}
    assert got == {i: [*library.encode(dict(corpus())[i], add_special_tokens=False).ids, 2] for i in (403, 7)}


def test_token_files_of_nothing(spark):
    folder = scratch(spark, "t")
    index = token_files.write_tokens(empty(spark), folder, BPE, end=2)
    assert token_files.read_tokens(token_files.with_starts(index), folder).count() == 0


def test_seek_table_and_checksums(spark, docs):
    from pyarrow import fs

    folder = scratch(spark, "t")
    index = token_files.write_tokens(docs, folder, BPE, end=2, partitions=1)
    row = index.orderBy("frame").first()
    path = folder.removeprefix("file://") + "/" + row["file"]
    with fs.LocalFileSystem().open_input_file(path) as f:
        assert [e[0] for e in token_files.read_seek_table(f)] == [r["size"] for r in index.orderBy("frame").collect()]
    data = bytearray(open(path, "rb").read())
    data[row["offset"] + row["size"] // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum|decompress|corrupt"):
        token_files.read_tokens(token_files.with_starts(index), folder).collect()


def test_null_keys_in_token_files(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, "b")], SCHEMA)
    folder = scratch(spark, "t")
    got = [(r["doc_id"], r["n_tokens"]) for r in token_files.read_tokens(token_files.with_starts(token_files.write_tokens(df, folder, BPE, 2)), folder).orderBy("start").collect()]
    assert got == [(None, 2), (1, 1), (1, 2)]


# 3


def plain_repeats(rows, least):
    first, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        raw = t.encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if first.setdefault(raw[p : p + least], i) < i:
                covered[p : p + least] = b"\1" * least
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        runs = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out[i] = (len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("least", [50, 30])
def test_repeats(docs, least):
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs.withColumn("spans", F.lit(0)), least).collect()}
    assert got == plain_repeats(corpus(), least)


def test_repeats_on_small_alphabets(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 300)))) for i in range(40)] + [(50 + i, "ab" * 100 + str(i)) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df, 24).collect()}
    assert got == plain_repeats(rows, 24)


def crowded(n):
    """(texts' bytes, ends, documents): one passage amid ``n`` different surroundings, some of them alike."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, 7)) + b" " for _ in range(60)]
    around = lambda: b"".join(words[i] for i in rng.integers(0, 60, 8))
    texts = [around() + b"the one passage of all the many documents, " + around() for _ in range(n)]
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts]), rng.permutation(n)


def pieces_by_key(n):
    data, ends, docs = crowded(n)
    text, start, end, key = repeats.pieces(data, ends, 50, 20)
    by = np.argsort(key, kind="stable")
    return data, start[by], (end - start)[by], key[by], docs[text[by]]


def test_crowded_grams_are_cut_again():
    rows = pieces_by_key(400)
    found = []
    for most in (1 << 40, 3000, 1):
        covered = {(p, x) for p, a, b in repeats.later_spans(*rows, 50, 20, most).T.tolist() for x in range(a, b)}
        found.append(covered)
    data, start, sizes, _, docs = rows
    first = {}
    for p in range(len(start)):
        for x in range(start[p], start[p] + sizes[p] - 49):
            s = data[x : x + 50].tobytes()
            first[s] = min(first.get(s, docs[p]), docs[p])
    want = {(p, x + k - start[p]) for p in range(len(start)) for x in range(start[p], start[p] + sizes[p] - 49) if first[data[x : x + 50].tobytes()] < docs[p] for k in range(50)}
    assert found[0] == found[1] == found[2] == want and want


def test_a_crowded_gram_takes_bounded_memory():
    data, start, sizes, key, docs = pieces_by_key(60000)
    one = key == np.unique(key)[np.argmax(np.unique(key, return_counts=True)[1])]
    rows = data, start[one], sizes[one], key[one], docs[one]
    tracemalloc.start()
    repeats.later_spans(*rows, 50, 20, 1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes[one].sum() > 3 << 20 and peak < 32 * sizes[one].sum(), (sizes[one].sum(), peak)


def test_repeats_of_odd_rows(spark):
    text = "x" * 10 + "the same long line of text that two documents hold, word for word"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (6, text), (7, None)], SCHEMA)
    got = Counter((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert got == Counter({(None, 0): 1, (5, 0): 2, (6, len(text)): 1, (7, 0): 1})
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_pieces_that_meet_follow_the_input(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    both = line(200)
    rows = [(i, line(300) + (both if i in (3, 60) else "") + line(100)) for i in range(100)]
    source = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "0L AS digest", "text", "false AS copied", "cast(doc_id % 7 AS int) AS slice")
    met = repeats.met_elsewhere(source, 50, 20, repeats.Cells(64)).collect()
    keys = [{k for t, *_, k in zip(*repeats.pieces(*repeats._joined([rows[i][1].encode()]), 50, 20), strict=True)} for i in (3, 60)]
    want = len(keys[0] & keys[1])
    assert {r["slice"] for r in met} == {3, 60 % 7} and want > 5
    assert sum(int.from_bytes(r["bits"]).bit_count() for r in met) == 2 * want
    for size in (1 << 30, 1 << 33, 60 << 30):  # a k-gram leads a piece in some 16 bytes: few share a hash, whatever the input
        assert size / 16 < 0.05 * (1 << repeats.Cells(repeats._parts(size, repeats.HASH_BYTES)).bits + repeats.HASH_BITS)


def test_repeats_shuffle_the_texts_once(spark):
    df = spark.createDataFrame([(i, f"the same long line of text that all documents hold, word for word {i}") for i in range(20)], SCHEMA)
    out = repeats.remove_repeats(df)
    assert len(out.collect()) == 20
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2, plan


def test_backward_extension_finds_all_repeated_strings():
    rng = random.Random(1)
    for _ in range(20):
        text = bytes(rng.choice(b"ab\xff") for _ in range(200)) + b"\xff"
        order, low, high = repeats.repeated_intervals(np.frombuffer(text, np.uint8), 5)
        got = {text[order[a] : order[a] + 5]: b - a for a, b in zip(low.tolist(), high.tolist(), strict=True)}
        want = Counter(text[p : p + 5] for p in range(len(text) - 4))
        assert got == {s: n for s, n in want.items() if n > 1 and b"\xff" not in s}


# 4


def test_quality_measures(spark):
    rows = [(1, "a b c a b c d"), (2, None), (3, ""), (4, "x\n\n x\nx \nx\n#*"), (5, "é ü % | <b>")]
    got = {r["doc_id"]: r["quality"]["m"].asDict() for r in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_repeat_words"]) == (7, 7, 6)
    assert set(got[2].values()) == set(got[3].values()) == {0}
    assert (got[4]["n_lines"], got[4]["n_dup_lines"], got[4]["n_symbols"]) == (5, 1, 2)
    assert (got[5]["n_words"], got[5]["word_chars"], got[5]["n_symbols"]) == (4, 8, 4)


def test_quality_verdicts(spark):
    good = " ".join(["the river and a mill of stone"] + [f"word{i} of the" for i in range(30)])
    rows = [(1, good), (2, good.replace(" ", "### ")), (3, " ".join(f"zz{i}" for i in range(80))), (4, "the " * 80), (5, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("quality", F.lit("own"))
    assert [r["doc_id"] for r in quality_rules.keep_good(df).collect()] == [1]
    assert quality_rules.keep_good(df).columns == df.columns
    assert quality_rules.assess(empty(spark)).count() == 0


def test_quality_is_one_projection(docs):
    plan = quality_rules.assess(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5


def test_warc_round_trip(spark):
    long = "x" * 1200
    rows = [(1, "http://a", long), (2, None, long), (3, "http://c\r\nX: y", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é" * 700), (None, "u", long), (3, "http://c", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own")).repartition(3)
    folder = scratch(spark, "w")
    index = warc.write_archives(pages, folder)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index, folder).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for page, _, html in rows:
        revisit = html == long and page != 3
        want[(page, len((html or "").encode()), sha(html), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == want


def test_warc_selected_by_index(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i % 3}", f"page {i}") for i in range(40)], "page_id long, url string, html string").repartition(4)
    folder = scratch(spark, "w")
    index = warc.write_archives(pages, folder)
    got = {r["page_id"]: r["payload"].decode() for r in warc.read_records(index, folder, F.col("url") == "http://h/1", with_payload=True).collect()}
    assert got == {i: f"page {i}" for i in range(40) if i % 3 == 1}
    assert index.select("offset").distinct().count() > 1


def test_warc_of_nothing(spark):
    folder = scratch(spark, "w")
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_records(index, folder).count() == 0


# 6

PARTS = ["'s", "'re", "'ll", "don't", "'", " ", "\n", "a", "The", "éü", "ß", "İ", "Σ", "ΑΣ", "中文", "12", "٣", "!!", "''s", "'t'", "<|endoftext|>", "<|startoftext|", "\x1c", "\x85", "\xa0", "é", "🙂", "antidisestablishmentarianism", "ſ", "K", "½", "‍", "́", "'Re", "<|ENDOFTEXT|>", "Ⅷ", "ªº", "ẖ", "H̱"]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["a" * 5000, "ab" * 3000 + "'" * 2000, "", "é" * 3000, "x y " * 4000]


def test_counts_equal_the_library(library):
    texts = odd_texts(1500)
    assert TokenCounter(BPE).count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tables_may_begin_again(library, monkeypatch):
    monkeypatch.setattr("millrace.llm.bpe_automaton.MOST_CELLS", 1)
    counter, texts = TokenCounter(BPE), odd_texts(60)
    for _ in range(2):
        assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_tokens(spark, docs, library):
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs.withColumn("n_tokens", F.lit(0)), BPE, limit=100).collect())
    want = Counter()
    for i, t in corpus():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts.count_tokens(empty(spark), BPE).count() == 0


def test_pieces_equal_whole_texts(library):
    texts = odd_texts(1500)
    encoder = PieceEncoder(BPE)
    for _ in range(2):
        got = encoder.encode([t.encode() for t in texts], 2)
        assert [x.tolist() for x in got] == [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_remembered_pieces_go_with_the_task(spark, docs, tmp_path):
    def held(batches):
        for _ in batches:
            with encoder(BPE) as own:
                yield pa.RecordBatch.from_arrays([pa.array([len(own.known) + len(own.known.before)])], ["n"])

    most = lambda: max(r["n"] for r in spark.range(0, 32, 1, 16).mapInArrow(held, "n long").collect())
    packing.pack(docs, BPE, 2).collect()
    assert most() == 1
    token_files.write_tokens(docs, f"file://{tmp_path}/t", BPE, end=2)
    assert most() == 1
    with contextlib.suppress(ZeroDivisionError), encoder(BPE) as own:
        first = own.encode([b"some words"], 2)[0].tolist()
        assert len(own.known) == 3 and 1 / 0
    with encoder(BPE) as again:
        assert again is own and len(again.known) == 1 and again.encode([b"some words"], 2)[0].tolist() == first


# 7


def plain_lines(rows, least):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: r[0]):
        kept, gone = [], 0
        for line in ("" if t is None else t).split("\n"):
            holes = {("s", k, line[:k] + line[k + 1 :]) for k in range(len(line))}
            shorter = {h[2] for h in holes}
            if len(line) >= least and (("=", line) in seen or holes & seen or any(("=", s) in seen for s in shorter) or ("d", line) in seen):
                gone += 1
            else:
                kept.append(line)
            if len(line) >= least:
                seen |= {("=", line)} | holes | {("d", s) for s in shorter}
        out[i] = (gone, None if t is None else "\n".join(kept))
    return out


def line_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(3):
            b = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k, r = rng.randrange(len(b)), rng.random()
                if r < 0.5:
                    b[k] = rng.choice("xyz")
                elif r < 0.75:
                    b.pop(k)
                else:
                    b.insert(k, "w")
            lines.append("".join(b))
        rows.append((i, "\n".join([*lines, "short", ""])))
    return rows + [(900, None), (901, ""), (902, base[0] + "\r"), (903, "é" * 40 + "\n" + "é" * 39)]


@pytest.mark.parametrize("crowd", [64, 3])
def test_lines_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    df = spark.createDataFrame(line_rows(), SCHEMA).withColumn("id", F.lit("own")).withColumn("n_lines", F.lit("own")).repartition(4)
    out = line_dedup.dedup_lines(df, 1, 32)
    assert out.columns == ["doc_id", "text", "id", "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in out.collect()} == plain_lines(line_rows(), 32)


@pytest.mark.parametrize("crowd", [64, 2])
def test_lines_with_two_edits(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(8)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(10, 14))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df, 2, 10).filter("n_removed > 0").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {i for i, x in enumerate(lines) if any(distance(x, y) <= 2 for y in lines[:i])}


def test_banded_distance(spark):
    rng, rows = random.Random(3), []
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i, k = rng.randrange(len(b) + 1), rng.random()
            if k < 0.4 and i < len(b):
                b.pop(i)
            elif k < 0.7:
                b.insert(i, "d")
            elif i < len(b):
                b[i] = "é"
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        assert df.filter(line_dedup.within_edits(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("crowd", [64, 2])
def test_lines_with_edits_by_length(spark, monkeypatch, crowd):
    """Classes against all pairs, and short equal lines; lines near the bounds of the classes meet too."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(5)
    lines = []
    for _ in range(14):
        base = [rng.choice("abcdefghé ") for _ in range(rng.choice([32, 40, 63, 64, 127, 129, 130, 200, 255, 258]))]
        lines.append("".join(base))
        for _ in range(5):
            b = list(base)
            for _ in range(rng.randint(1, 7)):
                at = rng.randrange(len(b))
                kind = rng.randrange(3)
                b[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("xyz")]
            lines.append("".join(b))
    lines += ["Les.", "", "Les.", "", "ok", "x" * 31, "x" * 30]
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df, line_dedup.CLASSES, 1).filter("n_removed > 0").collect()}

    def near(a, b):
        allowed = max([e for n, e in line_dedup.CLASSES if n <= max(len(a), len(b))], default=0)
        if min(len(a), len(b)) < 32:
            return a == b and a != ""
        return abs(len(a) - len(b)) <= allowed and edit_distance(a, b) <= allowed

    assert got == {i for i, x in enumerate(lines) if any(near(x, y) for y in lines[:i])}


@pytest.mark.parametrize("crowd", [256, 20])
def test_lines_under_a_shared_lead(spark, monkeypatch, crowd):
    """Some hundred log lines with one lead, most of them near no other, some one edit from an earlier one, some longer than one edit allows for."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(6)
    lead = "2024-01-01 INFO worker says: line "
    lines = [lead + "".join(rng.choice("abcdefgh01é") for _ in range(rng.choice([20, 36, 60, 93, 94, 110]))) for _ in range(260)]
    for base in lines[::4]:
        b, at = list(base), rng.randrange(20, len(base))
        kind = rng.randrange(4)
        b[at : at + (kind != 1)] = [] if kind == 2 else ["z"]
        lines.append("".join(b) if kind < 3 else base[:-1] + "!")
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df, line_dedup.CLASSES, 1).filter("n_removed > 0").collect()}
    allowed = lambda a, b: max(e for n, e in line_dedup.CLASSES if n <= max(len(a), len(b)))
    assert got == {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= allowed(x, y) and edit_distance(x, y) <= allowed(x, y) for y in lines[:i])}


def test_lines_one_edit_apart(spark):
    lines = ["abc", "abd", "abe", "ab", "xabc", "zzz", "éa", "a", "a"[:0] + "b"]
    df = spark.createDataFrame([(i, i, t, len(t)) for i, t in enumerate(lines)], "no long, id long, line string, n int")
    got = {tuple(r) for r in line_dedup._one_edit_apart(df).collect()}
    assert all(x < y and edit_distance(lines[x], lines[y]) == 1 for x, y in got)
    assert {y for _, y in got} == {j for j, t in enumerate(lines) if any(edit_distance(t, u) == 1 for u in lines[:j])}
    leads = spark.range(3000).select(F.col("id").alias("no"), "id", F.concat(F.lit("lead " * 8), F.md5(F.col("id").cast("string"))).alias("line"), F.lit(72).alias("n"))
    assert line_dedup._one_edit_apart(leads).count() == 0  # no pairs of lines that are not near


def test_lines_of_production_allow_more_edits(spark, monkeypatch):
    """A changed date in a long line, and equal lines under 32 characters, as the query and the pipeline's stage read them."""
    from millrace.llm import catalog

    line = "the report of 2024-01-15 says in so many words that nothing of note has changed since the report before it was written down, " * 3
    df = spark.createDataFrame([(1, line + "\nLes."), (2, line.replace("2024-01-15", "2025-02-15", 1) + "\nLes.")], SCHEMA)
    monkeypatch.setattr(catalog, "_documents", lambda spark, folder: df)
    assert {r["doc_id"]: r["n_removed"] for r in catalog.op7_line_dedup(spark, "").collect()} == {1: 0, 2: 2}


def test_counts_leave_near_lines(spark):
    """What the counts refuse is not near, whatever the number of a letter, and most unlike lines are refused; the JVM compiles the filter: no method of over 8000 bytes."""
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        n = rng.choice([32, 64, 127, 128, 256, 600, 1100])
        a = "".join(rng.choice("aaaaaen Zé0179") for _ in range(n))
        b, edits = list(a), max(e for least, e in line_dedup.CLASSES if least <= n)
        for _ in range(rng.randint(0, edits)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("ae0Zz")]
        rows += [(a, "".join(b), True), (a, "".join(rng.choice("ethlas dn") for _ in range(n)), False)]
    df = spark.createDataFrame(rows, "a string, b string, near boolean")
    side = lambda x: F.struct(*line_dedup._side(F.col(x), F.length(x), line_dedup.CLASSES)).alias(x)
    sides = settle(df.select(side("a"), side("b"), "near"), "sides")
    left = sides.filter(line_dedup._may_be_near(F.col("a"), F.col("b")))
    counts = Counter(r["near"] for r in left.collect())
    assert counts[True] == 300 and counts[False] < 15
    text = spark._jvm.PythonSQLUtils.explainString(left._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_bits_of_segments_are_few_rows(spark, monkeypatch):
    """16 MB of bits are broadcast in at most 2 ** 18 rows; a row for each 64 bits took several times that in the driver."""
    tables, real = {}, line_dedup.settle

    def kept(df, name):
        tables[name] = real(df, name)
        return tables[name]

    monkeypatch.setattr(line_dedup, "settle", kept)
    monkeypatch.setattr(line_dedup, "unsettle", lambda *tables: None)
    lines = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.sha1(F.col("id").cast("string")), F.repeat(F.lit("x"), 80)).alias("text"))
    assert line_dedup.dedup_lines(lines, line_dedup.CLASSES, 1).count() == 500
    for name in ("bits", "wanted"):
        first = tables[name].columns[0]
        low, high, n = tables[name].agg(F.min(first), F.max(first), F.count("*")).first()
        assert 0 <= low and high < 1 << 18 and n > 0


def test_lines_stay_native(docs):
    plan = line_dedup.dedup_lines(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_of_odd_rows(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    line = "a line that is long enough to be judged here"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line + "\n" + line)], SCHEMA)
    got = Counter((r["doc_id"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == Counter({(None, 0): 1, (1, 1): 2, (2, 2): 1})


# 8


@pytest.mark.parametrize("size", [64, 4096])
def test_packing_keeps_every_id_once(docs, library, size):
    rows = packing.pack(docs.dropDuplicates().withColumn("offset", F.lit(9)), BPE, 2, size, with_ids=True).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in corpus()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, whole in ids.items():
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in pieces for x in r["ids"]] == whole and [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        total = sum(r["length"] for r in pieces)
        assert total == size or total < size and total & (total - 1) == 0


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark), BPE, 2).count() == 0


def test_sum_of_squares_takes_the_least_sum():
    rng, size = random.Random(2), 12
    packer, counts = SumOfSquares(size), Counter()
    for k in range(400):
        n = rng.randrange(1, size)
        options = []
        for fill in [0, *sorted(f for f, c in counts.items() if c and f + n <= size)]:
            after = counts.copy()
            after[fill] -= fill > 0
            after[fill + n] += fill + n < size
            options.append((sum(c * c for f, c in after.items() if 0 < f < size), -fill, after))
        best = min(options, key=lambda o: o[:2])
        packer.place((k, 0, np.zeros(n, np.uint32), n))
        counts = best[2]
        assert {f: len(w) for f, w in enumerate(packer.open) if w} == {f: c for f, c in counts.items() if c and 0 < f < size}


# 9


def test_best_match_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        item = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 8))], np.uint64)
        region = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 14))], np.uint64)

        def distance(part, item=item):
            row = list(range(len(part) + 1))
            for i, x in enumerate(item, 1):
                new = [i]
                for j, y in enumerate(part, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        least = min(distance(region[a:b].tolist()) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        found, a, b = decontaminate.best_match(item, region)
        assert found == least == distance(region[a:b].tolist())


def leaks():
    rng = random.Random(7)
    items = [(i, words(rng, rng.randrange(12, 50), 3000).replace(" ", ", ")) for i in range(40)] + [(90, "tiny item"), (91, None), (92, " ")]
    docs, want = [], set()
    for d in range(160):
        item, text = items[d % 40]
        w = text.replace(",", "").split()
        edits = rng.randrange(0, int(0.2 * len(w)) + 1) if d % 2 else 0
        for k in rng.sample(range(len(w)), edits):
            w[k] = f"changed{rng.randrange(99)}"
        docs.append((d, words(rng, 60, 3000) + "\n" + " ".join(w).upper() + " " + words(rng, 60, 3000)))
        want.add((d, item))
    return items, docs + [(500, words(rng, 300, 3000)), (501, None), (502, ""), (503, "a Tiny, item here")], want


def test_leaks_are_found(spark):
    items, rows, want = leaks()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("own")).repartition(3)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_items(docs, bench).collect()}
    exact = {p for p in want if p[0] % 2 == 0}
    assert exact <= set(got) and all(got[p]["distance"] == 0 for p in exact)
    assert len(want & set(got)) >= 0.97 * len(want)
    assert set(got) - want == {(503, 90)}
    kept = decontaminate.without_items(docs, bench)
    assert kept.columns == docs.columns and {500, 501, 502} <= {r["doc_id"] for r in kept.collect()}


def test_large_benchmarks_go_in_slices(spark, monkeypatch):
    items, rows, want = leaks()
    monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", 16)
    got = decontaminate.find_items(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {p for p in want if p[0] % 2 == 0} <= {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_no_items_or_no_documents(spark):
    items, rows, _ = leaks()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_items(empty(spark), bench).count() == 0
    assert decontaminate.find_items(spark.createDataFrame(rows, SCHEMA), bench.limit(0)).count() == 0


# 10


def plain_secrets(text):
    spans, counts = [], [0, 0, 0]
    rules = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 8), (r"AKIA[A-Z0-9]+", re.A, 0, 16), (r"[0-9a-f]+", re.A, 0, 32)]
    for k, (pattern, flags, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                counts[k] += 1
                spans.append((m.start(), k, m.end()))
    written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*counts, hashlib.sha256(written.encode()).hexdigest())


def secrets():
    rng = random.Random(2)
    parts = ["token", "=", ":", " ", "'", '"', "abc", "secret", "api_key", "APIKEY", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "ghp_" + "a1" * 20, "x" * 9, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c-_", "-----BEGIN RSA PRIVATE KEY-----", "é", "PassWord", "\n", "K", "ſecret"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    return rows + [(900, None), (901, ""), (902, "password = hunter22x " * 3000), (903, "f" * 9000)]


def test_secrets(spark):
    df = spark.createDataFrame(secrets(), SCHEMA).withColumn("spans", F.lit(0)).repartition(3)
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == {i: plain_secrets(t) for i, t in secrets()}
    assert any("github:" in r["spans"] for r in got.values()) and any("jwt:" in r["spans"] for r in got.values()) and any("pem:" in r["spans"] for r in got.values())
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [[(1, "clean text")], [(1, None), (2, None)], [(1, ""), (2, "")], [(1, "clean"), (2, None), (3, ""), (4, "password=abcdefgh1"), (5, "é" * 40)]])
def test_secrets_of_clean_batches(spark, rows):
    for parts in (1, len(rows)):
        got = {r["doc_id"]: tuple(r)[1:5] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
        assert got == {i: plain_secrets(t) for i, t in rows}


def test_automaton_is_minimal_and_right():
    from millrace.llm.regex_automaton import compile_rules

    found = compile_rules([("(ab|ac)+d{2,3}", False), ("[x-z]?Q", True)])
    assert len(found.accepts) // found.width <= 10
    for text in ("ababdd", "acd", "zq", "Q", "abacddd", "abd"):
        hits = np.bitwise_or.reduce(found.hits(np.frombuffer(text.encode() + b"\xff", np.uint8)))
        assert bool(hits & 1) == bool(re.search("(ab|ac)+d{2,3}", text)) and bool(hits & 2) == bool(re.search("[x-z]?q", text, re.I))
