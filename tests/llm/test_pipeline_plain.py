"""run() of the pipeline against every stage written plainly in Python."""

import random
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import line_dedup, quality_rules  # noqa: E402
from millrace.session import scratch  # noqa: E402

COMMON = "the of and to in is that was it for on with as be by at from this are or an not".split()


def sentence(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(repeats) > 50 * len(words):
        return False
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return 2 <= sum(map(len, words)) / len(words) <= 12 and symbols / len(words) <= 0.1 and stops / len(words) >= 0.02 and (len(lines) - len(set(lines))) / len(lines) <= 0.5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.CLASSES[0][0]:
        return False
    allowed = max(e for n, e in line_dedup.CLASSES if n <= max(len(a), len(b)))
    apart = Counter(a)
    apart.subtract(Counter(b))
    return abs(len(a) - len(b)) <= allowed and sum(abs(v) for v in apart.values()) <= 2 * allowed and edits(a, b) <= allowed


def without_lines(docs):
    earlier, out = [], {}
    for i, text in sorted(docs.items()):
        kept = []
        for line in text.split("\n"):
            if not line.strip(" \t\n\x0b\x0c\r"):
                kept.append(line)
                continue
            if not any(near(line, x) for x in earlier):
                kept.append(line)
            earlier.append(line)
        joined = "\n".join(kept)
        if joined == text or re.search(r"[^\x20\x09-\x0D]", joined):
            out[i] = joined
    return out


def first_of_each(docs):
    sets = {i: set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w := text.lower().split()) >= 5 else {tuple(w)} for i, text in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: t for i, t in docs.items() if find(i) == i}


def holds(text, item):
    words = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t.lower())
    own, region = words(item), words(text)
    row = [0] * (len(region) + 1)
    for k, w in enumerate(own, 1):
        new = [k]
        for j, x in enumerate(region, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row) <= int(0.2 * len(own))


def test_run_against_plain_stages(spark):
    rng = random.Random(11)
    docs = {i: "\n".join(sentence(rng, rng.choice([6, 9, 20])) for _ in range(8)) for i in range(40)}
    items = [(k, sentence(rng, 25)) for k in range(4)]
    docs[50] = docs[3]
    docs[51] = docs[4] + "\n" + sentence(rng, 9)
    changed = docs[5].split("\n")
    docs[52] = "\n".join([changed[0][:10] + "x" + changed[0][10:], *[sentence(rng, 20) for _ in range(4)], changed[1]])
    docs[53] = "\n".join([sentence(rng, 20), items[0][1], sentence(rng, 20), sentence(rng, 20)])
    edited = items[1][1].split()
    edited[3:5] = ["other", "words", "here"]
    docs[54] = "\n".join([sentence(rng, 30), sentence(rng, 8) + " " + " ".join(edited) + " " + sentence(rng, 8), sentence(rng, 30)])
    words = docs[6].replace("\n", " ").split()
    for k in range(0, len(words), 60):
        words[k] = "altered"
    docs[55] = " ".join(words)
    docs[56], docs[57], docs[58] = "| " * 90, "", "the " * 100
    docs[59] = "Les.\n" + docs[7].replace("\n", " ") + "\nLes.\n \n" + sentence(rng, 20)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(60, None, "en", "s", 0)]
    path = scratch(spark, "plain")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    kept = {i: t for i, t in docs.items() if good(t)}
    assert 56 not in kept and 58 not in kept and 53 in kept
    kept = without_lines(kept)
    assert 50 not in kept and kept[52].count("\n") == 3
    kept = first_of_each(kept)
    assert 55 not in kept
    kept = {i: t for i, t in kept.items() if not any(holds(t, x) for _, x in items)}
    assert 53 not in kept and 54 not in kept and len(kept) > 35

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in kept.items()}
    pieces, fills = {}, Counter()
    for r in corpus_pipeline.run(spark, path).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], list(r["ids"])))
        fills[r["sequence_id"]] += r["length"]
    assert {i: sum((x for _, x in sorted(v)), []) for i, v in pieces.items()} == want
    assert all(n == 4096 or n < 4096 and n & (n - 1) == 0 for n in fills.values())


def test_run_of_nothing_and_of_repeats(spark):
    rng = random.Random(3)
    text = "\n".join(sentence(rng, 20) for _ in range(6))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows, want in (([], 0), ([(1, text, "en", "s", 1)] * 3 + [(2, text, "en", "s", 1), (3, None, "en", "s", 0)], 3)):
        path = scratch(spark, "odd")
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, sentence(rng, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        found = corpus_pipeline.run(spark, path).collect()
        assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found) and {r["doc_id"] for r in found} <= {1}
        assert sum(r["start"] == 0 for r in found) == want
