"""Line dedup: a segment-partition edit join over the distinct lines of all documents, in DataFrame functions only.

The edits that are allowed grow with the longer line (``CLASSES``: classes of length). A line of a class with ``edits``
is cut into ``edits`` + 1 segments or one more, half of them counted from the front and half from the end, at places
that depend on the class alone, so lengths need no keys of their own. Of 2m segments and 2m - 1 edits one half has
at most m - 1 edits, hence a segment j of it, counted from its end of the line, that is whole and has j edits
outside it: it has moved by j characters at most. So each line is listed under its own segments and asks under its
substrings at places shifted by up to j. Pairs that meet are verified by the banded edit distance.

Most segments are nobody else's. Rows are kept from the shuffle by bits of fixed number, three of a word set for each hash of own
segments: an asking row passes if some line owns its hash, an owning row if another line owns it or a row that
passed asks for it. A false hit costs work only.

Under each segment, lines are first held against its earliest owner; a line that no link makes late by then is
held against all earlier ones of that segment, in blocks of CROWD owners. Groups of near copies are linear by
this. Lines that share a segment without being near, and are near no earlier line, meet in pairs; of these only those
are verified whose counts of LETTERS allow it: an edit changes one count up and one down at most. Counts are kept
modulo 10 as codes of five bits of which neighbours differ in one bit, so the bits in which two lines differ are no more
than what their counts do, and one comparison takes few operations: the JVM does not compile methods of over 8000 bytes.

A segment that more than CROWD lines own is often a fixed lead or end, and its lines are not near each other. Where one edit is allowed
and many of these lines are not late yet, they do not meet in pairs: two of them are near if one character taken from the same place of both, or from the
longer one, leaves the same text. So each is listed under all its texts with one character less, which is linear in their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import unused
from millrace.llm.quality_rules import NOT_SPACE, let
from millrace.session import settle, unsettle

#: Owners of a segment that one block of comparisons holds.
CROWD = 256
SMALL_ROWS = 1 << 18
#: Bits for the hashes of segments, 16 MB in all, WORDS numbers of 64 bits to a row of what the executors get: 262144 rows.
CELL_BITS = 27
WORDS = 8
#: Characters that are counted; any would do, frequent ones come first as they tell most lines apart.
LETTERS = "eanirtsoldhucmpgbfvyqwkjxz0123456789"
#: (least characters, edits): two more edits each time that the length doubles.
CLASSES = ((32, 1), (64, 1), *((64 << i, 2 * i + 1) for i in range(1, 11)))
#: Lines of so many characters meet in pairs in crowds, too: texts with one character less take the square of a line's length.
LONGEST_LISTED = 512
_BITS = 62
_MASK = (1 << _BITS) - 1


def _bits(value: int) -> Column:
    return F.lit(value).cast("long")


def _inverse(x: Column) -> Column:
    return x.bitwiseXOR(_bits(_MASK))


def _without_affixes(a: Column, b: Column) -> Column:
    """struct(a, b) without some of what they share at their ends, which costs no edit."""

    def cut(pair: Column, share: int, front: bool) -> Column:
        def body(p: Column) -> Column:
            n, m = F.length(p["a"]), F.length(p["b"])
            k = F.floor(F.least(n, m) / share).cast("int")
            if front:
                same = F.substring(p["a"], F.lit(1), k) == F.substring(p["b"], F.lit(1), k)
                rest = F.struct(F.substring(p["a"], k + 1, n).alias("a"), F.substring(p["b"], k + 1, m).alias("b"))
            else:
                same = F.substring(p["a"], n - k + 1, k) == F.substring(p["b"], m - k + 1, k)
                rest = F.struct(F.substring(p["a"], F.lit(1), n - k).alias("a"), F.substring(p["b"], F.lit(1), m - k).alias("b"))
            return F.when((k > 0) & same, rest).otherwise(p)

        return let(pair, body)

    pair = F.struct(a.alias("a"), b.alias("b"))
    for share in (2, 2, 2, 3, 3, 4):
        pair = cut(cut(pair, share, True), share, False)
    return pair


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the strings are within ``edits`` edits: Hyyrö's bit vectors on a band of the matrix.

    Bits stand for the rows along the diagonal; the band moves down a row with each character of the second
    string, and the distance is followed first along its lowest diagonal, then along the last row.
    """

    def banded(pair: Column) -> Column:
        def run(x: Column) -> Column:
            rows, columns, n, m = x["r"], x["c"], F.size(x["r"]), F.size(x["c"])

            def step(s: Column, j: Column) -> Column:
                letter = F.get(columns, j)
                hits = [F.when(F.get(rows, j + d) == letter, _bits(1 << (_BITS - 1 - edits + d))).otherwise(_bits(0)) for d in range(-edits, edits + 1)]
                match = reduce(lambda u, v: u.bitwiseOR(v), hits)

                def moved(t: Column) -> Column:
                    vp, vn, pm = s["vp"], s["vn"], t["pm"]
                    zero = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(_bits(_MASK))

                    def after(d0: Column) -> Column:
                        hp, hn = vn.bitwiseOR(_inverse(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                        slid = F.shiftright(d0, 1)
                        on_row = j - (n - edits)  # steps since the band's lowest diagonal met the last row
                        at = F.call_function("shiftright", _bits(1 << (_BITS - 2)), F.greatest(on_row, F.lit(0)))
                        along = F.when(hp.bitwiseAND(at) != 0, 1).when(hn.bitwiseAND(at) != 0, -1).otherwise(0)
                        down = F.when(d0.bitwiseAND(_bits(1 << (_BITS - 1))) == 0, 1).otherwise(0)
                        change = F.when(on_row < 0, down).otherwise(along)
                        return F.struct(hn.bitwiseOR(_inverse(slid.bitwiseOR(hp))).alias("vp"), slid.bitwiseAND(hp).alias("vn"), (s["cost"] + change).alias("cost"))

                    return let(zero, after)

                return let(F.struct(match.alias("pm")), moved)

            band = ((1 << (edits + 1)) - 1) << (_BITS - edits - 1)
            start = F.struct(_bits(band).alias("vp"), _bits(0).alias("vn"), F.lit(edits).alias("cost"))
            walked = F.aggregate(F.sequence(F.lit(0), m - 1), start, step, lambda s: s["cost"])
            # the last row is met only by strings longer than the band
            return F.when(F.abs(n - m) > edits, F.lit(False)).when(m == 0, n <= edits).when(n <= edits, F.levenshtein(pair["a"], pair["b"]) <= edits).otherwise(walked <= edits)

        chars = F.struct(F.split(pair["a"], "").alias("r"), F.split(pair["b"], "").alias("c"))
        return let(chars, run)

    return let(_without_affixes(a, b), banded)


def _shapes(number: int, least: int, edits: int, own: bool, asks: bool) -> list[str]:
    """SQL structs (segment, at, size, own) of a class; ``at`` counts from 0, or from the line's end if negative."""
    half = edits // 2 + 1
    size = (least - edits) // (2 * half)
    if size < 1:
        raise ValueError(f"lines of {least} characters are too short for {edits} edits")
    out = []
    for j in range(half):
        for shift in range(-j, j + 1):
            if own if shift == 0 else asks:
                for back, at in ((0, j * size + shift), (1, shift - (j + 1) * size)):
                    out.append(f"struct({number * 64 + 2 * j + back} AS segment, {at} AS at, {size} AS size, {shift == 0} AS own)")
    return out


def _chosen(classes: tuple, own: bool, asks: bool) -> Column:
    """array<struct(segment, at, size, own)> of a line of n characters; a line is also listed in the next class if a line of that could be near."""
    reach = [least - edits if i else least for i, (least, edits) in enumerate(classes)]
    bounds = sorted({least for least, _ in classes} | (set(reach) if own else set()))
    branches = []
    for i, low in enumerate(bounds):
        main = max((k for k, (least, _) in enumerate(classes) if least <= low), default=None)
        shapes = [] if main is None else _shapes(main, *classes[main], own, asks)
        shapes += [x for k, (least, edits) in enumerate(classes) if own and reach[k] <= low < least for x in _shapes(k, least, edits, True, False)]
        if shapes:
            branches.append(f"WHEN n >= {low} AND {f'n < {bounds[i + 1]}' if i + 1 < len(bounds) else 'true'} THEN array({', '.join(shapes)})")
    return F.expr(f"CASE {' '.join(branches)} END")


def _key(line: Column, n: Column, shape: Column) -> Column:
    start = F.when(shape["at"] < 0, n + shape["at"]).otherwise(shape["at"]) + 1
    return F.xxhash64(shape["segment"], F.substring(line, start, shape["size"]))


def _keyed(lines: DataFrame, classes: tuple, own: bool, asks: bool) -> DataFrame:
    """(key, h, own): the rows of all lines (h, line, n), those of their own segments, those that ask, or both."""
    plain = F.octet_length("line") == F.col("n")  # then bytes are characters, and no walk leads to a place
    some = lines.filter((F.octet_length("line") >= classes[0][0]) & (F.col("n") >= classes[0][0]))
    rows = some.select("h", "line", "n", F.when(plain, F.col("line").cast("binary")).alias("raw"), F.explode(_chosen(classes, own, asks)).alias("s"))
    n, s = F.col("n"), F.col("s")
    return rows.select(F.when(F.col("raw").isNotNull(), _key(F.col("raw"), n, s)).otherwise(_key(F.col("line"), n, s)).alias("key"), "h", F.col("s.own").alias("own"))


def _part() -> Column:
    return F.shiftrightunsigned("key", 64 - CELL_BITS + 9).alias("part")


def _bit() -> Column:
    """Three bits of the key's word, by 18 bits of the key."""
    return reduce(lambda u, v: u.bitwiseOR(v), [F.call_function("shiftleft", _bits(1), (F.shiftrightunsigned("key", 64 - CELL_BITS - 6 * i) % 64).cast("int")) for i in range(3)])


def _word() -> Column:
    return (F.shiftrightunsigned("key", 64 - CELL_BITS + 6) % WORDS).cast("int").alias("word")


def _ored(bits: Column, name: str) -> list[Column]:
    """Aggregates, the WORDS numbers of a part: ``bits`` of the rows of each word."""
    return [F.coalesce(F.bit_or(F.when(F.col("word") == i, bits)), _bits(0)).alias(f"{name}{i}") for i in range(WORDS)]


def _with_bits(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """The rows (key, h, own) whose bits the ``table`` (part, and WORDS numbers by ``name``) has: 2 ** CELL_BITS bits at most, so it may be broadcast."""
    bits = reduce(lambda then, i: F.when(F.col("word") == i, F.col(f"{name}{i}")).otherwise(then), range(1, WORDS), F.col(f"{name}0"))
    table = table.select("part", *[f"{name}{i}" for i in range(WORDS)])
    return rows.select("*", _part(), _word()).join(F.broadcast(table), "part").filter(bits.bitwiseAND(_bit()) == _bit()).select("key", "h", "own")


def meetings(lines: DataFrame, classes: tuple) -> DataFrame:
    """(key, h, own, owners): rows of segments that a line owns and another owns or asks for."""
    owned = settle(_keyed(lines, classes, own=True, asks=False), "owned")
    keys = owned.select(_part(), "key", F.shiftright("h", 33).cast("int").alias("t")).repartition("part").groupBy("part", "key").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    keys = keys.select("part", _word(), _bit().alias("bit"), F.when(F.col("low") < F.col("high"), _bit()).otherwise(_bits(0)).alias("more"))
    table = settle(keys.groupBy("part").agg(*_ored(F.col("bit"), "seen"), *_ored(F.col("more"), "twice")), "bits")
    asking, wanted = None, table
    if any(e > 1 for _, e in classes):
        asking = settle(_with_bits(_keyed(lines, classes, own=False, asks=True), table, "seen"), "asking")
        asked = asking.select(_part(), _word(), _bit().alias("bit")).groupBy("part").agg(*_ored(F.col("bit"), "asked"))
        either = [F.col(f"twice{i}").bitwiseOR(F.coalesce(f"asked{i}", _bits(0))).alias(f"twice{i}") for i in range(WORDS)]  # what is asked for is seen
        wanted = settle(table.join(asked, "part", "left").select("part", *either), "wanted")
    rows = _with_bits(owned, wanted, "twice")
    rows = (rows if asking is None else rows.union(asking)).repartition("key").groupBy("key", "h").agg(F.max("own").alias("own"))
    same = Window.partitionBy("key")
    counted = rows.select("*", F.count_if("own").over(same).alias("owners"), F.count("*").over(same).alias("all"))
    met = settle(counted.filter("owners > 0 AND all > 1").select("key", "h", "own", "owners"), "met")
    unsettle(owned, table, *([] if asking is None else [asking, wanted]))
    return met


def _allowed(n: Column, m: Column, classes: tuple) -> Column:
    """The edits that lines of n and m characters may differ by."""
    longer, edits = F.greatest(n, m), F.lit(classes[0][1])
    for least, more in classes[1:]:
        edits = F.when(longer >= least, more).otherwise(edits)
    return edits


def _near(a: Column, b: Column, n: Column, m: Column, classes: tuple) -> Column:
    """Whether lines of n and m characters are within the edits of the longer one's class."""
    edits = _allowed(n, m, classes)
    return F.when(F.abs(n - m) <= edits, F.call_function("levenshtein", a, b, edits) >= 0).otherwise(False)


def _side(line: Column, n: Column, classes: tuple) -> list[Column]:
    """n, edits (allowed by the line's own length) and of: counted (characters in LETTERS) and the codes of their counts, twelve to a number."""
    codes = F.lit([(1 << k) - 1 for k in range(5)] + [31 ^ ((1 << k) - 1) for k in range(5)]).cast("array<long>")
    counts = F.transform(F.lit(list(LETTERS)), lambda x: F.octet_length(line) - F.octet_length(F.replace(line, x, F.lit(""))))
    coded = lambda some: F.aggregate(some, _bits(0), lambda w, c: F.shiftleft(w, 5).bitwiseOR(F.get(codes, c % 10)))
    words = lambda c: [coded(F.slice(c, i + 1, 12)).alias(f"w{i // 12}") for i in range(0, len(LETTERS), 12)]
    of = let(counts, lambda c: F.struct(F.aggregate(c, F.lit(0), lambda u, v: u + v).alias("counted"), *words(c)))
    return [n.alias("n"), _allowed(n, n, classes).alias("edits"), of.alias("of")]


def _may_be_near(a: Column, b: Column) -> Column:
    """Whether what _side() says of two lines leaves it open that they are near; false only of lines that are not.

    Of counts that go up by u and down by v in all, u and v are no more than the edits; at most u + v is summed here, u - v is known.
    """
    edits = F.greatest(a["edits"], b["edits"])
    gaps = reduce(lambda u, v: u + v, [F.bit_count(a["of"][f"w{i}"].bitwiseXOR(b["of"][f"w{i}"])) for i in range(len(LETTERS) // 12)])
    return (F.abs(a["n"] - b["n"]) <= edits) & (gaps + F.abs(a["of"]["counted"] - b["of"]["counted"]) <= 2 * edits)


def _listed_below(classes: tuple) -> int:
    """Lines of fewer characters are allowed one edit, as the longer one of a pair, and are short enough to be listed."""
    if classes[0][1] != 1:
        return 0
    return min([LONGEST_LISTED, *[least for least, edits in classes if edits > 1]])


def _one_edit_apart(lines: DataFrame) -> DataFrame:
    """(x, y), y the later one: of lines (no, id, line, n), pairs that differ by one character at one place or by one more, such that each line that has an earlier one in
    such a distance is a y. Of lines that agree but for one place, the first stands for all earlier ones."""
    less = lines.select("no", "id", "line", "n", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    last = F.substring("line", F.col("i"), F.lit(1)) != F.substring("line", F.col("i") + 1, F.lit(1))  # of a run of one character, any leaves the same rest
    less = less.select("no", "id", "i", last.alias("last"), F.concat(F.substring("line", F.lit(1), F.col("i") - 1), F.substring("line", F.col("i") + 1, F.col("n"))).alias("rest"))
    same = less.select(F.xxhash64("i", "rest").alias("key"), F.struct("id", "no").alias("a"))
    groups = same.groupBy("key").agg(F.min("a").alias("first"), F.max("a").alias("then"), F.count("*").alias("many")).filter("many > 1")
    groups = settle(groups, "one-off")
    two = groups.filter("many = 2").select(F.col("first.no").alias("x"), F.col("then.no").alias("y"))
    more = same.join(_few(groups.filter("many > 2").select("key", "first")), "key").filter(F.col("a.no") != F.col("first.no")).select(F.col("first.no").alias("x"), F.col("a.no").alias("y"))
    changed = two.union(more)
    whole = lines.select(F.xxhash64("line").alias("key"), F.struct("id", "no").alias("a"))
    longer = less.filter("last").select(F.xxhash64("rest").alias("key"), F.struct("id", "no").alias("b"))
    met = longer.join(whole, "key")
    return changed.union(met.select(F.least("a", "b")["no"].alias("x"), F.greatest("a", "b")["no"].alias("y")))


def late_lines(lines: DataFrame, classes: tuple) -> DataFrame:
    """(h, g) of the distinct lines that are within the edits of their class of an earlier, different line.

    ``lines`` has id, h, g, line and n for every line of every document.
    """
    met = meetings(lines, classes)
    needed = settle(met.select("h").distinct(), "needed")
    held = lines.select("id", "h", "g", "line", "n").join(_few(needed), "h", "left_semi")
    held = held.groupBy("h", "g").agg(F.min("id").alias("id"), F.any_value("line").alias("line"), F.any_value("n").alias("n"))
    texts = settle(held.withColumn("no", F.monotonically_increasing_id()), "texts")
    unsettle(needed)
    a, b = (texts.select(F.col("no").alias(s), F.struct("line", "n").alias(f"of_{s}")) for s in "xy")

    def verified(pairs: DataFrame) -> DataFrame:
        of_x, of_y = F.col("of_x"), F.col("of_y")
        return settle(pairs.distinct().join(a, "x").join(b, "y").filter(_near(of_x["line"], of_y["line"], of_x["n"], of_y["n"], classes)).select("y").distinct(), "late")

    keys = F.transform(_chosen(classes, True, False), lambda x: _key(F.col("line"), F.col("n"), x)).alias("keys")
    named = texts.select("h", F.struct("id", "no", keys, *_side(F.col("line"), F.col("n"), classes)).alias("at"))
    named = settle(met.join(named, "h").select("key", "at", "own", "owners"), "named")
    heads = named.filter("own").groupBy("key").agg(F.min("at").alias("head"))
    heads_first = F.col("head.id") < F.col("at.id")
    first, second = (F.when(heads_first, F.col(u)).otherwise(F.col(v)) for u, v in (("head", "at"), ("at", "head")))
    headed = settle(named.join(heads, "key").filter("at.no <> head.no"), "headed")
    unsettle(met, named)
    near = lambda a, b: _may_be_near(F.col(a), F.col(b))
    late = verified(headed.filter(near("at", "head")).select(first["no"].alias("x"), second["no"].alias("y")))
    blocks = F.ceil(F.col("owners") / CROWD).cast("int")
    short = F.col("at.n") < _listed_below(classes)
    asking = headed.join(late, headed["at"]["no"] == late["y"], "left_anti")
    busy = asking.filter(short & (F.col("owners") > CROWD)).groupBy("key").agg(F.count("*").alias("asks")).filter(F.col("asks") > CROWD // 8)
    busy = settle(busy.select("key", F.lit(True).alias("busy")), "busy")
    crowd = headed.filter(short).join(_few(busy), "key", "left_semi").select(F.col("at.no").alias("no")).distinct()
    listed_late = verified(_one_edit_apart(texts.join(crowd, "no")))
    sides = F.when(short & F.col("busy"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))  # short lines of a crowd meet longer ones only
    asks = asking.join(_few(busy), "key", "left").select("key", F.col("at").alias("asker"), F.col("own").alias("asker_owns"), F.explode(sides).alias("short"), blocks.alias("blocks"))
    asks = asks.select("key", "asker", "asker_owns", "short", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    before = headed.select("key", "at", "own", short.alias("short"), F.pmod(F.xxhash64("at.no"), blocks).cast("int").alias("block"))
    shared = F.array_intersect("at.keys", "asker.keys")
    once = (F.size(shared) == 0) | (F.col("key") == F.array_min(shared))  # lines that own several segments together meet under one
    more = before.join(asks, ["key", "block", "short"]).filter((F.col("own") | F.col("asker_owns")) & (F.col("at.id") < F.col("asker.id")) & near("at", "asker") & once)
    later = verified(more.select(F.col("at.no").alias("x"), F.col("asker.no").alias("y")))
    every = late.union(later).union(listed_late).distinct()
    found = settle(texts.join(every, texts["no"] == every["y"], "left_semi").select("h", "g"), "late")
    unsettle(headed, late, later, listed_late, busy, texts)
    return found


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, line, n): id is doc_id, a hash of the text and the line's number; only lines of ``least`` characters."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("parts"))
    rows = parts.select("doc", "mark", F.posexplode("parts").alias("pos", "line"))  # the text itself must not ride along with each line
    octets = F.octet_length("line")
    long_enough = (octets >= least) & ((octets >= 4 * least) | (F.length("line") >= least))  # most lines need no count of their characters
    return rows.filter(long_enough).select(F.struct("doc", "mark", "pos").alias("id"), "line", F.length("line").alias("n"))


def _few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has at most SMALL_ROWS rows (of three numbers each)."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def dedup_lines(docs: DataFrame, edits: int | tuple = 1, least: int = 32) -> DataFrame:
    """``docs`` with the kept lines as text, and two more columns, n_lines and n_removed.

    Lines are what newline characters part. Of lines with at least ``least`` characters, one stays if no line
    of all documents that is equal or within ``edits`` edits comes earlier, by doc_id and then by place; all
    others go. Shorter lines stay. Long lines are compared whole. With classes (least characters, edits) as ``edits``, lines are compared by the
    edits of the longer one's class, and from ``least`` characters up to the first class by equality alone; lines
    without anything but white space then stay. Equality is that of 128 bits of hash. A null text stays null with 0 lines;
    an empty one has one empty line. Rows that share doc_id and text are one document, rows that share only
    doc_id are ordered by a hash of the text; a null doc_id comes first. An empty table gives no rows. Other
    columns pass through; columns already named n_lines or n_removed are replaced.
    """
    classes = edits if isinstance(edits, tuple) else ((least, edits),)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = _lines(docs, least)
    if isinstance(edits, tuple):
        lines = lines.filter((F.ascii("line") > 32) | F.col("line").rlike(NOT_SPACE))
    lines = settle(lines.select("id", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(11), F.col("line")).alias("g"), "line", "n"), "lines")
    marks = lines.select("id", "h", "g")
    copied = settle(marks.groupBy("h", "g").agg(F.count("*").alias("many")).filter("many > 1").select("h", "g"), "copied")
    heads = marks.join(_few(copied), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.min("id").alias("head"))
    late = late_lines(lines, classes)
    changed = heads.join(late.withColumn("late", F.lit(True)), ["h", "g"], "full").select("h", "g", "head", F.coalesce("late", F.lit(False)).alias("late"))
    changed = settle(changed, "changed")
    unsettle(copied, late)
    gone = marks.join(_few(changed), ["h", "g"]).filter("late OR id <> head")
    doc, mark, places, own = (unused(docs, c) for c in ("of_doc", "of_text", "places", "own_text"))
    by_doc = settle(gone.groupBy(F.col("id.doc").alias(doc), F.col("id.mark").alias(mark)).agg(F.collect_set("id.pos").alias(places)), "gone")
    unsettle(lines, changed)
    whole = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64("text").alias(own))
    joined = whole.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(mark)), "left")
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(places))
    left = let(F.split("text", "\n"), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n"))
    kept = F.when(F.col(places).isNull(), F.col("text")).otherwise(left)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_removed = F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
