"""Quality rules: one table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import unused

# The ASCII white space that ends a word, and the symbols that are counted.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, Spanish, German and French.
STOP_WORDS = (
    "the of and to in is that was it for on with as be by at from this are or an not "
    "de la que el en y los del se las por un para con no una su al lo "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine "
    "le les et des du est une dans qui pour au il sur ne pas"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= measure <= high``; a missing bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word but for line_repeats, which is per line with a word.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_words_per_word", 0.02, None),
    Rule("line_repeats", None, 0.5),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, each word once."""
    last = F.size(words) - 3
    at = lambda i, k: F.get(words, i + k)

    def exact(_: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("g"), i.alias("i"))))

        def covered(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])
            starts = F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.get(s, k - 1)["g"] == x["g"], F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
            places = F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(places)).cast("long")

        return let(windows, covered)

    # Windows whose hashes all differ all differ; only the other texts need the sort of whole windows.
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0).cast("long")))
    return F.when(last >= 1, some).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of counts of the text; null counts as the empty text.

    n_words, word_chars (code points), n_symbols, n_lines (lines with a word), n_dup_lines (such lines
    equal to an earlier one), n_repeat_words, n_stop_words. Without a word every count but n_symbols is 0.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    stops = F.lit(0).cast("long")
    by_word = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, stops, lambda n, x: n + F.length(x)).alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return let(
        F.struct(by_word.alias("w"), by_line.alias("l"), symbols.alias("s")),
        lambda m: F.struct(m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["s"].alias("n_symbols"), m["l"]["n_lines"].alias("n_lines"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"), m["w"]["n_stop_words"].alias("n_stop_words")),
    )


def _ratio(of: Column, to: Column) -> Column:
    return F.coalesce(F.try_divide(of.cast("double"), to.cast("double")), F.lit(0.0))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measured struct fails, in the table's order."""
    value = {
        "mean_word_chars": _ratio(m["word_chars"], m["n_words"]),
        "symbols_per_word": _ratio(m["n_symbols"], m["n_words"]),
        "stop_words_per_word": _ratio(m["n_stop_words"], m["n_words"]),
        "line_repeats": _ratio(m["n_dup_lines"], m["n_lines"]),
    }
    fails = []
    for rule in rules:
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value[rule.measure] < rule.low)
        if rule.high is not None:
            out = out | (value[rule.measure] > rule.high)
        fails.append(F.when(out, F.lit(rule.measure)))
    return F.array_compact(F.array(*fails))


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``into``: the measures, base_failed, failed (rule names), kept.

    Null and empty texts have no words and fail the base rule. Every row is judged alone, so repeated rows
    repeat their verdict; an empty table stays empty; other columns pass through, and a column already
    named ``into`` is replaced.
    """
    judged = let(
        measures(F.col(f"`{text}`")),
        lambda m: F.struct(m.alias("m"), ((m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])).alias("base_failed"), verdict(m, rules).alias("failed")),
    )
    flat = let(judged, lambda q: F.struct(q["m"].alias("m"), q["base_failed"].alias("base_failed"), q["failed"].alias("failed"), (~q["base_failed"] & (F.size(q["failed"]) == 0)).alias("kept")))
    return docs.withColumn(into, flat)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    mark = unused(docs, "quality")
    return assess(docs, rules, into=mark).filter(F.col(mark)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
