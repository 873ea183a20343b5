"""Deterministic rewards of completions, as column expressions where Spark has the semantics."""

from __future__ import annotations

import difflib
import json
import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalised(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return F.trim(F.regexp_replace(bare, _SPACE, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts (not an edit distance)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def reference_match(text: Column, reference: Column, mode: str, threshold: float | None = None) -> Column:
    got, want = normalised(text), normalised(reference.cast("string"))
    if mode == "equals":
        hit = got == want
    elif mode == "contains":
        hit = F.contains(got, want)
    elif mode == "fuzzy" and threshold is not None:
        hit = similarity(got, want) >= threshold
    else:
        raise ValueError(f"mode is equals, contains, or fuzzy with a threshold; got {mode!r}")
    return F.when(hit, 1.0).otherwise(0.0)


def regex(text: Column, pattern: str, group: int | None = None, reference: Column | None = None) -> Column:
    """1 if the pattern is found; with a group, if that group equals the reference after normalisation.

    Patterns that Java reads otherwise than Python (conditionals, named groups of Python's form) go to Python.
    """
    if (group is None) != (reference is None):
        raise ValueError("give a group and a reference together")
    re.compile(pattern, re.DOTALL)
    if re.search(r"\(\?P|\(\?\(|\\Z|\\[wdsb]", pattern):

        @F.pandas_udf("string")
        def found(texts: pd.Series) -> pd.Series:
            compiled = re.compile(pattern, re.DOTALL)
            hits = [compiled.search(t or "") for t in texts]
            return pd.Series([None if m is None else (m[group or 0] or "") for m in hits])

        hit = found(text)
    else:
        hit = F.when(text.rlike(f"(?s){pattern}"), F.regexp_extract(text, f"(?s){pattern}", group or 0))
    if group is None:
        return F.when(hit.isNotNull(), 1.0).otherwise(0.0)
    return F.when(normalised(hit) == normalised(reference.cast("string")), 1.0).otherwise(0.0)


def phrases(text: Column, required: list[str] = (), forbidden: list[str] = ()) -> Column:
    """Share of required phrases present less the share of forbidden ones, in any case."""
    if not required and not forbidden:
        raise ValueError("give required or forbidden phrases")

    def share(listed: list[str]) -> Column:
        if not listed:
            return F.lit(0.0)
        hits = [F.when(F.contains(F.lower(text), F.lit(p.lower())), 1).otherwise(0) for p in listed]
        return sum(hits[1:], hits[0]) / F.lit(float(len(listed)))

    return share(list(required)) - share(list(forbidden))


def length_window(n: Column, low: int, high: int) -> Column:
    """1 inside [low, high], falling to 0 one width away."""
    away = F.when(n < low, low - n).when(n > high, n - high).otherwise(0)
    return F.greatest(F.lit(0.0), 1.0 - away / F.lit(float(high - low)))


def json_valid(text: Column, keys: list[str] = ()) -> Column:
    """1 if the whole text is JSON, as Python reads it, and an object with all ``keys``."""

    @F.pandas_udf("double")
    def valid(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float:
            try:
                value = json.loads((t or "").strip())
            except (ValueError, RecursionError):
                return 0.0
            return float(not keys or isinstance(value, dict) and all(k in value for k in keys))

        return pd.Series([one(t) for t in texts])

    return valid(text)


def judged(reply: Column) -> Column:
    """The first number in a judge's reply, 0 without one."""
    number = F.regexp_extract(reply, r"-?\d+(?:\.\d+)?", 0)
    return F.when(number == "", 0.0).otherwise(number.try_cast("double"))


BUILT_IN = {"reference_match": reference_match, "regex": regex, "phrases": phrases, "length_window": length_window, "json_valid": json_valid}


def resolve(name: str):
    """A reward by name: built in, ``module:function``, or ``path.py:function``."""
    if name in BUILT_IN:
        return BUILT_IN[name]
    place, _, function = name.rpartition(":")
    if not place:
        raise ValueError(f"unknown reward {name!r}; built in are {', '.join(BUILT_IN)}")
    if place.endswith(".py"):
        import importlib.util

        spec = importlib.util.spec_from_file_location("user_reward", place)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        import importlib

        module = importlib.import_module(place)
    return getattr(module, function)


def repeated_trigrams(text: Column) -> Column:
    """Share of 3-word windows that repeat an earlier one; 0 with fewer than three words."""
    from millrace.functions.lets import let

    def share(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.array_join(F.slice(w, i + 1, F.lit(3)), " "))
        return F.when(F.size(w) >= 3, let(grams, lambda g: 1.0 - F.size(F.array_distinct(g)) / F.size(g))).otherwise(0.0)

    return let(words(text), share)


def _numbered(tokens: Column) -> Column:
    """The tokens that are not null, each with the number of its occurrence, so that equal multisets are equal sets."""
    from millrace.functions.lets import let

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def spread(at: Column) -> Column:
            one = lambda start, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, j + 1), F.size(s)) - start), lambda k: F.concat(F.get(s, start), F.lit(" "), k.cast("string")))
            return F.flatten(F.transform(at, one))

        return F.when(F.size(s) > 0, let(starts, spread)).otherwise(F.array().cast("array<string>"))

    return let(F.array_sort(F.filter(tokens, lambda t: t.isNotNull())), runs)


def token_f1(got: Column, want: Column) -> Column:
    """F1 over words as multisets, by one sort of each list; two empty lists agree."""
    return counted_f1(counted(got), counted(want))


def counted(tokens: Column) -> Column:
    """struct(n, set): what token_f1() needs of a list, for lists that are compared more than once."""
    return F.struct(F.size(tokens).alias("n"), F.when(F.size(tokens) > 0, _numbered(tokens)).alias("set"))


def counted_f1(got: Column, want: Column) -> Column:
    """token_f1() of two lists by their counted()."""
    n, m = got["n"], want["n"]
    shared = F.size(F.array_intersect(got["set"], want["set"]))
    return F.when((n == 0) | (m == 0), F.when(n == m, 1.0).otherwise(0.0)).otherwise(2.0 * shared / (n + m))
