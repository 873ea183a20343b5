"""Table functions for SQL: chunks of texts, sections of Markdown, repaired lines of JSON.

Each takes a table and the names of its columns, and its result has the key's own type, so they work on any table:
``SELECT * FROM chunk_text(TABLE(documents), key => 'doc_id', text => 'text', most => 256)``. ``heal`` reads the lines of one
file in order: ``SELECT * FROM heal(TABLE(lines) PARTITION BY file ORDER BY line_no, key => 'file', number => 'line_no', line => 'line')``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from millrace.operators.chunking import chunks
from millrace.operators.repair import heal_line
from millrace.sources.markup import markdown_sections


def _named(table: AnalyzeArgument, argument: str, name: AnalyzeArgument, kinds: tuple = ()) -> StructField:
    """The column of the table that a constant argument names."""
    if not table.isTable or not isinstance(table.dataType, StructType):
        raise ValueError("the first argument is a table: TABLE(...)")
    if not name.isConstantExpression or not isinstance(name.value, str):
        raise ValueError(f"{argument} names a column of the table as a string")
    for column in table.dataType.fields:
        if column.name.lower() == name.value.lower():
            if kinds and not isinstance(column.dataType, kinds):
                raise ValueError(f"{argument}: column {column.name} is {column.dataType.simpleString()}")
            return column
    raise ValueError(f"{argument}: the table has no column {name.value}; it has {', '.join(table.dataType.names)}")


@dataclass
class Found(AnalyzeResult):
    """The result's columns, and where in a row the named columns are."""

    places: tuple[int, ...] = ()


def _result(table: AnalyzeArgument, named: list[StructField], *columns: tuple) -> Found:
    """``named``: the key and the other columns that are read."""
    schema = StructType([StructField(named[0].name, named[0].dataType), *[StructField(n, t) for n, t in columns]])
    return Found(schema, places=tuple(table.dataType.names.index(c.name) for c in named))


class ChunkText:
    """(key, chunk_no, chunk): chunks of at most ``most`` estimated tokens, in order; null and blank texts give none."""

    def __init__(self, found: Found):
        self.key, self.text = found.places

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, most: AnalyzeArgument) -> Found:
        if not most.isConstantExpression or not isinstance(most.value, int) or most.value < 1:
            raise ValueError("most is a whole number of tokens, 1 or more")
        return _result(table, [_named(table, "key", key), _named(table, "text", text, (StringType,))], ("chunk_no", LongType()), ("chunk", StringType()))

    def eval(self, row: Row, key: str, text: str, most: int) -> Iterator[tuple]:
        for n, chunk in enumerate(chunks(row[self.text] or "", most)):
            yield row[self.key], n, chunk


class MarkdownSections:
    """(key, heading, level, first_line, end_line, body) of each text's sections by its headings."""

    def __init__(self, found: Found):
        self.key, self.text = found.places

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument) -> Found:
        return _result(table, [_named(table, "key", key), _named(table, "text", text, (StringType,))], ("heading", StringType()), ("level", LongType()), ("first_line", LongType()), ("end_line", LongType()), ("body", StringType()))

    def eval(self, row: Row, key: str, text: str) -> Iterator[tuple]:
        for section in markdown_sections(row[self.text] or ""):
            yield row[self.key], *section


class Heal:
    """(key, line_no, part, line, repairs, error) of the repaired lines of each partition, which is one file in order.

    A last line that is cut off is dropped: its part is -1 and its line null. Lines wait for the next one that is not blank, since only
    then it is known that they are not the last.
    """

    def __init__(self, found: Found):
        self.key, self.number, self.line = found.places
        self.held: list[tuple] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, number: AnalyzeArgument, line: AnalyzeArgument) -> Found:
        named = [_named(table, "key", key), _named(table, "number", number, (IntegralType,)), _named(table, "line", line, (StringType,))]
        return _result(table, named, ("line_no", LongType()), ("part", LongType()), ("line", StringType()), ("repairs", ArrayType(StringType())), ("error", StringType()))

    def _healed(self, is_last: bool) -> Iterator[tuple]:
        for key, number, line in self.held:
            lines, repairs, error = heal_line(line, is_last and bool(line.strip()))
            for part, healed in list(enumerate(lines)) or [(-1, None)]:
                yield key, number, part, healed, repairs, error
        self.held = []

    def eval(self, row: Row, key: str, number: str, line: str) -> Iterator[tuple]:
        text = row[self.line] or ""
        if text.strip():
            yield from self._healed(False)
        self.held.append((row[self.key], row[self.number], text))

    def terminate(self) -> Iterator[tuple]:
        yield from self._healed(True)


#: Names in SQL.
TABLE_FUNCTIONS = {"chunk_text": ChunkText, "md_sections": MarkdownSections, "heal": Heal}


def register_tables(spark: SparkSession) -> None:
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, useArrow=False))  # with Arrow, Spark makes a batch of what each single row gives
