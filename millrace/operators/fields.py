"""Column operations with a small Python-like expression language compiled to Spark columns.

An expression names columns, or row["any name"]; it may hold constants, arithmetic, comparisons, ``in``,
and/or/not, conditional expressions, subscripts and len, str, int and float. It is compiled, never evaluated.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import RowError, truthy

_ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.FloorDiv: "//"}


class _Compiler:
    def __init__(self, df: DataFrame, source: str):
        self.df, self.source = df, source
        self.kinds = dict(df.dtypes)

    def refuse(self, why: str) -> RowError:
        return RowError(f"expression `{self.source}`: {why}")

    def kind(self, value: Column) -> str:
        return self.df.select(value.alias("v")).dtypes[0][1]

    def column(self, name: str) -> Column:
        if name not in self.kinds:
            raise self.refuse(f"unknown name {name!r}")
        return F.col(f"`{name}`")

    def truth(self, node: ast.expr) -> Column:
        value = self.value(node)
        return truthy(value, self.kind(value))

    def value(self, node: ast.expr) -> Column:
        method = getattr(self, "on_" + type(node).__name__, None)
        if method is None:
            raise self.refuse(f"{type(node).__name__} is not allowed")
        return method(node)

    def on_Constant(self, node):
        return F.lit(node.value)

    def on_Name(self, node):
        return self.column(node.id)

    def on_Subscript(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "row" and isinstance(node.slice, ast.Constant):
            return self.column(node.slice.value)
        of, kind = self.value(node.value), None
        kind = self.kind(of)
        if kind.startswith("array"):
            at = self.value(node.slice)
            return F.element_at(of, F.when(at >= 0, at + 1).otherwise(at).cast("int"))
        if kind == "string":
            at = self.value(node.slice)
            return F.substring(of, F.when(at >= 0, at + 1).otherwise(at).cast("int"), F.lit(1))
        if isinstance(node.slice, ast.Constant):
            return of[node.slice.value]
        raise self.refuse("only lists, strings, maps and structs have items")

    def on_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        if isinstance(node.op, ast.USub):
            return -self.value(node.operand)
        raise self.refuse("unknown sign")

    def on_BoolOp(self, node):
        """Operands count by their truth."""
        join = Column.__and__ if isinstance(node.op, ast.And) else Column.__or__
        return reduce(join, [self.truth(v) for v in node.values])

    def on_IfExp(self, node):
        return F.when(self.truth(node.test), self.value(node.body)).otherwise(self.value(node.orelse))

    def on_BinOp(self, node):
        a, b, sign = self.value(node.left), self.value(node.right), _ARITHMETIC.get(type(node.op))
        if sign is None:
            raise self.refuse("unknown operator")
        if sign == "+" and self.kind(a) == "string":
            return F.concat(a, b)
        if sign == "+" and self.kind(a).startswith("array"):
            return F.concat(a, b)
        if sign == "%":  # takes the divisor's sign
            return ((a % b) + b) % b
        if sign == "//":
            return F.floor(a / b)
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[sign]

    def on_Compare(self, node):
        found, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            found.append(self.compared(op, left, right))
            left = right
        return reduce(Column.__and__, found)

    def compared(self, op, left, right):
        a = self.value(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                hit = a.isin(*[self.value(x) for x in right.elts])
            else:
                b = self.value(right)
                hit = F.array_contains(b, a) if self.kind(b).startswith("array") else F.contains(b, a)
            return ~hit if isinstance(op, ast.NotIn) else hit
        b = self.value(right)
        if isinstance(op, (ast.Eq, ast.Is)):
            return a.eqNullSafe(b)
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return ~a.eqNullSafe(b)
        return {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]

    def on_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.keywords or len(node.args) != 1:
            raise self.refuse("only len, str, int and float of one value can be called")
        x, name = self.value(node.args[0]), node.func.id
        kind = self.kind(x)
        if name == "len":
            return F.length(x) if kind == "string" else F.size(x)
        if name == "str":
            return F.when(x, "True").otherwise("False") if kind == "boolean" else x.cast("string")
        if name == "int":
            return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long") if kind in ("double", "float") else x.cast("long")
        if name == "float":
            return x.cast("double")
        raise self.refuse(f"unknown function {name!r}")


def compile_expression(df: DataFrame, source: str) -> Column:
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as error:
        raise RowError(f"expression `{source}` cannot be read: {error.msg} at column {error.offset}") from error
    return _Compiler(df, source).value(tree.body)


def assignment(argument: str, flag: str) -> tuple[str, str]:
    """(name, value) of NAME=VALUE, parted at the first equals sign."""
    name, sign, value = argument.partition("=")
    if not sign or not name:
        raise RowError(f"{flag} takes NAME=VALUE, got {argument!r}")
    return name, value


def apply_fields(df: DataFrame, adds=(), removes=(), renames=(), swaps=()) -> DataFrame:
    """Columns added, then removed, then renamed, then swapped; later additions see earlier ones."""
    for name, source in adds:
        df = df.withColumn(name, compile_expression(df, source))

    def need(flag: str, *names: str) -> None:
        for name in names:
            if name not in df.columns:
                raise RowError(f"{flag}: there is no column {name!r}")

    for name in removes:
        need(f"remove {name}", name)
        df = df.drop(name)
    for old, new in renames:
        need(f"rename {old}={new}", old)
        if old != new:
            df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (old, new)], F.col(f"`{old}`").alias(new))
    for a, b in swaps:
        need(f"swap {a}={b}", a, b)
        swap = {a: b, b: a}
        df = df.select(*[F.col(f"`{swap.get(c, c)}`").alias(c) for c in df.columns])
    return df


def where(df: DataFrame, *sources: str) -> DataFrame:
    """Rows for which every expression is true in Python's sense."""
    for source in sources:
        value = compile_expression(df, source)
        df = df.filter(truthy(value, df.select(value.alias("v")).dtypes[0][1]))
    return df
