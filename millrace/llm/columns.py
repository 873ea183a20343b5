"""Names of columns that an operator adds for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
