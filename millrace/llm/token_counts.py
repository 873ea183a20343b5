"""Token counts of documents by a compiled finite-state transducer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.arrow_docs import bounded_batches, frugal, slices, utf8
from millrace.llm.bpe_automaton import TokenCounter
from millrace.llm.lockstep import LANES_BYTES


@lru_cache(2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Counts equal the tokenizer library's for the file ``tokenizer`` without added begin or end tokens; its
    special strings inside a text count as one token each. Null and empty texts have 0. Rows repeat as they
    do in the input, and keys are passed on as they are, null included. Texts are read whole; words of more than
    LONGEST_WORD bytes are counted by the library's model. Other columns are not read.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in slices(batches, text, LANES_BYTES):
            raw = utf8(batch.column(text))
            counts = counter.count([x.decode("utf-8", "replace") for x in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([len(x) for x in raw], pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
