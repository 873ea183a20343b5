"""Ordered requests to a language-model endpoint, and the pipelines built on them.

A client is any picklable callable that takes a list of messages and returns a reply mapping with ``content``
and perhaps ``reasoning`` or ``reasoning_content``. There is no network client here by default.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import chunking, messages, series
from millrace.operators.rows import RowError
from millrace.session import settle

# Statuses worth another try.
RETRIED = (429, 500, 502, 503, 504)


class EndpointError(RuntimeError):
    def __init__(self, why: str, status: int | None = None):
        super().__init__(why)
        self.status = status


def with_retries(client: Callable, tries: int, pause: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Callable:
    """``client`` tried again after connection faults, malformed replies and retried statuses, with doubled pauses."""

    def call(request):
        for k in range(tries + 1):
            try:
                return client(request)
            except EndpointError as error:
                if error.status is not None and error.status not in RETRIED or k == tries:
                    raise
            except (ConnectionError, TimeoutError, json.JSONDecodeError):
                if k == tries:
                    raise
            wait(pause * 2**k)

    return call


def redacted(text: str, *secrets: str) -> str:
    for secret in filter(None, secrets):
        text = text.replace(secret, "[redacted]")
    return text


def complete(df: DataFrame, key: str, request: str, client: Callable, concurrency: int = 4) -> DataFrame:
    """(key, content, reasoning): one reply for each row, its request being JSON text of messages.

    Requests of a partition run in a pool; the first failure ends the task. The replies are written down, so
    that later steps never repeat a paid request.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                replies = list(pool.map(lambda r: client(json.loads(r)), batch.column(request).to_pylist()))
                thought = [r.get("reasoning") or r.get("reasoning_content") for r in replies]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([r.get("content") for r in replies], pa.string()), pa.array(thought, pa.string())], [key, "content", "reasoning"])

    kind = df.schema[key].dataType.simpleString()
    return settle(df.select(key, request).mapInArrow(run, f"`{key}` {kind}, content string, reasoning string"), "replies")


def complete_raw(df: DataFrame, key: str, request: str, client: Callable, concurrency: int = 4) -> DataFrame:
    """(key, body): the raw text of each reply, written down before anything parses it. ``client`` returns that text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                bodies = list(pool.map(lambda r: client(json.loads(r)), batch.column(request).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(bodies, pa.string())], [key, "body"])

    kind = df.schema[key].dataType.simpleString()
    return settle(df.select(key, request).mapInArrow(run, f"`{key}` {kind}, body string"), "bodies")


def parsed_bodies(bodies: DataFrame, key: str) -> DataFrame:
    """(key, content, reasoning, fault) of raw bodies; a body that is no JSON or holds no text has a fault and stays where it was written."""
    fields = bodies.select(key, reply_fields(F.col("body")).alias("r"), F.try_parse_json("body").isNull().alias("bad"))
    blank = F.length(F.trim(F.coalesce("r.content", F.lit("")))) == 0
    return fields.select(key, "r.content", "r.reasoning", F.when(F.col("bad"), "not JSON").when(blank, "no text").alias("fault"))


# The sampling settings that a request may carry, with the least and the greatest value of each.
SAMPLING = {"temperature": (0, None), "top_p": (0, 1), "top_k": (-1, None), "max_tokens": (1, None), "presence_penalty": (None, None), "repetition_penalty": (0, None)}


def generate(client: Callable, user: str, system: str = "", context: list[dict] = (), **sampling) -> dict:
    """answer and reasoning of one request; ``client`` takes the messages and the sampling settings."""
    if not user.strip():
        raise RowError("the user prompt is blank")
    for name, value in sampling.items():
        if name not in SAMPLING:
            raise RowError(f"{name} is no sampling setting; use {', '.join(SAMPLING)}")
        low, high = SAMPLING[name]
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or low is not None and value < low or high is not None and value > high or name == "repetition_penalty" and value == 0):
            raise RowError(f"{name} may not be {value!r}")
    turns = [{"role": "system", "content": system}] * bool(system) + [*context, {"role": "user", "content": user}]
    reply = client(turns, **{k: v for k, v in sampling.items() if v is not None})
    return {"answer": reply.get("content"), "reasoning": reply.get("reasoning") or reply.get("reasoning_content")}


def user_request(text: Column) -> Column:
    return F.to_json(F.array(messages.message("user", text)))


def reply_fields(body: Column) -> Column:
    """struct(content, reasoning) of a raw response body in either spelling."""
    at = lambda field: F.get_json_object(body, f"$.choices[0].message.{field}")
    return F.struct(at("content").alias("content"), F.coalesce(at("reasoning"), at("reasoning_content")).alias("reasoning"))


def chat_rows(df: DataFrame, key: str, text: str, most: int, n: int, asker: Callable, answerer: Callable, question_prompt: str, answer_prompt: str, evaluation: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): chunks give questions, new ones give answers, and each answer a conversation.

    rows: key, chunk_no, question_no, question, answer, reasoning, evaluation (the last ``evaluation`` kept questions of a
    chunk). Questions repeat only once over all chunks, the first in order. skipped: (key, chunk_no, why).
    """
    if not 0 <= evaluation < n:
        raise RowError("evaluation questions are fewer than questions")
    chunks = chunking.chunk_texts(df, key, text, most).withColumn("__id", F.concat_ws("/", key, "chunk_no"))
    chunks = settle(chunks, "chunks")
    asked = chunks.withColumn("request", user_request(messages.fill_template(question_prompt, {"n": F.lit(n), "chunk": F.col("chunk")})))
    replies = complete(asked, "__id", "request", asker)
    listed = chunks.join(replies, "__id").withColumn("q", chunking.questions(F.col("content"), n))
    each = listed.select("__id", key, "chunk_no", "chunk", F.posexplode("q").alias("question_no", "question"))
    firsts = series.reserve_last(series.first_occurrences(each, "question", key, "chunk_no", "question_no"), "__id", "question_no", evaluation)
    firsts = settle(firsts.withColumn("__q", F.concat_ws("/", "__id", "question_no")), "questions")
    wanted = firsts.withColumn("request", user_request(messages.fill_template(answer_prompt, {"chunk": F.col("chunk"), "question": F.col("question")})))
    answers = complete(wanted, "__q", "request", answerer)
    rows = firsts.join(answers, "__q").select(key, "chunk_no", "question_no", "question", F.col("content").alias("answer"), "reasoning", "evaluation")
    none = listed.filter(F.size("q") == 0).select(key, "chunk_no", F.lit("no questions parsed").alias("why"))
    again = each.join(firsts.select("__id", "question_no"), ["__id", "question_no"], "left_anti").select(key, "chunk_no", F.concat(F.lit("duplicate question: "), F.col("question")).alias("why"))
    blank = rows.filter(F.length(F.trim(F.coalesce("answer", F.lit("")))) == 0).select(key, "chunk_no", F.concat(F.lit("empty answer: "), F.col("question")).alias("why"))
    return rows.filter(F.length(F.trim(F.coalesce("answer", F.lit("")))) > 0), none.union(again).union(blank)


def summaries(df: DataFrame, key: str, text: str, client: Callable, prompt: str) -> DataFrame:
    """(key, content, reasoning): one reply for each row or none at all: a row without reply is an error."""
    if df.filter(F.col(text).isNull() | (F.length(F.trim(text)) == 0)).limit(1).count():
        raise RowError("a row has no text to summarise; nothing was requested")
    out = complete(df.withColumn("request", user_request(messages.fill_template(prompt, {"text": F.col(text)}))), key, "request", client)
    if out.filter(F.col("content").isNull() | (F.length(F.trim("content")) == 0)).limit(1).count():
        raise RowError("a reply was empty")
    return out


def replay_rows(df: DataFrame, key: str, client: Callable, column: str = "messages") -> DataFrame:
    """(key, messages): prompts up to the last user turn with a fresh reply."""
    prompts = df.withColumn("prompt", messages.prompt_of(F.col(column))).filter("prompt IS NOT NULL")
    replies = complete(prompts.withColumn("request", F.to_json("prompt")), key, "request", client)
    return prompts.join(replies, key).select(key, messages.with_reply(F.col("prompt"), F.col("content")).alias("messages"))
