"""Conversations as arrays of messages: reshapes, checks, renderings and edits, all as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import RowError

MESSAGE = "struct<role:string,content:string>"


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def gather(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(by, messages) from one row for each turn, in order."""
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))))
    return turns.groupBy(by).agg(F.transform(sorted_, lambda x: message(x["r"], x["t"])).alias("messages"))


def last_role(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))["role"]


def convertible(messages: Column) -> Column:
    """Whether the messages can become prompt and completion: each has a role and content, the last is the assistant's."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()) & (last_role(messages) == "assistant"), F.lit(False))


def to_prompt_completion(df: DataFrame, column: str = "messages") -> DataFrame:
    """``prompt`` (all but the last message) and ``completion`` (the last) in place of ``messages``."""
    if column not in df.columns:
        raise RowError(f"there is no column {column!r} to convert; rows may be converted already")
    m = F.col(column)
    return df.withColumns({"prompt": F.slice(m, F.lit(1), F.size(m) - 1), "completion": F.slice(m, F.size(m), F.lit(1))}).drop(column)


def to_messages(df: DataFrame) -> DataFrame:
    """``messages`` in place of ``prompt`` and ``completion``: two strings or two message lists."""
    kinds = dict(df.dtypes)
    if "messages" in kinds:
        raise RowError("rows have messages already")
    strings = [kinds.get(c) == "string" for c in ("prompt", "completion")]
    if any(strings) != all(strings):
        raise RowError("prompt and completion must both be text or both be messages")
    if all(strings):
        made = F.array(message("user", F.col("prompt")), message("assistant", F.col("completion")))
    else:
        made = F.concat("prompt", "completion")
    return df.withColumn("messages", made).drop("prompt", "completion")


def last_index(messages: Column, role: str) -> Column:
    """Place from 0 of the last message of a role, -1 if there is none."""
    return F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == role, i).otherwise(-1))), F.lit(-1))


def prompt_of(messages: Column) -> Column:
    """Messages up to the last user turn; null if there is none."""
    at = last_index(messages, "user")
    return F.when(at >= 0, F.slice(messages, F.lit(1), at + 1))


def completion_text(messages: Column) -> Column:
    """Content of the last assistant message, or the empty text."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"], F.lit(""))


def prompt_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def contents(messages: Column) -> Column:
    """Contents joined by newlines."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def user_key(messages: Column) -> Column:
    """Contents of the user turns, which identify a conversation whatever its system text."""
    return F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])


def with_reply(prompt: Column, reply: Column) -> Column:
    return F.concat(prompt, F.array(message("assistant", reply)))


def merge_reasoning(messages: Column, reasoning: Column) -> Column:
    """Messages of role, content and reasoning: a nonempty trace goes to the last message, which must be the only assistant's."""
    last = F.size(messages) - 1
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when((i == last) & (F.length(F.trim(reasoning)) > 0), reasoning).alias("reasoning")))


def can_merge_reasoning(messages: Column) -> Column:
    return (F.size(F.filter(messages, lambda m: m["role"] == "assistant")) == 1) & (last_role(messages) == "assistant")


def drop_before_last_user(messages: Column, roles: tuple[str, ...] = ("developer",)) -> Column:
    """Messages without those of ``roles`` that stand before the last user turn."""
    at = last_index(messages, "user")
    return F.filter(messages, lambda m, i: ~(m["role"].isin(*roles) & (i < at)))


def merge_runs(turns: DataFrame, by: str, order: str, roles: tuple[str, ...] = ("user", "tool"), role: str = "role", text: str = "text") -> DataFrame:
    """(by, block, role, n_messages, text): consecutive turns of one of ``roles`` become one block; others stay alone."""
    w = Window.partitionBy(by).orderBy(order)
    fresh = F.when((F.lag(role).over(w) == F.col(role)) & F.col(role).isin(*roles), 0).otherwise(1)
    blocks = turns.withColumn("__new", fresh).withColumn("block", F.sum("__new").over(w).cast("long"))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n")
    return blocks.groupBy(by, "block").agg(F.first(role).alias("role"), F.count("*").alias("n_messages"), pieces.alias("text"))


def order_results(calls: Column, results: Column) -> Column:
    """Tool results (structs with tool_call_id) in the order of the calls (ids) before them; unknown ones last."""
    place = lambda r: F.when(F.array_position(calls, r["tool_call_id"]) > 0, F.array_position(calls, r["tool_call_id"])).otherwise(F.lit(1 << 30))
    keyed = F.transform(results, lambda r, i: F.struct(place(r).alias("p"), i.alias("i"), r.alias("r")))
    return F.transform(F.sort_array(keyed), lambda x: x["r"])


def flatten_blocks(blocks: Column) -> Column:
    """Content blocks (structs of type and text) as one text, images as a placeholder, a blank line between."""
    shown = F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"].startswith("image"), F.lit("[image]")).otherwise(F.raise_error(F.concat(F.lit("content block of type "), b["type"]))))
    return F.array_join(shown, "\n\n")


def has_media(df: DataFrame, blocks: str | None = None) -> Column:
    """Whether a row is multimodal: media columns that hold something, or blocks that are not text."""
    found = F.lit(False)
    for name in ("image", "images", "audio", "audios", "video", "videos"):
        if name in df.columns:
            found = found | F.col(name).isNotNull()
    return found | F.exists(blocks, lambda b: b["type"] != "text") if blocks else found


def shape_of(columns: list[str]) -> str:
    """What kind of rows have these columns."""
    names = set(columns)
    if names & {"input_ids", "chosen_ids", "chosen_input_ids"}:
        return "pretokenized"
    return "conversational" if names & {"messages", "chosen", "conversations"} else "plain_text"


#: Column sets by row format; a set of rows passes if it has all columns of one alternative.
FORMATS = {
    "language_modeling": (("text",), ("messages",), ("prompt", "completion")),
    "preference": (("prompt", "chosen", "rejected"), ("chosen", "rejected")),
    "unpaired_preference": (("prompt", "completion", "label"),),
    "prompt_only": (("prompt",),),
}


def check_format(df: DataFrame, kind: str) -> None:
    if not any(set(a) <= set(df.columns) for a in FORMATS[kind]):
        raise RowError(f"{kind} rows need {' or '.join('+'.join(a) for a in FORMATS[kind])}; found {sorted(df.columns)}")


_FIELD = re.compile(r"\{([A-Za-z_]\w*)\}")
_BLOCK = re.compile(r"\[\[(.*?)\]\]", re.DOTALL)


def check_template(template: str, required: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> None:
    if not template.strip():
        raise RowError("the template is empty")
    marks = re.findall(r"\[\[|\]\]", template)
    if marks != ["[[", "]]"] * (len(marks) // 2):
        raise RowError("optional blocks must be closed and not nested")
    names = set(_FIELD.findall(template))
    wrong = [f"missing {n}" for n in sorted(set(required) - names)] + [f"unknown {n}" for n in sorted(names - set(required) - set(allowed))]
    if wrong:
        raise RowError("template placeholders: " + ", ".join(wrong))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """The template with columns in place of {names}, in one pass; an optional [[block]] goes if a field in it is null.

    Unknown names stay as written, and braces in the data are never read as fields.
    """

    def pieces(text: str, keep_unknown: bool = True) -> list[Column]:
        out, at = [], 0
        for m in _FIELD.finditer(text):
            out.append(F.lit(text[at : m.start()]))
            out.append(F.coalesce(values[m[1]].cast("string"), F.lit("None")) if m[1] in values else F.lit(m[0]))
            at = m.end()
        return [*out, F.lit(text[at:])]

    parts, at = [], 0
    for block in _BLOCK.finditer(template):
        parts += pieces(template[at : block.start()])
        absent = F.lit(False)
        for name in _FIELD.findall(block[1]):
            absent = absent | (values[name].isNull() if name in values else F.lit(True))
        parts.append(F.when(absent, F.lit("")).otherwise(F.concat(*pieces(block[1]))))
        at = block.end()
    return F.concat(*parts, *pieces(template[at:]))


def generation_prompt(messages: Column, instructions: Column) -> Column:
    """The instructions after a last user turn, or as a user turn of their own; none if they are empty."""
    n = F.size(messages)
    asked = F.transform(messages, lambda m, i: F.when(i == n - 1, message(m["role"], F.concat(m["content"], F.lit("\n\n"), instructions))).otherwise(message(m["role"], m["content"])))
    added = F.concat(F.transform(messages, lambda m: message(m["role"], m["content"])), F.array(message("user", instructions)))
    return F.when(F.length(F.coalesce(instructions, F.lit(""))) == 0, F.transform(messages, lambda m: message(m["role"], m["content"]))).when(last_role(messages) == "user", asked).otherwise(added)


def insert_at(messages: Column, index: Column, new: Column) -> Column:
    """``new`` (an array of messages) at a place from 0 through the length; null outside."""
    n = F.size(messages)
    made = F.concat(F.slice(messages, F.lit(1), F.greatest(index, F.lit(0))), new, F.slice(messages, F.greatest(index, F.lit(0)) + 1, F.greatest(n - index, F.lit(0))))
    return F.when((index >= 0) & (index <= n), made)


def remove_range(messages: Column, index: Column, count: Column) -> Column:
    """Messages without ``count`` from ``index``; null if the range is empty or leaves the array."""
    return F.when((index >= 0) & (count > 0) & (index + count <= F.size(messages)), F.filter(messages, lambda m, i: (i < index) | (i >= index + count)))


def move_range(messages: Column, index: Column, count: Column, to: Column) -> Column:
    """A range moved; ``to`` counts in what is left after its removal."""
    moving = F.when((index >= 0) & (count > 0) & (index + count <= F.size(messages)), F.slice(messages, F.greatest(index, F.lit(0)) + 1, F.greatest(count, F.lit(0))))
    return insert_at(remove_range(messages, index, count), to, moving)


def replace_content(messages: Column, index: Column, content: Column) -> Column:
    made = F.transform(messages, lambda m, i: F.when(i == index, m.withField("content", content)).otherwise(m))
    return F.when((index >= 0) & (index < F.size(messages)), made)


def show_range(messages: Column, index: Column, count: Column) -> Column:
    return F.when((index >= 0) & (count > 0) & (index + count <= F.size(messages)), F.slice(messages, F.greatest(index, F.lit(0)) + 1, F.greatest(count, F.lit(0))))


def next_call_id(used: Column) -> Column:
    """The first free call_NNNN, used being an array of ids."""
    free = F.array_except(F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda i: F.concat(F.lit("call_"), F.lpad(i.cast("string"), 4, "0"))), used)
    return F.array_min(free)


def outline(df: DataFrame, *keys: str, column: str = "messages", preview: int = 40) -> DataFrame:
    """One row for each message: index, role, content_type, characters, preview."""
    rows = df.select(*keys, F.posexplode(column).alias("index", "m"))
    kind = F.when(F.col("m.content").isNull(), "null").otherwise("string")
    return rows.select(*keys, F.col("index").cast("long").alias("index"), F.coalesce("m.role", F.lit("<missing>")).alias("role"), kind.alias("content_type"), F.length("m.content").cast("long").alias("characters"), F.substring("m.content", 1, preview).alias("preview"))


def context_errors(df: DataFrame, *keys: str, column: str = "messages") -> DataFrame:
    """(keys, index, error) of the first fault of each conversation with tool calls.

    Messages are structs of role, content, tool_calls (array of struct id, type, name, arguments) and
    tool_call_id. Calls must be the assistant's, of type function, with a name, JSON object arguments and an id
    of their own; each is answered once, after it and before any other turn.
    """
    step_type = "struct<declared:array<string>,pending:array<string>,done:array<string>,error:string,at:int>"
    empty = F.lit(None).cast("array<string>")
    start = F.struct(F.coalesce(empty, F.array().cast("array<string>")).alias("declared"), F.array().cast("array<string>").alias("pending"), F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("at")).cast(step_type)

    def advance(s: Column, m: Column) -> Column:
        ids = F.coalesce(F.transform(m["tool_calls"], lambda c: c["id"]), F.array().cast("array<string>"))
        has = m["tool_calls"].isNotNull()
        answer = m["tool_call_id"]
        badly = F.exists(F.coalesce(m["tool_calls"], F.array().cast(_CALLS)), lambda c: F.coalesce((c["type"] != "function") | (F.length(c["name"]) == 0), F.lit(True)))
        args = F.exists(F.coalesce(m["tool_calls"], F.array().cast(_CALLS)), lambda c: F.coalesce(~F.trim(c["arguments"]).startswith("{"), F.lit(True)) | F.try_parse_json(c["arguments"]).isNull())
        error = (
            F.when((m["role"] == "tool") & has, "a tool result declares calls")
            .when((m["role"] == "tool") & F.coalesce(F.length(answer) == 0, F.lit(True)), "a tool result names no call")
            .when((m["role"] == "tool") & F.array_contains(s["done"], answer), "the call has a result already")
            .when((m["role"] == "tool") & ~F.array_contains(s["pending"], answer), "the result answers no pending call")
            .when((m["role"] != "tool") & answer.isNotNull(), "only tool results name a call")
            .when((m["role"] != "tool") & (F.size(s["pending"]) > 0), "calls wait for their results")
            .when(has & (m["role"] != "assistant"), "only the assistant calls tools")
            .when(has & (F.size(ids) == 0), "the list of calls is empty")
            .when(F.exists(ids, lambda x: F.coalesce(F.length(x) == 0, F.lit(True))), "a call has no id")
            .when((F.size(F.array_distinct(ids)) < F.size(ids)) | F.arrays_overlap(ids, s["declared"]), "a call id is used twice")
            .when(badly, "a call is not a named function")
            .when(args, "arguments are not a JSON object")
        )
        tool = m["role"] == "tool"
        moved = F.struct(
            F.concat(s["declared"], ids).alias("declared"),
            F.when(tool, F.array_remove(s["pending"], F.coalesce(answer, F.lit("")))).otherwise(F.concat(s["pending"], ids)).alias("pending"),
            F.when(tool, F.concat(s["done"], F.array(answer))).otherwise(s["done"]).alias("done"),
            error.alias("error"),
            F.when(error.isNull(), s["at"] + 1).otherwise(s["at"]).alias("at"),
        ).cast(step_type)
        return F.when(s["error"].isNotNull(), s).otherwise(moved)

    end = F.aggregate(column, start, advance)
    found = df.select(*keys, end.alias("e")).select(*keys, F.col("e.at").cast("long").alias("index"), F.coalesce("e.error", F.when(F.size("e.pending") > 0, "calls lack results")).alias("error"))
    return found.filter("error IS NOT NULL")


_CALLS = "array<struct<id:string,type:string,name:string,arguments:string>>"
TOOL_MESSAGE = f"struct<role:string,content:string,tool_calls:{_CALLS},tool_call_id:string>"


def attach_tools(messages: Column, schema: Column) -> Column:
    """Tool schemas, as text, after the first system message, or as a system message of their own in front."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "system")
    added = F.transform(messages, lambda m, i: F.when(i == first - 1, message(m["role"], F.concat(m["content"], F.lit("\n\n"), schema))).otherwise(message(m["role"], m["content"])))
    return F.when(first > 0, added).otherwise(F.concat(F.array(message("system", schema)), F.transform(messages, lambda m: message(m["role"], m["content"]))))
