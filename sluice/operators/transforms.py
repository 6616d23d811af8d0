"""Row transforms from raw source rows to chat or text records.

Each transform takes a DataFrame and options and returns it with a column `messages`
(array of role and content) or `text`; rows it rejects have null there and `accepted` drops them.
Columns that a source lacks count as null.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import first_truthy, is_blank, strip

Transform = Callable[..., DataFrame]
TRANSFORMS: dict[str, Transform] = {}

MESSAGES = "array<struct<role:string,content:string>>"
#: The roles that turns may name, by what they become.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "system": "system"}

#: What prompts say besides the rows' own texts.
ENDING_PROMPT = "Choose the ending that best continues the passage.\n\n"
CHOICE_PROMPT = "\n\nAnswer with the letter only."
TOOLS_PROMPT = "You have access to the following tools:\n"
#: The names that source configurations use, by the transform they mean.
CONFIGURED = {
    "fineweb2_text": "scored_text", "messages_passthrough": "messages", "conversations_sharegpt": "sharegpt", "conversations_humanassistant": "human_assistant", "instruction_io": "instruction",
    "mmlu_mc": "multiple_choice", "hellaswag_mc": "best_ending", "glaive_chat": "marked_chat", "xlam_function_call": "function_call", "the_cauldron": "image_pairs", "vl_image_qa": "image_question",
}


def transform(name: str) -> Callable[[Transform], Transform]:
    """Register a transform under its name."""

    def add(f: Transform) -> Transform:
        TRANSFORMS[name] = f
        return f

    return add


def apply(name: str, df: DataFrame, **options) -> DataFrame:
    """Run the named transform and drop what it rejects; an unknown name raises KeyError."""
    out = TRANSFORMS[CONFIGURED.get(name, name)](df, **options)
    return out.where(F.col("messages").isNotNull() if "messages" in out.columns else F.col("text").isNotNull())


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a null of `kind` where the source has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def normalised(turns: Column, role: str = "role", content: str = "content") -> Column:
    """Messages with known roles and content that isn't blank; null unless an assistant speaks."""
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    clean = F.filter(
        F.transform(turns, lambda t: F.struct(F.try_element_at(known, t[role]).alias("role"), strip(t[content]).alias("content"))),
        lambda m: m["role"].isNotNull() & m["content"].isNotNull() & (m["content"] != ""),
    )
    return F.when(F.exists(clean, lambda m: m["role"] == "assistant"), clean)


@transform("plain_text")
def plain_text(df: DataFrame, text_field: str = "text") -> DataFrame:
    """Stripped text of a field; blank text is rejected."""
    text = column(df, text_field)
    return df.withColumn("text", F.when(~is_blank(text), strip(text)))


@transform("scored_text")
def scored_text(df: DataFrame, text_field: str = "text", score_field: str = "language_score", least: float = 0.85) -> DataFrame:
    """As plain_text, but rows whose score is known and below `least` are rejected."""
    score = column(df, score_field, "double")
    return plain_text(df, text_field).withColumn("text", F.when(score.isNull() | (score >= least), F.col("text")))


@transform("messages")
def messages_passthrough(df: DataFrame, messages_field: str = "messages") -> DataFrame:
    return df.withColumn("messages", normalised(F.col(messages_field)))


def _literal_turns(texts: Column) -> Column:
    """Turns written as a Python literal; null where they can't be read."""

    def read(text):
        try:
            return [{"from": t.get("from") or t.get("role"), "value": t.get("value") or t.get("content")} for t in ast.literal_eval(text)]
        except (ValueError, SyntaxError, AttributeError, TypeError):
            return None

    @F.pandas_udf("array<struct<from:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([read(t) if isinstance(t, str) else None for t in texts])

    return run(texts)


@transform("sharegpt")
def conversations_sharegpt(df: DataFrame) -> DataFrame:
    """Turns of from and value: an array, or a string with JSON (single quotes allowed) or a literal."""
    name = "conversations" if "conversations" in df.columns else "conversation"
    turns = F.col(name)
    if dict(df.dtypes)[name] == "string":
        parsed = F.from_json(F.translate(turns, "'", '"'), "array<struct<from:string,value:string>>")
        # a text that isn't valid JSON may still be a literal
        turns = F.when(F.try_parse_json(F.translate(turns, "'", '"')).isNotNull(), parsed).otherwise(_literal_turns(turns))
    return df.withColumn("messages", normalised(turns, "from", "value"))


@transform("human_assistant")
def conversations_pairs(df: DataFrame, field: str = "conversations") -> DataFrame:
    """Pairs of human (or user) and assistant (or gpt, bot), in order."""
    has = {f.name for f in df.schema[field].dataType.elementType.fields}
    pick = lambda t, names: first_truthy(*(t[n] for n in names if n in has))
    flat = F.flatten(F.transform(F.col(field), lambda t: F.array(message("user", pick(t, ("human", "user"))), message("assistant", pick(t, ("assistant", "gpt", "bot"))))))
    return df.withColumn("messages", normalised(flat))


@transform("instruction")
def instruction_io(df: DataFrame) -> DataFrame:
    """Instruction and output under any of their usual names, the input appended after a blank line."""
    ask = strip(first_truthy(*(column(df, c) for c in ("instruction", "question", "prompt", "query"))))
    answer = strip(first_truthy(*(column(df, c) for c in ("output", "response", "answer"))))
    more = strip(first_truthy(column(df, "input"), column(df, "context")))
    user = F.when(F.coalesce(more, F.lit("")) != "", F.concat(ask, F.lit("\n\n"), more)).otherwise(ask)
    return df.withColumn("messages", F.when((ask != "") & (answer != ""), F.array(message("user", user), message("assistant", answer))))


def _choices(head: Column, choices: Column, place: Column, letters: str) -> Column:
    letter = lambda i: F.substring(F.lit(letters), i + 1, F.lit(1))
    body = F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), F.coalesce(c, F.lit("None")))), "\n")
    user = F.concat(head, F.lit("\n\n"), body, F.lit(CHOICE_PROMPT))
    fits = (place >= 0) & (place < F.size(choices)) & (F.size(choices) <= len(letters))
    return F.when(fits, F.array(message("user", user), message("assistant", letter(place))))


@transform("multiple_choice")
def multiple_choice(df: DataFrame) -> DataFrame:
    """Question, two to eight choices and the answer's index, also inside a struct `train`."""
    inside = "train" in df.columns and dict(df.dtypes)["train"].startswith("struct")
    get = lambda c: F.coalesce(F.col(f"train.{c}"), column(df, c, "array<string>" if c == "choices" else "string")) if inside else F.col(c)
    choices = get("choices")
    return df.withColumn("messages", F.when(F.size(choices) >= 2, _choices(strip(get("question")), choices, get("answer").cast("int"), "ABCDEFGH")))


@transform("best_ending")
def best_ending(df: DataFrame) -> DataFrame:
    """A passage, up to four endings and the right one's index as text."""
    head = F.concat(F.lit(ENDING_PROMPT), strip(F.col("ctx")))
    endings = _literal_strings(F.col("endings")) if dict(df.dtypes)["endings"] == "string" else F.col("endings")
    return df.withColumn("messages", _choices(head, endings, F.expr("try_cast(label as int)"), "ABCD"))


def _literal_strings(texts: Column) -> Column:
    """A list of strings written as a Python literal; null where it can't be read."""

    def read(text):
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError):
            return None
        return [str(x) for x in value] if isinstance(value, list) else None

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([read(t) if isinstance(t, str) else None for t in texts])

    return run(texts)


@transform("marked_chat")
def marked_chat(df: DataFrame) -> DataFrame:
    """One string with USER:, ASSISTANT: and FUNCTION RESPONSE: parts between two blank lines."""
    end = "<|endoftext|>"

    def body(part: Column, marker: str) -> Column:
        text = strip(F.substring(part, len(marker) + 1, 1 << 30))
        return F.when(text.endswith(end), F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - len(end)), r"(?U)[\s\x1c-\x1f]+$", "")).otherwise(text)

    def turn(part: Column) -> Column:
        reply = body(part, "FUNCTION RESPONSE:")
        return (
            F.when(part.startswith("USER:"), message("user", body(part, "USER:")))
            .when(part.startswith("ASSISTANT:"), message("assistant", body(part, "ASSISTANT:")))
            .when(part.startswith("FUNCTION RESPONSE:") & (reply != ""), message("user", F.concat(F.lit("FUNCTION RESPONSE: "), reply)))
        )

    system = strip(column(df, "system"))
    system = F.when(system.startswith("SYSTEM:"), strip(F.substring(system, 8, 1 << 30))).otherwise(system)
    turns = F.filter(F.transform(F.split("chat", "\n\n\n"), lambda p: turn(strip(p))), lambda t: t.isNotNull())
    return df.withColumn("messages", F.when(~is_blank(F.col("chat")), normalised(F.concat(F.array(message("system", system)), turns))))


def _spaced_json(texts: Column) -> Column:
    """A JSON list written anew with a space after commas and colons; null for anything else."""

    def dump(text):
        try:
            value = json.loads(text)
        except (ValueError, TypeError):
            return None
        return json.dumps(value, ensure_ascii=False) if isinstance(value, list) else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([dump(t) for t in texts])

    return run(texts)


@transform("function_call")
def function_call(df: DataFrame) -> DataFrame:
    """A query with tools and answers as JSON lists."""
    tools, answers = _spaced_json(F.col("tools")), _spaced_json(F.col("answers"))
    found = F.array(message("system", F.concat(F.lit(TOOLS_PROMPT), tools)), message("user", strip(F.col("query"))), message("assistant", answers))
    return df.withColumn("messages", F.when(~is_blank(F.col("query")) & tools.isNotNull() & answers.isNotNull(), found))


def image_messages(question: Column, answer: Column, marker: str = "__IMG_0__") -> Column:
    """A user turn of an image block and a text block, and the answer."""
    block = "array<struct<type:string,text:string,image:string>>"
    blocks = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(marker).alias("image")), F.struct(F.lit("text").alias("type"), question.alias("text"), F.lit(None).cast("string").alias("image")))
    user = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), blocks.alias("blocks"))
    return F.when((question != "") & (answer != ""), F.array(user, F.struct(F.lit("assistant").alias("role"), answer.alias("content"), F.lit(None).cast(block).alias("blocks"))))


@transform("image_pairs")
def image_pairs(df: DataFrame) -> DataFrame:
    """The first image with the first question and answer of lists of both."""
    first = F.try_element_at("texts", F.lit(1))
    found = image_messages(strip(first["user"]), strip(first["assistant"]))
    return df.withColumn("messages", F.when(F.size("images") > 0, found)).withColumn("images", F.slice("images", 1, 1))


@transform("image_question")
def image_question(df: DataFrame, image_field: str = "image", question_field: str = "question", answer_field: str = "answer") -> DataFrame:
    found = image_messages(strip(F.col(question_field)), strip(F.col(answer_field)))
    return df.withColumn("messages", F.when(F.col(image_field).isNotNull(), found)).withColumn("images", F.array(image_field))


def resolve_images(df: DataFrame) -> DataFrame:
    """Markers `__IMG_n__` become the n-th path of `images` as a file URI; a missing path drops the row."""
    path = lambda marker: F.concat(F.lit("file://"), F.try_element_at("images", F.regexp_extract(marker, r"^__IMG_(\d+)__$", 1).cast("int") + 1))
    block = lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), F.when(b["image"].rlike(r"^__IMG_\d+__$"), path(b["image"])).otherwise(b["image"]).alias("image"))
    out = df.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.transform(m["blocks"], block).alias("blocks"))))
    broken = F.exists("messages", lambda m: F.coalesce(F.exists(m["blocks"], lambda b: (b["type"] == "image") & b["image"].isNull()), F.lit(False)))
    return out.where(~broken)


def countable_text(m: Column) -> Column:
    """A message's text for counting: blocks joined by newlines, an image as `<image>`."""
    return F.coalesce(m["content"], F.array_join(F.transform(m["blocks"], lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise(F.lit("<image>"))), "\n"))


def grouped_messages(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """One row per key: its turns, in order, as normalised messages; null where no assistant speaks."""
    rows = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("turns"))
    return rows.select(key, normalised(F.col("turns")).alias("messages"))
