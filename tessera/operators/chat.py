"""Conversations: building them from questions, templates, multimodal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T



def _content(kind: str, text: Column, image: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), image.cast("string").alias("image_url"))


def text_part(text: Column) -> Column:
    return _content("text", text, F.lit(None))


def message(role: str, parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), parts.alias("content"))


def conversation(question: Column, answer: Column) -> Column:
    """array<struct<role, content: array<struct<type, text, image_url>>>> of a question and its answer."""
    return F.array(message("user", F.array(text_part(question))), message("assistant", F.array(text_part(answer))))


def multimodal_conversation(question: Column, answer: Column, most: int | None = None, mark: str = " ") -> Column:
    """Image markup becomes image parts behind the text of its message."""

    def parts(c: Column) -> Column:
        images = F.transform(T.image_links(c, most), lambda u: _content("image", F.lit(None), u))
        return F.concat(F.array(text_part(T.without_images(c, mark))), images)

    return F.array(message("user", parts(question)), message("assistant", parts(answer)))


def captioned(image: Column, caption: Column, instruction: str) -> Column:
    user = F.array(text_part(F.lit(instruction)), _content("image", F.lit(None), image))
    return F.array(message("user", user), message("assistant", F.array(text_part(caption))))


def question_prompt(question: Column, image: Column) -> Column:
    """A user message only; with the image where there is one."""
    plain = F.array(text_part(question))
    return F.array(message("user", F.when(image.isNull(), plain).otherwise(F.concat(plain, F.array(_content("image", F.lit(None), image))))))


def text_of(content: Column) -> Column:
    """Texts of a message's parts, one after the other."""
    return F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def text_only(messages: Column) -> Column:
    """The conversation without images; a message without text keeps one empty text."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(F.exists(m["content"], lambda p: p["type"] == "text"), F.filter(m["content"], lambda p: p["type"] == "text")).otherwise(F.array(text_part(F.lit("")))).alias("content")))


def has_image(messages: Column) -> Column:
    return F.exists(messages, lambda m: F.exists(m["content"], lambda p: p["type"] == "image"))


def by_kind(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds kind: image or text."""
    return df.withColumn("kind", F.when(has_image(F.col(messages)), "image").otherwise("text"))


#: Role names, and what stands before and after a turn, by template.
TEMPLATES = {
    "turns": {"roles": {"user": "user", "assistant": "model"}, "open": "<start_of_turn>{role}\n", "close": "<end_of_turn>", "between": "\n", "generate": "<start_of_turn>model\n", "end": ""},
    "chatml": {"roles": {"system": "system", "user": "user", "assistant": "assistant"}, "open": "<|im_start|>{role}\n", "close": "<|im_end|>\n", "between": "", "generate": "<|im_start|>assistant\n", "end": ""},
    "pipes": {"roles": {"system": "system", "user": "user", "assistant": "assistant"}, "open": "<|{role}|>\n", "close": "<|end|>\n", "between": "", "generate": "<|assistant|>\n", "end": "<|endoftext|>"},
}


def apply_template(messages: Column, template: str = "turns", generate: bool = False, content=lambda m: m["content"]) -> Column:
    """Text of a conversation; roles that the template lacks are dropped.

    generate: the text ends with the opening of the assistant's turn instead of the end of text.
    """
    t = TEMPLATES[template]
    known = F.filter(messages, lambda m: m["role"].isin(list(t["roles"])))
    head, tail = t["open"].split("{role}")

    def turn(m: Column) -> Column:
        role = F.coalesce(*[F.when(m["role"] == a, F.lit(b)) for a, b in t["roles"].items()])
        return F.concat(F.lit(head), role, F.lit(tail), F.coalesce(content(m), F.lit("")), F.lit(t["close"]))

    body = F.array_join(F.transform(known, turn), t["between"])
    return F.concat(body, F.lit(t["between"] + t["generate"] if generate else t["end"]))


def conversations(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as one row of messages each: key, messages array<struct<role, content>>."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(key).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def with_fallback(good: Column, fallback: Column) -> Column:
    """Rows whose conversion gives nothing get the fallback."""
    return F.coalesce(good, fallback)
