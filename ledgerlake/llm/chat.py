"""Chat formatting from typed content parts, in DataFrame functions only.

A message's content is a list of typed parts. A visitor walks them in order and turns each into text:
text is escaped, an image, an audio clip or a document becomes a placeholder, its reference joins the
message's attachments and its expanded token count is worked out from its size. A turn then reads

    [INST]role[/INST]body</s>

and a conversation starts with ``<s>``. Inside roles and texts a control string gets a backslash after
its first character (``[\\INST]``), and one that already has backslashes there gets one more, so that the
output holds control strings only where the template put them and unescaping is exact. The loss mask
lists spans (turn, start, length) of the assistant's bodies: code points inside the turn's segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template: fixed values.
START, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
_NAMED = r"(/?(?:s>|INST\]|IMG\]|AUDIO\]|DOC\]))"
PARTS = "array<struct<type: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>>"

#: Expanded tokens: image patches of PATCH pixels a side in rows that end with one more, audio frames a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 16, 12.5, 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _NAMED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _NAMED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    one = F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("long").alias("pages"))
    return F.array(one)


def _expanded(part: Column) -> Column:
    rows, across = F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH), F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH)
    image = rows * (across + 1)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)
    pages = F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(F.lit(0)).cast("long")


def _visited(part: Column) -> Column:
    placed = F.coalesce(*(F.when(part["type"] == kind, F.lit(mark)) for kind, mark in PLACEHOLDERS.items()))
    return F.coalesce(placed, escape(F.coalesce(part["text"], F.lit(""))))


def visit(messages: DataFrame, content_col: str = "content") -> DataFrame:
    """``messages`` with body (string), attachments (array of kind, ref, tokens in order of appearance) and attachment_tokens (long).

    A null content or part is empty; a part of an unknown type counts as text.
    """
    parts = F.filter(F.coalesce(F.col(content_col), F.array().cast(PARTS)), lambda p: p.isNotNull())
    kinds = F.array(*map(F.lit, PLACEHOLDERS))
    attached = F.filter(parts, lambda p: F.coalesce(F.array_contains(kinds, p["type"]), F.lit(False)))
    refs = F.transform(attached, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    return messages.withColumns({
        "body": F.array_join(F.transform(parts, _visited), ""),
        "attachments": refs,
        "attachment_tokens": F.aggregate(refs, F.lit(0).cast("long"), lambda a, r: a + r["tokens"]),
    })


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """Rows (conv_id, formatted, n_turns, attachments, attachment_tokens, loss_spans), one per conversation.

    Rows of a conversation go by turn (null first), equal turns by role and body; repeated rows stay.
    A null role is empty. Loss spans cover whole bodies of role ``assistant`` (placeholders included) and
    nothing else; rows with a null conv_id form one conversation. Other columns are ignored.
    """
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.col(content_col).alias("content"))
    turns = visit(base)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    turns = turns.select("conv_id", F.struct("turn", "role", "body", "attachments", "attachment_tokens", F.length(head).alias("head"), F.concat(head, F.col("body")).alias("segment")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.cast("long").alias("turn"), t["head"].cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))))
    return grouped.select(
        "conv_id",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: F.concat(t["segment"], F.lit(END))), "")).alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["attachment_tokens"]).alias("attachment_tokens"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, turns: array of role and text, loss_text) from ``formatted`` and ``loss_spans`` alone.

    Texts are unescaped; placeholders stay as they are. loss_text joins all text under the mask.
    """
    body = F.substring("formatted", len(START) + 1, 2**31 - 1)
    segments = F.slice(F.split(body, END, -1), 1, F.greatest(F.size(F.split(body, END, -1)) - 1, F.lit(0)))
    rows = formatted.withColumn("_segments", segments)
    role = lambda s: unescape(F.substring_index(F.substring(s, len(OPEN) + 1, 2**31 - 1), CLOSE, 1))
    text = lambda s: unescape(F.substring(s, F.length(F.substring_index(s, CLOSE, 1)) + len(CLOSE) + 1, F.length(s)))
    masked = F.transform("loss_spans", lambda x: unescape(F.substring(F.get(F.col("_segments"), x["turn"].cast("int")), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return rows.select("conv_id", "formatted", F.transform("_segments", lambda s: F.struct(role(s).alias("role"), text(s).alias("text"))).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_text_content(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as messages of one text part each."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text_part(F.col("text")).alias("content"))
