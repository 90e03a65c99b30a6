"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a role and an array of content parts (type, text, ref, width, height, seconds, pages). The visitor
flattens the parts in order: a text part becomes its escaped text, an image, audio or document part becomes a
placeholder, and the attachment (its place, type, reference and expanded token count) is recorded.

Template of a turn:   <s>[ROLE]role[/ROLE]body</s>   with the body of a user between [INST] and [/INST].

Control strings inside texts, roles and unknown content are escaped reversibly: ESC (U+001B) becomes ESC 0, then
every control string gets ESC 1 after its first character. As every ESC of an escaped text is followed by 0 or 1,
taking out ESC 1 and turning ESC 0 into ESC restores the text exactly.

Defined cases: a NULL text, role or part counts as empty; a NULL conversation id is one conversation; turns are
ordered by (turn, role, body), NULLs first, repeated rows stay; a conversation without assistant turns has an empty
mask; a part of unknown type is text; an attachment without measures counts no tokens. No rows give no rows.
A conversation is one row of the result, so its turns are gathered by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESC = "\x1b"
OPEN, ROLE, ROLE_END, INST, INST_END, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROLS = (OPEN, CLOSE, ROLE, ROLE_END, INST, INST_END, *PLACEHOLDERS.values())

#: Fields of a content part; all but the type may be missing (NULL).
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESC), F.lit(ESC + "0"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESC + "1" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def text_part(text: Column) -> Column:
    """An array of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))


def _tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Expanded tokens of an attachment: patches of an image, frames of a sound, pages of a document."""
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    count = (F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["seconds"] * audio_rate))
             .when(part["type"] == "document", part["pages"].cast("long") * page_tokens))
    return F.coalesce(count, F.lit(0)).cast("long")


def visit(parts: Column, *, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 800) -> tuple[Column, Column]:
    """(body, attachments) of one turn."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))

    def flat(part: Column) -> Column:
        out = escape(part["text"])
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
        return out

    def attachment(part: Column, i: Column) -> Column:
        return F.struct(i.alias("part"), part["type"].alias("type"), part["ref"].alias("ref"),
                        _tokens(part, patch, audio_rate, page_tokens).alias("tokens"), _is_media(part).alias("media"))

    attachments = F.filter(F.transform(parts, attachment), lambda a: a["media"])
    return F.array_join(F.transform(parts, flat), ""), attachments


def format_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts", learn: str = "assistant", **costs) -> DataFrame:
    """(conv, n_turns, formatted, loss_mask, attachments): one row per conversation.

    `loss_mask` holds (start, length) in code points of `formatted`, from 0, one span per turn of the role `learn`;
    `attachments` holds (turn position, part, type, ref, tokens) in reading order."""
    body, attachments = visit(F.col(f"`{parts}`"), **costs)
    rows = turns.select(
        F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"),
        body.alias("b"), attachments.alias("a"))
    head = F.concat(F.lit(OPEN + ROLE), escape(F.col("r")), F.lit(ROLE_END), F.when(F.col("r") == "user", INST).otherwise(""))
    tail = F.concat(F.when(F.col("r") == "user", INST_END).otherwise(""), F.lit(CLOSE))
    rows = rows.withColumn("h", head).withColumn("s", F.concat("h", "b", tail)).withColumn("n", F.length("s").cast("long"))
    order = Window.partitionBy("c").orderBy(F.asc_nulls_first("t"), "r", "b")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn(
        "before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    rows = rows.withColumn("turn_row", F.struct(
        "i", "s", F.when(F.col("r") == learn, F.struct((F.col("before") + F.length("h")).alias("start"),
                                                      F.length("b").cast("long").alias("length"))).alias("span"), "a"))
    out = rows.groupBy("c").agg(F.array_sort(F.collect_list("turn_row")).alias("rows"))
    found = F.flatten(F.transform("rows", lambda x: F.transform(x["a"], lambda a: F.struct(
        x["i"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return out.select(
        F.col("c").alias(conv), F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda x: x["s"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"),
        found.alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add `turns`, the (role, text) pairs, and `loss_text`, what lies under the mask, from `formatted` alone.
    Placeholders stay in the texts as they are."""
    def parse(raw: Column) -> Column:
        pieces = F.split(raw, r"\[/ROLE\]", 2)
        role = unescape(F.substring(pieces[0], len(OPEN + ROLE) + 1, 2**31 - 1))
        body = pieces[1]
        inner = F.when(role == "user", F.substr(body, F.lit(len(INST) + 1), F.length(body) - len(INST + INST_END))).otherwise(body)
        return F.struct(role.alias("role"), unescape(inner).alias("text"))

    ended = F.split("formatted", "</s>", -1)
    turns = F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), parse)
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)
