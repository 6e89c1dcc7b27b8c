"""Chat formatting with typed content parts, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a document page and of a text token, pixels of an image patch side, audio tokens a second.
PAGE_TOKENS, TEXT_CHARS, PATCH, AUDIO_RATE = 512, 4, 28, 25
#: Fields of a content part; a kind other than these four is text.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What may not occur in an escaped text: "[INST]", "[/INST]", "<s>", "</s>", "<<" and "<|".
_CONTROL_ANGLE, _CONTROL_SQUARE = r"(?=\\*(?:/?s>|<|\|))", r"(?=\\*/?INST\])"
_PLAIN_ROLE = r"\A[A-Za-z0-9_.-]{1,64}\z"
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<[A-Za-z0-9_.=-]*>>.*?<</>>"


def escape(text: Column) -> Column:
    """One backslash more behind the first letter of each control string, backslashed or not."""
    return F.regexp_replace(F.regexp_replace(text, "<" + _CONTROL_ANGLE, r"<\\"), r"\[" + _CONTROL_SQUARE, r"[\\")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\\" + _CONTROL_SQUARE, "["), r"<\\" + _CONTROL_ANGLE, "<")


def _opening(role: Column) -> Column:
    other = F.when(role.rlike(_PLAIN_ROLE), role).otherwise(F.concat(F.lit("="), F.hex(role.cast("binary"))))
    return F.when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("<<"), other, F.lit(">>")))


def _closing(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("<</>>")


def _visit(part: Column) -> Column:
    """The string of a part: escaped text, or a placeholder."""
    return F.when(part["kind"].isin("image", "audio", "document"), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _tokens(part: Column) -> Column:
    """Tokens that a part takes once its placeholder is expanded."""
    patches = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / TEXT_CHARS))
        .cast("long")
    )


def text_parts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows of plain text as rows with one text part each; a null text is an empty one."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select("conv_id", "turn", "role", F.array(part).cast(f"array<{PART}>").alias("parts"))


def format_chat(rows: DataFrame) -> DataFrame:
    """From rows (conv_id, turn, role, parts) one row a conversation.

    formatted holds its turns by turn number (then role, then content; null turns first): user turns
    in [INST] ... [/INST], assistant turns in <s> ... </s>, others in <<role>> ... <</>>. Text parts
    are escaped so that no control string is left in them; images, audio and documents become
    placeholders, in order. loss_spans are the (start, length) code points of the assistant turns'
    content. attachments lists (turn, part, kind, ref, tokens) of the placeholders in their order;
    n_tokens sums the estimate for all parts. Null roles are empty ones; null part lists are empty;
    rows with a null conv_id form one conversation; repeated rows are repeated turns.

    Offsets are running sums in a window, which streams; only the output string itself, one row of
    the result, holds a conversation whole.
    """
    role = F.coalesce("role", F.lit(""))
    content = F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), _visit), "")
    attached = F.filter(
        F.transform("parts", lambda p, i: F.struct(F.col("turn"), i.cast("long").alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
        lambda a: a["kind"].isin("image", "audio", "document"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    turns = (
        rows.select("conv_id", "turn", role.alias("role"), content.alias("content"), F.coalesce(attached, F.array()).alias("attached"), F.coalesce(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + _tokens(p)), F.lit(0)).alias("tokens"))
        .withColumn("open", _opening(F.col("role")))
        .withColumn("segment", F.concat("open", "content", _closing(F.col("role"))))
        .withColumn("k", F.row_number().over(order))
        .withColumn("at", F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment"))
    )
    span = F.struct((F.col("at") + F.length("open")).alias("start"), F.length("content").cast("long").alias("length"))
    return (
        turns.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("k", "segment", "attached"))).alias("turns"),
            F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"),
            F.sum("tokens").alias("n_tokens"),
        )
        .select("conv_id", F.array_join("turns.segment", "").alias("formatted"), "loss_spans", F.flatten("turns.attached").alias("attachments"), "n_tokens")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns, an array of (role, text) read from its string, and loss_texts, what is under its loss mask."""
    open_role = lambda t: F.regexp_extract(t, "^<<([A-Za-z0-9_.=-]*)>>", 1)

    def turn(t: Column) -> Column:
        other = F.when(open_role(t).startswith("="), F.decode(F.unhex(F.substring(open_role(t), F.lit(2), F.length(open_role(t)))), "UTF-8")).otherwise(open_role(t))
        role = F.when(t.startswith("[INST]"), "user").when(t.startswith("<s>"), "assistant").otherwise(other)
        body = F.regexp_replace(t, r"^(?:\[INST\]|<s>|<<[A-Za-z0-9_.=-]*>>)|(?:\[/INST\]|</s>|<</>>)\z", "")
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return formatted.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)), turn)).withColumn(
        "loss_texts", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    )
