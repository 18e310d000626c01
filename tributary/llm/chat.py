"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts ``struct<type, text, uri, tokens>``; type is text, image, audio or document. The
visitor flattens the parts in order: text is escaped, any other part becomes a placeholder ``<|type|>`` and one
attachment ``struct<position, type, uri, tokens>``; its expanded token count is the part's own, or ``PART_TOKENS`` of
its type. Turns are marked ``<|im_start|>role\\n ... <|im_end|>\\n``. Control strings inside texts and roles can't be
taken for marks: ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, which ``unescape`` reverses exactly.

The loss mask is the array of ``struct<start, length>`` (from 0, in code points) of every assistant content.

Defined results: null or unknown text is empty, a null role is empty, a part of an unknown type is a placeholder of
that type with ``part_`` before it, so that none is a turn's mark; a conversation's turns are ordered by turn, then role, then content; repeated rows are separate turns; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a placeholder stands for where the part does not say.
PART_TOKENS = {"image": 576, "audio": 188, "document": 1024}
PARTS = "array<struct<type:string,text:string,uri:string,tokens:long>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("tokens"))).cast(PARTS)


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def visit(parts: Column) -> Column:
    """The content string of one turn's parts."""
    seen = F.transform(
        F.coalesce(parts, F.array().cast(PARTS)),
        lambda p: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), F.when(_kind(p).isin(*PART_TOKENS), "").otherwise("part_"), F.regexp_replace(_kind(p), r"[^\w-]", "_"), F.lit("|>"))
        ),
    )
    return F.array_join(seen, "")


def attachments(parts: Column) -> Column:
    """The parts that are not text, in order, with their expanded token counts."""
    default = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in PART_TOKENS.items()], F.lit(1))
    numbered = F.transform(
        F.coalesce(parts, F.array().cast(PARTS)),
        lambda p, i: F.struct(
            i.alias("position"), _kind(p).alias("type"), p["uri"].alias("uri"), F.coalesce(p["tokens"], default(_kind(p)).cast("long")).alias("tokens")
        ),
    )
    return F.filter(numbered, lambda a: a["type"] != "text")


def format_chat(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, content: PARTS) to one row a conversation: conv_id, formatted, loss_mask, attachments
    (with the turn's number), n_placeholder_tokens."""
    head = lambda role: F.concat(F.lit(START), escape(role), F.lit("\n"))
    tail = f"{END}\n"
    turn = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        visit(F.col("content")).alias("content"),
        attachments(F.col("content")).alias("attached"),
    )
    # Where a turn's content begins: after all turns before it and its own head.
    size = F.length(head(F.col("role"))) + F.length("content") + len(tail)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = turn.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length(head(F.col("role")))).cast("int"))
    conv = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "start", "attached"))).alias("turns"))
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    masks = F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), F.length(t["content"]).alias("length")))
    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn_no"), a.alias("part")))))
    return conv.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t["role"]), t["content"], F.lit(tail))), "").alias("formatted"),
        masks.alias("loss_mask"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda acc, a: acc + a["part"]["tokens"]).alias("n_placeholder_tokens"),
    )


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Reads format_chat's rows back: conv_id, turns array<struct<role, text>> and loss array<string>, both unescaped."""
    marked = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
            unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text"),
        ),
    )
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation of plain texts, as read back from the formatted strings: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    typed = conversations.select("conv_id", "turn", "role", text_part(F.col("text").cast("string")).alias("content"))
    back = parse_chat(format_chat(typed))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
