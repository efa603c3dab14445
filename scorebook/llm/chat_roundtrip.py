"""Chat formatting with a grammar round trip, in DataFrame functions alone.

The grammar: a conversation is a row of turns; a turn is ``<|im_start|>``, its role, perhaps
``<|esc|>``, a line break, its text and ``<|im_end|>`` with a line break.  A turn is rendered as it
is and parsed again; where the parser does not give back the role and the text, the turn is
escaped.  The whole conversation is then parsed and compared with its source; should it differ,
all its turns are escaped.  Escaping writes ``&`` as ``&amp;`` and ``<|`` as ``&lt;|`` (and a line
break in a role as ``&nl;``), so an escaped turn holds no control string and reads back exactly.

Null roles and texts count as empty.  Turns stand in the order of ``turn`` (nulls first), equal
ones by role and text; repeated rows are turns of their own.  Rows without a conversation ID are
one conversation without an ID.  No rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = "<|im_start|>"
CLOSE = "<|im_end|>\n"
ESCAPED = "<|esc|>"


def replace_all(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return replace_all(text, ("&", "&amp;"), ("<|", "&lt;|"))


def unescape(text: Column) -> Column:
    return replace_all(text, ("&lt;|", "<|"), ("&amp;", "&"))


def escape_role(role: Column) -> Column:
    return replace_all(escape(role), ("\n", "&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(replace_all(role, ("&nl;", "\n")))


def raw_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def escaped_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(ESCAPED + "\n"), escape(text), F.lit(CLOSE))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text, closed); text after the first
    closing mark of a turn makes ``closed`` false."""
    pieces = F.split(formatted, F.lit(r"\Q" + OPEN + r"\E"), F.lit(-1))
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        rest = F.substring(piece, F.length(head) + 2, F.length(piece))
        body = F.substring_index(rest, CLOSE, 1)
        marked = F.endswith(head, F.lit(ESCAPED))
        role = F.substring(head, F.lit(1), F.length(head) - len(ESCAPED))
        return F.struct(
            F.when(marked, unescape_role(role)).otherwise(head).alias("role"),
            F.when(marked, unescape(body)).otherwise(body).alias("text"),
            (F.length(rest) == F.length(body) + len(CLOSE)).alias("closed"),
        )

    return F.transform(pieces, turn)


def formatted(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``formatted``; ``turns``, parsed from it; ``loss``, the offsets in
    ``formatted`` (code points, end exclusive) of every assistant text with ``escaped``; and
    ``identical``, whether the parsed turns are the source's.

    Both renderings of a turn and their running lengths come from one window, partitioned as the
    grouping after it, so rows are shuffled once.
    """
    one = rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text", F.lit(True).alias("closed")))
    one = (
        one.withColumn("raw", raw_turn(F.col("role"), F.col("text")))
        .withColumn("safe", escaped_turn(F.col("role"), F.col("text")))
        .withColumn("kept", parsed(F.col("raw")) == source)
        .withColumn("piece", F.when(F.col("kept"), F.col("raw")).otherwise(F.col("safe")))
        .drop("raw")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    one = one.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum(F.length("safe").cast("long")).over(before), F.lit(0)).alias("at_safe"),
    )
    whole = one.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "kept", "piece", "safe", "at", "at_safe"))).alias("t")
    )
    wanted = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(True).alias("closed")))
    first = F.array_join(F.transform("t", lambda x: x["piece"]), "")
    whole = whole.withColumn("source", wanted).withColumn("first", first)
    whole = whole.withColumn("same", parsed(F.col("first")) == F.col("source"))
    whole = whole.withColumn(
        "formatted",
        F.when(F.col("same"), F.col("first")).otherwise(F.array_join(F.transform("t", lambda x: x["safe"]), "")),
    )
    same = F.col("same")

    def masked(x: Column) -> Column:
        piece = F.when(same, x["piece"]).otherwise(x["safe"])
        at = F.when(same, x["at"]).otherwise(x["at_safe"])
        start = at + F.length(F.substring_index(piece, "\n", 1)) + 1
        return F.struct(
            start.alias("start"),
            (at + F.length(piece) - len(CLOSE)).alias("end"),
            (~(same & x["kept"])).alias("escaped"),
        )

    loss = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), masked)
    return whole.withColumn("turns", parsed(F.col("formatted"))).select(
        "conv_id", "formatted", "turns", loss.alias("loss"), (F.col("turns") == F.col("source")).alias("identical")
    )


def loss_text(formatted_: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""

    def under(span: Column) -> Column:
        text = F.substring(formatted_, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.when(span["escaped"], unescape(text)).otherwise(text)

    return F.array_join(F.transform(loss, under), "")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, all read back from the output."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = loss_text(F.col("formatted"), F.col("loss"))
    return found.withColumn("__loss", under).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
