r"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. A conversation that does not end in an
assistant turn (or has none) gets one more example without a trainable span, so
that the formatted output holds every turn.

Template, for each turn:  ``### role: text</turn>\n``. Inside role and text a
backslash becomes ``\\``, ``#`` becomes ``\#`` and ``</turn>`` becomes
``<\/turn>``; inside a role ``:`` becomes ``\:`` too. So a control string never
occurs inside a text, and dropping the backslash of each pair gives it back.

Null roles and texts are empty; rows of a null conv_id are one conversation.
Turns go by (turn, role, text), nulls first, so ties and repeated rows have one
order; each row is a turn. Extra columns are ignored. An example's text is the
prefix of the conversation's formatted text up to the end of its reply, so a
conversation is one row, however long its texts. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed control strings of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("#"), F.lit("\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last): one row for each assistant turn, and one for a tail without.

    The trainable span is [loss_start, loss_end) in code points of ``text``
    (both null in a tail); ``last`` marks the example that holds all turns.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    whole = format_turn(F.col("role"), F.col("text"))
    # Only lengths are added up over the window, so that a turn's text is shuffled once.
    placed = turns.withColumns({"k": F.count(F.lit(1)).over(order), "end": F.sum(F.length(whole)).over(order).cast("int")})
    placed = placed.select("conv_id", F.struct("k", whole.alias("s"), F.length(escape(F.col("text"))).alias("n"), "end", (F.col("role") == TRAINED_ROLE).alias("trained")).alias("t"))
    convs = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("pieces"))
    convs = convs.select("conv_id", "pieces", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("whole"))
    size = F.size("pieces")
    cuts = F.transform("pieces", lambda p, i: F.struct((i + 1 == size).alias("last"), p["trained"].alias("trained"), p["end"].alias("end"), p["n"].alias("n")))
    rows = convs.select("conv_id", "whole", F.posexplode(F.filter(cuts, lambda c: c["trained"] | c["last"])).alias("example", "cut"))
    end = F.col("cut.end") - len(CLOSE)
    return rows.select(
        "conv_id", "example", F.expr("substring(whole, 1, cut.end)").alias("text"),
        F.when(F.col("cut.trained"), end - F.col("cut.n")).alias("loss_start"), F.when(F.col("cut.trained"), end).alias("loss_end"), F.col("cut.last").alias("last"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(text, r"</turn>\n"), lambda p: p != "")
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the examples."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)")))
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    listing = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = examples.select("conv_id", F.struct("example", loss.alias("loss")).alias("loss"), F.size(turns).alias("n"), listing.alias("listing"), F.length("text").alias("chars"))
    found = parts.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.sha2(F.max("listing"), 256).alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: F.coalesce(x["loss"], F.lit(""))), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'), (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:')) + 14 AS n FROM c
), s AS (
  SELECT *, sum(n) OVER w AS reach, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(reach) FILTER (role = 'assistant' OR k = m) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
