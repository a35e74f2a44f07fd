r"""Chat formatting by prefix-target expansion (operator 9), in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, that reply
as the only trainable text.  A conversation that does not end with a reply gets one closing example
with nothing to train on, so its last turns are not lost.

A turn is written ``### role: text</turn>`` and a newline.  Inside texts ``\`` is written ``\b``,
``<`` ``\l`` and ``#`` ``\h`` (in roles also ``:`` as ``\c``), so no control string can occur there, and
each text comes back exactly.

Output: conv_id, example (from 0), text, loss_start, loss_end (code points, end exclusive, of the
escaped reply inside ``text``).  Examples of a conversation are prefixes of one string.

Rules: turns by ``turn`` (nulls last), ties by role, then text; repeated rows are turns of their own; a null
role or text is empty; a null conv_id is one conversation.  A conversation is one row, as each of its last
examples has to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
REPLY_ROLE = "assistant"
#: Character -> what is written for it; the first comes first when escaping and last when reading.
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}
#: A conversation whose texts hold the template's own marks.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(text: Column, table: dict[str, str] = ESCAPES) -> Column:
    for raw, written in table.items():
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column, table: dict[str, str] = ESCAPES) -> Column:
    for raw, written in reversed(table.items()):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns as an ordered array of (head, body, reply)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == REPLY_ROLE).alias("reply"))).alias("turns"))


def expand(conversations: DataFrame) -> DataFrame:
    """The examples: conv_id, example, text, loss_start, loss_end.  One shuffle, on conv_id."""
    places = "array<struct<start:int,stop:int,upto:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("reply"), F.array().cast(places).alias("found"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        upto = stop + len(CLOSE)
        place = F.struct(start.alias("start"), stop.alias("stop"), upto.alias("upto"))
        return F.struct(upto.alias("at"), t["reply"].alias("reply"),
                        F.when(t["reply"], F.array_append(acc["found"], place)).otherwise(acc["found"]).alias("found"))

    def close(acc: Column) -> Column:
        end = F.struct(acc["at"].alias("start"), acc["at"].alias("stop"), acc["at"].alias("upto"))
        return F.when(acc["reply"], acc["found"]).otherwise(F.array_append(acc["found"], end))

    rows = _turns(conversations).select(
        "conv_id", F.aggregate("turns", zero, step, close).alias("places"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("whole"))
    return rows.select("conv_id", "whole", F.posexplode("places").alias("example", "p")).select(
        "conv_id", "example", F.substr("whole", F.lit(1), F.col("p.upto")).alias("text"),
        F.col("p.start").alias("loss_start"), F.col("p.stop").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.split(text, CLOSE)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, AFTER_ROLE, 1)
        body = F.substr(x, F.length(head) + F.lit(len(AFTER_ROLE) + 1))
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"),
                        unescape(body).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, and the trainable texts in order."""
    trained = F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = examples.select("conv_id", "example", F.length("text").alias("chars"), "text",
                           F.struct("example", unescape(trained).alias("trained")).alias("loss"))
    found = rows.groupBy("conv_id").agg(F.max_by("text", "example").alias("longest"), F.sum("chars").alias("formatted_chars"),
                                        F.sort_array(F.collect_list("loss")).alias("loss"))
    return found.select("conv_id", read_turns(F.col("longest")).alias("turns"),
                        F.array_join(F.transform("loss", lambda x: x["trained"]), "").alias("trained"), "formatted_chars")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation: what the formatted output holds, read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(expand(conversations)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


def with_tricky(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold control strings."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
