"""Chat formatting: every participant's perspective of a dialogue of several parties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """One row per (conversation, participant): conv_id, part, speaker, n_turns, n_own_turns, text, spans, n_target_chars.

    A participant is a role other than `system` that speaks in the conversation; each row has the whole of it. In its perspective its turns are headed
    `assistant`, the system's `system`, all others `user name=<role>`; spans are the (start, end) code points of its
    own turns with their end marks, the only ones with a loss mask of 1. part is 0.
    Turns go by number, then role, then text. A repeated row is rendered once. A null role is the role '', a null
    text is empty, a null turn comes first, a null conversation is a conversation of its own.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("said"),
    )
    whole = rows.groupBy("conv_id").agg(F.lit(0).cast("long").alias("part"), F.sort_array(F.collect_set("said")).alias("said"))
    people = F.array_distinct(F.filter(F.transform("said", lambda x: x["role"]), lambda r: r != system))
    each = whole.select("*", F.explode(F.array_sort(people)).alias("speaker"))
    head = lambda x: F.when(x["role"] == F.col("speaker"), "assistant").when(x["role"] == system, system).otherwise(F.concat(F.lit("user name="), x["role"]))
    pieces = F.transform("said", lambda x: F.struct(F.concat(F.lit("<|im_start|>"), head(x), F.lit("\n")).alias("head"), F.concat(x["text"], F.lit("<|im_end|>")).alias("body"), (x["role"] == F.col("speaker")).alias("own")))
    each = each.select("conv_id", "part", "speaker", pieces.alias("pieces"))
    # Code points before each piece, by a running sum in the order of the turns.
    step = lambda a, x: F.struct((a["at"] + F.length(x["head"]) + F.length(x["body"]) + 1).alias("at"), F.when(x["own"], F.array_append(a["spans"], F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end")))).otherwise(a["spans"]).alias("spans"))
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    spans = F.aggregate("pieces", none, step, lambda a: a["spans"])
    each = each.withColumns({"spans": spans, "text": F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")})
    return each.select(
        "conv_id", "part", "speaker",
        F.size("pieces").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_own_turns"), "text", "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_target_chars"),
    )
