"""Chat formatting in budgeted windows, with column functions only.

Prefix sums of the tokens of a conversation's turns choose windows of whole turns: a turn belongs to the
window in which its first token lies when the conversation is laid over windows of the free budget (what
the system turn and the history leave). A window begins with the system turn, if the conversation has
one, repeats up to ``history`` turns from before it (within a quarter of the budget), and then holds its
own turns. The loss mask covers assistant texts of own turns only, so no target is learnt twice.

Each turn is written ``<s>[INST]role[/INST]text</s>``. A backslash inside a role or text is doubled, and
control strings are broken by a backslash after their first character; dropping the first backslash of
each pair gives the text back exactly.

Rows of any kind: null texts and roles are empty; turns with the same number follow in the order of role
and text; a null turn comes first; a null conv_id is a conversation of its own; a turn longer than the
budget makes its window longer rather than being cut; an empty table gives no windows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 2
WORD = r"[^\x20\x09-\x0D]+"



def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, rest in (("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]")):
        doubled = F.replace(doubled, F.lit(first + rest), F.lit(f"{first}\\{rest}"))
    return doubled


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), role, F.lit("[/INST]"), text, F.lit("</s>"))


def placed_turns(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Every turn in every window that shows it: conv_id, window, place, role, text (both escaped), own."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("lead_in", (F.col("place") == 0) & (F.col("role") == "system"))
        .withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + 1)
        .withColumn("own_tokens", F.when(F.col("lead_in"), 0).otherwise(F.col("tokens")))
        .withColumn("begin", F.sum("own_tokens").over(until) - F.col("own_tokens"))
        .withColumn("system", F.max(F.when(F.col("lead_in"), F.col("tokens")).otherwise(0)).over(until))
        # A long system turn still leaves a quarter of the budget for each window's own turns.
        .withColumn("room", F.greatest(F.lit(budget // 4), F.lit(budget - budget // 4) - F.col("system")))
        .withColumn("home", F.when(F.col("lead_in"), 0).otherwise(F.floor(F.col("begin") / F.col("room"))))
        .withColumn("before", F.when(F.lag("lead_in").over(order), None).otherwise(F.lag("home").over(order)))
        .withColumn("opens", ~F.col("lead_in") & (F.col("home") != F.coalesce("before", F.col("home"))))
        .withColumn("last", F.max("home").over(whole))
    )
    again = [
        F.when(
            F.lead("opens", j).over(order)
            & ~F.col("lead_in")
            & (F.lead("begin", j).over(order) - F.col("begin") <= budget // 4),
            F.lead("home", j).over(order),
        )
        for j in range(1, history + 1)
    ]
    # A window without own turns (inside a turn longer than the room) does not exist; system turns follow own turns.
    opened = F.collect_set(F.when(~F.col("lead_in"), F.col("home"))).over(whole)
    shown = F.when(F.col("lead_in"), F.array_union(F.array(F.lit(0).cast("long")), opened)).otherwise(
        F.array_compact(F.array(F.col("home"), *again))
    )
    return (
        placed.withColumn("shown", shown)
        .select("conv_id", "place", "role", "text", "home", "lead_in", F.explode(F.array_distinct("shown")).alias("window"))
        .withColumn("own", F.col("window") == F.col("home"))
        .select("conv_id", "window", "place", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), "own")
    )


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_turns, n_own, repeated (one flag per turn) and loss (spans).

    ``loss`` holds start and end, in code points of ``text``, of each assistant text to learn from.
    """
    shown = placed_turns(turns, budget, history)
    windows = shown.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "own"))).alias("turns")
    )
    written = F.transform("turns", lambda t: formatted_turn(t["role"], t["text"]))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + F.lit(len("<s>[INST][/INST]"))
        end = begin + F.length(t["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        learn = t["own"] & (t["role"] == "assistant")
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        return F.struct(
            (end + F.lit(len("</s>"))).alias("at"),
            F.concat(state["spans"], F.when(learn, span).otherwise(none)).alias("spans"),
        )

    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")
    return windows.select(
        "conv_id",
        "window",
        F.array_join(written, "").alias("text"),
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: ~t["own"]).alias("repeated"),
        F.aggregate("turns", start, add)["spans"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The conversations that formatted windows hold: conv_id, n_turns, turns, loss_text and formatted_chars.

    ``turns`` are role and text of every turn, parsed from the windows' texts; ``loss_text`` is all text under
    the mask, unescaped.
    """
    pieces = F.split("text", "</s>", -1)
    parsed = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<s>\[INST\](.*?)\[/INST\]", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<s>\[INST\].*?\[/INST\]", "")).alias("text"),
        ),
    )
    own = F.transform(
        F.filter(F.arrays_zip(parsed.alias("turn"), F.col("repeated")), lambda z: ~z["repeated"]), lambda z: z["turn"]
    )
    learnt = F.array_join(
        F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), ""
    )
    return (
        windows.select("conv_id", "window", own.alias("turns"), learnt.alias("loss_text"), F.length("text").alias("chars"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            F.flatten(F.col("w.turns")).alias("turns"),
            F.array_join(F.col("w.loss_text"), "").alias("loss_text"),
            "formatted_chars",
        )
        .withColumn("n_turns", F.size("turns"))
    )
