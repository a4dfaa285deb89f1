"""Chat formatting from event logs with built-in functions alone.

An event has conv_id, seq (order in the log), turn (order in the conversation), kind, role and text:
message starts a turn, delta appends to it, edit replaces its text, regenerate replaces it and drops what the
log had so far at later turns. Folding needs no loop: an event counts if no later regenerate at an earlier
turn drops it and no later message, edit or regenerate at its own turn replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
REPLACING = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """A backslash before backslashes and inside '<|', so that no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role is one line: line feeds are escaped as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages. Null kinds are messages, null texts empty; a null role is taken
    from the turn's other events, or empty. Deltas before any message start the turn. Events of one seq count in the
    order of kind, role and text; a null seq or turn comes first, and null conv_id is a conversation of its own."""
    e = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "kind", "role", "text")
    e = e.withColumn("nth", F.row_number().over(log))
    earlier_turns = Window.partitionBy("conv_id").orderBy(F.coalesce("turn", F.lit(-(2**62)))).rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("dropped", F.max(F.when(F.col("kind") == "regenerate", F.col("nth"))).over(earlier_turns))
    e = e.where(F.col("dropped").isNull() | (F.col("nth") > F.col("dropped")))
    own = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("since", F.max(F.when(F.col("kind").isin(*REPLACING), F.col("nth"))).over(own))
    e = e.withColumn("role", F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("nth"))).over(own), F.lit("")))
    e = e.where(F.col("since").isNull() | (F.col("nth") >= F.col("since")))
    parts = e.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("parts"))
    return parts.select("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array<struct<at, chars>>, code points from 0): one row for each conversation.
    The loss mask covers the escaped texts of the trained role, without the marks around them."""
    shown = turns.select("conv_id", "turn", "role", escape_role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    shown = shown.withColumn("piece", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(START) + 1 + F.length("head"))
    mask = F.when(F.col("role") == trained, F.struct(F.col("at"), F.length("body").alias("chars")))
    grouped = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list(mask)).alias("loss"))
    return grouped.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def read_back(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.filter(F.split(F.col(formatted), r"<\|im_start\|>", -1), lambda p: p != "")
    one = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
    )
    return F.transform(parts, one)


def loss_text(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the mask, unescaped, nothing between."""
    cut = F.transform(F.col(loss), lambda s: unescape(F.substring(F.col(formatted), (s["at"] + 1).cast("int"), s["chars"])))
    return F.array_join(cut, "")
