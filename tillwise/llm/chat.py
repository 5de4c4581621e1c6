"""Preference records from pairs of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the
prompt; what follows in each is its completion, with a mask of the spans to learn from: the turns of
the assistant. Everything is done by DataFrame functions: one grouping puts the turns of a conversation
together, and two joins bring a pair's conversations together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.arrays import with_running_sum
from tillwise.sources.shared import stage

LEARNT_ROLE = "assistant"
#: Conversations in one range of ids when pairs are formed, about.
RANGE_ROWS = 1 << 16


def _marker(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_marker(turn), turn["text"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, learnt_role: str) -> Column:
    """Spans start:end, in code points, of the texts of the learnt role and their final line ends."""

    def measure(turn: Column) -> Column:
        whole = F.length(_rendered(turn))
        return F.struct(
            whole.cast("long").alias("end"), (whole - F.length(_marker(turn))).alias("size"), (turn["role"] == learnt_role).alias("learnt")
        )

    placed = with_running_sum(F.transform(turns, measure), "end", ["end", "size", "learnt"])
    spans = F.transform(F.filter(placed, lambda x: x["learnt"]), lambda x: F.concat_ws(":", x["end"] - x["size"], x["end"]))
    return F.array_join(spans, ",")


def whole_conversations(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turns): the turns of each conversation, by turn number; equal numbers by role, then text.

    A null role is ``unknown``, a null text empty, a null turn number comes first; rows with a null id
    are left out, and repeated rows are one turn. Other columns are not read.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _predecessors(rows: DataFrame, keys: list[str], range_rows: int) -> DataFrame:
    """(conv_id, before): the greatest smaller id among the rows (conv_id, keys) with the same keys, if any.

    Rows are cut into ranges of (keys, conv_id) of about ``range_rows`` rows, whatever the ids look like, so a key that a
    third of all conversations share lies in many ranges. A row's predecessor is the row before it in its range; only the
    first row of a range gets the last one of the range before, from a table with one row per range.
    """
    order = [*keys, "conv_id"]
    ranges = max(1, -(-rows.count() // range_rows))
    cut = rows.select(*order).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    placed = stage(cut, "ranges")  # two readers must see the same ranges
    row = F.struct(*order)
    near = placed.select(row.alias("own"), F.lag(row).over(Window.partitionBy("part").orderBy(*order)).alias("prior"))
    ends = placed.groupBy("part").agg(F.min(row).alias("own"), F.max(row).alias("last"))
    far = ends.select("own", F.lag("last").over(Window.orderBy("part")).alias("prior"))
    found = near.unionByName(far).filter(F.col("prior").isNotNull())
    for key in keys:
        found = found.filter(F.col("own")[key].eqNullSafe(F.col("prior")[key]))
    return found.select("own.conv_id", F.col("prior.conv_id").alias("before"))


def opening_pairs(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): each conversation, as the rejected one, with the one
    before it, by id, that opens with the same turn. Ids are of any type that sorts; texts sort by their UTF-8 bytes."""
    first = F.col("turns")[0]
    opening = F.sha2(F.to_json(F.struct(first["role"].alias("role"), first["text"].alias("text"))), 256)
    before = _predecessors(conversations.select("conv_id", opening.alias("opening")), ["opening"], range_rows)
    pairs = before.select(F.col("before").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    one = conversations.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    two = conversations.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    joined = pairs.join(one, "chosen_id").join(two, "rejected_id")
    return joined.select("chosen_id", "rejected_id", "chosen", "rejected")


def swapped_reply_pairs(conversations: DataFrame, *, learnt_role: str = LEARNT_ROLE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): each conversation up to its last reply, against the same
    with the last reply of the conversation before it, by id. Conversations without a reply are left out."""
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == learnt_role, i + 1)))
    answered = conversations.withColumn("n", last).filter("n is not null")
    replies = answered.select(F.col("conv_id").alias("rejected_id"), F.col("turns")[F.col("n") - 1]["text"].alias("other"))
    before = _predecessors(answered.select("conv_id"), [], range_rows)
    pairs = before.select(F.col("conv_id").alias("chosen_id"), F.col("before").alias("rejected_id"))
    chosen = answered.select(F.col("conv_id").alias("chosen_id"), F.slice("turns", 1, F.col("n")).alias("chosen"), "n")
    joined = pairs.join(chosen, "chosen_id").join(replies, "rejected_id")
    reply = F.col("chosen")[F.col("n") - 1]
    swapped = F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"), F.col("other").alias("text"))
    rejected = F.concat(F.slice("chosen", 1, F.col("n") - 1), F.array(swapped))
    return joined.select("chosen_id", "rejected_id", "chosen", rejected.alias("rejected"))


def preference_records(pairs: DataFrame, *, learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """The pairs, with prompt_turns, prompt, chosen_text, rejected_text and their masks after their columns.

    ``chosen`` and ``rejected`` are turns as in ``whole_conversations``; these two columns are replaced by
    the result. Turns are equal when role and text are. A completion is empty, with an empty mask, when
    its conversation is a prefix of the other. A null conversation is one without turns.
    """
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    empty = F.array().cast(pairs.schema["chosen"].dataType)
    both = pairs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("chosen", empty).alias("a"), F.coalesce("rejected", empty).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    shared = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("a"), F.size("b"))).cast("int")
    cut = both.withColumn("prompt_turns", shared)

    def rest(turns: str) -> Column:
        return F.slice(turns, F.col("prompt_turns") + 1, F.size(turns) - F.col("prompt_turns"))

    return cut.select(
        *[F.col(f"`{c}`") for c in kept],
        "prompt_turns",
        _render(F.slice("a", 1, F.col("prompt_turns"))).alias("prompt"),
        _render(rest("a")).alias("chosen_text"),
        _render(rest("b")).alias("rejected_text"),
        _mask(rest("a"), learnt_role).alias("chosen_mask"),
        _mask(rest("b"), learnt_role).alias("rejected_mask"),
    )
