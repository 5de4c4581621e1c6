"""The trie of all conversations' prefixes, by van Emde Boas recursion over depths.

The recursion cuts every range of depths at its half: what lies above the cut is one upper trie, what lies below is a forest
with a lower trie under each prefix that ends at the cut, and both go on in the same way. Cuts at halves of halves lie at
multiples of powers of two, so all ranges of one size are handled together, in rounds that grow with the logarithm of
the longest conversation:

1. ``_blocks`` names every aligned stretch of 1, 2, 4, ... turns after its two halves, so that a stretch of any length
   is compared as one value.
2. ``_prefix_names`` names the prefixes at the cuts, widest ranges first: the name at a cut follows from the name at the start of the
   range and that of the stretch between. Equal names are one node.
3. ``_grafted`` carries totals upwards, narrowest ranges first: the totals of the lower tries under a cut are added to
   all nodes of the upper trie on the way to it.

Turns stay one row each throughout. No step holds a whole conversation, a node's members or a subtree in one row or task, apart from
the list of members that end at a node, which is hashed as a stream of chunks. Names are SHA-256 digests; equal
digests count as equal prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.sources.shared import Tables, stage

#: Ids that a task joins to one chunk of the text that is hashed.
IDS_PER_CHUNK = 4096
#: Partition number of a row, in Spark's increasing ids.
_PARTITION_SHIFT = 33
_ROOT = b"\x00" * 32


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _tag(number: int) -> Column:
    return F.lit(bytes([number]))


def ordered_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, pos, symbol, chars): the turns of every conversation, numbered from 1 in the order of their turn, null first.

    A null role or text is empty, and a symbol stands for both. Turns with the same number follow in the order of their
    symbols; repeated rows are turns of their own. Rows without an id belong to no conversation. Other columns are not
    read. Texts are never shuffled. Numbers come from the places of the rows in range partitions, which may cut
    a conversation anywhere, so that its length has no bearing on a task. The rows are staged.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    symbol = _digest(_tag(0), F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), symbol.alias("symbol"), F.char_length(text).alias("chars")
    )
    # Equal rows are told apart by chance, so that any number of them can be cut too.
    in_order = turns.orderBy("id", F.asc_nulls_first("turn"), "symbol", F.rand(11)).select("id", "symbol", "chars")
    row = stage(in_order.withColumn("row", F.monotonically_increasing_id()), "ordered_turns")
    row = row.withColumn("part", F.shiftright("row", _PARTITION_SHIFT))
    # A row per conversation and partition that it touches.
    heads = row.groupBy("id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("id", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = row.join(heads, ["id", "part"])
    return stage(numbered.select("id", (F.col("row") - F.col("first") + F.col("before") + 1).alias("pos"), "symbol", "chars"), "numbered_turns")


def with_shared_openings(turns: DataFrame, *, group: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like others: (ids, turns) where the first ``head`` turns come from another conversation.

    ``turns`` are those of ``ordered_turns`` with whole-number ids. Conversation c gets the first h turns of conversation
    ``c - c % group`` (SQL's remainder; fewer if it has fewer, none if there is none) in place of its own first h, where
    ``head`` is h as an expression of ``id``, ``most`` at the most. Every id stays, also without a turn.
    """
    lengths = turns.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    giver = F.col("id") - F.col("id") % group
    plans = lengths.select("id", giver.alias("giver"), head.cast("long").alias("head"))
    found = lengths.select(F.col("id").alias("giver"), "length")
    plans = stage(
        plans.join(found, "giver", "left").select("id", "giver", "head", F.least("head", F.coalesce("length", F.lit(0))).alias("taken")),
        "openings",
    )
    own = turns.join(plans.select("id", "head", "taken"), "id").filter("pos > head")
    own = own.select("id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "symbol", "chars")
    # At most ``most`` turns of a giver, for at most ``2 * group`` conversations each.
    given = turns.filter(F.col("pos") <= most).withColumnRenamed("id", "giver").join(plans, "giver").filter("pos <= head")
    return plans.select("id"), own.unionByName(given.select("id", "pos", "symbol", "chars"))


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k, the aligned stretches of 2^k turns: (id, block, name, chars of the last text)."""
    blocks = [stage(turns.select("id", (F.col("pos") - 1).alias("block"), F.col("symbol").alias("name"), "chars"), "blocks_0")]
    right = F.col("block") % 2 == 1
    for k in range(1, levels):
        halves = blocks[-1].groupBy("id", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~right, F.col("name"))).alias("left"), F.max(F.when(right, F.struct("name", "chars"))).alias("right")
        )
        whole = halves.filter("left is not null and right is not null")
        name = _digest(_tag(1), F.col("left"), F.col("right.name"))
        blocks.append(stage(whole.select("id", "block", name.alias("name"), F.col("right.chars").alias("chars")), f"blocks_{k}"))
    return blocks


def _prefix_names(ids: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(id, pos, name, chars) of every prefix of every conversation, the empty one at 0 too."""
    names = stage(ids.select("id", F.lit(0).cast("long").alias("pos"), F.lit(_ROOT).alias("name"), F.lit(0).alias("chars")), "prefixes")
    for k in range(len(blocks) - 1, -1, -1):
        # The cut of a range of 2^(k+1) depths lies 2^k below its start, which is a cut of a wider range or the root.
        upper = blocks[k].filter("block % 2 = 0").select("id", F.shiftleft("block", k).alias("pos"), F.col("name").alias("stretch"), F.col("chars").alias("last"))
        cut = names.select("id", "pos", "name").join(upper, ["id", "pos"])
        cut = cut.select("id", (F.col("pos") + (1 << k)).alias("pos"), _digest(_tag(2), F.col("name"), F.col("stretch")).alias("name"), F.col("last").alias("chars"))
        names = names.unionByName(stage(cut, "prefixes"))
    return names


def _grafted(nodes: DataFrame, paths: DataFrame, levels: int, sums: list[str]) -> DataFrame:
    """Nodes (depth, id) with ``sums`` over their subtrees in place of their own values."""
    state = stage(nodes, "totals")
    for k in range(levels):
        # Tops of the lower halves of all ranges of 2^(k+1) depths, and the upper halves' nodes on the way to them.
        tops = state.filter(F.col("depth") % (2 << k) == 1 << k)
        tops = tops.select(F.col("id").alias("of"), (F.shiftright("depth", k) - 1).alias("range"), *sums)
        above = paths.select("of", F.shiftright("depth", k).alias("range"), "depth", "id")
        more = above.join(tops, ["of", "range"]).groupBy("depth", "id").agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        added = [(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums]
        state = stage(state.join(more, ["depth", "id"], "left").select("depth", "id", *added), "totals")
    return state


def _ends(ids: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the ids of the conversations that end at a prefix, in order, with commas.

    Ids are sorted and joined to chunks in range partitions, which cut a prefix's members anywhere; what one task reads
    in order per prefix is the text of the chunks.
    """
    lengths = names.groupBy("id").agg(F.max("pos").alias("pos"))
    ends = names.join(lengths, ["id", "pos"]).select("name", "id", F.col("id").cast("string").alias("text"))

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, texts, made = None, [], []
        number = 0

        def close() -> None:
            nonlocal texts
            if texts:
                made.append((name, number, ",".join(texts).encode()))
            texts = []

        for batch in batches:
            for own, place, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != name or len(texts) >= IDS_PER_CHUNK:
                    close()
                    name, number = own, place
                texts.append(text)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["name", "place", "chunk"])
                made = []
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["name", "place", "chunk"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for own, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(chunk)
                else:
                    state.update(b"," + chunk)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    # The place of a row among all stands for its id, whatever the type of the ids.
    in_order = ends.orderBy("name", "id").select("name", F.monotonically_increasing_id().alias("place"), "text")
    chunked = in_order.mapInArrow(chunks, "name binary, place long, chunk binary")
    dealt = chunked.repartition("name").sortWithinPartitions("name", "place").select("name", "chunk")
    return dealt.mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct sequence of the first turns of a conversation, the empty one included.

    ``ids`` has a row per conversation, ``turns`` are (id, pos, symbol, chars) as from ``ordered_turns``, with the positions 1, 2, ... of
    each conversation. Returned: id (the smallest member, that is conversation that opens with the sequence), depth,
    parent_id (the parent's id; null at the root), n_members, n_children, n_leaves (nodes without children in the
    subtree, itself included), saved_chars (over the subtree, members but one times the characters of a node's last
    text), ends_sha256 (of the ids of the members that end here, in order, joined with commas; of nothing if there is none).
    Conversations without turns are members of the root. Without any conversation there is no row. The result is staged;
    the tables in between are deleted.
    """
    with Tables(ids.sparkSession) as tables:
        return tables.hand_over(_trie(ids, turns), "prefix_trie")


def _trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    deepest = turns.agg(F.max("pos")).first()[0] or 0
    blocks = _blocks(turns, deepest.bit_length())
    names = _prefix_names(ids, blocks)
    nodes = names.groupBy("name").agg(
        F.min("id").alias("id"), F.min("pos").alias("depth"), F.min("chars").alias("chars"), F.count(F.lit(1)).alias("n_members")
    )
    nodes = stage(nodes, "trie_nodes")
    # The way to every node from its smallest member; conversations that lead no node are not needed any more.
    leading = names.join(nodes.select("id").distinct(), "id", "left_semi").withColumnsRenamed({"id": "of", "pos": "depth"})
    paths = stage(leading.select("of", "depth", "name").join(nodes.select("name", "id"), "name").select("of", "depth", "id"), "trie_paths")

    up = paths.select(F.col("of").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent_id"))
    placed = stage(nodes.join(up, ["id", "depth"], "left"), "trie_parents")
    children = placed.filter("depth > 0").groupBy(F.col("parent_id").alias("id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    known = stage(placed.join(children, ["id", "depth"], "left").na.fill(0, ["n_children"]), "trie_children")

    own = known.select(
        "depth", "id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_members") - 1) * F.col("chars")).alias("saved_chars")
    )
    totals = _grafted(own, paths, deepest.bit_length(), ["n_leaves", "saved_chars"])
    listed = known.join(totals, ["depth", "id"]).join(_ends(ids, names), "name", "left")
    none = hashlib.sha256(b"").hexdigest()
    return listed.select(
        "id", "depth", "parent_id", "n_members", "n_children", "n_leaves", "saved_chars", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
