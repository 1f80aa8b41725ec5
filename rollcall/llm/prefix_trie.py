"""The trie of shared conversation beginnings, with totals of every subtree by tree contraction.

A conversation is its turns in order; two turns are equal if role and text are. A node of the
trie is a distinct sequence of first turns, its members are the conversations that start with
it. Totals over subtrees come from parallel tree contraction (rake and compress):

* *rake* takes away all leaves and adds what they have gathered to their parents,
* *compress* takes away all chains of nodes with one child left: each node of a chain doubles
  its pointer down the chain until it points at the chain's lower end, adding up what it passes,
  and the lower end becomes a child of the node above the chain,

in turns until nothing is left. After a compress every inner node has two children or more, so a
round takes away at least half of the nodes, however deep or wide the tree is. A raked node has
its total; a compressed one has the total of its chain's lower end plus a known difference, and
gets it when the rounds are gone through backwards. All joins are on keys that are unique on
both sides, and what goes to a parent is an aggregate, so neither a node with a third of all
nodes as children nor a conversation with a third of all turns makes a large task.

Turns are numbered, and sequences hashed, in slices: a sequence's key is a sum of 128 bits of
hash per turn and place, so prefixes are running sums, of which only one row per slice takes
part in the pass over a whole conversation.

Rows without a conv_id belong to no conversation. A null turn comes first, equal turn numbers
are in the order of role and the text's digest; null roles and texts are empty. Repeated rows
are turns of their own. No rows give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised
from rollcall.operators.keyed import running_sums

FAMILY, MOST_SHARED = 5, 9
# Four sums of 32 bits a turn: no overflow below 2^31 turns, 128 bits to tell sequences apart.
SUMS = ["s0", "s1", "s2", "s3"]
IDS_PER_PIECE = 1 << 16


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), size (turns of the conversation), role_text (digest) and n_bytes of the text.

    Rows are ranged by conversation and turn, so a long conversation is spread over several
    slices; numbers inside a slice are shifted by the rows of the slices before it.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("role_text"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["turn", "role", "role_text"]
    sliced = materialised(turns.repartitionByRange("conv_id", *order).select("*", F.spark_partition_id().alias("slice")), "turns")
    runs = sliced.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("conv_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
                       F.sum("n").over(W.partitionBy("conv_id")).alias("size"))
    inside = W.partitionBy("conv_id", "slice").orderBy(*order)
    return sliced.withColumn("place", F.row_number().over(inside) - 1).join(runs, ["conv_id", "slice"]).select(
        "conv_id", (F.col("place") + F.col("shift")).alias("pos"), "size", "role_text", "n_bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family.

    conv_id c takes its first h turns, h = crc32(c) % ``most``, from conversation c - c % ``family``
    (fewer or none if it has no more) and goes on with its own turns after its first h. Gives the
    turns (conv_id, depth from 1, length, role_text, n_bytes) and every conv_id with its length.
    """
    c = F.col("conv_id")
    sizes = turns.where("pos = 0").select("conv_id", "size")
    convs = sizes.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % most, "base": c - c % family})
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("held")), "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("held", F.lit(0))))
    convs = materialised(convs.select("conv_id", "base", "h", "taken", (
        F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "length", "role_text", "n_bytes")
    heads = turns.where((F.col("pos") < most - 1) & (c % family == 0)).select(
        c.alias("base"), "pos", "role_text", "n_bytes")
    lent = heads.join(convs, "base").where("pos < taken").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "length", "role_text", "n_bytes")
    return own.unionByName(lent), convs.select("conv_id", "length")


def _key(depth, sums) -> F.Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, length, role_text, n_bytes) with the keys of the node they lead to and of its parent."""
    both = [F.xxhash64("depth", "role_text"), F.xxhash64(F.lit("again"), "role_text", "depth")]
    halves = [x for h in both for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    hashed = materialised(turns.withColumns(dict(zip(["x0", "x1", "x2", "x3"], halves))), "hashed")
    summed = running_sums(hashed, ["conv_id"], "depth", {s: F.col(f"x{i}") for i, s in enumerate(SUMS)})
    return summed.select(
        "conv_id", "depth", "length", "n_bytes", _key(F.col("depth"), [F.col(s) for s in SUMS]).alias("node"),
        _key(F.col("depth") - 1, [F.col(s) - F.col(f"x{i}") for i, s in enumerate(SUMS)]).alias("parent"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """node and the SHA-256 of the conv_ids that end there, in decimal, ascending, with commas between.

    A digest can't be cut in pieces, but its text can: tasks write out runs of ids, and only a
    node's finished pieces meet, one after the other, in the task that digests them.
    """

    schema = pa.schema([("node", pa.string()), ("first", pa.int64()), ("text", pa.string())])

    def pieces(batches):
        node, ids = None, []
        for batch in batches:
            done = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (key != node or len(ids) == IDS_PER_PIECE):
                    done.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_pylist([{"node": node, "first": ids[0], "text": ",".join(map(str, ids))}], schema)

    def digests(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    made = ranged.mapInArrow(pieces, "node string, first long, text string")
    return made.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, ends_sha256 string")


def _raked(alive: DataFrame, amounts: list[str]) -> DataFrame:
    """The nodes that had children left, with what their leaves had gathered."""
    gifts = alive.where("kids = 0 AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("gone"), *[F.sum(F.col(a) + F.col(f"up_{a}")).alias(f"got_{a}") for a in amounts])
    none = F.lit(0)
    return alive.where("kids > 0").join(gifts, "node", "left").select(
        "node", "parent", (F.col("kids") - F.coalesce("gone", none)).alias("kids"),
        *[(F.col(a) + F.coalesce(f"got_{a}", none)).alias(a) for a in amounts], *[f"up_{a}" for a in amounts])


def _chains(alive: DataFrame, amounts: list[str]) -> DataFrame | None:
    """For every node of a chain: its parent, its child, ``low`` (the chain's lower end) and the sum from it down to there."""
    unary = alive.where("kids = 1 AND parent IS NOT NULL")
    if unary.isEmpty():
        return None
    only = alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n"), F.max(F.struct("node", *[f"up_{a}" for a in amounts])).alias("c")).where("n = 1")
    steps = materialised(unary.join(only, "node").select(
        "node", "parent", F.col("c.node").alias("child"), F.col("c.node").alias("low"), F.lit(False).alias("ended"),
        *[f"up_{a}" for a in amounts], *[(F.col(a) + F.col(f"c.up_{a}")).alias(a) for a in amounts]), "chains")
    while not steps.where("NOT ended").isEmpty():
        ahead = steps.select(F.col("node").alias("low"), F.col("low").alias("next"), F.col("ended").alias("next_ended"),
                             *[F.col(a).alias(f"next_{a}") for a in amounts])
        found = F.col("next").isNotNull()
        moved = steps.where("NOT ended").join(ahead, "low", "left").select(
            "node", "parent", "child", F.coalesce("next", "low").alias("low"),
            (~found | F.col("next_ended")).alias("ended"), *[f"up_{a}" for a in amounts],
            *[(F.col(a) + F.coalesce(f"next_{a}", F.lit(0))).alias(a) for a in amounts])
        steps = materialised(steps.where("ended").unionByName(moved), "chains")
    return steps


def _compressed(alive: DataFrame, chains: DataFrame, amounts: list[str]) -> DataFrame:
    """``alive`` without its chains: their lower ends hang from the node above, the chain's sum on the edge."""
    tops = chains.join(chains.select(F.col("child").alias("node")), "node", "left_anti").select(
        F.col("low").alias("node"), F.col("parent").alias("above"),
        *[(F.col(a) + F.col(f"up_{a}")).alias(f"chain_{a}") for a in amounts])
    return alive.where("NOT (kids = 1 AND parent IS NOT NULL)").join(tops, "node", "left").select(
        "node", F.coalesce("above", "parent").alias("parent"), "kids", *amounts,
        # The chain's sum ends with the old edge of its lower end, so it takes that edge's place.
        *[F.coalesce(f"chain_{a}", f"up_{a}").alias(f"up_{a}") for a in amounts])


def subtree_sums(nodes: DataFrame, amounts: list[str]) -> DataFrame:
    """node and, for each of ``amounts`` (whole numbers), the sum over its subtree, itself included.

    ``nodes`` has node, parent (null for a root), kids (its number of children) and the amounts;
    it may hold several trees.
    """
    alive = materialised(nodes.select(
        "node", "parent", "kids", *amounts, *[F.lit(0).cast("long").alias(f"up_{a}") for a in amounts]), "alive")
    known, contracted = None, []
    while not alive.isEmpty():
        leaves = alive.where("kids = 0").select("node", *amounts)
        known = leaves if known is None else known.unionByName(leaves)
        alive = materialised(_raked(alive, amounts), "raked")
        chains = _chains(alive, amounts)
        if chains is not None:
            contracted.append(chains.select("node", "low", *amounts))
            alive = materialised(_compressed(alive, chains, amounts), "alive")
    for chains in reversed(contracted):
        below = known.select(F.col("node").alias("low"), *[F.col(a).alias(f"low_{a}") for a in amounts])
        expanded = chains.join(below, "low").select("node", *[(F.col(a) + F.col(f"low_{a}")).alias(a) for a in amounts])
        known = known.unionByName(materialised(expanded, "expanded"))
    return known if known is not None else alive.select("node", *amounts)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (see :func:`rebuilt`); ``convs`` names every conversation, turnless ones as well.

    node and parent (keys; the root's parent is null), depth, conv_id (the smallest member),
    parent_conv_id, n_convs, n_children, n_bytes (of the last text), n_leaves and saved_tokens
    (bytes of texts that members share, both over the subtree), and ends_sha256.
    """
    reached = materialised(prefixes(turns), "prefixes")
    top = _key(F.lit(0), [F.lit(0)] * len(SUMS))
    inner = reached.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        top.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    own = materialised(inner.unionByName(root), "nodes")
    children = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialised(own.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    sums = subtree_sums(nodes.select(
        "node", "parent", F.col("n_children").alias("kids"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = reached.where("depth = length").select("node", "conv_id").unionByName(
        convs.where("length = 0").select(top.alias("node"), "conv_id"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(sums, "node").join(ends_digests(ends), "node", "left").join(above, "parent", "left").select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_bytes", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns, convs = rebuilt(materialised(numbered(conversations), "numbered"))
    return trie(turns, convs)
