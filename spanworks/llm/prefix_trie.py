"""A trie of conversations by their turns, built by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, staged

#: A conversation opens with the first turns of the first conversation of its hundred: up to five of them.
GROUP, OPENINGS = 100, 6
#: Turns by which one round refines the classes: 1, 2, 4, ... up to this.
MOST_TURNS = 256
#: Depths of a unary chain that are written out together.
TAIL = 4096

_NOTHING = hashlib.sha256(b"").hexdigest()


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv_id.cast("string")) % OPENINGS


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars) per turn, staged: pos counts from 1 by turn (null first), role and text; key stands for
    role and text, chars counts the text's code points. The rows are sorted by ranges and counted in each, so that no
    task holds a conversation of many turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.select("conv_id", "turn", "role", F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256).alias("key"), F.char_length("text").cast("long").alias("chars"), "text")
    ranged = staged(turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "text").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("ahead"))
    line = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = ranged.withColumn("row", F.row_number().over(line)).join(ahead, ["conv_id", "part"])
    out = staged(placed.select("conv_id", (F.col("row") + F.col("ahead")).alias("pos"), "key", "chars"))
    discard(ranged)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of all conversations and (conv_id, depth, key, chars) of their turns by ranges of depth, staged:
    the opening of each hundred's first conversation, then a conversation's own turns after as many."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", opening(F.col("conv_id")))
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = staged(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    openings = turns.where(F.col("pos") < OPENINGS).withColumnRenamed("conv_id", "base")
    opened = convs.where("taken > 0").join(openings, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "key", "chars")
    kept = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "key", "chars")
    return convs, staged(opened.union(kept).repartitionByRange("depth", "conv_id"))


def refined(convs: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Lists of staged tables: shared nodes (owner, depth, parent, n, chars), retired conversations (conv_id, depth, parent,
    length) and ends in shared nodes (owner, depth, conv_id). A class is named by its owner, its smallest member.

    All conversations are one class at first. A round splits every active class turn by turn, over a few turns at once: a
    member's walk is the chain of hashes of its turns since the round began, and members part where their walks do. A
    class that comes down to one member retires with the depth where it did. Members that have ended leave their class;
    the others of shared classes go on to the next round, over twice as many turns."""
    top = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).first()
    root = convs.sparkSession.createDataFrame([(top.owner, 0, None, top.n, 0)], "owner long, depth long, parent long, n long, chars long")
    shared, retired = [root], []
    ends = [convs.where("length = 0").select(F.lit(top.owner).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id")]
    active = staged(convs.where("length > 0").select("conv_id", "length", F.lit(top.owner).cast("long").alias("class")))
    since, width = 0, 1
    same = ["class", "depth", "walk"]
    while active.limit(1).count():
        block = turns.where((F.col("depth") > since) & (F.col("depth") <= since + width)).join(active, "conv_id")
        steps = F.array_sort(F.collect_list(F.struct("depth", "key", "chars")))
        start = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit("").alias("walk"), F.lit("").alias("before"), F.lit(0).cast("long").alias("chars")))
        step = lambda acc, x: F.concat(acc, F.array(F.struct(x.depth.alias("depth"), F.sha2(F.concat(F.element_at(acc, -1).walk, x.key), 256).alias("walk"), F.element_at(acc, -1).walk.alias("before"), x.chars.alias("chars"))))
        walks = staged(block.groupBy("class", "conv_id", "length").agg(F.aggregate(steps, start, step).alias("walk")).withColumn("walk", F.slice("walk", 2, width)))
        each = walks.select("class", "conv_id", "length", F.inline("walk"))
        nodes = staged(each.groupBy(*same, "before").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("length").alias("length")))
        classes = nodes.where("n > 1")
        above = classes.select("class", (F.col("depth") + 1).alias("depth"), F.col("walk").alias("before"), F.col("owner").alias("parent"))
        first = nodes.where(F.col("depth") == since + 1).withColumn("parent", F.col("class"))
        linked = staged(first.unionByName(nodes.where(F.col("depth") > since + 1).join(above, ["class", "depth", "before"])).select("owner", "depth", "parent", "n", "chars", "length"))
        shared.append(linked.where("n > 1").drop("length"))
        retired.append(linked.where("n = 1").select(F.col("owner").alias("conv_id"), "depth", "parent", "length"))
        last = walks.select("class", "conv_id", "length", F.element_at("walk", -1).alias("last")).select("class", "conv_id", "length", "last.depth", "last.walk")
        going = staged(last.join(classes.select(*same, "owner"), same).select("owner", "depth", "conv_id", "length"))
        ends.append(going.where("length = depth").drop("length"))
        gone, active = active, staged(going.where("length > depth").select("conv_id", "length", F.col("owner").alias("class")))
        discard(gone, walks, nodes)
        since, width = since + width, min(2 * width, MOST_TURNS)
    return shared, retired, ends


def folded(shared: DataFrame, retired: DataFrame) -> DataFrame:
    """shared with n_children, n_leaves and saved_tokens, summed over subtrees.

    Every class has an owner that also owns one of its children, unless it ends there; so the trie falls apart into paths of
    one owner each. A path's sums go up to the node it hangs from, from there with its path's further up, as often as
    paths hang from paths. Within a path, the sums are added up from its end."""
    children = shared.where("parent is not null").select("parent", "depth").union(retired.select("parent", "depth"))
    children = children.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tails = retired.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("tails"))
    nodes = shared.join(children, ["owner", "depth"], "left").join(tails, ["owner", "depth"], "left").na.fill(0, ["n_children", "tails"])
    leaves = F.col("tails") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    nodes = staged(nodes.select("owner", "depth", "parent", "n", "n_children", leaves.alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")))
    hung = nodes.where("parent is not null and parent <> owner").select("owner", "parent", (F.col("depth") - 1).alias("at"))
    sums = nodes.groupBy("owner").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    added, rising = [], staged(sums.join(hung, "owner").select("parent", "at", "leaves", "saved"))
    while rising.limit(1).count():
        added.append(rising)
        sums = rising.groupBy(F.col("parent").alias("owner")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        rising = staged(sums.join(hung, "owner").select("parent", "at", "leaves", "saved"))
    for rows in added:
        nodes = nodes.unionByName(rows.select(F.col("parent").alias("owner"), F.col("at").alias("depth"), "leaves", "saved"), allowMissingColumns=True)
    nodes = nodes.groupBy("owner", "depth").agg(*[F.max(c).alias(c) for c in ("parent", "n", "n_children")], *[F.sum(c).alias(c) for c in ("leaves", "saved")])
    below = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.select("owner", "depth", "parent", "n", "n_children", F.sum("leaves").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of the nodes where conversations end: ids are joined by ranges, and the pieces of a node
    go through one hash in order, as a stream; no task holds a node's ids."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, list[int]] = {}
            for owner, depth, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                out.setdefault((owner, depth), []).append(conv_id)
            rows = [(*node, ids[0], ",".join(map(str, ids))) for node, ids in out.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("owner", "depth", "first", "ids"), r)) for r in rows], schema=pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for owner, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, depth) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(done)
        if now:
            yield _digests([(*now, state.hexdigest())])

    strings = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(joined, "owner long, depth long, first long, ids string")
    return strings.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(hashed, "owner long, depth long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("owner", "depth", "ends_sha256"), r)) for r in rows], schema=pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))


def chains(retired: DataFrame) -> DataFrame:
    """The nodes that one conversation has to itself, from where it retired to its end. Long ones are dealt out in parts."""
    parts = retired.withColumn("from", F.explode(F.sequence("depth", "length", F.lit(TAIL).cast("long"))))
    parts = parts.where(F.col("length") - F.col("depth") < TAIL).union(parts.where(F.col("length") - F.col("depth") >= TAIL).repartition("conv_id", "from"))
    nodes = parts.select("*", F.explode(F.sequence("from", F.least(F.col("from") + TAIL - 1, F.col("length")))).alias("at"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ended = F.col("at") == F.col("length")
    return nodes.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(ended, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(ended, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NOTHING).alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn is first; turns of equal number go by role, then text, and equal ones each
    count. Rows without a conv_id belong to no conversation and are not read. A negative conv_id's hundred is that of
    SQL's %. Equal turns are told by SHA-256. An empty table gives no rows; without turns there is the root alone. Other
    columns are not read. Texts are shuffled to be put in order, from then on their hashes. Rounds grow with the logarithm
    of the greatest depth that two conversations share, up to MOST_TURNS turns a round.
    """
    turns = numbered(conversations)
    convs, placed = rebuilt(turns)
    discard(turns)
    if not convs.limit(1).count():
        return chains(convs.select("conv_id", F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("parent"), "length").where("false"))
    shared, retired, ends = (_all(rows) for rows in refined(convs, placed))
    retired = retired if retired is not None else convs.select("conv_id", F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("parent"), "length").where("false")
    nodes = folded(staged(shared), retired).join(staged(end_digests(ends)), ["owner", "depth"], "left")
    nodes = nodes.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    return nodes.union(chains(retired))


def _all(tables: list[DataFrame]) -> DataFrame | None:
    whole = None
    for rows in tables:
        whole = rows if whole is None else whole.unionByName(rows)
    return whole
