"""A trie of conversation prefixes, its subtrees summed by leaf-peeling message passing.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then its own turns after its first h, where h is
crc32 of the decimal c, mod 6. A node is a distinct sequence of the first d rebuilt turns; its members are the conversations that start with it.

1. Turns become narrow where they are read: 16 bytes of a hash of (role, text), and the code points of the text. Texts go no further.
2. Per conversation, in order, a running hash of the turns so far names the node of each depth (a task holds one hash, not the
   conversation). Nodes are counted with partial aggregation, so a node that a third of all conversations share is one row per task.
3. Along a conversation the nodes with the same smallest member and as many members form a run, in which no node but the last has
   children apart or ends; a run is one row of the peeling.
4. Peeling: every run holds the number of its children that have not reported. Runs without any are complete: they send leaves and tokens of
   their subtree to their parents, added up per parent, and the parents' counters go down; this goes on until the root alone is left and
   finishes. The rounds are the tree's height in runs, not its depth in turns.
5. Sums within a run, and of what hangs below it, give the totals of its nodes.

Hashes of 128 bits name nodes; sequences are equal if theirs are.

Nulls and edge cases: turns are ordered by turn, null first, ties by md5 of role and text; a null role or text is an empty string; rows
without a conv_id belong to no conversation and make no node; repeated rows are turns of their own; a conversation of which nothing
is left after rebuilding is a member of the root alone; an empty table gives no node, not even the root; negative ids have the
remainder of the same sign, as in SQL; other columns are ignored, whatever their names. Long texts are only hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, materialise

#: Ids that share their first turns, and the bound of h.
BLOCK, SHARED = 100, 6
#: The name of the root.
ROOT = bytes(16)


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), turn digest, chars."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    narrow = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.unhex(F.md5(content)).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return narrow.select("conv_id", F.row_number().over(order).alias("i"), "digest", "chars")


def rebuilt_turns(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, part, i, digest, chars), in order of part and i, and the conversations (conv_id, base, h)."""
    convs = numbered.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    first = numbered.where(F.col("i") < SHARED).select(F.col("conv_id").alias("base"), "i", "digest", "chars")
    # At most five turns of a base, each for at most a hundred conversations.
    taken = convs.where("h > 0").join(first, "base").where("i <= h").select("conv_id", F.lit(0).alias("part"), "i", "digest", "chars")
    own = numbered.where(F.col("i") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "i", "digest", "chars")
    return taken.unionByName(own), convs


def name_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, node, parent, chars) of each turn, from turns in order; the running hash is all that is held."""
    conv, depth, name = None, 0, ROOT
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("depth", "node", "parent")}
        ids = batch.column(batch.schema.get_field_index("conv_id"))
        for c, digest in zip(ids.to_pylist(), batch.column(batch.schema.get_field_index("digest")).to_pylist()):
            if c != conv:
                conv, depth, name = c, 0, ROOT
            out["parent"].append(name)
            depth, name = depth + 1, hashlib.blake2b(name + digest, digest_size=16).digest()
            out["depth"].append(depth)
            out["node"].append(name)
        yield pa.record_batch([ids, pa.array(out["depth"], pa.int64()), pa.array(out["node"], pa.binary()), pa.array(out["parent"], pa.binary()), batch.column(batch.schema.get_field_index("chars"))], ["conv_id", "depth", "node", "parent", "chars"])


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from (node, conv_id) in order; ids are hashed as they pass."""
    node, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for at, conv in zip(batch.column(batch.schema.get_field_index("node")).to_pylist(), batch.column(batch.schema.get_field_index("conv_id")).to_pylist()):
            if at != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = at, hashlib.sha256(str(conv).encode())
            else:
                running.update(f",{conv}".encode())
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], ["node", "ends_sha256"])
    if running is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def peel(runs: DataFrame) -> DataFrame:
    """(run, leaves, saved below and in it) of each run, from (run, parent, waits: children, leaf: 1 or 0, own).

    A table per round in the shared folder: what still waits, and what this round completed.
    """
    spent, complete = [], []
    waiting = runs.select("run", "parent", "waits", F.col("leaf").alias("leaves"), F.col("own").alias("saved"))
    while True:
        waiting = materialise(waiting, "waiting")
        spent.append(waiting)
        done = waiting.where("waits = 0")
        complete.append(done.select("run", "leaves", "saved"))
        left = waiting.where("waits > 0")
        if not left.limit(1).count():
            break
        sent = done.groupBy(F.col("parent").alias("_to")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        got = left.join(sent, F.col("run") == F.col("_to"), "left")
        waiting = got.select("run", "parent", (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"))
    out = complete[0]
    for part in complete[1:]:
        out = out.unionByName(part)
    out = materialise(out, "peeled")
    for table in spent:
        drop_table(table)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    numbered = materialise(numbered_turns(conversations), "turns")
    turns, convs = rebuilt_turns(numbered)
    named = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i").select("conv_id", "digest", "chars").mapInArrow(name_nodes, "conv_id long, depth long, node binary, parent binary, chars long")
    named = materialise(named, "named")

    # depth, parent and chars follow from the node; as keys they leave two numbers to aggregate.
    inner = named.groupBy("node", "depth", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).select("node", "conv_id", "depth", "parent", "n_convs", "chars")
    root = convs.agg(F.lit(ROOT).alias("node"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("chars")).where("n_convs > 0")
    bare = inner.unionByName(root)
    children = inner.groupBy(F.col("parent").alias("_node")).agg(F.count("*").alias("n_children"))
    nodes = bare.join(children, F.col("node") == F.col("_node"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("_node")
    nodes = materialise(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    # Runs, each with its last node's children; a run's name is its last node's, so children find it by their parent.
    ends = F.struct("depth", "node", "n_children")
    runs = nodes.groupBy("conv_id", "n_convs").agg(F.max(ends).alias("last"), F.min(F.struct("depth", "parent")).alias("top"), F.sum("own").alias("own"))
    runs = runs.select(F.col("last.node").alias("run"), F.col("top.parent").alias("parent"), F.col("last.n_children").alias("waits"), (F.col("last.n_children") == 0).cast("long").alias("leaf"), "own", "conv_id", "n_convs")
    runs = materialise(runs, "runs")
    peeled = peel(runs)
    totals = runs.select("run", "conv_id", "n_convs").join(peeled, "run").select(F.col("conv_id").alias("_conv"), F.col("n_convs").alias("_n"), "leaves", "saved")

    # A node has what its run has, less what stands above it in the run.
    above = Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumn("above", F.coalesce(F.sum("own").over(above), F.lit(0)))
    summed = placed.join(totals, (F.col("conv_id") == F.col("_conv")) & (F.col("n_convs") == F.col("_n"))).withColumn("saved_tokens", F.col("saved") - F.col("above"))

    parents = nodes.select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id"))
    last = named.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last")).select("conv_id", F.col("last.node").alias("node"))
    rootless = convs.select("conv_id").join(last.select(F.col("conv_id").alias("_conv")), F.col("conv_id") == F.col("_conv"), "left_anti").select("conv_id", F.lit(ROOT).alias("node"))
    digests = last.unionByName(rootless).repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(digest_ends, "node binary, ends_sha256 string").withColumnRenamed("node", "_end")
    out = summed.join(parents, F.col("parent") == F.col("_node"), "left").join(digests, F.col("node") == F.col("_end"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
