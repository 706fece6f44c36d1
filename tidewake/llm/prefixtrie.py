r"""The trie of conversations' common beginnings, by digests of blocks of turns.

Conversations' turns are cut into blocks of ``BLOCK_TURNS``. Conversations are grouped
by block digest first: those of one block behind one common beginning are an edge, of which
only their number, their smallest id and one copy of its turns go on. Only where
siblings diverge, several edges behind one beginning, are turns within blocks looked at:
their prefixes are grouped turn by turn, a row an edge instead of a row a conversation.
All other edges' turns are nodes as they stand.

A beginning is named by its depth and the exclusive or of 2 x 64-bit hashes of (place, role,
text), so that names come from running totals of blocks, within pieces of ``PIECE``
blocks and then by piece: a conversation that holds a third of all rows isn't one task's.
Places in a conversation are counted the same way, in ranges of the whole order.

Sums over a subtree take no rounds by level. A node belongs to its smallest member; a
member's own nodes are the last of its path. So the subtree of a node holds all own
nodes of its members but those of its owner above it: a second grouping of the members'
totals over edges and nodes, less a running total along the owner's path. Digests of
members that end at a node come from chunks of ids, written as text by many tasks, and
streamed by one task a node through SHA-256, which has an order.

Rows without a conversation's id are left out; a null turn stands before all others, a null role
or text is empty. Rows of one turn are in the order of role and of a hash of the text;
repeated rows are turns of their own. A conversation can have no turns after rebuilding and
still is a member of the root. An empty table gives no rows. Texts of any length count
whole; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import written

BLOCK_TURNS = 4
#: Rows of one key that a running total has in one task.
PIECE = 4096
#: Conversations' ids that can be in one chunk of text, as a power of two.
CHUNK = 12

NAME = ["depth", "x", "y"]
EDGE = ["j", "px", "py", "bx", "by"]


def words(text: Column) -> Column:
    r"""How many words [^\x20\x09-\x0D]+ a text has, without a list of them."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with ``i``, their place from 1 within their key, counted in ranges of the whole order; written."""
    ranges = written(rows.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_p", key).orderBy(*order)).cast("long")
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that go on in a next range have rows before it: fewer than there are ranges.
    starts = ranges.groupBy("_p", key).count().withColumn("_before", F.sum("count").over(before)).where(F.col("_before") > 0).drop("count")
    return ranges.withColumn("i", place).join(F.broadcast(starts), ["_p", key], "left").withColumn("i", F.col("i") + F.coalesce("_before", F.lit(0))).drop("_p", "_before")


def running(rows: DataFrame, key: str, at: str, totals: dict[str, str], total: Callable, add: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows with totals (name: column) of their key's rows before them by ``at``, 0 for the first, in pieces of PIECE."""
    pieces = rows.withColumn("_piece", F.expr(f"{at} div {PIECE}"))
    inside = Window.partitionBy(key, "_piece").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = pieces.groupBy(key, "_piece").agg(*(total(c).alias(f"_{n}") for n, c in totals.items()))
    starts = whole.withColumns({f"_{n}": total(f"_{n}").over(earlier) for n in totals}).where(F.col("_piece") > 0)
    near = pieces.withColumns({n: F.coalesce(total(c).over(inside), F.lit(0)).cast("long") for n, c in totals.items()})
    return near.join(starts, [key, "_piece"], "left").withColumns({n: add(F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(0))) for n in totals}).drop("_piece", *(f"_{n}" for n in totals))


def shared_heads(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of rebuilt conversations: (conv_id, depth, x, y, words) and (conv_id, length).

    The first h turns come from conversation c - c % 20, all others from c behind its own first h, with h = crc32(c) % 4.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), words(text).alias("words")
    )
    own = placed(light, "conv_id", "turn", "role", "a", "b").drop("turn", "role")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    turn = F.struct("i", "a", "b", "words")
    # Three turns a conversation at most.
    heads = own.where((F.col("conv_id") % 20 == 0) & (F.col("i") <= 3)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "h": h}).join(heads, "base", "left").withColumn("taken", F.greatest(taken, F.lit(0)))
    first = convs.select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t")).select("conv_id", F.col("t.i").alias("depth"), "t.a", "t.b", "t.words")
    rest = own.withColumns({"base": base, "h": h}).where(F.col("i") > F.col("h")).join(heads.select("base", F.size("head").cast("long").alias("_there")), "base", "left")
    rest = rest.select("conv_id", (F.col("i") - F.col("h") + F.least(F.col("h"), F.coalesce("_there", F.lit(0)))).alias("depth"), "a", "b", "words")
    turns = first.unionByName(rest).select("conv_id", "depth", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("a", "depth", "b").alias("y"), "words")
    return turns, convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _xor(turns: Column, part: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[part]))


def nodes_of(edges: DataFrame, sums: dict[str, Callable]) -> DataFrame:
    """(depth, x, y, parent's px and py, words) and the sums, of every node but the root; edges that diverge are grouped by turn."""
    at = lambda part, i: F.col(f"p{part}").bitwiseXOR(_xor(F.slice("turns", F.lit(1), i), part))
    node = lambda i: F.struct(F.col("turns")[i - 1]["depth"].alias("depth"), at("x", i).alias("x"), at("y", i).alias("y"), at("x", i - 1).alias("px"), at("y", i - 1).alias("py"), F.col("turns")[i - 1]["words"].alias("words"))
    rows = edges.select("alone", F.explode(F.transform(F.sequence(F.lit(1), F.size("turns")), node)).alias("node"), *sums).select("alone", "node.*", *sums)
    apart = rows.where(~F.col("alone")).groupBy("depth", "x", "y", "px", "py", "words").agg(*(f(c).alias(c) for c, f in sums.items()))
    return rows.where("alone").drop("alone").unionByName(apart)


def _ends(finals: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of nodes at which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *now, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != name:
                    if name is not None:
                        out.append((*name, digest.hexdigest()))
                    name, digest = now, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*NAME, "ends_sha256"], r)) for r in out], kind)
        if name is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*NAME, "ends_sha256"], (*name, digest.hexdigest())))], kind)

    kind = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    # A chunk's ids differ in their last CHUNK bits only.
    chunks = finals.groupBy(*NAME, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    streamed = chunks.repartition(*NAME).sortWithinPartitions(*NAME, "chunk").select(*NAME, "ids")
    return streamed.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, depth, x, y, words) whose conversations are ``members`` (conv_id, length)."""
    xor = lambda a, b: a.bitwiseXOR(b)
    members = written(members)
    # BLOCK_TURNS rows a group at most.
    blocks = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {BLOCK_TURNS}").alias("j")).agg(F.sort_array(F.collect_list(F.struct("depth", "x", "y", "words"))).alias("turns"))
    blocks = blocks.withColumns({"bx": _xor(F.col("turns"), "x"), "by": _xor(F.col("turns"), "y")})
    blocks = written(running(blocks, "conv_id", "j", {"px": "bx", "py": "by"}, F.bit_xor, xor))

    edges = written(blocks.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("turns").alias("turns")))
    fan = edges.where("j > 0").groupBy("j", "px", "py").agg((F.count("*") == 1).alias("alone"))
    # Behind the root all edges count as siblings, so that its key joins nothing.
    later = edges.where("j > 0").join(fan, ["j", "px", "py"])
    edges = written(edges.where("j = 0").withColumn("alone", F.lit(False)).unionByName(later))

    root = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    zero = {c: F.lit(0).cast("long") for c in ("depth", "x", "y", "px", "py", "words")}
    nodes = written(root.withColumns(zero).unionByName(nodes_of(edges, {"n": F.sum, "conv_id": F.min})))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")})
    nodes = written(running(nodes, "conv_id", "depth", {"leaves_above": "leaf", "saved_above": "saved"}, F.sum, lambda a, b: a + b))

    # What each conversation owns, summed over the members of edges and nodes.
    owned = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves_in"), F.sum("saved").alias("saved_in"))
    sums = {"leaves_in": F.sum, "saved_in": F.sum}
    weighed = blocks.join(owned, "conv_id").groupBy(*EDGE).agg(*(f(c).alias(c) for c, f in sums.items()))
    below = nodes_of(edges.join(weighed, EDGE), sums).select(*NAME, *sums)
    whole = owned.agg(*(f(c).alias(c) for c, f in sums.items())).where("leaves_in > 0").withColumns({c: zero[c] for c in NAME})
    below = below.unionByName(whole)

    last = blocks.select("conv_id", "j", F.col("px").bitwiseXOR(F.col("bx")).alias("x"), F.col("py").bitwiseXOR(F.col("by")).alias("y"))
    finals = members.where("length > 0").withColumn("j", F.expr(f"(length - 1) div {BLOCK_TURNS}")).join(last, ["conv_id", "j"]).select("conv_id", F.col("length").alias("depth"), "x", "y")
    finals = finals.unionByName(members.where("length = 0").select("conv_id", *(zero[c].alias(c) for c in NAME)))

    # The root's children, of which there may be as many as conversations, don't join: their parent's id is the least of all.
    named = nodes.select(F.col("depth").alias("_d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    second = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(members.agg(F.min("conv_id")).first()[0]).cast("long"))
    deeper = nodes.where("depth > 1").withColumn("_d", F.col("depth") - 1).join(named.where("_d > 0"), ["_d", "px", "py"]).drop("_d")
    every = top.unionByName(second).unionByName(deeper)
    # Members without a node of their own own nothing: a node's owner is a member that does, so the inner joins lose none.
    out = every.join(below, NAME).join(_ends(finals), NAME, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("leaves_in") - F.col("leaves_above")).alias("n_leaves"),
        (F.col("saved_in") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
