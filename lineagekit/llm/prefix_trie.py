"""The trie of conversations' turns, by prefix doubling.

Turns get dense names; blocks of a power of two of turns get theirs from the names of their halves, a join
round for each power. The prefix of ``d`` turns falls into blocks by the binary digits of ``d``, largest
first; its name comes from that of the prefix before its last block and from that block's, again a round
for each power. Equal names are equal sequences, so grouping rows by name gives the nodes. Both ways take
the logarithm of the longest conversation in rounds, and about twice the turns in rows altogether.

No task holds a conversation or the members of a node: positions in a conversation and sums along it come
from ranges of rows and small carries between them (:func:`running`), names go back to rows by joins whose
most frequent keys, at most 63 by their share, are broadcast (:func:`looked_up`), counts of nodes are
grouped aggregates, and the ids that end at a node are packed before they are hashed as a stream.

What belongs to a subtree needs no walk over it: each node is charged to its smallest member, at its depth.
A member's charges from a depth on, summed over the members of a node, are those of the node's subtree.

Turns are ordered by turn (null first), then role and text, which settles ties; repeated rows are repeated
turns. Null roles and texts are empty strings. Rows without a conv_id are left out. Turns are told apart by
SHA-256 over role and text (the role's length before them). An empty table has no conversation, so no node,
not even the root. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, table, written

#: A key with more than this share of the rows is joined by broadcast: there are fewer than its reciprocal.
HOT_SHARE = 64
#: Characters of ids that are packed into a row before they are hashed.
PACKED = 1 << 16
ROOT = 0
#: Conversations borrow the first turns of the first conversation of their group of GROUP; at most MOST of them.
GROUP, MOST = 20, 3


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has each of ``keys`` once and how many rows have it.

    Keys of more than a 64th of all rows are fewer than 64 and broadcast; the others are shuffled.
    """
    total = found.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = found.where(F.col(count) * HOT_SHARE > total).drop(count)
    if hot.isEmpty():
        return rows.join(found.drop(count), keys)
    cold = found.where(F.col(count) * HOT_SHARE <= total).drop(count)
    often = rows.join(F.broadcast(hot), keys)
    return often.unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys))


def named(rows: DataFrame, keys: list[str], start: int) -> tuple[DataFrame, int]:
    """``rows``, a written table, with ``name``: dense numbers from ``start`` on, one for each value of ``keys``.

    Also the first number that is free."""
    counted = rows.groupBy(keys).agg(F.count("*").alias("_count"))
    once = written(counted.withColumn("_at", F.monotonically_increasing_id()), "names")
    sizes = sorted((r[0], r[1]) for r in once.groupBy(F.shiftright("_at", 33)).count().collect())
    offsets, free = [], start
    for part, size in sizes:
        offsets.append((part, free))
        free += size
    spark = rows.sparkSession
    small = spark.createDataFrame(offsets, "_part long, _first long")  # a row a partition
    once = once.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(small), "_part")
    once = once.select(*keys, "_count", (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("name"))
    return looked_up(rows, once, keys, "_count"), free


def running(rows: DataFrame, group: str, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows``, a written table, with ``at`` (place in its group from 0) and running sums ``sum_x`` in ``order``.

    Rows are sorted over ranges of (group, order), so a group may span many tasks; what a range's first group
    has before it is carried over, a row a range. ``group`` is a long without nulls."""
    spark, keys = rows.sparkSession, [F.col(group), *order]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    made = ["at", *(f"sum_{s}" for s in sums)]
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int", *(f"{m} long" for m in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, part = None, [0] * len(made), TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index(group)).to_numpy()
            first = np.concatenate([[True], own[1:] != own[:-1]])
            head = np.flatnonzero(first)[np.cumsum(first) - 1]  # where each row's group begins in the batch
            values = [np.ones(len(own), dtype=np.int64), *(batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in sums)]
            out = []
            for i, v in enumerate(values):
                total = np.cumsum(v)
                total = total - (total[head] - v[head])
                if own[0] == last:
                    total[own == own[0]] += carry[i]
                carry[i] = int(total[-1])
                out.append(pa.array(total - (i == 0), pa.int64()))
            last = own[-1]
            names = [*batch.schema.names, "_part", *made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, dtype=np.int32)), *out], names)

    local = written(dealt.mapInArrow(run, spec), "ranges")
    ends = F.max_by(F.struct(*(F.col(m) + (1 if m == "at" else 0) for m in made)), F.struct(group, "at"))
    carried, last, carry = [], None, [0] * len(made)
    for part, low, high, end in sorted(local.groupBy("_part").agg(F.min(group), F.max(group), ends).collect()):
        if low == last:
            carried.append((part, low, *carry))
        carry = [a + b for a, b in zip(carry, end)] if low == high == last else list(end)
        last = high
    names = [f"_{m}" for m in made]
    small = spark.createDataFrame(carried, ", ".join(["_part int", f"`{group}` long", *(f"{n} long" for n in names)]))  # a row a range
    joined = local.join(F.broadcast(small), ["_part", group], "left")
    return joined.select(*rows.columns, *((F.col(m) + F.coalesce(n, F.lit(0))).alias(m) for m, n in zip(made, names)))


def rebuilt(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, at, turn (digest), words of the rebuilt conversations; and all conv_ids."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn_at"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # texts are needed for ties only, and their order is that of their bytes
    rows = rows.select("conv_id", "turn_at", "role", "text", digest.alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    own = running(rows, "conv_id", [F.col("turn_at").asc_nulls_first(), F.col("role"), F.col("text")], [])
    own = written(own.select("conv_id", "at", "digest", "words"), "turns")
    convs = written(own.groupBy("conv_id").count().select("conv_id"), "convs")
    h, base = F.crc32(F.col("conv_id").cast("string")) % (MOST + 1), F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("at") < MOST).select(F.col("conv_id").alias("base"), "at", "digest", "words")
    borrowed = convs.select("conv_id", base.alias("base"), h.alias("h")).join(heads, "base").where("at < h")
    both = borrowed.select("conv_id", F.lit(0).alias("own"), F.col("at").alias("place"), "digest", "words")
    both = both.unionByName(own.where(F.col("at") >= h).select("conv_id", F.lit(1).alias("own"), F.col("at").alias("place"), "digest", "words"))
    placed = running(written(both, "rebuilt"), "conv_id", [F.col("own"), F.col("place")], [])
    return written(placed.select("conv_id", "at", "digest", "words"), "placed"), convs


def prefix_names(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, name: a row for each prefix of each conversation, the empty one (ROOT) too."""
    level, free = named(turns.select("conv_id", F.col("at").alias("block"), "digest"), ["digest"], ROOT + 1)
    levels = [written(level.select("conv_id", "block", "name"), "blocks")]
    while True:
        # the halves of a block meet; a last block without its other half goes no further
        half = F.col("block") % 2
        pairs = levels[-1].groupBy("conv_id", F.expr("block div 2").alias("block")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        pairs = written(pairs.where("left is not null and right is not null"), "pairs")
        if pairs.isEmpty():
            break
        level, free = named(pairs, ["left", "right"], free)
        levels.append(written(level.select("conv_id", "block", "name"), "blocks"))
    known = written(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("name")), "prefixes")
    done = [known]
    for power in range(len(levels) - 1, -1, -1):
        # a prefix ends with a block of this power where it is the first of two; what is before has larger blocks
        size = 1 << power
        blocks = levels[power].where("block % 2 = 0").select("conv_id", (F.col("block") * size).alias("depth"), F.col("name").alias("right"))
        pairs = blocks.join(known.withColumnRenamed("name", "left"), ["conv_id", "depth"]).select("conv_id", (F.col("depth") + size).alias("depth"), "left", "right")
        level, free = named(written(pairs, "pairs"), ["left", "right"], free)
        done.append(written(level.select("conv_id", "depth", "name"), "prefixes"))
        known = known.unionByName(done[-1])
    return known


def ends_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of rows (name, conv_id): the ids in order, joined by commas and hashed.

    A hash takes its bytes in order, so a name's ids must pass through one task. They come there packed, a row
    for some thousands, and as a stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, name, first, held, size, out = TaskContext.get().partitionId(), 0, None, None, [], 0, []
        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (own != name or size > PACKED):
                    out.append((name, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    name, first = own, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), o)) for o in out], schema=packed)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([{"name": name, "first": first, "ids": ",".join(held)}], schema=packed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own == name:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((name, state.hexdigest()))
                name, state = own, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "ends_sha256"), o)) for o in out], schema=hashed)
            out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": state.hexdigest()}], schema=hashed)

    packed = pa.schema([("name", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    hashed = pa.schema([("name", pa.int64()), ("ends_sha256", pa.string())])
    n = partitions(ends.sparkSession)
    chunks = ends.select("name", "conv_id").repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pack, "name long, first long, ids string")
    return chunks.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(digest, "name long, ends_sha256 string")


def prefix_trie(talks: DataFrame) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prepare(talks.sparkSession)
    turns, convs = rebuilt(talks)
    prefixes = written(prefix_names(turns, convs), "all_prefixes")
    members = written(prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs")), "members")
    # a node's last turn and its parent are those of its smallest member
    words = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "words")
    before = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = members.join(words, ["conv_id", "depth"], "left").join(before, ["conv_id", "depth"], "left")
    nodes = written(nodes.withColumn("words", F.coalesce("words", F.lit(0))), "nodes")
    children = written(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    # charges of the nodes at their smallest members, summed from the deepest prefix upwards
    childless = nodes.join(children.select(F.col("parent").alias("name")), "name", "left_anti").select("conv_id", "depth", F.lit(1).cast("long").alias("leaf"))
    charges = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).join(childless, ["conv_id", "depth"], "left")
    charged = prefixes.join(charges, ["conv_id", "depth"], "left").select("conv_id", "depth", "name", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    summed = written(running(written(charged, "charges"), "conv_id", [F.col("depth").desc()], ["saved", "leaf"]), "summed")
    totals = summed.groupBy("name").agg(F.sum("sum_saved").alias("saved_tokens"), F.sum("sum_leaf").alias("n_leaves"))
    ends = ends_digests(summed.where("at = 0"))  # the deepest prefix of a conversation
    # a parent with many children is a frequent key
    above = members.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(children, "parent")
    parents = looked_up(nodes.where("parent is not null").select("name", "parent"), above, ["parent"], "n_children").select("name", "parent_conv_id")
    out = nodes.join(parents, "name", "left").join(children.withColumnRenamed("parent", "name"), "name", "left").join(totals, "name").join(ends, "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of the decimal id, bit by bit: the reflected polynomial is 3988292384.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
ORACLE_SQL = {
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, b.place, b.role, b.text FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.place < c.h UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
s AS (SELECT c.conv_id, coalesce(q.seq, []) AS seq, coalesce(q.words, []) AS words FROM c LEFT JOIN (SELECT conv_id, list(md5(role) || md5(text) ORDER BY own, place) AS seq, list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY own, place) AS words FROM r GROUP BY conv_id) q ON q.conv_id = c.conv_id),
p AS (SELECT conv_id, d AS depth, array_to_string(seq[1:d], '') AS key, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(seq) AS ends FROM s, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY depth, key),
u AS (SELECT n.*, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND starts_with(k.key, n.key)) AS n_children FROM n)
SELECT u.conv_id, u.depth, a.conv_id AS parent_conv_id, u.n_convs, u.n_children, x.n_leaves, x.saved_tokens, u.ends_sha256
FROM u LEFT JOIN u a ON a.depth = u.depth - 1 AND starts_with(u.key, a.key)
JOIN (SELECT u.depth, u.key, CAST(sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((v.n_convs - 1) * v.words) AS BIGINT) AS saved_tokens FROM u JOIN u v ON v.depth >= u.depth AND starts_with(v.key, u.key) GROUP BY u.depth, u.key) x ON x.depth = u.depth AND x.key = u.key
"""
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
