"""Prefix trie of conversations by truncation peeling.

The trie is built from its deepest level up.  At depth d the conversations that
end there are merged with the nodes that survived from depth d + 1; every node
is then stripped of its last turn and regrouped with those that now are equal.
A node's members, smallest member, children, leaves and saved bytes are summed
in the same step that finds it.

A conversation is one row of digests, 20 bytes a turn: key d is the sum (modulo
2**64, twice, from independent hashes) of the hashes of (place, role, text) of
its first d turns, so a stripped node's key is the key before it.  Texts are
read once and not carried.

Peeling level by level over the whole table would take a shuffle for each turn
of the longest conversation, so the work is cut by *anchors*: depths 1, 2, 4, 8
and so on.  A conversation's anchor is the first of them where no more than
``GROUP_TURNS`` turns share its prefix.  All that shares an anchored prefix is
peeled in one task, down to the anchor; the anchored nodes and the conversations
that end above their anchor are then peeled by one grouping a level.  Groupings
combine on the map side, so a prefix that a third of all conversations share is
a few rows for each task.  Copies of a conversation are merged before peeling.

The hash of a node's own conversations is taken over their ids in range-sorted
order: tasks join ids to pieces of text, and one task hashes a node's pieces one
after the other without holding them.

Edge cases: null roles and texts are empty; null turns come first, turns with
equal numbers are ordered by content hash; rows with a null conversation id
belong to no conversation and are left out; repeated rows are turns of their
own; an empty table has no node; other columns are not read.  A conversation
must fit in a row (about 100 million turns).
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from penprint.llm.arrays import mix
from penprint.session import cut_lineage

U = np.uint64
#: Turns that may be peeled as one group in a task; bounds memory, not results.
GROUP_TURNS = 1024
#: Turns handed to one call of ``peel``, and ids in one piece of a node's list.
CHUNK, PIECE = 1 << 16, 1 << 16
HEADS, FAMILY = 9, 5
NO_ENDS = hashlib.sha256(b"").hexdigest()

_CHAIN = "k1 array<long>, k2 array<long>, bytes array<long>"
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends string")
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, turns): one row a conversation, its turns in order as (turn, h1, h2, bytes)."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.xxhash64(role_, text_).alias("h1"),
                 F.xxhash64(text_, F.lit(1), role_).alias("h2"), F.octet_length(text_).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """op12's conversations: the first turns of the family's first, then the own
    ones.  At most nine conversations look up one."""
    heads = (convs.where(F.col("conv") % FAMILY == 0)
             .select(F.col("conv").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head")))
    own = convs.select("conv", "turns", (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
                       (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), rest).alias("turns"))


def chains(convs: DataFrame) -> DataFrame:
    """(conv, depth, e1, e2, k1, k2, bytes): the keys of all prefixes, from the
    empty one, and the bytes of each prefix's last text; e1 and e2 are the last keys."""
    def run(batches):
        for b in batches:
            turns = b.column(1)
            off = turns.offsets.to_numpy().astype(np.int64)
            off, flat = off - off[0], turns.flatten()
            depth = np.diff(off)
            place = np.arange(off[-1]) - np.repeat(off[:-1], depth)
            at = off + np.arange(len(off))  # one entry more for each conversation
            inner = np.ones(at[-1], bool)
            inner[at[:-1]] = False

            def padded(values):
                out = np.zeros(at[-1], U)
                out[inner] = values
                return out

            def sums(field):
                code = mix(mix(place.astype(U), 11) ^ flat.field(field).to_numpy(zero_copy_only=False).view(U), 13)
                total = np.cumsum(padded(code), dtype=U)
                return (total - np.repeat(total[at[:-1]], depth + 1)).view(np.int64)

            k1, k2 = sums("h1"), sums("h2")
            size = padded(flat.field("bytes").to_numpy(zero_copy_only=False).view(U)).view(np.int64)
            place_of = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(place_of, pa.array(x)) for x in (k1, k2, size)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(depth), pa.array(k1[at[1:] - 1]), pa.array(k2[at[1:] - 1]), *lists],
                ["conv", "depth", "e1", "e2", "k1", "k2", "bytes"])

    return convs.select("conv", "turns").mapInArrow(run, f"conv long, depth long, e1 long, e2 long, {_CHAIN}")


def ended(chain: DataFrame) -> DataFrame:
    """(depth, e1, e2, conv, n, ends): the conversations that end at each node,
    merged: the smallest, their number, and the hash of their ids."""
    key = ["depth", "e1", "e2"]
    parts = int(chain.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        held, ids = None, []

        def piece():
            return (*held, ids[0], len(ids), ",".join(map(str, ids)))

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], key + ["conv", "n", "ids"])

        for b in batches:
            out = []
            for *node, conv in zip(*(b.column(i).to_pylist() for i in range(4))):
                if node != held or len(ids) == PIECE:
                    if ids:
                        out.append(piece())
                    held, ids = node, []
                ids.append(conv)
            if out:
                yield table(out)
        if ids:
            yield table([piece()])

    def hashed(batches):
        held = total = first = digest = None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], key + ["conv", "n", "ends"])

        for b in batches:
            out = []
            for *node, conv, n, ids in zip(*(b.column(i).to_pylist() for i in range(6))):
                if node == held:
                    total += n
                    digest.update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append((*held, first, total, digest.hexdigest()))
                held, first, total, digest = node, conv, n, hashlib.sha256(ids.encode())
            if out:
                yield table(out)
        if held is not None:
            yield table([(*held, first, total, digest.hexdigest())])

    schema = "depth long, e1 long, e2 long, conv long, n long, "
    joined = (chain.select(*key, "conv").repartitionByRange(parts, *key, "conv")
              .sortWithinPartitions(*key, "conv").mapInArrow(pieces, schema + "ids string"))
    return (joined.repartition(*key).sortWithinPartitions(*key, "conv").mapInArrow(hashed, schema + "ends string"))


def anchored(ends: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """``ends`` with ``anchor``: the depth down to which its group is peeled in one
    task, null for what ends above it."""
    powers = F.expr("transform(sequence(0, int(log2(depth))), x -> shiftleft(1L, x))")
    probe = (ends.where("depth > 0").select("conv", "depth", "k1", "k2", F.explode(powers).alias("a"))
             .select("conv", "depth", "a", *(F.element_at(k, (F.col("a") + 1).cast("int")).alias(k) for k in ("k1", "k2"))))
    crowded = (probe.groupBy("a", "k1", "k2").agg(F.sum(F.col("depth") + 1).alias("turns"), F.count("*").alias("n"))
               .where((F.col("turns") > group_turns) & (F.col("n") > 1)).select("a", "k1", "k2"))
    last = probe.join(crowded, ["a", "k1", "k2"]).groupBy("conv").agg(F.max("a").alias("a"))
    anchor = F.coalesce(F.col("a") * 2, F.lit(1))
    return (ends.join(last, "conv", "left")
            .withColumn("anchor", F.when(anchor <= F.col("depth"), anchor)).drop("a"))


def peel(ends: dict, emit_node, emit_top) -> None:
    """Peel whole groups from the deepest end to their anchors.  ``ends``: arrays
    conv, depth, n, anchor and off (where a row's keys start), flat k1, k2, bytes.
    ``emit_node(row, depth, parent, *sums)`` gets the nodes below the anchors,
    ``emit_top`` the anchored ones (parent None); sums: conv, n_convs, n_children,
    n_leaves, saved, and the row whose conversations end there (-1 for none)."""
    off, depth, anchor = ends["off"], ends["depth"], ends["anchor"]
    by_depth = np.argsort(-depth, kind="stable")
    cut = np.searchsorted(-depth[by_depth], -np.arange(int(depth.max()) + 1), "left")
    rows = np.empty(0, np.int64)
    sums = [np.empty(0, np.int64)] * 6
    for d in range(int(depth.max()), int(anchor.min()) - 1, -1):
        new = by_depth[cut[d]:cut[d - 1]] if d else by_depth[cut[0]:]
        none = np.zeros(len(new), np.int64)
        all_rows = np.concatenate([rows, new])
        if not len(all_rows):
            continue
        kept = len(rows)
        conv = np.concatenate([sums[0], ends["conv"][new]])
        n = np.concatenate([sums[1], ends["n"][new]])
        child = np.concatenate([np.ones(kept, np.int64), none])
        leaves = np.concatenate([sums[3], none])
        saved = np.concatenate([sums[4], none])
        own = np.concatenate([np.full(kept, -1), new])
        at = off[all_rows] + d
        a, b = ends["k1"][at], ends["k2"][at]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(fresh)
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(fresh) - 1
        add = lambda x: np.add.reduceat(x[order], first)
        conv_ = np.minimum.reduceat(conv[order], first)
        n_, child_, leaves_ = add(n), add(child), add(leaves)
        row_ = all_rows[order][first]
        saved_ = add(saved) + (n_ - 1) * ends["bytes"][off[row_] + d]
        leaves_[child_ == 0] = 1
        if kept:
            emit_node(rows, d + 1, conv_[group[:kept]], *sums)
        sums = [conv_, n_, child_, leaves_, saved_, np.maximum.reduceat(own[order], first)]
        top = anchor[row_] == d
        if top.any():
            emit_top(row_[top], d, None, *(s[top] for s in sums))
        rows, sums = row_[~top], [s[~top] for s in sums]


def peeled_groups(placed: DataFrame) -> DataFrame:
    """Nodes below the anchors, and the anchored nodes with their chains."""
    key = [F.element_at(k, (F.col("anchor") + 1).cast("int")).alias(a) for k, a in (("k1", "a1"), ("k2", "a2"))]
    dealt = (placed.select("conv", "depth", "n", "anchor", "ends", "k1", "k2", "bytes", *key)
             .repartition("a1", "a2").sortWithinPartitions("a1", "a2"))

    def made(table):
        ints = {c: table.column(c).to_numpy().astype(np.int64) for c in ("conv", "depth", "n", "anchor")}
        lists = {c: table.column(c).combine_chunks() for c in ("k1", "k2", "bytes")}
        off = np.concatenate([[0], np.cumsum(ints["depth"] + 1)])
        flat = {c: x.flatten().to_numpy() for c, x in lists.items()}
        hashes = np.array(table.column("ends").to_pylist() + [NO_ENDS], object)  # -1: none
        out = []

        def emit(rows, d, parent, conv, n, child, leaves, saved, own):
            m = len(rows)
            if parent is None:
                size = np.full(m, d + 1)
                span = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(off[rows] - span[:-1], size) + np.arange(span[-1])
                chain = [pa.ListArray.from_arrays(pa.array(span, pa.int32()), pa.array(flat[c][take]))
                         for c in ("k1", "k2", "bytes")]
                parent = pa.nulls(m, pa.int64())
            else:
                chain = [pa.nulls(m, pa.list_(pa.int64()))] * 3
                parent = pa.array(parent)
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(conv), pa.array(np.full(m, d)), parent, pa.array(n), pa.array(child), pa.array(leaves),
                 pa.array(saved), pa.array(hashes[own], pa.string()), *chain], _NAMES + ["k1", "k2", "bytes"]))

        peel(ints | flat | {"off": off}, emit, emit)
        return out

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(5).flatten())
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            a1, a2 = table.column("a1").to_numpy(), table.column("a2").to_numpy()
            other = np.flatnonzero((a1 != a1[-1]) | (a2 != a2[-1]))
            if len(other):  # the last group may go on
                yield from made(table.slice(0, other[-1] + 1))
                table = table.slice(other[-1] + 1)
            held = table.to_batches()
            size = len(table.column("k1").combine_chunks().flatten()) if len(table) else 0
        if held and sum(b.num_rows for b in held):
            yield from made(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, f"{_NODE}, {_CHAIN}")


def prefix_trie(convs: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """All nodes (``_NODE``) of the trie of ``conversations``' rows."""
    chain = cut_lineage(chains(convs))
    ends = (ended(chain).select("conv", "n", "ends").join(chain, "conv"))
    placed = cut_lineage(anchored(cut_lineage(ends), group_turns))
    parts = cut_lineage(peeled_groups(placed.where("anchor IS NOT NULL")))
    tops = parts.where("k1 IS NOT NULL")
    loose = placed.where("anchor IS NULL").select(
        F.col("conv").alias("conv_id"), "depth", F.col("n").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in (
            "n_children", "n_leaves", "saved_tokens")), "ends", "k1", "k2", "bytes")
    sums = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "k1", "k2", "bytes"]
    found = [parts.where("k1 IS NULL").select(*_NAMES)]
    deepest = tops.select("depth").unionAll(loose.select("depth")).agg(F.max("depth")).first()[0]
    level = None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        short = [F.slice(c, 1, d + 1).alias(c) for c in ("k1", "k2", "bytes")]
        came = loose.where(F.col("depth") == d).select(*sums)
        if level is not None:
            came = came.unionByName(level.select(
                "conv_id", F.lit(d).cast("long").alias("depth"), "n_convs", F.lit(1).cast("long").alias("n_children"),
                "n_leaves", "saved_tokens", F.lit(NO_ENDS).alias("ends"), *short))
        a, b = (F.element_at(k, d + 1).alias(n) for k, n in (("k1", "a1"), ("k2", "a2")))
        grouped = (came.select("*", a, b, F.when(F.col("ends") != NO_ENDS, F.col("ends")).alias("own"))
                   .groupBy("a1", "a2").agg(
                       F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                       F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                       F.sum("saved_tokens").alias("saved_tokens"), F.max("own").alias("own"),
                       *(F.any_value(c).alias(c) for c in ("k1", "k2", "bytes"))))
        whole = grouped.select(
            "conv_id", F.lit(d).cast("long").alias("depth"), "n_convs", "n_children",
            F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("bytes", d + 1)).alias("saved_tokens"),
            F.coalesce("own", F.lit(NO_ENDS)).alias("ends"), "k1", "k2", "bytes")
        below, level = level, cut_lineage(whole.unionByName(tops.where(F.col("depth") == d).select(*sums)))
        if below is not None:
            found.append(_with_parents(below, level, d))
    if level is not None:
        found.append(level.select(*[F.lit(None).cast("long").alias(c) if c == "parent_conv_id" else c for c in _NAMES]))
    return reduce(DataFrame.unionByName, found)


def _with_parents(nodes: DataFrame, level: DataFrame, d: int) -> DataFrame:
    """Nodes of depth d + 1 beside the smallest member of the node above."""
    key = lambda: [F.element_at(k, d + 1).alias(n) for k, n in (("k1", "a1"), ("k2", "a2"))]
    above = level.select(*key(), F.col("conv_id").alias("parent_conv_id"))
    if d == 0:
        above = F.broadcast(above)  # the root: one row
    return nodes.select("*", *key()).join(above, ["a1", "a2"]).select(*_NAMES)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rebuilt(conversations(turns))).withColumnRenamed("ends", "ends_sha256")


# The same by definition: every prefix of every conversation as a row, subtree
# sums over the ancestors of each node.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY turn NULLS FIRST, x) AS xs FROM t GROUP BY c),
h AS (
  SELECT c, xs, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM o),
r AS (
  SELECT h.c, list_concat(coalesce(b.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs
  FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
p AS (
  SELECT c, d, len(xs) AS n, md5(xs[1:d]::VARCHAR || '|' || d) AS k,
         CASE WHEN d > 0 THEN md5(xs[1:d - 1]::VARCHAR || '|' || (d - 1)) END AS up,
         CASE WHEN d > 0 THEN strlen(xs[d].t) ELSE 0 END AS b
  FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM r)),
nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n, any_value(up) AS up, any_value(b) AS b,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS e FROM p GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((x.n - 1) * x.b) AS saved
  FROM nodes x JOIN p ON p.c = x.c AND p.d <= x.d LEFT JOIN kids ON kids.up = x.k GROUP BY p.k)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, q.c AS parent_conv_id, nodes.n::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves,
       below.saved::BIGINT AS saved_tokens, sha256(nodes.e) AS ends_sha256
FROM nodes JOIN below ON below.k = nodes.k LEFT JOIN kids ON kids.up = nodes.k LEFT JOIN nodes q ON q.k = nodes.up
"""
