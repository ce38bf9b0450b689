"""Prefix trie of conversations by ternary search trees on range shards.

Turns are dictionary-encoded: the SHA-256 of role and text stands for a
distinct turn, and each gets a number. Conversations are rebuilt (see
``rebuilt``) and cut into bands of ``BAND`` turns; a piece of a conversation
in one band, a segment, is one row of at most ``BAND`` numbers, and the turns
before it are named by a 128-bit digest, the group of the segment. Segments
are range-partitioned and sorted by (band, group, numbers, conversation), so a
shard is a stretch of the sorted order, of any one group too.

In a shard, stretches of bounded size are read one after another. Each builds a
ternary search tree, its distinct sequences inserted median first, so the
branches of a node are balanced. One pass over the nodes, children before
parents, adds up members, children, leaves and savings. Savings are kept as two
sums that add up over stretches: members times bytes, and bytes of the nodes
that are new in the stretch. A node is new unless the sequence before the
stretch has it too, and a leaf is counted in the last stretch that has it.

Nodes that two stretches or shards share lie on the first or last path of a
stretch. They come out in parts under a digest of their path; the first and
last sequences of neighbouring shards say which of them were counted twice,
and one sum over the digests merges them. Where conversations go beyond a
band, the group's first node is the last node of the band before; totals of
groups go up the tree of groups in rounds that double the distance, then to the
nodes on the path above.

Lists of ends are hashed in the stretch, or, for shared nodes, from one text a
stretch, in order, one node after another: no list is held whole.

Defined results: rows with a null ``conv_id`` belong to no conversation; null
role or text is empty; a null turn goes first; equal turn numbers go by the
SHA-256 of (bytes of the role, ':', role, text), and rows equal in all that
all stay; ``%`` keeps the sign of a negative id; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, keyed_join, map_text, written

by_value(__name__)

BAND = 512
STRETCH = 100_000
SHARED, CYCLE = 9, 5
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- turns and rebuilt conversations

def turn_digest(role: Column, text: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def encoded_turns(rows: DataFrame) -> DataFrame:
    """``conv, turn, digest, bytes, row, id`` of each row; ``id`` is the
    number of its distinct (role, text)."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    turns = written(rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        turn_digest(F.col("role"), F.col("text")).alias("digest"), size.alias("bytes"),
        F.monotonically_increasing_id().alias("row")), "trie-turns")
    distinct = turns.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return keyed_join(turns, written(distinct.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary"), "digest", "n")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, at, id, bytes`` of every turn of the rebuilt conversations,
    and one row with null ``at`` for each that has none.

    Conversation c is the first h turns of conversation c - c % 5 and its own
    after its first h, h = crc32 of c's decimal digits modulo 9. Turns are
    numbered over range partitions, so one long conversation spans many."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    placed = written(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv", "id", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "trie-ordered")
    stretch = placed.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(stretch.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "trie-starts")
    own = F.crc32(F.col("conv").cast("string").cast("binary")) % F.lit(SHARED)
    convs = starts.groupBy("conv").agg(F.sum("n").alias("turns")).withColumn("h", own).withColumn("base", F.col("conv") - F.col("conv") % F.lit(CYCLE))
    lengths = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = written(convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))), "trie-convs")
    # one row a conversation and partition: as evenly spread as the partitions
    info = starts.join(convs.select("conv", "h", "taken"), "conv")
    ranked = placed.join(info, ["conv", "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("before"))
    rest = ranked.filter("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "id", "bytes")
    heads = ranked.filter(F.col("at") < F.lit(SHARED - 1)).filter(F.col("conv") % F.lit(CYCLE) == 0).select(
        F.col("conv").alias("base"), "at", "id", "bytes")
    taken = convs.filter("taken > 0").select("conv", "base", "taken").join(heads, "base").filter("at < taken").select("conv", "at", "id", "bytes")
    bare = convs.filter("taken = 0 and turns <= h").select("conv", *(F.lit(None).cast("long").alias(c) for c in ("at", "id", "bytes")))
    return rest.unionByName(taken).unionByName(bare)


SEGMENT = "band long, p1 long, p2 long, ids array<long>, bytes array<long>, more boolean, q1 long, q2 long, conv long"


def segments(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each conversation and band: ``p1, p2`` name the turns
    before it, ``q1, q2`` those up to its end."""
    piece = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "id", "bytes"))))
    rows = turns.withColumn("band", F.coalesce(F.floor(F.col("at") / F.lit(band)).cast("long"), F.lit(0)))
    # at most ``band`` turns a group
    cut = rows.groupBy("conv", "band").agg(piece.alias("t")).select("conv", "band", F.col("t.id").alias("ids"), F.col("t.bytes").alias("bytes"))
    mine = Window.partitionBy("conv").orderBy("band")
    earlier = mine.rowsBetween(Window.unboundedPreceding, -1)
    for k in ("1", "2"):
        own = F.xxhash64("band", "ids", F.lit(int(k)))
        cut = cut.withColumn("h" + k, own)
    cut = cut.withColumn("more", F.lead("band").over(mine).isNotNull())
    for k in ("1", "2"):
        cut = cut.withColumn("p" + k, F.coalesce(F.bit_xor("h" + k).over(earlier), F.lit(0).cast("long")))
    return cut.select("band", "p1", "p2", "ids", "bytes", "more", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"),
                      F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "conv")


# ---- one stretch of the sorted order

def path_keys(group: tuple, ids: list[int], last: int, after: tuple, band: int) -> list[bytes]:
    """Digest of the first 0 to ``last`` turns of a segment of ``group``; a
    whole band's last node goes by the group that starts there."""
    state = hashlib.blake2b(struct.pack("<qqq", *group), digest_size=16)
    out = [state.digest()]
    for i in ids[:last]:
        state.update(struct.pack("<q", i))
        out.append(state.digest())
    if last == band:
        out[-1] = hashlib.blake2b(struct.pack("<qqq", group[0] + 1, *after), digest_size=16).digest()
    return out


def common_turns(a: list[int], b: list[int]) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class SearchTree:
    """Ternary search tree over sequences of numbers. Every node is a prefix;
    node 0 is the empty one. ``below`` leads to the prefixes one longer, which
    ``low`` and ``high`` order by their last number."""

    def __init__(self) -> None:
        self.number, self.low, self.high, self.below = [0], [-1], [-1], [-1]
        self.up, self.depth, self.bytes = [-1], [0], [0]

    def _made(self, up: int, number: int, size: int) -> int:
        for column, value in ((self.number, number), (self.low, -1), (self.high, -1), (self.below, -1), (self.up, up),
                              (self.depth, self.depth[up] + 1), (self.bytes, size)):
            column.append(value)
        return len(self.up) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> list[int]:
        """The nodes on the path, node 0 first."""
        number, low, high, below = self.number, self.low, self.high, self.below
        node, path = 0, [0]
        for i, size in zip(ids, sizes, strict=True):
            at, link, last = below[node], below, node
            while at >= 0 and number[at] != i:
                link, last = (low if i < number[at] else high), at
                at = link[at]
            if at < 0:
                at = link[last] = self._made(node, i, size)
            node = at
            path.append(node)
        return path


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += ((mid + 1, b), (a, mid))


FIELDS = ["kind", "key", "parent_key", "conv", "parent", "depth", "members", "children", "leaves", "weight", "fresh", "from_group",
          "ends_sha256", "ends"]
KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
         pa.int64(), pa.bool_(), pa.string(), pa.string()]
EDGE = "band long, p1 long, p2 long, q1 long, q2 long, ids array<long>, bytes array<long>, leaf boolean"
EDGE_TYPE = pa.struct([*((c, pa.int64()) for c in ("band", "p1", "p2", "q1", "q2")), ("ids", pa.list_(pa.int64())),
                       ("bytes", pa.list_(pa.int64())), ("leaf", pa.bool_())])
NODE = ("kind int, key binary, parent_key binary, conv long, parent long, depth long, members long, children long, leaves long, "
        f"weight long, fresh long, from_group boolean, ends_sha256 string, ends string, part int, head struct<{EDGE.replace(' ', ': ').replace(',:', ',')}>, "
        f"tail struct<{EDGE.replace(' ', ': ').replace(',:', ',')}>")
FINAL, PART, EDGES = 0, 1, 2


def stretch_nodes(rows: list[tuple], before: int | None, after: int | None, band: int) -> tuple[list[tuple], bool]:
    """Nodes of sorted segments of one group, and whether the last sequence
    was counted as a leaf. ``before`` and ``after``: turns shared with the
    segment before and after the stretch, -1 for another group, None if that
    segment is in another shard."""
    group, runs = rows[0][:3], []  # runs of equal sequences
    for r in rows:
        if not runs or runs[-1][0][3] != r[3]:
            runs.append((r, [], []))
        runs[-1][2 if r[5] else 1].append(r[8])
    tree, first, last = SearchTree(), [], []
    ends: dict[int, list[int]] = {}
    goes_on: dict[int, list[int]] = {}
    full: dict[int, tuple] = {}  # a whole band's last node: the group that starts there
    for k in median_first(len(runs)):
        r, stop, more = runs[k]
        path = tree.insert(r[3], r[4])
        if k == 0:
            first = path
        if k == len(runs) - 1:
            last = path
        ends[path[-1]], goes_on[path[-1]] = stop, more
        if len(r[3]) == band:
            full[path[-1]] = (r[6], r[7])
    n = len(tree.up)
    old = set(first[:(-1 if before is None else before) + 1])
    shared = old | set(first if before is None else ()) | set(last if after is None else last[:after + 1])
    members, children, leaves, weight, fresh = ([0] * n for _ in range(5))
    smallest: list[int | None] = [None] * n
    keyed = [False] * n
    counted = False
    for node in range(n - 1, -1, -1):  # children are made after their parents
        stop, more = ends.get(node, ()), goes_on.get(node, ())
        members[node] += len(stop) + len(more)
        for convs in (stop, more):
            if convs and (smallest[node] is None or convs[0] < smallest[node]):
                smallest[node] = convs[0]
        here = members[node], tree.bytes[node]
        if tree.below[node] < 0 and not more and not (node == last[-1] and after == tree.depth[node]):
            leaves[node] += 1
            counted |= node == last[-1]
        weight[node] += here[0] * here[1]
        if node not in old:
            fresh[node] += here[1]
        keyed[node] |= bool(more) or node in shared or (node == 0 and group[0] > 0)
        up = tree.up[node]
        if up >= 0:
            members[up] += members[node]
            children[up] += node not in old
            leaves[up] += leaves[node]
            weight[up] += weight[node]
            fresh[up] += fresh[node]
            if smallest[up] is None or smallest[node] < smallest[up]:
                smallest[up] = smallest[node]
            keyed[up] |= bool(more) or (keyed[node] and node not in shared)
    keys: dict[int, bytes] = {}
    state = {0: hashlib.blake2b(struct.pack("<qqq", *group), digest_size=16)}
    out = []
    for node in range(n):
        up = tree.up[node]
        if keyed[node]:  # and so are all nodes above it
            if up >= 0:
                state[node] = state[up].copy()
                state[node].update(struct.pack("<q", tree.number[node]))
            if node in full:
                keys[node] = hashlib.blake2b(struct.pack("<qqq", group[0] + 1, *full[node]), digest_size=16).digest()
            else:
                keys[node] = state[node].digest()
        virtual = node == 0 and group[0] > 0
        stop = ends.get(node, ())
        text = ",".join(map(str, stop))
        out.append((PART if keyed[node] else FINAL, keys.get(node), keys.get(up), smallest[node],
                    smallest[up] if up >= 0 and up not in keys else None, group[0] * band + tree.depth[node],
                    0 if virtual else members[node], children[node], leaves[node], weight[node], fresh[node], virtual,
                    None if keyed[node] else hashlib.sha256(text.encode()).hexdigest(), text if keyed[node] and stop else None))
    return out, counted


def _batch(nodes: list[tuple], part: int | None = None, head: dict | None = None, tail: dict | None = None) -> pa.RecordBatch:
    edge = head is not None
    columns = [pa.array([v[k] for v in nodes] + ([EDGES] if k == 0 else [None]) * edge, t) for k, t in enumerate(KINDS)]
    gap = [None] * len(nodes)
    for value, t in ((part, pa.int32()), (head, EDGE_TYPE), (tail, EDGE_TYPE)):
        columns.append(pa.array(gap + [value] * edge, t))
    return pa.RecordBatch.from_arrays(columns, [*FIELDS, "part", "head", "tail"])


def _scan(band: int, limit: int):
    names = ["band", "p1", "p2", "ids", "bytes", "more", "q1", "q2", "conv"]

    def edge(r: tuple, leaf: bool) -> dict:
        return dict(zip(["band", "p1", "p2", "ids", "bytes", "q1", "q2", "leaf"], (*r[:5], *r[6:8], leaf), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, before, head, part = 0, None, None, None
        for b in batches:
            if b.num_rows and part is None:
                part = b.column("part")[0].as_py()
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if held and (turns >= limit or held[-1][:3] != r[:3]):
                    after = common_turns(held[-1][3], r[3]) if held[-1][:3] == r[:3] else -1
                    yield _batch(stretch_nodes(held, before, after, band)[0])
                    held, turns, before = [], 0, after
                if head is None:
                    head = edge(r, False)
                held.append(r)
                turns += len(r[3]) + 1
        if held:
            nodes, leaf = stretch_nodes(held, before, None, band)
            yield _batch(nodes, part, head, edge(held[-1], leaf))

    return run


# ---- merging

def _twice_counted(band: int):
    """What the second of two neighbouring shards counted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tail, head in zip(b.column("before").to_pylist(), b.column("head").to_pylist(), strict=True):
                group = tuple(head[c] for c in ("band", "p1", "p2"))
                if tail is None or tuple(tail[c] for c in ("band", "p1", "p2")) != group:
                    continue
                same = common_turns(tail["ids"], head["ids"])
                leaf = int(tail["leaf"] and len(tail["ids"]) == same)
                size = 0
                for d, key in reversed(list(enumerate(path_keys(group, head["ids"], same, (head["q1"], head["q2"]), band)))):
                    size += head["bytes"][d - 1] if d else 0
                    out.append((PART, key, None, None, None, group[0] * band + d, 0, -int(d < same), -leaf, 0, -size,
                                d == 0 and group[0] > 0, None, None))
            yield _batch(out)

    return run


def _merged(parts: DataFrame) -> DataFrame:
    total = [F.sum(c).alias(c) for c in ("members", "children", "leaves", "weight", "fresh")]
    group = F.when(F.col("from_group"), F.col("leaves")), F.when(F.col("from_group"), F.col("weight") - F.col("fresh"))
    return parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv").alias("conv"), F.max("depth").alias("depth"), *total,
                                    F.sum(group[0]).alias("group_leaves"), F.sum(group[1]).alias("group_saved"))


def _group_totals(merged: DataFrame, cut: DataFrame, band: int) -> DataFrame:
    """``key, leaves, saved`` to add to the nodes above each group, from all
    groups below: up the tree of groups, twice as far in each round."""
    starts = merged.filter("group_leaves is not null").select(
        F.col("key").alias("own"), (F.col("depth") / F.lit(band)).cast("long").alias("band"), "conv", "group_leaves", "group_saved")
    above = cut.withColumn("band", F.col("band") + 1).withColumnRenamed("band", "next_band")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            keys = [path_keys((r["next_band"] - 1, r["p1"], r["p2"]), r["ids"], band, (r["q1"], r["q2"]), band) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array([k[0] if r["next_band"] > 1 else None for k, r in zip(keys, rows, strict=True)], pa.binary()),
                                              pa.array([k[r["next_band"] > 1:-1] for k, r in zip(keys, rows, strict=True)], pa.list_(pa.binary())),
                                              b.column("group_leaves"), b.column("group_saved")], ["own", "up", "path", "leaves", "saved"])

    joined = starts.join(above, (above["conv"] == starts["conv"]) & (above["next_band"] == starts["band"])).select(
        "own", "next_band", "p1", "p2", "ids", "q1", "q2", "group_leaves", "group_saved")
    groups = written(map_text(joined, paths, "own binary, up binary, path array<binary>, leaves long, saved long"), "trie-groups")
    state = groups.select("own", "up", "leaves", "saved")
    while not state.filter("up is not null").isEmpty():
        gift = state.filter("up is not null").groupBy(F.col("up").alias("own")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("own").alias("up"), F.col("up").alias("up_up"))
        state = written(state.join(gift, "own", "left").join(further, "up", "left").select(
            "own", F.col("up_up").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-totals")
    whole = state.select("own", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    done = groups.join(whole, "own")
    on_path = done.select(F.explode("path").alias("key"), F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved"))
    here = done.select(F.col("own").alias("key"), (F.col("all_leaves") - F.col("leaves")).alias("leaves"),
                       (F.col("all_saved") - F.col("saved")).alias("saved"))
    return on_path.unionByName(here).groupBy("key").agg(F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each key, which come one after another."""
    key, state = None, None
    for b in batches:
        done = []
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                         ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, band: int = BAND, stretch: int = STRETCH) -> DataFrame:
    """One row for each node over ``conv, at, id, bytes`` (``rebuilt``)."""
    spark = turns.sparkSession
    cut = written(segments(turns, band), "trie-segments")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "p1", "p2", "ids", "more", "conv"]
    ordered = cut.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    nodes = written(map_text(ordered, _scan(band, stretch), NODE), "trie-nodes")
    # one row a shard, with two segments
    neighbours = nodes.filter(F.col("kind") == EDGES).select("head", F.lag("tail").over(Window.orderBy("part")).alias("before"))
    again = map_text(neighbours, _twice_counted(band), NODE)
    merged = written(_merged(nodes.filter(F.col("kind") == PART).unionByName(again)), "trie-shared")
    saved = F.col("weight") - F.col("fresh")
    if merged.filter("group_leaves is not null").isEmpty():
        known = merged.withColumn("saved", saved)
    else:
        known = merged.join(_group_totals(merged, cut, band), "key", "left").withColumn(
            "saved", saved + F.coalesce("add_saved", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("add_leaves", F.lit(0)))
    texts = nodes.filter(F.col("kind") == PART).filter("ends is not null").select(
        "key", F.substring_index("ends", ",", 1).cast("long").alias("conv"), "ends")
    sorted_texts = texts.repartition("key").sortWithinPartitions("key", "conv").select("key", "ends")
    digests = map_text(sorted_texts, _digests, "key binary, ends_sha256 string")
    columns = ["parent_key", "conv", "depth", "members", "children", "leaves", "saved", "ends_sha256"]
    shared = known.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    own = nodes.filter(F.col("kind") == FINAL).withColumn("saved", saved)
    inner = own.filter("parent_key is null").select(*columns, "parent")
    top = shared.filter("parent_key is null").select(*columns, F.lit(None).cast("long").alias("parent"))
    linked = written(own.filter("parent_key is not null").select(*columns).unionByName(
        shared.filter("parent_key is not null").select(*columns)), "trie-linked")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent"), F.col("children").alias("n"))
    found = keyed_join(linked, parents.filter("n > 0"), "parent_key", "n").select(*columns, "parent")
    return inner.unionByName(top).unionByName(found).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie_query(rows: DataFrame, band: int = BAND, stretch: int = STRETCH) -> DataFrame:
    return prefix_trie(rebuilt(encoded_turns(rows)), band, stretch)


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS size,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), listed AS (
  SELECT c, list({'d': digest, 'n': size} ORDER BY turn NULLS FIRST, digest) AS t FROM turns GROUP BY c
), heads AS (
  SELECT c, t, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(ch)::BIGINT for ch in string_split(c::VARCHAR, '')]),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))),
    4294967295::BIGINT) % 9 AS h
  FROM listed
), whole AS (
  SELECT a.c, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t
  FROM heads a LEFT JOIN listed b ON b.c = a.c - a.c % 5
), paths AS (
  SELECT c, t, unnest(range(0, len(t) + 1)) AS depth FROM whole
), nodes AS (
  SELECT [e.d for e in t[1:depth]] AS path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(t[depth].n) AS size,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(t) = depth), '') AS ends
  FROM paths GROUP BY ALL
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END AS leaf,
    (n_convs - 1) * coalesce(size, 0) AS saved
  FROM nodes n LEFT JOIN children k ON k.path = n.path
), upward AS (
  SELECT path[1:up] AS path, leaf, saved FROM (SELECT path, leaf, saved, unnest(range(0, depth + 1)) AS up FROM own)
), sums AS (
  SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM upward GROUP BY path
)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN sums s ON s.path = o.path LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
"""
