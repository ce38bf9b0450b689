"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints. The text in lower case (A-Z) is cut into words; every run of
four words, repeats included, is hashed (XXH64, seed 42) and a bit of the
fingerprint is set if it is set in over half of the hashes.

Index, over distinct fingerprints. Cut the 64 bits into ``pieces`` segments:
two fingerprints at most ``max_bits`` bits apart agree on all bits of at least
``pieces - max_bits`` segments. Each such choice of segments is a mask, and
the upper nodes of the index are the masked bit patterns: fingerprints of one
node share the pattern, with no difference accumulated so far. All nodes are
range-partitioned and sorted by (mask, pattern, Gray rank), so a node of any
size is cut into blocks of at most ``BLOCK`` fingerprints that lie next to
each other in Gray order. In a block, runs of neighbours are factored again
into nodes of the bits their members all share; a search adds up the
differences on those bits from the top down and drops a whole node as soon as
they exceed ``max_bits``. Blocks of one node that was cut are compared pair by
pair, except pairs whose shared bits already differ too much.

A block gives the links it finds as a spanning star per connected part, at
most one row per fingerprint, and the parts are merged by repeated
contraction to smallest neighbours. No link is lost and no group is expanded
into all its pairs. The number of segments follows the number of distinct
fingerprints (more segments: smaller nodes, more masks); any choice gives the
same links.

Defined results: null text counts as empty; no words: fingerprint zero,
linked like any other; under four words: the whole sequence is the one
shingle; the class of a group is its smallest id, null ids last (all null:
null); a repeated row is a row of its own; an empty table gives no rows.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOCATOR, by_value, keep_rows, keyed_join, locator, map_text, stored, strings, written

by_value(__name__)

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BLOCK = 4096
FAN = 16
PAIR_CELLS = 1 << 22


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        first = [0, *(ends[:-words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, ends[words - 1:].tolist(), strict=True)),
                             np.uint64, len(first))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > hashes.size).tobytes(), "big")


def gray_rank(fp: Column) -> Column:
    """Position of a 64-bit pattern in the reflected Gray sequence (as a
    signed long; any one order of the top bit will do)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def masks(pieces: int, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks (signed longs) that keep ``pieces - max_bits`` segments."""
    cuts = [round(i * 64 / pieces) for i in range(pieces + 1)]
    segments = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = [sum(segments[i] for i in keep) for keep in combinations(range(pieces), pieces - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def pieces_for(count: int, max_bits: int = MAX_BITS) -> int:
    """Fewest segments whose nodes hold a block on average at most."""
    for pieces in range(max_bits + 1, max_bits + 5):
        if count <= BLOCK << (64 * (pieces - max_bits) // pieces):
            return pieces
    return max_bits + 4


def _level(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, low.size, FAN)
    return np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)


def tree(sorted_fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (shared bit patterns, masks of the shared bits), leaves
    first; every node covers ``FAN`` neighbours of the level below."""
    low, high, levels = sorted_fps, sorted_fps, []
    while True:
        levels.append((low, ~(low ^ high)))
        if low.size <= FAN:
            return levels
        low, high = _level(low, high)


def search(queries: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(query index, leaf index) of all pairs at most ``max_bits`` apart."""
    got_q, got_leaf = [], []
    top = levels[-1][0].size
    step = max(1, PAIR_CELLS // (top * FAN))
    for at in range(0, queries.size, step):
        q = np.repeat(np.arange(at, min(at + step, queries.size)), top)
        node = np.tile(np.arange(top), q.size // top)
        seen = np.zeros(q.size, dtype=np.uint64)
        spent = np.zeros(q.size, dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            pattern, shared = levels[depth]
            fresh = shared[node] & ~seen
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & fresh)
            keep = spent <= max_bits
            q, node, spent = q[keep], node[keep], spent[keep]
            if depth == 0:
                break
            seen = shared[node]
            below = levels[depth - 1][0].size
            children = node[:, None] * FAN + np.arange(FAN)
            real = children < below
            q, spent, seen = (np.repeat(a, FAN)[real.ravel()] for a in (q, spent, seen))
            node = children.ravel()[real.ravel()]
        got_q.append(q)
        got_leaf.append(node)
    return np.concatenate(got_q), np.concatenate(got_leaf)


def star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def block_links(fps: np.ndarray, max_bits: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, representative) among one block, or between
    and within two blocks."""
    if other is None:
        everything = fps
        if fps.size <= 3 * FAN:
            a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits, 1))
        else:
            a, b = search(fps, tree(fps), max_bits)
    else:
        everything = np.concatenate([fps, other])
        a, b = search(fps, tree(other), max_bits)
        b = b + fps.size
    label = star(everything.size, a, b)
    moved = np.nonzero(label != np.arange(everything.size))[0]
    return everything[moved].view(np.int64), everything[label[moved]].view(np.int64)


LINK_SCHEMA = "src long, dst long, mask int, pattern long, low long, high long, members binary"


def _scan_nodes(max_bits: int, block: int):
    """Over (mask, pattern, fp) sorted by Gray rank in each node: the links
    of every block, and each block that may be a part of a larger node."""

    def emit(links: list, opened: list) -> pa.RecordBatch:
        src = np.concatenate([x for x, _ in links] or [np.zeros(0, np.int64)])
        dst = np.concatenate([y for _, y in links] or [np.zeros(0, np.int64)])
        pad = [None] * len(opened)
        gap = [None] * src.size
        cols = [pa.array(src.tolist() + pad, pa.int64()), pa.array(dst.tolist() + pad, pa.int64())]
        for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())):
            cols.append(pa.array(gap + [o[k] for o in opened], kind))
        return pa.RecordBatch.from_arrays(cols, ["src", "dst", "mask", "pattern", "low", "high", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (mask, pattern, fingerprints so far, its node may have started elsewhere)
        first = True
        links: list = []
        opened: list = []

        def flush(mask: int, pattern: int, fps: np.ndarray, partial: bool) -> None:
            if fps.size > 1:
                links.append(block_links(fps, max_bits))
            if partial:
                low, high = np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps)
                opened.append((mask, pattern, int(low.view(np.int64)), int(high.view(np.int64)), fps.tobytes()))

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, pattern, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = fps.view(np.uint64)
            edge = np.nonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))[0] + 1
            bounds = [0, *edge.tolist(), fps.size]
            for a, b in zip(bounds, bounds[1:], strict=False):
                key, part, partial = (int(mask[a]), int(pattern[a])), fps[a:b], first
                if held is not None:
                    if held[0] == key:
                        part, partial = np.concatenate([held[1], part]), held[2]
                    else:
                        flush(*held[0], held[1], held[2])
                        first = partial = False
                while part.size > block:
                    flush(*key, part[:block], True)
                    part, partial = part[block:], True
                held = (key, part, partial)
            yield emit(links, opened)
            links, opened = [], []
        if held is not None:  # the node may go on in the next partition
            flush(*held[0], held[1], True)
            yield emit(links, opened)

    return run


def _scan_pairs(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                src, dst = block_links(np.frombuffer(a, np.uint64), max_bits, np.frombuffer(b, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, pieces: int | None = None, block: int = BLOCK) -> DataFrame:
    """Spanning links ``src, dst`` over distinct fingerprints ``fp``."""
    spark = nodes.sparkSession
    pieces = pieces or pieces_for(nodes.count(), max_bits)
    upper = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern"))
                                for i, m in enumerate(masks(pieces, max_bits))]))
    keyed = nodes.select("fp", upper.alias("u")).select("u.mask", "u.pattern", "fp", gray_rank(F.col("fp")).alias("rank"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["mask", "pattern", "rank"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("mask", "pattern", "fp")
    found = written(ordered.mapInArrow(_scan_nodes(max_bits, block), LINK_SCHEMA), "simhash-blocks")
    cut = found.filter("members is not null").withColumn("block", F.xxhash64("mask", "pattern", "members"))
    near = cut.select("mask", "pattern", "block", "low", "high")
    other = near.select("mask", "pattern", *[F.col(c).alias(f"{c}_2") for c in ("block", "low", "high")])
    clash = F.col("low").bitwiseAND(F.bitwise_not("high_2")).bitwiseOR(F.col("low_2").bitwiseAND(F.bitwise_not("high")))
    pairs = near.join(other, ["mask", "pattern"]).filter((F.col("block") < F.col("block_2")) & (F.bit_count(clash) <= max_bits))
    body = cut.select("block", "members")
    both = pairs.select("block", "block_2").join(body, "block").join(
        body.select(F.col("block").alias("block_2"), F.col("members").alias("members_2")), "block_2")
    across = both.select("members", "members_2").mapInArrow(_scan_pairs(max_bits), "src long, dst long")
    inside = found.filter("src is not null").select("src", "dst")
    return inside.unionByName(across).distinct()


def _to_the_end(to: DataFrame) -> DataFrame:
    """``src, to`` with every chain of steps followed to its end: a step is
    replaced by two until none gets further, so a chain of n steps takes
    log2(n) rounds."""
    while True:
        ahead = to.select(F.col("src").alias("to"), F.col("to").alias("next"))
        to = written(to.select("src", "to").join(ahead, "to", "left").select(
            "src", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "simhash-jump")
        if to.filter("moved").isEmpty():
            return to.select("src", "to")


def components(edges: DataFrame) -> DataFrame:
    """``fp, root`` for every fingerprint with a link. Each round sends a
    node to its smallest neighbour, if that is smaller, and on to the end of
    such steps, and keeps the links between the nodes arrived at. These have
    no smaller neighbour, so each stands for two nodes at least: rounds, and
    the jumps in a round, are at most the logarithm of the nodes."""
    edges = written(edges, "simhash-edges")
    root = None
    while not edges.isEmpty():
        around = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = _to_the_end(written(around.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("to")), "simhash-round"))
        step = to.select(F.col("src").alias("root"), "to")
        root = to.select(F.col("src").alias("fp"), F.col("to").alias("root")) if root is None else written(
            root.join(step, "root", "left").select("fp", F.coalesce("to", "root").alias("root")), "simhash-roots")
        moved = edges.join(to, "src").select(F.col("to").alias("a"), F.col("dst").alias("src")).join(to, "src").select(
            F.least("a", "to").alias("src"), F.greatest("a", "to").alias("dst"))
        edges = written(moved.filter("src <> dst").distinct(), "simhash-edges")
    if root is None:
        return edges.select(F.col("src").alias("fp"), F.col("dst").alias("root"))
    return root


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """``id, locator, fp`` of a stored table, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in strings(b, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("locator"), pa.array(fps.view(np.int64))], ["id", "locator", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), locator(docs).alias("locator"),
                       F.col(text_col).cast("string").alias("text"))
    return map_text(rows, run, f"id long, locator {LOCATOR}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    seed: int = SEED, max_bits: int = MAX_BITS, pieces: int | None = None, block: int = BLOCK) -> DataFrame:
    """``id, locator, fp, component_id, keep_locator`` for every row of
    ``docs``; one row of each class stays, that at ``keep_locator``."""
    docs = stored(docs)
    rows = written(fingerprints(docs, id_col, text_col, words, seed), "simhash-fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "simhash-nodes")
    root = components(links(nodes.select("fp"), max_bits, pieces, block))
    member = written(nodes.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n"), "simhash-members")
    best = member.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("members"))
    # a class of very many fingerprints, a fingerprint of very many rows
    classes = keyed_join(member.select("fp", "root", "n"), written(best, "simhash-best"), "root", "members")
    return keyed_join(rows, written(classes.select("fp", "first", "n"), "simhash-classes"), "fp", "n").select(
        "id", "locator", "fp", F.col("first.id").alias("component_id"), F.col("first.locator").alias("keep_locator"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, all columns of ``docs``."""
    docs = stored(docs)
    return keep_rows(docs, near_duplicates(docs, id_col, text_col).filter("locator = keep_locator"))


def simhash_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
