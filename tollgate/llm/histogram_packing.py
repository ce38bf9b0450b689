"""Shortest-pack-first packing over the length histogram.

Documents are tokenized and closed with an end id; only those longer than a
sequence are cut, at multiples of its capacity. What is packed is not the
pieces but their histogram: at most ``capacity`` lengths with their counts.
Lengths are placed longest first. Open packs are kept as patterns (the lengths
inside) with a count, and a length goes into the packs with most space left,
as many at once as the pattern and the length both have; if it fits into none,
new packs are opened for all that are left. A pattern that is only partly used
is split in two. So the work depends on the number of distinct lengths and
not on the rows.

Each pattern then owns a run of sequence numbers, and of each of its lengths a
run of ranks. Pieces get a rank within their length and find sequence and
offset in these runs. Ranks are counted without a window over a whole length:
a length is dealt into cells of about ``CELL_ROWS`` pieces, which are counted,
and each piece is numbered in its cell from the count of the cells before.

Bounds: the histogram has at most ``capacity`` rows. A placement either uses
up a length or a pattern, and each length splits one pattern and opens one, so
there are at most 2 * ``capacity`` patterns; one with sum ``capacity`` has
less than sqrt(2 * ``capacity``) distinct lengths. Both are therefore bounded
at any input size, and small enough to go to the driver and to every task.

Defined results: a null or empty text is one piece holding the end id alone;
null ids and repeated rows are packed like any other row; an empty table gives
no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, map_text, strings, written
from .words import WordTokens

by_value(__name__)

CAPACITY = 2048
END_ID = 1
CELL_ROWS = 1_000
RANK_BITS = 44
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def pack_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of the packs, shortest pack first: lengths are
    placed longest first, each into the packs with most space left."""
    packs: list[tuple] = []  # heap of (-space left, age, count, (lengths before, last length))
    age = 0
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            age += 1
            if not packs or -packs[0][0] < length:
                # none has room: a new pack, which is then the one with most space, so it takes all it can hold
                copies = min(capacity // length, todo)
                chain = None
                for _ in range(copies):
                    chain = (chain, length)
                used = todo // copies
                heapq.heappush(packs, (copies * length - capacity, age, used, chain))
                todo -= used * copies
                continue
            gap, old, count, lengths = heapq.heappop(packs)
            used = min(count, todo)
            heapq.heappush(packs, (gap + length, age, used, (lengths, length)))
            if used < count:
                heapq.heappush(packs, (gap, old, count - used, lengths))
            todo -= used
    out = []
    for _, _, count, chain in sorted(packs, key=lambda p: p[:2]):
        lengths = []
        while chain is not None:
            chain, last = chain
            lengths.append(last)
        out.append((count, tuple(reversed(lengths))))
    return out


class Places:
    """Where the piece of each length and rank lies."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        taken: dict[int, int] = {}
        runs = []  # length, first rank, copies in a pack, first sequence, offset
        first = 0
        for count, lengths in patterns:
            at = offset = 0
            while at < len(lengths):
                length, copies = lengths[at], 1
                while at + copies < len(lengths) and lengths[at + copies] == length:
                    copies += 1
                rank = taken.get(length, 0)
                runs.append((length, rank, copies, first, offset))
                taken[length] = rank + copies * count
                offset += copies * length
                at += copies
            first += count
        runs.sort()
        table = np.array(runs, dtype=np.int64).reshape(-1, 5)
        self.keys = (table[:, 0] << RANK_BITS) | table[:, 1]
        self.first_rank, self.copies, self.sequence, self.offset = (table[:, k] for k in range(1, 5))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset."""
        run = np.searchsorted(self.keys, (length << RANK_BITS) | rank, side="right") - 1
        pack, copy = np.divmod(rank - self.first_rank[run], self.copies[run])
        return self.sequence[run] + pack, self.offset[run] + copy * length


def ranked(rows: DataFrame, histogram: dict[int, int], cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (a stored table with the columns ``length`` and ``row``, its
    distinct row number) with ``rank``, gapless from 0 within each length."""
    cells = rows.sparkSession.createDataFrame([(k, -(-n // cell_rows)) for k, n in histogram.items()], "length long, __cells long")
    # one row a length: at most as many as a sequence has tokens
    cell = F.pmod(F.xxhash64("row"), F.col("__cells"))
    dealt = rows.join(F.broadcast(cells), "length").withColumn("__cell", cell).drop("__cells")
    counts = dealt.groupBy("length", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__cell").orderBy("row")) - 1
    return dealt.withColumn("__k", inside).join(starts, ["length", "__cell"]).select(
        *rows.columns, (F.col("__before") + F.col("__k")).alias("rank"))


def pack_rows(rows: DataFrame, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (a stored table with ``length``, from 1 to ``capacity``, and
    ``row``) with ``sequence_id`` and ``offset`` instead of ``row``."""
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(pack_patterns(histogram, capacity))
    kept = [c for c in rows.columns if c != "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                                             [*kept, "sequence_id", "offset"])

    schema = rows.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked(rows, histogram, cell_rows).mapInArrow(run, schema)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: bytes, end_id: int) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows, columns = [], ([], [], [], [])
            for k, text in enumerate(strings(b, "text")):
                raw = tokens.id_bytes(text) + end
                for at in range(0, len(raw), 4 * capacity):
                    part = raw[at:at + 4 * capacity]
                    rows.append(k)
                    for column, value in zip(columns, (at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    return map_text(rows, run, schema)


def pack_by_histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                      vocabulary_path: str = VOCABULARY, end_id: int = END_ID, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    pieces = token_pieces(docs, id_col, text_col, capacity, vocabulary, end_id)
    rows = written(pieces.withColumn("row", F.monotonically_increasing_id()), "histogram-pieces")
    return pack_rows(rows, capacity, cell_rows)


def histogram_packing_query(docs: DataFrame) -> DataFrame:
    return pack_by_histogram(docs).withColumnRenamed("id", "doc_id")
