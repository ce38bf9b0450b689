"""Sum-of-squares packing of token sequences.

Documents are tokenized, closed with an end id and cut into pieces of at most
``capacity`` tokens (only longer documents are cut). Pieces are dealt at
random into packs of about ``pack_bins`` sequences' worth of tokens, and each
pack is filled on its own, so a pack has a bounded number of rows at any input
size. In a pack, longest pieces first, each piece goes where the sum over all
residual gaps of the squared number of open sequences with that gap becomes
smallest (a full sequence counts no more); ties go to the smallest gap left,
then to an open sequence before a new one.

Defined results: a null or empty text is one piece holding the end id alone;
null ids and repeated rows are packed like any other row; an empty table
gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, map_text, strings, written
from .words import WordTokens

by_value(__name__)

CAPACITY = 4096
END_ID = 1
PACK_BINS = 2048
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, given longest first."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(lengths.size, dtype=np.int64)
    offsets = np.empty(lengths.size, dtype=np.int64)
    made = 0
    for k, size in enumerate(lengths.tolist()):
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if size < capacity:
            have = count[size:capacity]
            cost = 2 * (count[:capacity - size] - have) + 2
            cost[0] = 1 - 2 * have[0]
            cost[have == 0] = np.iinfo(np.int64).max
            left = int(np.argmin(cost))
            gap = size + left if cost[left] <= fresh else capacity
        else:
            gap = capacity
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = holders[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > size:
            holders[gap - size].append(at)
            count[gap - size] += 1
    return bins, offsets


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: bytes, end_id: int) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows, index, start, length, crc = [], [], [], [], []
            for k, text in enumerate(strings(b, "text")):
                raw = tokens.id_bytes(text) + end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    rows.append(k)
                    index.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return map_text(rows, run, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, pack_bins: int = PACK_BINS) -> DataFrame:
    """``rows`` (a stored table with a ``length`` column) with
    ``sequence_id`` and ``offset``."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    packs = max(1, -(-total // (capacity * pack_bins)))
    names = rows.columns

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("length").to_numpy(), kind="stable")
        bins, offsets = sum_of_squares(table.column("length").to_numpy()[order], capacity)
        out = table.take(pa.array(order)).select(names)
        out = out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    dealt = rows.withColumn("__pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(packs)))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("__pack").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   vocabulary_path: str = VOCABULARY, end_id: int = END_ID, pack_bins: int = PACK_BINS) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    rows = written(pieces(docs, id_col, text_col, capacity, vocabulary, end_id), "packing-pieces")
    return pack(rows, capacity, pack_bins)


def packing_query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).withColumnRenamed("id", "doc_id")
