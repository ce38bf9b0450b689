"""Cross-tokenizer alignment with counts of linked id pairs.

Each text, with a space before it, is encoded by a byte-level vocabulary A and
by a sentence-piece vocabulary B. Where a token of A and a token of B end at
the same byte the two are linked, and these places cut both sequences into
groups. Texts are encoded once and their ids written; both passes align the
written ids by their byte lengths.

First pass: every task aligns its documents and gives its distinct linked
pairs with their number. The pairs of all tasks are united up a tree (nodes of
``FAN`` tasks), and a minimal perfect hash is built over them: in each level
the keys that are alone in their cell of a bit array are placed, the others go
to the next level, and a key's number is the count of bits set before its own.
Counts are dense vectors indexed by that number, summed up the tree.

Second pass: documents are aligned again and look up the count of each link;
the key kept under the number is compared, so a pair that was never seen can
not take another's count.

Bound: both tokens of a link end at the same byte, so the shorter one is a
suffix of the longer one. The number of distinct pairs is at most the number
of such pairs of vocabulary entries (``pair_bound``; a few times the entries),
whatever the size of the input. Key sets, vectors and the hash stay below
that, which is why one task, the driver and every worker may hold one.

Defined results: a null or empty text, or one whose tokens do not join to the
bytes of the space and the text (B writes some characters otherwise), has no
tokens: zeros and ''. Null ids and repeated rows are aligned and counted like
any other row; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_value, map_text, strings, worker_store, written
from .words import CLOSING, LETTERS, OLD_LETTERS, RecentChunks, spelled

by_value(__name__)

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
FAN = 16
GAMMA = 2
MAX_CHUNKS = 600_000
#: Cuts before white space; chunks do not depend on each other under A.
CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: Characters on which notions of white space differ or that join its runs.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u2064\u3000\ufeff]")
MARK = "\u2581"


# ---- vocabularies

def bytes_of_a(content: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file."""
    byte = {c: b for b, c in LETTERS.items()}
    entries = Tokenizer.from_str(content.decode("utf-8")).get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode("utf-8")
    return out


def bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each piece."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode("utf-8"))
    return out


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Number of pairs of entries one of which is a suffix of the other."""
    def suffixes(longer: list[bytes], shorter: list[bytes], own: int) -> int:
        known = Counter(shorter)
        return sum(known[t[k:]] for t in longer for k in range(own, len(t)))

    return suffixes(a, b, 0) + suffixes(b, a, 1)


class BothTokens:
    """Ids of texts under both vocabularies, kept per worker. A text is cut at
    white space for A, and each distinct chunk encoded once."""

    def __init__(self, a: bytes, b: bytes):
        store = worker_store(f"both-{zlib.crc32(a)}-{zlib.crc32(b)}")
        if not store:
            library = Tokenizer.from_str(a.decode("utf-8"))
            library.encode_special_tokens = True
            model = sentencepiece.SentencePieceProcessor(model_proto=b)
            raw_a, raw_b = bytes_of_a(a), bytes_of_b(model)
            kind_a, kind_b = id_type(len(raw_a)), id_type(len(raw_b))
            tokenize = library.model.tokenize

            def whole(text: str) -> bytes:
                return np.array(library.encode(text, add_special_tokens=False).ids, dtype=kind_a).tobytes()

            def chunk_ids(chunk: str) -> bytes:
                if len(chunk) > 2 and chunk[-1] in CLOSING and OLD_LETTERS.fullmatch(chunk, 1, len(chunk) - 1):
                    return chunks[chunk[:-1]] + chunks[chunk[-1]]
                if chunk[0] == " " and OLD_LETTERS.fullmatch(chunk, 1):  # one word of the split
                    return np.array([t.id for t in tokenize(LETTERS[32] + spelled(chunk[1:]))], dtype=kind_a).tobytes()
                return whole(chunk)

            chunks = RecentChunks(chunk_ids)
            split = repr(library.pre_tokenizer)
            store.update(whole=whole, chunks=chunks, model=model, raw_b=raw_b, kind_b=kind_b,
                         # chunks are independent of each other under the byte-level split
                         cut=library.normalizer is None and split.startswith("ByteLevel(") and "use_regex=True" in split)
        self.__dict__.update(store)

    def ids_a(self, spaced: str) -> bytes:
        if not self.cut or ODD_SPACE.search(spaced) is not None:
            return self.whole(spaced)
        self.chunks.trim(MAX_CHUNKS)
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(spaced)))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Little-endian ids of each text under A and B; empty if it has none."""
        for text, b in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            if text and b"".join(map(self.raw_b.__getitem__, b)) == spaced.encode("utf-8"):
                yield self.ids_a(spaced), np.array(b, dtype=self.kind_b).tobytes()
            else:
                yield b"", b""


def id_type(entries: int) -> str:
    return "<u2" if entries <= 1 << 16 else "<u4"


# ---- minimal perfect hash

def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A number from 0 to n - 1 for each of n distinct keys."""

    def __init__(self, keys: np.ndarray):
        self.sizes, words, left = [], [], keys
        while left.size:
            size = -(-GAMMA * left.size // 64) * 64
            cell = (_mixed(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            held = np.bincount(cell, minlength=size)
            words.append(np.packbits(held == 1, bitorder="little").view("<u8"))
            left = left[held[cell] != 1]
            self.sizes.append(size)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.zeros(keys.size, dtype=np.int64)
        self.keys[self._number(keys)] = keys

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.size, -1, dtype=np.int64)
        open_, base = np.arange(keys.size), 0
        for level, size in enumerate(self.sizes):
            cell = _mixed(keys[open_], level) % np.uint64(size) + np.uint64(base)
            word, bit = (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            here = self.words[word]
            hit = (here >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[word] + below)[hit]
            open_ = open_[~hit]
            base += size
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for a key that is none of the n."""
        number = self._number(keys)
        number[(number >= 0) & (self.keys[number] != keys)] = -1
        return number


# ---- alignment of ids

class Aligner:
    """Aligns ids by the byte lengths of their tokens."""

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.lengths_a, self.lengths_b = lengths_a, lengths_b
        self.kind_a, self.kind_b = id_type(lengths_a.size), id_type(lengths_b.size)

    def batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents of a batch, one after another, and the number
        of ids of each document."""
        raw_a, raw_b = b.column("a").to_pylist(), b.column("b").to_pylist()
        ids_a = np.frombuffer(b"".join(raw_a), self.kind_a).astype(np.int64)
        ids_b = np.frombuffer(b"".join(raw_b), self.kind_b).astype(np.int64)
        width_a, width_b = np.dtype(self.kind_a).itemsize, np.dtype(self.kind_b).itemsize
        return (ids_a, ids_b, np.fromiter(map(len, raw_a), np.int64, b.num_rows) // width_a,
                np.fromiter(map(len, raw_b), np.int64, b.num_rows) // width_b)

    def links(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in A and in B of the tokens that end at the same byte. A
        document has the same bytes in both, so none reaches into the next."""
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        at = np.searchsorted(ends_b, ends_a)
        both = ends_b[at] == ends_a if ends_b.size else np.zeros(0, bool)
        return np.nonzero(both)[0], at[both]

    def keys(self, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
        """One number for each pair of ids."""
        return ids_a * self.lengths_b.size + ids_b


def _united(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=distinct.size).astype(np.int64)


def up_the_tree(rows: DataFrame, nodes: int, merge: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """One row from ``rows`` (``node`` below ``nodes``, and binary columns),
    merged ``FAN`` neighbours at a time."""
    while True:
        nodes = -(-nodes // FAN)

        def merged(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table({"node": pa.array([key[0].as_py()], pa.int64()),
                             **{k: pa.array([v], pa.binary()) for k, v in merge(table).items()}})

        rows = rows.withColumn("node", F.floor(F.col("node") / F.lit(FAN)).cast("long")).groupBy("node").applyInArrow(merged, schema)
        if nodes <= 1:
            return rows


def pair_counts(tokens: DataFrame, aligner: Aligner) -> tuple[PerfectHash, np.ndarray]:
    """The perfect hash of all linked pairs and their counts by its numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            ids_a, ids_b, _, _ = aligner.batch(b)
            at_a, at_b = aligner.links(ids_a, ids_b)
            more, n = np.unique(aligner.keys(ids_a[at_a], ids_b[at_b]), return_counts=True)
            keys, counts = _united(np.concatenate([keys, more]), np.concatenate([counts, n]))
        if keys.size:
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                                             ["keys", "counts"])

    found = tokens.mapInArrow(partial, "keys binary, counts binary")
    parts = written(found.select(F.spark_partition_id().cast("long").alias("node"), "keys", "counts"), "alignment-pairs")
    nodes = (parts.agg(F.max("node")).first()[0] or 0) + 1

    def joined(table: pa.Table, name: str) -> list[np.ndarray]:
        return [np.frombuffer(v, np.int64) for v in table.column(name).to_pylist()]

    def union(table: pa.Table) -> dict:
        return {"keys": functools.reduce(np.union1d, joined(table, "keys")).tobytes()}

    top = up_the_tree(parts.select("node", "keys"), nodes, union, "node long, keys binary").first()
    hashed = PerfectHash(np.frombuffer(top["keys"], np.int64) if top else np.zeros(0, np.int64))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, keys, counts in zip(*(b.column(c).to_pylist() for c in ("node", "keys", "counts")), strict=True):
                vector = np.zeros(hashed.keys.size, np.int64)
                vector[hashed.find(np.frombuffer(keys, np.int64))] = np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([vector.tobytes()], pa.binary())], ["node", "vector"])

    def total(table: pa.Table) -> dict:
        return {"vector": sum(joined(table, "vector")).tobytes()}

    vectors = parts.mapInArrow(dense, "node long, vector binary")
    top = up_the_tree(vectors, nodes, total, "node long, vector binary").first()
    return hashed, np.frombuffer(top["vector"], np.int64) if top else np.zeros(0, np.int64)


def _codes(ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, entries_a: int, entries_b: int) -> np.ndarray:
    """The groups as one sequence of numbers: A ids and B ids group by group,
    the last of a side shifted by the entries, B ids after all those of A."""
    last_a, last_b = np.zeros(ids_a.size, bool), np.zeros(ids_b.size, bool)
    last_a[at_a], last_b[at_b] = True, True
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    ends_a, ends_b = at_a + 1, at_b + 1
    out = np.empty(ids_a.size + ids_b.size, np.int64)
    out[np.arange(ids_a.size) + np.concatenate([[0], ends_b])[group_a]] = ids_a + last_a * entries_a
    out[np.arange(ids_b.size) + ends_a[group_b]] = ids_b + 2 * entries_a + last_b * entries_b
    return out


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = VOCABULARY_A,
            path_b: str = VOCABULARY_B) -> DataFrame:
    """``id, a, b``: little-endian ids of each whole text."""
    a, b = (open_bytes(p) for p in (path_a, path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = BothTokens(a, b)
        for batch in batches:
            got = list(tokens.encode(strings(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([g[k] for g in got], pa.binary()) for k in (0, 1))],
                                             ["id", "a", "b"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, run, rows.select("id").schema.add("a", "binary").add("b", "binary"), rows=256)


def open_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = VOCABULARY_A,
            path_b: str = VOCABULARY_B, spans: bool = False) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of each row of ``docs``; with ``spans``, also ``groups`` in plain text."""
    raw_a = bytes_of_a(open_bytes(path_a))
    raw_b = bytes_of_b(sentencepiece.SentencePieceProcessor(model_proto=open_bytes(path_b)))
    aligner = Aligner(np.array([len(t) for t in raw_a]), np.array([len(t) for t in raw_b]))
    tokens = written(encoded(docs, id_col, text_col, path_a, path_b), "alignment-ids")
    hashed, counts = pair_counts(tokens, aligner)
    of_b = hashed.keys % len(raw_b)
    most = np.zeros(len(raw_b), np.int64)
    np.maximum.at(most, of_b, counts)
    best = counts == most[of_b]
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written_as = [f"{i}{end}" for n, ends in ((len(raw_a), ",|"), (len(raw_b), ",;")) for end in ends for i in range(n)]
        for b in batches:
            ids_a, ids_b, n_a, n_b = aligner.batch(b)
            at_a, at_b = aligner.links(ids_a, ids_b)
            number = hashed.find(aligner.keys(ids_a[at_a], ids_b[at_b]))
            if number.size and number.min() < 0:
                raise ValueError("a link of the second pass was not seen in the first")
            doc = np.searchsorted(np.cumsum(n_a), at_a, side="right")
            n = np.bincount(doc, minlength=b.num_rows)
            n_best = np.bincount(doc[best[number]], minlength=b.num_rows)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, doc, counts[number])
            text = list(map(written_as.__getitem__, _codes(ids_a, ids_b, at_a, at_b, len(raw_a), len(raw_b)).tolist()))
            stops = np.cumsum(n_a + n_b).tolist()
            groups = ["".join(text[x:y])[:-1] for x, y in zip([0, *stops], stops, strict=False)]
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            columns = [b.column("id"), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n, n, n_best, sums)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(groups, pa.string())] * spans,
                                             ["id", *names, "groups_sha256"] + ["groups"] * spans)

    schema = tokens.select("id").schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    return map_text(tokens, run, schema.add("groups", "string") if spans else schema, rows=256)


def alignment_query(docs: DataFrame) -> DataFrame:
    return aligned(docs).withColumnRenamed("id", "doc_id")
