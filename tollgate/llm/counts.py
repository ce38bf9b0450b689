"""Token counts without token ids: heap-and-linked-list byte-pair merging.

A word starts as a linked list of its symbols (bytes as printable characters,
the last one marked as the word's end). A heap holds every adjacent pair that
has a merge, by rank and then position; the lowest is popped again and again,
stale entries are passed over, and a merge links the pair into one symbol and
pushes its two new neighbours. The count is the number of initial symbols
minus the number of merges; no identifier is looked up or emitted.

Defined results: null text counts as empty (no tokens); special strings of
the vocabulary inside a text count as one token each, as the library's
default has it; null ids and repeated rows are counted like any other row; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_value, map_text, strings, worker_store
from .words import CLOSING, OLD_LETTERS, RecentChunks, plain, spelled, word_pattern

by_value(__name__)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048


def merges_of(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in one word."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merged = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        merged += 1
        k = after[i] = after[j]
        after[j] = -1  # no longer a symbol
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return merged


class TokenCounter:
    """Counts tokens of whole texts under a word vocabulary file."""

    def __init__(self, vocabulary: bytes):
        store = worker_store(f"counts-{zlib.crc32(vocabulary)}-{len(vocabulary)}")
        if not store:
            spec = json.loads(vocabulary)
            ranks = {tuple(m): r for r, m in enumerate(spec["model"]["merges"])}
            suffix = spec["model"].get("end_of_word_suffix") or ""
            find = word_pattern(spec).findall
            marks = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
            library = Tokenizer.from_str(vocabulary.decode("utf-8"))
            normal, cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

            def of_word(word: str) -> int:
                symbols = list(word)
                symbols[-1] += suffix
                return len(symbols) - merges_of(symbols, ranks)

            def of_text(text: str) -> int:
                """The words as the library normalises and cuts them, with
                its own tables of letters and lower case."""
                return sum(words[w] for w, _ in cut(normal(text)))

            def of_chunk(chunk: str) -> int:
                if len(chunk) > 1 and chunk[-1] in CLOSING and OLD_LETTERS.fullmatch(chunk, 0, len(chunk) - 1):
                    return chunks[chunk[:-1]] + chunks[chunk[-1]]
                word = OLD_LETTERS.fullmatch(chunk) is not None
                if not word and not chunk.isascii():
                    return of_text(chunk)
                low = chunk.lower()
                if low != chunk:
                    return chunks[low]
                return words[spelled(chunk)] if word else sum(words[spelled(w)] for w in find(chunk))

            words, chunks = RecentChunks(of_word), RecentChunks(of_chunk)
            store["marks"] = tuple(marks)
            store["split"] = regex.compile("|".join(map(regex.escape, marks))) if marks else None
            store["words"], store["of_text"], store["chunks"] = words, of_text, chunks
        self.__dict__.update(store)

    def count(self, text: str) -> int:
        self.words.trim()
        self.chunks.trim()
        if plain(text, self.marks):
            return sum(map(self.chunks.__getitem__, text.split()))
        parts = self.split.split(text) if self.split is not None else [text]
        return sum(map(self.of_text, parts)) + len(parts) - 1


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY,
                 limit: int = LIMIT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for b in batches:
            n = [counter.count(t) for t in strings(b, "_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_bytes"), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    schema = docs.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return map_text(rows, run, schema)
