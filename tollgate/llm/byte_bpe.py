"""Byte-level BPE as a finite-state transducer, and its streaming inverse.

Encoding. A BPE encoding is characterised by its neighbours: a token sequence
is the encoding of its bytes exactly if every two adjacent tokens, encoded
together, stay those two tokens. So the encodings of all prefixes of a match
can be followed from left to right. A state of the transducer is the set of
boundaries from which some vocabulary token may still reach past the bytes
read: for each, the tokens not yet emitted, the last token before it, and the
place in the byte trie of the vocabulary. Reading a byte moves every
boundary down the trie and adds at most one new boundary (the one token that
fits its left neighbour); tokens that all boundaries agree on are emitted, so
output lags input by a bounded lookahead, and the end of the match emits the
rest. States are made when first reached and numbered, and their transitions
kept (lazy determinisation), so most bytes cost one lookup. Full tables are
dropped and rebuilt, which bounds memory and changes no result.

Decoding. Token ids are read one at a time; a UTF-8 state machine holds the
bytes of an unfinished character and emits text as characters complete.
Transitions (unfinished bytes, token) are kept once seen. Malformed bytes
become U+FFFD, as in the library's own text decoding.

Defined results: null text counts as empty: no tokens, hash of the empty
string; null ids and repeated rows are encoded like any other row; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import gc
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, map_text, strings, worker_store
from .words import CLOSING, Chunks

by_value(__name__)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
STATE, END = -1, -2
MAX_STATES = 300_000
MAX_ADJACENT = 600_000
MAX_CHUNKS = 500_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Transducer:
    """``encode`` gives the token ids of one match of the pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # trie: node -> {byte: node}; a node's token id, or None
        self.below: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.below[node].get(byte)
                if nxt is None:
                    nxt = self.below[node][byte] = len(self.below)
                    self.below.append({})
                    self.token_at.append(None)
                node = nxt
            self.token_at[node] = rank
        self.adjacent: dict[tuple[int | None, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        """Forget all states but the first. A state is its transitions,
        {byte: (next state, tokens emitted)}; under STATE it keeps its live
        boundaries, under END what the end of the match emits."""
        start = (((), None, 0),)
        self.start: dict = {STATE: start, END: ()}
        self.states: dict[tuple, dict] = {start: self.start}

    def _merged(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first, over the bytes of a few tokens."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int | None, token: int) -> bool:
        """Whether the two tokens stay as they are when encoded together."""
        key = (left, token)
        got = self.adjacent.get(key)
        if got is None:
            if len(self.adjacent) > MAX_ADJACENT:
                self.adjacent.clear()
            before = b"" if left is None else self.tokens[left]
            want = [token] if left is None else [left, token]
            got = self.adjacent[key] = self._merged(before + self.tokens[token]) == want
        return got

    def _move(self, boundaries: tuple, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The transition of a state on a byte: next state, tokens emitted."""
        below, token_at, adjacent = self.below, self.token_at, self.adjacent
        live = []
        fresh = None
        for pending, last, node in boundaries:
            nxt = below[node].get(byte)
            if nxt is None:
                continue
            token = token_at[nxt]
            if token is not None and fresh is None:
                fit = adjacent.get((last, token))
                if fit or (fit is None and self.fits(last, token)):
                    fresh = ((*pending, token), token, 0)
            if below[nxt]:
                live.append((pending, last, nxt))
        if fresh is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append(fresh)
        first = live[0][0]
        agreed = 0
        for token in first:
            if not all(len(p) > agreed and p[agreed] == token for p, _, _ in live):
                break
            agreed += 1
        if agreed:
            live = [(p[agreed:], last, node) for p, last, node in live]
        key = tuple(live)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {STATE: key, END: live[-1][0]}
        return state, first[:agreed]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state = self.start
        for byte in data:
            step = state.get(byte)
            if step is None:
                step = state[byte] = self._move(state[STATE], byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += state[END]
        return out


def whole_tokens(tokens: dict[int, bytes]) -> dict[int, str]:
    """Text of the tokens that leave the state machine where it started."""
    out = {}
    for i, raw in tokens.items():
        with contextlib.suppress(UnicodeDecodeError):
            out[i] = raw.decode("utf-8")
    return out


class Decoder:
    """Incremental UTF-8: ``feed`` takes token ids and gives finished text."""

    def __init__(self, tokens: dict[int, bytes], steps: dict | None = None, whole: dict | None = None):
        self.tokens = tokens
        self.steps = {} if steps is None else steps
        self.whole = whole_tokens(tokens) if whole is None else whole
        self.held = b""

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        if not self.held:  # a run of tokens that start and end with whole characters
            run = list(map(self.whole.get, ids := list(ids)))
            if None not in run:
                yield "".join(run)
                return
        held, steps = self.held, self.steps
        for i in ids:
            step = steps.get((held, i))
            if step is None:
                step = steps[(held, i)] = self._step(held, i)
            held, text = step
            yield text
        self.held = held

    def _step(self, held: bytes, token: int) -> tuple[bytes, str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = machine.decode(held + self.tokens[token])
        return machine.getstate()[0], text

    def finish(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


#: A space next to other white space; without one, single spaces cut a text
#: into chunks that the pattern treats independently of each other.
WIDE_SPACE = regex.compile(r" \s|\s ")


class ByteBpe:
    """Encodes and decodes whole texts, kept per worker."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        store = worker_store(f"byte-bpe-{zlib.crc32(content)}-{pattern}")
        if not store:
            gc.set_threshold(200_000, 20, 100)  # the tables hold many small objects and no cycles
            machine = Transducer(read_ranks(content))
            find = regex.compile(pattern).findall

            def ids(chunk: str) -> tuple[int, ...]:
                if len(chunk) > 2 and chunk[-1] in CLOSING and chunk[1:-1].isalpha():
                    return chunks[chunk[:-1]] + chunks[chunk[-1]]
                if (chunk if chunk[0] != " " else chunk[1:]).isalpha():
                    return tuple(machine.encode(chunk.encode("utf-8")))
                return tuple(chain.from_iterable(machine.encode(m.encode("utf-8")) for m in find(chunk)))

            chunks = Chunks(ids)
            matches = Chunks(lambda m: tuple(machine.encode(m.encode("utf-8"))))
            store.update(machine=machine, find=find, chunks=chunks, matches=matches, steps={},
                         whole=whole_tokens(machine.tokens), names={i: str(i) for i in machine.tokens})
        self.__dict__.update(store)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if WIDE_SPACE.search(text) is not None or text[0].isspace() or text[-1].isspace():
            self.matches.trim(MAX_CHUNKS)
            return list(chain.from_iterable(map(self.matches.__getitem__, self.find(text))))
        self.chunks.trim(MAX_CHUNKS)
        first, *rest = text.split(" ")
        get = self.chunks.__getitem__
        return list(chain(get(first), *map(get, map(" ".__add__, rest))))

    def decode(self, ids: list[int]) -> str:
        if len(self.steps) > MAX_CHUNKS:
            self.steps.clear()
        decoder = Decoder(self.machine.tokens, self.steps, self.whole)
        return "".join(decoder.feed(ids)) + decoder.finish()


    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
               pattern: str = PATTERN) -> DataFrame:
    """``id_col, ids, decoded``: token ids of each whole text and the text
    that the ids decode to."""
    return _coded(docs, id_col, text_col, ranks_path, pattern, lambda coder, ids, text: (
        [pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], ["ids", "decoded"]),
        [("ids", "array<int>"), ("decoded", "string")])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
            pattern: str = PATTERN) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: the same, digested in
    the task that encodes."""

    def digest(values: Iterable[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    return _coded(docs, id_col, text_col, ranks_path, pattern, lambda coder, ids, text: (
        [pa.array(list(map(len, ids)), pa.int64()), digest(coder.listed(i).encode() for i in ids),
         digest(t.encode("utf-8") for t in text)], ["n_tokens", "ids_sha256", "decoded_sha256"]),
        [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])


def _coded(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, columns, fields) -> DataFrame:
    with open(ranks_path, "rb") as f:
        content = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(content, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids = [coder.encode(t) for t in strings(b, "_text")]
                values, names = columns(coder, ids, [coder.decode(i) for i in ids])
                yield pa.RecordBatch.from_arrays([b.column("_id"), *values], [id_col, *names])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {id_type}", *(f"{n} {t}" for n, t in fields)])
    return map_text(rows, run, schema)
