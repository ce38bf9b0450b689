"""Word-level access to a vocabulary whose words do not cross white space
(normalised to lower case, white space dropped, word ends marked).

Chunks between white space are independent of each other, so each distinct
chunk is tokenized once per worker and looked up after that; the store of
chunks is emptied when it is full, so memory is bounded."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

from .common import by_value, worker_store

by_value(__name__)

MAX_CHUNKS = 600_000
#: Marks that stand by themselves after a word.
CLOSING = frozenset(".,;:!?")
#: White space to Python's split() but not to the vocabulary's pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")


#: Letters in every edition of the Unicode tables, with one lower-case letter each.
OLD_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def plain(text: str, marks: tuple[str, ...]) -> bool:
    """Whether white space alone separates the chunks of this text as the
    vocabulary's own normalisation does: no special string inside, no
    control character on which the two notions of white space differ."""
    return ODD_SPACE.search(text) is None and not any(m in text for m in marks)


class Chunks(dict):
    """chunk -> value, computed on first use."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        value = self[chunk] = self.make(chunk)
        return value

    def trim(self, limit: int = MAX_CHUNKS) -> None:
        if len(self) > limit:
            self.clear()


class RecentChunks(Chunks):
    """Chunks in two generations: those in use outlive a full store."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__(make)
        self.older: dict = {}

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            value = self.make(chunk)
        self[chunk] = value
        return value

    def trim(self, limit: int = MAX_CHUNKS) -> None:
        if len(self) > limit // 2:
            self.older = dict(self)
            self.clear()


#: Byte to printable character, as byte-level vocabularies write bytes.
def byte_letters() -> dict[int, str]:
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


LETTERS = byte_letters()


def spelled(word: str) -> str:
    """A word's bytes, one character each."""
    if word.isascii() and word.isalpha():
        return word
    return word.encode("utf-8").decode("latin-1").translate(LETTERS)


def word_pattern(spec: dict) -> regex.Pattern:
    """The split pattern that a vocabulary file states."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    return regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))


class WordTokens:
    """Token ids as the ``tokenizers`` library gives them, by chunk."""

    def __init__(self, vocabulary: bytes):
        store = worker_store(f"words-{zlib.crc32(vocabulary)}-{len(vocabulary)}")
        if not store:
            spec = json.loads(vocabulary)
            library = Tokenizer.from_str(vocabulary.decode("utf-8"))
            find, tokenize = word_pattern(spec).findall, library.model.tokenize

            def ids(chunk: str) -> bytes:
                if len(chunk) > 1 and chunk[-1] in CLOSING and OLD_LETTERS.fullmatch(chunk, 0, len(chunk) - 1):
                    return chunks[chunk[:-1]] + chunks[chunk[-1]]
                word = OLD_LETTERS.fullmatch(chunk) is not None
                if not word and not chunk.isascii():  # the library's own tables say what is a letter, and its lower case
                    return array("I", library.encode(chunk, add_special_tokens=False).ids).tobytes()
                low = chunk.lower()
                if low != chunk:
                    return chunks[low]
                if word:
                    return array("I", [t.id for t in tokenize(spelled(chunk))]).tobytes()
                return array("I", [t.id for w in find(chunk) for t in tokenize(spelled(w))]).tobytes()

            chunks = RecentChunks(ids)
            store["marks"] = tuple(t["content"] for t in spec.get("added_tokens", []))
            store["library"], store["chunks"] = library, chunks
        self.marks, self.library, self.chunks = store["marks"], store["library"], store["chunks"]

    def id_bytes(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        if not plain(text, self.marks):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        self.chunks.trim()
        return b"".join(map(self.chunks.__getitem__, text.split()))
