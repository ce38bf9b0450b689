"""Alignment, histogram packing and the conversation trie against brute force,
and token ids and counts against the library over all code points."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tollgate.llm import alignment, common, conversation_trie, counts, histogram_packing
from tollgate.llm.words import WordTokens

SCHEMA = "doc_id long, text string, id string, length string, start int, a string, node string, row string"
LONG = " ".join(f"word{i % 977}" for i in range(9_000))
TEXTS = [None, "", " ", "a", "plain words here", "Übergrößen, été  naïve\n\ttabs \n", "日本語 text 😀 mixed", "<|endoftext|> and <s> inside",
         "a▁b has a mark", "odd\x1cspace\x85and\xa0more　", "trailing ", "x" * 6000, LONG, LONG + " tail", "same text", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 5 else None, t, *["c"] * 2, 3, *["c"] * 3) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# ---- tokens

def test_ids_and_counts_equal_the_library_on_every_code_point():
    with open(counts.VOCABULARY, "rb") as f:
        content = f.read()
    library = Tokenizer.from_str(content.decode())
    points = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = [w for c in points for w in ("a" + c + "b", c + ". x")]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    tokens = WordTokens(content)
    assert [t for t, ids in zip(texts, want, strict=True) if tokens.id_bytes(t) != np.array(ids, "<u4").tobytes()] == []
    counter = counts.TokenCounter(content)
    assert [t for t, ids in zip(texts, want, strict=True) if counter.count(t) != len(ids)] == []


# ---- alignment

@pytest.fixture(scope="module")
def vocabularies():
    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    return a, b, alignment.bytes_of_a(alignment.open_bytes(alignment.VOCABULARY_A)), alignment.bytes_of_b(b)


def plain_tokens(text, vocabularies):
    a, b, raw_a, raw_b = vocabularies
    if not text:
        return [], []
    data = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(raw[i] for i in ids) != data for raw, ids in ((raw_a, ids_a), (raw_b, ids_b))):
        return [], []
    return ids_a, ids_b


def plain_alignment(texts, vocabularies):
    _, _, raw_a, raw_b = vocabularies
    number, found = Counter(), []
    for text in texts:
        a, b = plain_tokens(text, vocabularies)
        ends_a = {e: k for k, e in enumerate(np.cumsum([len(raw_a[i]) for i in a]).tolist())}
        links = [(ends_a[e], k) for k, e in enumerate(np.cumsum([len(raw_b[i]) for i in b]).tolist()) if e in ends_a]
        number.update((a[i], b[j]) for i, j in links)
        found.append((a, b, links))
    most = Counter()
    for (_, y), n in number.items():
        most[y] = max(most[y], n)
    for a, b, links in found:
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
            x, y = i + 1, j + 1
        at = [number[a[i], b[j]] for i, j in links]
        best = sum(n == most[b[j]] for n, (_, j) in zip(at, links, strict=True))
        text = ";".join(groups)
        yield len(a), len(b), len(links), len(links), best, sum(at), hashlib.sha256(text.encode()).hexdigest() if text else ""


def test_alignment_by_brute_force(docs, vocabularies):
    rows = docs.collect()
    want = Counter((r["doc_id"], *v) for r, v in zip(rows, plain_alignment([r["text"] for r in rows], vocabularies), strict=True))
    assert Counter(tuple(r) for r in alignment.alignment_query(docs).collect()) == want
    shown = alignment.aligned(docs, spans=True).filter("groups <> ''").first()
    assert hashlib.sha256(shown["groups"].encode()).hexdigest() == shown["groups_sha256"]
    assert alignment.alignment_query(docs.limit(0)).count() == 0


def test_chunked_tokens_equal_the_libraries(vocabularies):
    both = alignment.BothTokens(alignment.open_bytes(alignment.VOCABULARY_A), alignment.open_bytes(alignment.VOCABULARY_B))
    rnd = random.Random(3)
    pool = [" ", " the", "Ünï", "İ", ", ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "\xa0", "　", "a", "the", "é", "é", "1", "'s", "!", "<s>", "<0x41>", "᠎", "\x00"]
    texts = ["".join(rnd.choice([*pool, chr(rnd.randrange(0x20, 0x3000)), chr(rnd.randrange(0xE000, 0x20000))]) for _ in range(rnd.randrange(20)))
             for _ in range(6000)] + [w for c in range(0x3000) for w in ("a" + chr(c) + ". x", "x " + chr(c) + "y, ")]
    for text, got in zip(texts, both.encode(texts), strict=True):
        assert tuple(np.frombuffer(v, "<u2").tolist() for v in got) == plain_tokens(text, vocabularies), repr(text)


def test_perfect_hash_is_minimal_and_verified():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
        hashed = alignment.PerfectHash(keys)
        assert sorted(hashed.find(keys).tolist()) == list(range(keys.size))
        assert (hashed.find(keys + (1 << 41)) == -1).all()


def test_pairs_stay_below_their_bound(docs, vocabularies):
    _, _, raw_a, raw_b = vocabularies
    tokens = common.written(alignment.encoded(docs), "test-ids")
    aligner = alignment.Aligner(np.array([len(t) for t in raw_a]), np.array([len(t) for t in raw_b]))
    hashed, number = alignment.pair_counts(tokens, aligner)
    for key in hashed.keys.tolist():
        a, b = raw_a[key // len(raw_b)], raw_b[key % len(raw_b)]
        assert a.endswith(b) or b.endswith(a)
    assert alignment.pair_bound([b"x", b"yx", b"z"], [b"x", b"zx", b"q"]) == 3
    assert 0 < hashed.keys.size <= alignment.pair_bound(raw_a, raw_b) and number.min() > 0


# ---- histogram packing

def plain_shortest_first(lengths, capacity):
    packs = []
    for n in sorted(lengths, reverse=True):
        low = min(range(len(packs)), key=lambda k: sum(packs[k]), default=None)
        if low is None or sum(packs[low]) + n > capacity:
            packs.append([n])
        else:
            packs[low].append(n)
    return packs


def test_patterns_equal_packing_piece_by_piece():
    rnd = random.Random(7)
    for capacity in (10, 64, 200):
        for _ in range(20):
            lengths = [rnd.choice([rnd.randint(1, capacity), rnd.randint(1, 4)]) for _ in range(rnd.randrange(200))]
            patterns = histogram_packing.pack_patterns(Counter(lengths), capacity)
            got = Counter()
            for count, inside in patterns:
                got[sum(inside)] += count
            assert got == Counter(map(sum, plain_shortest_first(lengths, capacity)))
            assert Counter(n for count, inside in patterns for n in inside for _ in range(count)) == Counter(lengths)
            assert len(patterns) <= 2 * capacity


@pytest.mark.parametrize("cell_rows", [1000, 2])
def test_histogram_packing_keeps_every_id_once(docs, cell_rows):
    library = Tokenizer.from_file(histogram_packing.VOCABULARY)
    want = Counter((r["doc_id"], *(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes(),)) for r in docs.collect())
    out = histogram_packing.pack_by_histogram(docs, cell_rows=cell_rows).collect()
    pieces = Counter((i, at, raw[4 * at:4 * at + 8192], len(raw) // 4) for (i, raw), n in want.items() for at in range(0, len(raw) // 4, 2048) for _ in range(n))
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == Counter(
        {k: n for (i, at, part, size), n in pieces.items() for k in [(i, at, len(part) // 4, zlib.crc32(part), size)]})
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in sequences.values():
        rows.sort()
        assert [o for o, _ in rows] == np.cumsum([0, *(n for _, n in rows)])[:-1].tolist() and sum(n for _, n in rows) <= 2048
    assert Counter(sum(n for _, n in v) for v in sequences.values()) == Counter(map(sum, plain_shortest_first([r["length"] for r in out], 2048)))
    assert histogram_packing.histogram_packing_query(docs.limit(0)).count() == 0


# ---- conversation trie

def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((t is not None, t or 0, digest, role, text))
    listed = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in listed:
        h = zlib.crc32(str(c).encode()) % 9
        whole = listed.get(c - c % 5, [])[:h] + listed[c][h:]
        ends[tuple(whole)].append(c)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
            if d:
                children[tuple(whole[:d - 1])].add(tuple(whole[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def conversations(seed, n, turns, texts):
    rnd = random.Random(seed)
    return [(c, rnd.choice([t, t, None, 1]), rnd.choice(["user", "user", "user", None]), rnd.choice(texts))
            for c in range(n) for t in range(rnd.randrange(turns))]


TABLES = {
    "repeats": (conversations(1, 60, 7, ["x", "yé", None]), 512, 10),
    "all alike": ([(c, t, "user", "x") for c in range(60) for t in range(4)], 512, 5),
    "bands": (conversations(2, 50, 12, ["x", "yy"]), 3, 9),
    "one long": (conversations(3, 30, 9, ["x", "y"]) + [(0, t, "user", "x") for t in range(200)] + [(None, 1, "u", "q")], 4, 1000),
    "empty": ([], 512, 10),
}


@pytest.mark.parametrize("name", list(TABLES))
def test_trie_by_brute_force(spark, name):
    rows, band, stretch = TABLES[name]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, id int, key string")
    got = conversation_trie.conversation_trie_query(table, band, stretch)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_median_first_takes_each_once():
    for n in (0, 1, 2, 9, 100):
        assert sorted(conversation_trie.median_first(n)) == list(range(n))
    tree = conversation_trie.SearchTree()
    for k in conversation_trie.median_first(1023):
        tree.insert([k], [1])
    deep = {tree.below[0]: 1}
    for node in range(1, 1024):
        for child in (tree.low[node], tree.high[node]):
            if child >= 0:
                deep[child] = deep[node] + 1
    assert max(deep.values()) == 10


def test_keyed_join_splits_hot_keys(spark):
    rows = common.written(spark.range(5000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id"), "test-join")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = common.keyed_join(rows, table, "k", "n")
    assert got.columns == ["k", "id", "v"] and got.count() == 5000 and got.filter("v <> 2 * k").count() == 0
