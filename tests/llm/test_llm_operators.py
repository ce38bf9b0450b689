"""The training-data operators against brute force, exact round trips and
held-out accuracy, with null, empty, repeated and very long rows, extra
columns with clashing names, and empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tollgate.llm import ann, byte_bpe, common, counts, exact_dedup, language, packing, quality, sharding, simhash, url_filter
from tollgate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, score string, locator int, "
          "norm string, shard string, kept string, _id string, _text string, row string, digest string, part string")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None, *["x", None, 3, "n", "s", "k", "i", "t", "r", "d", "p"])


EDGES = [
    row(1, "the same text here now"), row(2, "the  same\ttext here now"), row(3, "The same text here now"), row(4, None),
    row(5, ""), row(6, " \n "), row(7, LONG), row(8, LONG + " tail"), row(9, "été ünï 日本語 😀"), row(10, "a"),
    row(10, "a"), row(None, "the same text here now"), row(None, "lonely text of a row without an id", None), row(11, "%%% ### 123"),
    row(12, "x" * 5000), row(13, "<|endoftext|> end\x1cof it's WE'LL"), row(14, "one two three"), row(15, "ONE two three", None),
]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(EDGES, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(edges, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    edges.limit(0).write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_oracles_match(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want), name


# ---- exact dedup

def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("bits,per_batch", [(256, None), (256, 1), (4, None)])
def test_exact_dedup_by_brute_force(edges, bits, per_batch):
    groups = defaultdict(list)
    for r in EDGES:
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.deduplicate(edges, bits=bits, per_batch=per_batch).withColumn("kept", F.expr("locator = keep_locator")).collect()
    assert len(got) == len(EDGES)
    want = Counter()
    for ids in groups.values():
        first = min((i for i in ids if i is not None), default=None)
        want.update((i, first, len(ids)) for i in ids)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_keeps_columns_and_state_goes_on(spark, edges, none, tmp_path):
    kept = exact_dedup.keep_first(edges)
    assert kept.columns == edges.columns and kept.count() == len({norm(r[1]) for r in EDGES})
    assert exact_dedup.keep_first(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    entries, sink, check = (str(tmp_path / n) for n in ("entries", "sink", "check"))
    schema = "digest string, id long, locator struct<file: string, row: long>"
    for ids in ([5, 9], [3], [7]):  # each start takes new files and finds the earlier state
        spark.createDataFrame([("d", i, ("f", i)) for i in ids], schema).coalesce(1).write.mode("append").parquet(entries)
        exact_dedup.run_state(spark, entries, spark.read.schema(schema).parquet(entries).schema, check, sink)
    state = exact_dedup.current_state(spark, sink).collect()
    assert [(r["digest"], r["keep_id"], r["n"]) for r in state] == [("d", 3, 4)]


# ---- SimHash

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, max_bits):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            low = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= max_bits)
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_simhash_by_brute_force(edges, none):
    fps = [plain_fingerprint(r[1]) for r in EDGES]
    assert [simhash.fingerprint(r[1] or "") for r in EDGES] == fps
    label = plain_classes(fps, 4)
    best = {}
    for r, k in zip(EDGES, label, strict=True):
        best[k] = min((x for x in (best.get(k), r[0]) if x is not None), default=None)
    got = simhash.near_duplicates(edges).collect()
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter(
        (r[0], f, best[k]) for r, f, k in zip(EDGES, fps, label, strict=True))
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("block,pieces", [(64, 5), (7, 6), (4096, 7)])
def test_links_of_dense_groups(spark, block, pieces):
    rng = random.Random(block)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(300)})
    label = plain_classes(fps, 4)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = {r["fp"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(nodes, 4, pieces, block)).collect()}
    got = defaultdict(set)
    for f in fps:
        got[root.get(f, f)].add(f)
    want = defaultdict(set)
    for f, k in zip(fps, label, strict=True):
        want[k].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tree_search_prunes_without_loss():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    a, b = simhash.search(fps, simhash.tree(fps), 4)
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))


# ---- tokens

ALPHABET = "aAbBsS \n\t  é'stDre<|endoftext|>\x1c\x85 123½😀İßÉ́．,.!?-日本"


def odd_texts(n, seed):
    rng = random.Random(seed)
    return [r[1] or "" for r in EDGES] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_word_counts_and_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        content = f.read()
    counter, ids = counts.TokenCounter(content), packing.WordTokens(content)
    for text in odd_texts(1500, 1):
        want = library.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(want)
        assert ids.id_bytes(text) == struct.pack(f"<{len(want)}I", *want)


def test_token_count_rows(edges, none):
    library = Tokenizer.from_file(counts.VOCABULARY)
    want = Counter()
    for r in EDGES:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 2048)] += 1
    assert Counter(map(tuple, counts.token_counts(edges).collect())) == want
    assert counts.token_counts(none).count() == 0


def test_byte_bpe_equals_the_library_and_round_trips(edges, none):
    with open(byte_bpe.RANKS, "rb") as f:
        content = f.read()
    own = byte_bpe.ByteBpe(content)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(content), special_tokens={})
    for text in odd_texts(1500, 2) + ["ab" * 3000, "  lead", "trail  ", "x \n y"]:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text
    rng = random.Random(3)
    for _ in range(3000):  # bytes of no valid text, through the transducer alone
        data = bytes(rng.choice(b"etaoinshr \xc3\xa9\xe2\x80\x99d\xff") for _ in range(rng.randint(1, 24)))
        assert own.machine.encode(data) == library._encode_single_piece(data)
        halves = byte_bpe.Decoder(own.machine.tokens)
        out = [t for i in own.machine.encode(data) for t in halves.feed([i])]
        assert "".join(out) + halves.finish() == data.decode("utf-8", "replace")
    got = Counter(map(tuple, byte_bpe.digests(edges).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in EDGES:
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))] += 1
    assert got == want
    assert [r["decoded"] for r in byte_bpe.round_trip(edges).filter("doc_id = 9").collect()] == [EDGES[8][1]]
    assert byte_bpe.digests(none).count() == 0


def test_transducer_forgets_without_a_trace(monkeypatch):
    with open(byte_bpe.RANKS, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 5)
    monkeypatch.setattr(byte_bpe, "MAX_ADJACENT", 5)
    machine = byte_bpe.Transducer(ranks)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in LONG.split()[:200] + [" unbelievably", " Donaudampfschiff"]:
        assert machine.encode(word.encode()) == library._encode_single_piece(word.encode())


# ---- packing

def test_packing_rows(edges, none):
    library = Tokenizer.from_file(packing.VOCABULARY)
    got = packing.packing_query(edges).collect()
    want = Counter()
    for r in EDGES:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[(r[0], n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.packing_query(none).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 31, 300)
    bins, offsets = packing.sum_of_squares(sizes, 30)
    level: dict[int, int] = {}
    for size, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def after(target, size=size):
            new = level | {target: level.get(target, 0) + size}
            gaps = Counter(30 - v for v in new.values() if v < 30)
            return sum(n * n for n in gaps.values())
        choices = [t for t, v in level.items() if v + size <= 30] + [len(level)]
        assert o == level.get(b, 0)
        assert after(b) == min(map(after, choices))
        level[b] = o + size


# ---- sharding

def test_sharding_rows(edges, none):
    got = sharding.sharding_query(edges).collect()
    assert len(got) == len(EDGES) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in EDGES)
    shard_of = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        shard_of[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 40 for k, s in slots.items())
    assert sharding.sharding_query(none).count() == 0


def test_sharding_balances_and_slots_over_many_cells(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 2)
    got = sharding.shard_groups(docs, shards=8).collect()
    sums, slots = Counter(), defaultdict(list)
    for r in got:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values()) / 8


def test_differencing_by_plain_lists():
    def plain(sizes, shards):
        parts = [[(0, [])] * (shards - 1) + [(s, [i])] for i, s in enumerate(sizes)]
        while len(parts) > 1:
            parts.sort(key=lambda p: -(p[-1][0] - p[0][0]))
            a, b, *rest = parts
            parts = [sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b), strict=True)), key=lambda p: p[0]), *rest]
        return sorted(s for s, _ in parts[0])

    rng = np.random.default_rng(1)
    for shards in (1, 2, 5):
        sizes = np.sort(rng.choice(10_000, 60, replace=False))[::-1]
        got = np.bincount(sharding.differencing(sizes, shards), sizes, minlength=shards)
        assert sum(got) == sizes.sum() and max(got) - min(got) <= max(plain(sizes.tolist(), shards)) - min(plain(sizes.tolist(), shards)) + 50
    assert sharding.differencing(np.array([4, 3, 2, 2, 1, 0]), 2).size == 6
    assert sorted(np.bincount(sharding.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


# ---- language, quality

def test_language_held_out_accuracy_and_edges(spark, docs, edges, none):
    out = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    got = language.language_query(edges).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    for i in (4, 5, 6, 11):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) or i == 11 and by[i]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in got} <= {"en", "und"}
    assert language.language_query(none).count() == 0
    kept = language.keep_identified(edges, language.learn_from_documents(edges))
    assert kept.columns == edges.columns and kept.filter("doc_id in (4, 5, 6)").count() == 0


def test_language_of_three_short_documents_is_learned(spark, docs):
    rare = {"vi": ["chúng tôi đi học mỗi ngày", "trời hôm nay rất đẹp", "tôi thích đọc sách mỗi ngày"],
            "zh": ["我们每天去学校读书", "今天的天气很好", "我喜欢每天读书"]}
    few = spark.createDataFrame([(None, t, x) for x, ts in rare.items() for t in ts], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(few)
    for limits in ({}, {"max_words": 200, "max_grams": 200}):  # the common words alone fill the list
        model = language.fit_language(both, **limits)
        assert model.languages == ["de", "en", "es", "fr", "vi", "zh"]
        assert model.predict(["hôm nay chúng tôi đọc sách", "今天我们去读书"])[0] == ["vi", "zh"]
        assert set(model.words) >= {"chúng", "我们每天去学校读书"} and "我" in model.grams[1]
        out = language.predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
        assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95
    unlisted = language.fit_language(docs.filter("lang = 'en'").unionByName(docs.limit(0)), max_words=1)
    assert len(unlisted.words) == 1 and len(unlisted.grams[4]) > 1000  # n-grams of the words that are not listed


def test_language_learns_every_labelled_language(spark):
    """1,200 languages of two short texts each, with words of their own."""
    import itertools

    syllables = ["".join(x) for x in itertools.product("bdfgklmnpr", "aeiou")]
    own = ["".join(x) for x in itertools.islice(itertools.product(syllables, repeat=2), 1200)]
    rows = [(2 * i + j, f"{w} {w}{'st'[j]} {w}", f"l{i:04}") for i, w in enumerate(own) for j in range(2)]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:04}" for i in range(1200)]
    names, _ = model.predict([f"{w} {w}" for w in own])
    assert names == model.languages


def test_language_ties_go_to_the_first():
    same = language.Rows({"word": np.array([-1.0, -1.0])})
    model = language.LanguageModel(["a", "b"], same, {n: language.Rows() for n in language.LENGTHS}, "tie")
    assert model.predict(["word word", "unknown"]) == (["a", "a"], [0.5, 0.5])


def test_language_backs_off_to_shorter_grams():
    one = lambda a, b: np.array([a, b])
    model = language.LanguageModel(["a", "b"], {"known": one(-1.0, -2.0)},
                                   {4: {"^wor": one(-1.0, -3.0)}, 3: {"^zz": one(-5.0, -1.0)}, 2: {}, 1: {"q": one(-1.0, -4.0)}}, "test")
    assert model.word("known").tolist() == [-1.0, -2.0]
    assert model.word("word").tolist() == pytest.approx([-0.7, -2.1])
    assert model.word("zz").tolist() == pytest.approx([-5 * 0.49, -0.49])
    assert model.word("qy").tolist() == pytest.approx([-(0.7**4), -4 * 0.7**4])
    assert model.word("0").tolist() == [0, 0]
    assert language.words_of("½ ² a² 7b ab_c") == ["a²", "b", "ab", "c"]
    assert model.predict(["½ ² 12", "known ½"]) == (["und", "a"], [0.0, pytest.approx(1 / (1 + np.exp(-1)))])


def test_quality_held_out_accuracy_and_edges(spark, docs, edges, none):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert len({quality.learn_from_labels(t, labels).prior for t in (table, table)}) == 1
    out = quality.quality_query(table, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r["score"] for r in out if r["quality"] == 1]
    bad = [r["score"] for r in out if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([r["predicted"] for r in out if r["quality"] == 1]) > 0.95
    marks = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_query(edges, marks).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.quality_query(edges, marks.limit(0)).collect()} == {0.5}
    assert quality.quality_query(none, marks).count() == 0
    kept = quality.keep_good(edges, quality.learn_from_labels(edges, marks))
    assert kept.columns == edges.columns


def test_keys_are_thinned_alike_in_any_order(spark):
    keys = spark.range(20_000).toDF("k")
    one, other = (sorted(r["k"] for r in common.thinned_keys(t, 4000, 41).collect()) for t in (keys, keys.repartition(7).orderBy(F.desc("k"))))
    assert one == other and 3700 < len(one) < 4300
    assert common.thinned_keys(keys, 30_000, 41).count() == 20_000 and common.thinned_keys(keys.limit(0), 5, 41).count() == 0


def test_long_texts_come_in_small_batches(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.get_total_buffer_size()])], ["n", "size"])

    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("t"))
    got = common.map_text(rows, run, "n long, size long").agg(F.sum("n"), F.max("size")).first()
    assert got[0] == 300 and got[1] < 2 * common.BATCH_BYTES


def test_non_negative_risk_by_finite_differences():
    rng = np.random.default_rng(0)
    for shift in (-3.0, 3.0):  # the negative part below and above zero
        mp, mu = rng.normal(2 - shift, 1, 40), rng.normal(shift, 1, 50)
        value, dp, _ = quality.pu_weights(mp, mu, 0.6)
        pos = 0.6 * np.logaddexp(0, -mp).mean()
        neg = np.logaddexp(0, mu).mean() - 0.6 * np.logaddexp(0, mp).mean()
        assert value == pytest.approx(pos + max(0, neg))
        if neg >= 0:
            step = mp.copy()
            step[3] += 1e-6
            assert (quality.pu_weights(step, mu, 0.6)[0] - value) / 1e-6 == pytest.approx(dp[3], abs=1e-4)
    prior = quality.estimate_prior(rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)]))
    assert prior == pytest.approx(0.7, abs=0.05)


# ---- URLs

URLS = [None, "", "no scheme", "http://A.Example.ORG/en/12?x", "https://example.org/es/", "ftp://notexample.org/es/", "http://x.com/de/1",
        "http://com/fr/", "http://x.com", "http://x.com?de/", "http://.org/", "://org/#a", "http://é.org/ü", "http://a..com//de/", "x://y://z.org/q"] * 2


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_by_brute_force(spark):
    pages = spark.createDataFrame([(i // 2 if i else None, u, "h", "r", "v") for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, rule string, verdict string")
    want = Counter((i // 2 if i else None, *plain_verdict(u)) for i, u in enumerate(URLS))
    assert Counter(map(tuple, url_filter.url_query(pages).collect())) == want
    assert url_filter.url_query(pages.limit(0)).count() == 0


def test_blocked_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("host_part"), F.lit("/").alias("path_part"))
    blocks = -(-2000 * url_filter.BITS_PER_KEY // url_filter.BLOCK_BITS)
    table = url_filter.bloom_blocks(listed, blocks)
    other = spark.range(2000, 12000).select(F.concat(F.lit("h"), "id").alias("host_part"), F.lit("/").alias("path_part"))
    assert url_filter.probe(listed, table, blocks, True).count() == 2000
    assert url_filter.probe(other, table, blocks, False).count() < 100


# ---- nearest neighbours

def plain_search(ids, x, k):
    out = {}
    for n, (i, v) in enumerate(zip(ids, x, strict=True)):
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out[n] = [(ids[j], s[j]) for j in order]
    return out


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 4000)] + 0.7 * rng.normal(size=(4000, 24))).astype(np.float32)
    x[500:1200] = x[500]  # one very common vector
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = defaultdict(list)
    for r in ann.search(table, F.col("id") % 20 == 0, block=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = plain_search(np.arange(4000), x.astype(np.float64), 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and len({i for _, i, _ in rows}) == 20
        assert all(s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float)), abs=1e-12) for _, i, s in rows)
        assert rows == [(n + 1, i, s) for n, (s, i) in enumerate((s, i) for s, i in sorted(((s, i) for _, i, s in rows), key=lambda p: (-p[0], p[1])))]
        floor = min(s for _, s in want[q])
        hits += sum(s >= floor - 1e-9 for _, _, s in rows)
    assert hits / (20 * len(want)) >= 0.9


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (None, [9.0, 9.0]),
            (7, [float("inf"), 0.0]), (8, [1.0]), (9, [0.5, 0.9]), (20, [-1.0, 0.0]), (1, [0.5, 0.5])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(map(tuple, ann.ann_query(table).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 9), (0, 4, 20), (20, 1, 1), (20, 2, 1), (20, 3, 9), (20, 4, 0)]
    assert ann.ann_query(table.limit(0)).count() == 0


# ---- pipeline

def test_pipeline(spark, edges, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, SF), "test-stage")
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        assert kept.exceptAll(before).count() == 0
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in kept.collect()}
    assert len(set(plain_classes(list(fps.values()), 4))) == len(fps)
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(fps)
    for name, stage in corpus_pipeline.STAGES:  # every stage takes every odd row, and none at all
        assert stage(spark, edges, SF).count() >= 0, name
        assert stage(spark, edges.limit(0), SF).count() == 0, name


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(simhash, "written", lambda df, name: made.append(name) or common.written(df, name))
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 1000)] + [(5000, 4000), (4500, 4000), (4500, 5000)], "src long, dst long")
    got = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 1001)} | {i: 4000 for i in (4000, 4500, 5000)}
    assert made.count("simhash-round") <= 2 and made.count("simhash-jump") <= 14


def test_components_of_random_links(spark):
    rnd = random.Random(11)
    names = rnd.sample(range(-10**6, 10**6), 600)
    links = [(names[i], names[rnd.choice([max(0, i - 1), rnd.randrange(i)])]) for i in range(1, 600) if rnd.random() < 0.95]
    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {n for pair in links for n in pair}
    got = simhash.components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert {r["fp"]: r["root"] for r in got} == {n: label[n] for n in linked}
