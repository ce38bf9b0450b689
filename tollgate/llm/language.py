"""Language identification: known words first, then shorter and shorter
character n-grams.

A known word adds its log frequency in each language. A word that is not in
the list backs off to the longest n-gram length (4, 3, 2, 1, word edges
marked) at which the model knows one of its n-grams, and adds the mean log
frequency of those, discounted at each shorter length. The score is the
posterior of the best language under equal priors.

The model is fitted on a bounded sample (about ``per_language`` labelled
documents of each language, however many languages there are; whole texts,
drawn at random by a fixed seed). N-grams are counted over all sampled
words. Each language has its own ``max_words`` most frequent words and
``max_grams`` n-grams of each length (fewer from 32 languages on, by the
square of their number, so that the tables stay of one size), so a language with few documents does
not compete with the others for a place; the languages are those of the
labelled rows, whatever their words. Prediction reads every whole text in one pass without a
shuffle and uses the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text when no labelled row exists; ties between languages go to
the first in sorted order; null ids and repeated rows are predicted like any
other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import by_value, fold, map_text, strings, worker_store, written

by_value(__name__)

UNKNOWN = "und"
LENGTHS = (4, 3, 2, 1)
DISCOUNT = 0.7
CACHE_CELLS = 1_500_000
#: Entries that a worker counts before it hands them on.
GRAMS_HELD = 200_000
CELLS = 1 << 30
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Its runs of letters. Numerals that are no decimal digits (a half, a
    superscript two) match the pattern too, but make no word on their own."""
    return [w for w in WORD.findall(text) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    w = word if n == 1 else f"^{word}$"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


class Rows(dict):
    """Entry to its row of one matrix, which is shipped as one."""

    def __reduce__(self):
        return _rows, (list(self), np.array(list(self.values())))


def _rows(entries: list[str], matrix: np.ndarray) -> Rows:
    return Rows(zip(entries, matrix, strict=True))


@dataclass
class LanguageModel:
    """Log frequencies by language for words and for n-grams by length."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]
    key: str = ""

    def word(self, w: str) -> np.ndarray:
        """Contribution of one lower-cased word to each language."""
        got = self.words.get(w)
        if got is not None:
            return got
        for step, n in enumerate(LENGTHS):
            table = self.grams[n]
            known = [table[g] for g in grams(w, n) if g in table]
            if known:
                return np.mean(known, axis=0) * DISCOUNT ** (step + 1)
        return np.zeros(len(self.languages))

    def chunk(self, c: str) -> tuple[np.ndarray, int]:
        """Sum over the words of a chunk without white space, and their count."""
        found = words_of(c)
        total = np.zeros(len(self.languages))
        for w in found:
            total = total + self.word(w)
        return total, len(found)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        width = len(self.languages)
        names, scores = [], []
        store = worker_store(f"language-{self.key}")
        if "rows" not in store:
            store["rows"], store["at"] = np.zeros((1024, width + 1)), {}
        limit = max(1024, CACHE_CELLS // (width + 1))
        for text in texts:
            chunks = text.lower().split()
            at = store["at"]
            if len(at) + len(chunks) > limit:
                store["rows"], store["at"] = np.zeros((1024, width + 1)), {}
                at = store["at"]
            for c in chunks:
                if c not in at:
                    k = len(at)
                    if k == len(store["rows"]):
                        store["rows"] = np.concatenate([store["rows"], np.zeros_like(store["rows"])])
                    store["rows"][k, :width], store["rows"][k, width] = self.chunk(c)
                    at[c] = k
            if not chunks or not width:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = store["rows"][np.fromiter(map(at.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
            if total[width] == 0:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            m = total[:width] - total[:width].max()
            best = int(np.argmax(m))
            names.append(self.languages[best])
            scores.append(float(min(1.0, 1.0 / np.exp(m).sum())))
        return names, scores


def _sizes(docs: DataFrame) -> DataFrame:
    """One row a language."""
    return docs.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))


def _sampled(docs: DataFrame, sizes: list[Row], per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, each drawn by itself.
    The table of language sizes has a row a language, so it is broadcast and the texts
    are not shuffled."""
    table = docs.sparkSession.createDataFrame(sizes, "_lang string, _n long")
    return docs.join(F.broadcast(table), "_lang").filter(F.rand(37) * F.col("_n") < per_language).select("_lang", "_text")


def _counted(flat: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*flat, strict=True)) if flat else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if x == "n" else pa.string()) for c, x in zip(cols, names, strict=True)], names)


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column("_lang").to_pylist(), strings(b, "_text"), strict=True):
                seen[lang].update(words_of(text.lower()))
            yield _counted([(lang, w, n) for lang, c in seen.items() for w, n in c.items()], ["lang", "word", "n"])

    part = map_text(rows, run, "lang string, word string, n long")
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    """``lang, gram, n`` of the n-grams of all lengths; an n-gram's length is its ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, w, times in zip(b.column("lang").to_pylist(), strings(b, "word"), b.column("n").to_pylist(), strict=True):
                for n in LENGTHS:
                    for g in grams(w, n):
                        seen[lang, g] += times
                if len(seen) > GRAMS_HELD:
                    yield _counted([(*k, n) for k, n in seen.items()], ["lang", "gram", "n"])
                    seen.clear()
            yield _counted([(*k, n) for k, n in seen.items()], ["lang", "gram", "n"])

    part = map_text(words, run, "lang string, gram string, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _listed(counts: DataFrame, quota: int) -> DataFrame:
    """``size, entry, langs, ns``: the ``quota`` most frequent entries of each
    language and size, with their counts in every language. Where the quota
    ends among equal counts, a hash of the entry decides. Only the table of
    distinct counts goes through a window."""
    by = Window.partitionBy("size", "lang").orderBy(F.desc("n"))
    steps = counts.groupBy("size", "lang", "n").agg(F.count(F.lit(1)).alias("_m"))
    steps = steps.withColumn("_above", F.sum("_m").over(by) - F.col("_m")).filter(F.col("_above") < quota)
    drawn = F.pmod(F.xxhash64("entry"), F.lit(CELLS)) < (F.lit(quota) - F.col("_above")) / F.col("_m") * CELLS
    marked = counts.join(F.broadcast(steps), ["size", "lang", "n"], "left").withColumn("_in", F.coalesce(drawn, F.lit(False)))
    return marked.groupBy("size", "entry").agg(
        F.max("_in").alias("_in"), F.collect_list(F.struct("lang", "n")).alias("by")
    ).filter("_in").select("size", "entry", F.col("by.lang").alias("langs"), F.col("by.n").alias("ns"))


def _smoothed(listed: pa.Table, totals: dict[str, int], languages: list[str], add: float = 0.5) -> Rows:
    """Log frequency of each entry in each language. What a language lacks
    costs the same in all of them, however few its texts."""
    at = {x: i for i, x in enumerate(languages)}
    rates = np.zeros((listed.num_rows, len(languages)))
    for row, langs, ns in zip(rates, listed.column("langs").to_pylist(), listed.column("ns").to_pylist(), strict=True):
        for x, n in zip(langs, ns, strict=True):
            row[at[x]] = n / totals[x]
    return Rows(zip(listed.column("entry").to_pylist(), np.log(rates + add / max(totals.values(), default=1)), strict=True))


def _tables(counts: DataFrame, languages: list[str], most: int, room: int) -> dict[int, Rows]:
    """Log frequencies by size. A language has ``most`` entries of a size;
    with many languages fewer, so that there are never more numbers than
    ``most`` entries in ``room`` languages have; it always has one."""
    quota = max(1, min(most, most * room // max(1, len(languages)) ** 2))
    totals: dict[int, dict[str, int]] = defaultdict(dict)
    for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect():
        totals[r["size"]][r["lang"]] = r["n"]
    listed = _listed(counts, quota).toArrow()
    return {size: _smoothed(listed.filter(pc.equal(listed.column("size"), size)), by, languages) for size, by in totals.items()}


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 per_language: int = 2500, max_words: int = 40000, max_grams: int = 20000,
                 room: int = 1000) -> LanguageModel:
    """Learn from the rows of ``docs`` whose ``lang_col`` is not null."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.filter("_lang is not null and _text is not null")
    sizes = _sizes(rows).collect()
    languages = sorted(r["_lang"] for r in sizes)
    counts = written(_word_counts(_sampled(rows, sizes, per_language)), "language-words")
    words = _tables(counts.select(F.lit(0).alias("size"), "lang", F.col("word").alias("entry"), "n"), languages, max_words, room)
    shorter = written(_gram_counts(counts).select(F.length("gram").alias("size"), "lang", F.col("gram").alias("entry"), "n"), "language-grams")
    tables = _tables(shorter, languages, max_grams, room)
    return LanguageModel(languages, words.get(0, Rows()), {n: tables.get(n, Rows()) for n in LENGTHS}, uuid.uuid4().hex)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(strings(b, "_text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_text(rows, run, docs.select(id_col).schema.add("lang_pred", "string").add("score", "double"))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a predicted language of at least that score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(strings(b, text_col))
            yield b.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return map_text(docs, run, docs.schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col, 4) == 2, F.lit(False))


def learn_from_documents(docs: DataFrame) -> LanguageModel:
    return fit_language(docs.filter(~held_out(F.col("doc_id"))))


def language_query(docs: DataFrame) -> DataFrame:
    out = predict_language(docs, learn_from_documents(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
