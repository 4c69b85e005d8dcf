"""Language identification with language-bitmask n-gram filters.

Every language gets the character n-grams that are typical of it. All of these sets live in one bit-sliced Bloom
filter: a cell holds a bit per language, and the AND of an n-gram's cells names all languages that (seem to) contain
it. A text's n-grams are counted per language bit, the counts are corrected for the filter's false positives, and the
language with the largest corrected count wins.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from difflens.llm.common import mix, slices, staged, text_column

NONE = "und"
ORDERS = (2, 3, 4)
_LETTERS: list[np.ndarray] = []


@dataclass
class Model:
    """``cells`` is the bit-sliced filter (one 64-bit word per 64 languages), ``false`` its false positive rates."""

    langs: list[str]
    cells: np.ndarray
    hashes: int
    false: np.ndarray

    def hits(self, grams: np.ndarray, word: int) -> np.ndarray:
        """Per n-gram a bit for each language of the given group of 64."""
        row = self.cells[word]
        size = np.uint64(len(row) - 1)
        found = row[(grams & size).astype(np.int64)]
        for i in range(1, self.hashes):
            found = found & row[((grams >> np.uint64(21 * i)) & size).astype(np.int64)]
        return found


def letters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark that may belong to one, 0 for anything else."""
    if not _LETTERS:
        kinds = {"L": 2, "M": 1}
        _LETTERS.append(np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8))
    return _LETTERS[0]


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of lower-cased texts: hashes, the text of each, and the number of letters of each text.

    Runs of letters count as words, with one blank at either side; everything else is left out.
    """
    sizes = np.fromiter(map(len, low := [t.lower() for t in texts]), dtype=np.int64, count=len(texts))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = letters()[code]
    is_letter = kind > 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    n_letters = np.bincount(owner[kind == 2], minlength=len(texts))
    # A blank before each run of letters and one after it.
    first = is_letter.copy()
    first[1:] &= ~is_letter[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(is_letter)
    gap = np.cumsum(first[at])
    place = np.arange(len(at)) + gap
    flat = np.zeros(len(at) + (int(gap[-1]) if len(at) else 0) + 1, dtype=np.uint64)
    flat[place] = code[at]
    whose = np.full(len(flat), -1, dtype=np.int64)
    whose[place] = owner[at]
    hashes, owners = [], []
    for n in ORDERS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        ok = np.ones(m, dtype=bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + flat[j : j + m]
            if 0 < j < n - 1:  # a blank may stand first or last only
                ok &= flat[j : j + m] != 0
        if n == 2:
            ok &= (flat[:m] != 0) | (flat[1:] != 0)
        of = whose[1 : 1 + m] if n > 2 else np.maximum(whose[:m], whose[1 : 1 + m])
        hashes.append(mix(h[ok]))
        owners.append(of[ok])
    return (np.concatenate(hashes), np.concatenate(owners), n_letters) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, per_lang: int = 1000, grams: int = 20_000, share: float = 0.5, support: int = 3) -> Model:
    """Learns from ``docs`` (doc_id, text, lang): all rows given are used or may be sampled.

    ``per_lang``: about so many texts of a language are learned from, chosen by a hash of the id; the bound keeps the
    model's cost fixed at any input size. A language's set holds at most ``grams`` n-grams with ``support`` or more
    occurrences whose frequency in the language is at least ``share`` of the highest frequency in any language.
    Rows with a null text or lang teach nothing.
    """
    docs = docs.filter("text is not null and lang is not null")
    totals = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((1, 1), dtype=np.uint64), 1, np.zeros(0))
    part = F.lit(0.0)
    for lang in langs:
        part = F.when(F.col("lang") == lang, min(1.0, per_lang / totals[lang])).otherwise(part)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    sample = docs.filter(draw < part).select("text", "lang")
    counts = sample.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts.filter(F.col("n") >= support), "grams")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(sums), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    typical = rates.join(best, "gram").filter(F.col("rate") >= share * F.col("best"))
    top = typical.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= grams)
    return build(langs, {lang: [] for lang in langs} | {r.lang: r.grams for r in top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()})


def _count_batches(batches):
    for whole in batches:
        for batch in slices(whole, 1 << 18):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            hashes, owner, _ = gram_hashes(text_column(batch).to_pylist())
            for lang in sorted(set(langs)):
                gram, n = np.unique(hashes[(langs == lang)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def build(langs: list[str], sets: dict[str, list[int]], hashes: int = 2, load: int = 16) -> Model:
    """The bit-sliced filter of the languages' n-gram sets, with ``load`` cells for each n-gram of the largest set."""
    size = 1 << max(10, int(np.ceil(np.log2(load * max(1, *map(len, sets.values()), 1)))))
    cells = np.zeros((-(-len(langs) // 64), size), dtype=np.uint64)
    for i, lang in enumerate(langs):
        grams = np.array(sets[lang], dtype=np.int64).view(np.uint64)
        for k in range(hashes):
            at = np.unique((grams >> np.uint64(21 * k)) & np.uint64(size - 1)).astype(np.int64)
            cells[i // 64, at] |= np.uint64(1 << (i % 64))
    false = np.array([((cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** hashes for i in range(len(langs))])
    return Model(langs, cells, hashes, false)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which depend on the text alone.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or when there is no language to
    choose from. Otherwise it is the language with the most n-grams after correction; ties go to the first by name.
    The score is the share of that language's corrected count in the counts of the best two. A model is a fixed-size
    table, so it travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in ("lang_pred", "score") if c in docs.columns]
    kept = docs.drop(*extra)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(partial(_predict_batches, shared=shared), schema)


def _predict_batches(batches, shared):
    model = shared.value
    for whole in batches:
        for batch in slices(whole, 1 << 18):
            names, scores = classify(text_column(batch).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def classify(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    hashes, owner, n_letters = gram_hashes(texts)
    if not model.langs or not len(texts):
        return [NONE] * len(texts), [0.0] * len(texts)
    total = np.bincount(owner, minlength=len(texts)).astype(float)
    counts = np.zeros((len(texts), len(model.langs)))
    for word in range(len(model.cells)):
        found = model.hits(hashes, word)
        for i in range(64 * word, min(64 * word + 64, len(model.langs))):
            counts[:, i] = np.bincount(owner, weights=(found >> np.uint64(i % 64)) & np.uint64(1), minlength=len(texts))
    # A share `false` of the n-grams that a language lacks is found by chance.
    counts = np.maximum(0, (counts - total[:, None] * model.false) / (1 - np.minimum(model.false, 0.99)))
    best = counts.argmax(axis=1)
    top = counts[np.arange(len(texts)), best]
    rest = counts.copy()
    rest[np.arange(len(texts)), best] = 0
    second = rest.max(axis=1)
    score = np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0)
    return [model.langs[b] if n else NONE for b, n in zip(best.tolist(), n_letters.tolist())], np.where(n_letters > 0, np.clip(score, 0, 1), 0.0).tolist()


def identify(docs: DataFrame, per_lang: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, learned from those that aren't held out.

    Repeated rows stay, null texts and empty texts are ``und``; other columns are ignored. No rows give no rows.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), per_lang)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """``docs`` without the documents whose language is unknown or whose score is below ``least``."""
    out = predict(docs.select(*docs.columns), model)
    return out.filter((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select(*docs.columns)


def as_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents of ``docs`` in which one language has more n-grams than any other, with that language as ``lang``."""
    found = predict(docs, model).filter((F.col("lang_pred") != NONE) & (F.col("score") > 0.5))
    return found.select(*[F.col("lang_pred" if c == "lang" else f"`{c}`").alias(c) for c in docs.columns])
