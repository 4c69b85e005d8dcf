"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is contained in a document when at least ``threshold`` of its distinct word shingles occur there. Items are
partitioned by size (powers of two), and each partition fixes how many of an item's lowest-hashed shingles make up its
MinHash sketch: one more than an item of that size may miss. A containing document therefore always holds a sketch
shingle, however long it is, so the search loses nothing. Documents holding one are verified on the shingles
themselves, compared as text.

Words are runs of letters and digits of the lower-cased text. Shingles have five words; an item of fewer words is one
shingle of all its words.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import Words, slices, staged, text_column, utf8

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: The same words for the checking SQL.
WORD_PATTERN = r"[a-z0-9\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def _words(batch: pa.RecordBatch) -> Words:
    data, at = utf8(pa.array([t.lower() for t in text_column(batch).to_pylist()], pa.string()))
    is_word = _WORD[data]
    if len(data):
        # Punctuation and blanks outside ASCII: U+0080-00BF, U+2000-207F and U+3000-303F.
        two = np.flatnonzero(data == 0xC2)
        lead = np.flatnonzero((data == 0xE2) | (data == 0xE3))
        after = data[np.minimum(lead + 1, len(data) - 1)]
        lead = lead[np.where(data[lead] == 0xE2, (after == 0x80) | (after == 0x81), after == 0x80)]
        is_word[np.concatenate([two, two + 1, lead, lead + 1, lead + 2])] = False
    return Words(data, at, is_word)


def _shingle_text(words: Words, raw: bytes, at: int, k: int) -> str:
    return b" ".join(raw[s:e] for s, e in zip(words.start[at : at + k].tolist(), words.end[at : at + k].tolist())).decode("utf-8", "replace")


def item_shingles(items: DataFrame, shingle: int = 5) -> DataFrame:
    """(item_id, k, hash, shingle) for each distinct shingle of each item; ``k`` is its number of words."""
    return items.select("item_id", "text").mapInArrow(partial(_item_batches, shingle=shingle), "item_id long, k int, hash long, shingle string")


def _item_batches(batches, shingle):
    for whole in batches:
        for batch in slices(whole):
            words, rows = _words(batch), []
            raw, hashes = words.data.tobytes(), words.hashes()[0]
            ids = batch.column("item_id").to_pylist()
            found = {k: words.windows(hashes, k) for k in range(1, shingle + 1)}
            for i, item in enumerate(ids):
                lo, hi = words.first[i], words.first[i + 1]
                k = min(shingle, int(hi - lo))
                if k and item is not None:
                    at, h = found[k]
                    own = slice(*np.searchsorted(at, [lo, hi]))
                    for value, j in zip(*(x.tolist() for x in np.unique(h[own], return_index=True))):
                        rows.append((item, k, value, _shingle_text(words, raw, int(at[own][j]), k)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(np.array(cols[2], dtype=np.uint64).view(np.int64)), pa.array(cols[3], pa.string())], ["item_id", "k", "hash", "shingle"])


def sketched(shingles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``shingles`` with the item's size ``n``, the matches it ``needs``, and whether a shingle is in its MinHash sketch.

    Partition ``p`` holds the items of more than 2^(p-1) and at most 2^p shingles; its sketches have
    2^p - ceil(threshold * 2^p) + 1 shingles, those with the lowest hashes (all, if the item has fewer).
    """
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n"))
    sized = shingles.join(sizes, "item_id").withColumn("needs", F.ceil(F.col("n") * threshold - 1e-9))
    most = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    sized = sized.withColumn("sketch", (most - F.ceil(most * threshold - 1e-9) + 1).cast("int"))
    lows = F.expr("transform(slice(array_sort(collect_list(struct(hash, shingle))), 1, max(sketch)), x -> x.shingle)")
    lows = sized.groupBy("item_id").agg(lows.alias("lows"))
    return sized.join(lows, "item_id").withColumn("in_sketch", F.array_contains("lows", F.col("shingle"))).drop("lows", "sketch")


def bitmap(hashes: DataFrame, least: int = 16, most: int = 27) -> np.ndarray:
    """A bit for each ``hash`` modulo the bitmap's size, which is 16 bits a row but never above 2^most bits (16 MB).

    Only 64-bit words that aren't empty reach the driver. A fuller bitmap lets more rows through, and loses none.
    """
    n = hashes.count()
    size = min(most, max(least, int(np.ceil(np.log2(16 * n + 1)))))
    cell = F.col("hash").bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    words = hashes.select(F.shiftright(cell, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(64 * len(bits) - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) != 0


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each item contained in a document.

    Null texts and texts without words contain nothing and are contained in nothing; rows without an id take no part.
    Rows that repeat a doc_id count as one document, rows that repeat an item_id as one item. Other columns are
    ignored. No documents or no items give no rows.
    """
    index = staged(sketched(item_shingles(items, shingle).distinct(), threshold), "items")
    widths = [r.k for r in index.select("k").distinct().collect()]
    maps = (bitmap(index.filter("in_sketch").select("hash")), bitmap(index.select("hash")))
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    hits = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(partial(_hit_batches, shared=shared, widths=sorted(widths)), "doc_id long, shingle string")
    # The bitmaps let about a shingle in 16 through by chance; only those of items are kept.
    hits = staged(hits.join(index.select("shingle").distinct(), "shingle", "left_semi").select("doc_id", "shingle"), "hits")
    # Candidates from the sketches alone; a shingle that many items share counts only for the items a document may hold.
    candidates = hits.join(index.filter("in_sketch").select("item_id", "shingle"), "shingle").select("doc_id", "item_id").distinct()
    checked = candidates.join(index.select("item_id", "n", "needs", "shingle"), "item_id").join(hits, ["doc_id", "shingle"], "left_semi")
    pairs = checked.groupBy("doc_id", "item_id").agg(F.first("n").alias("n_shingles"), F.first("needs").alias("needs"), F.count("*").alias("n_found"))
    found = pairs.filter(F.col("n_found") >= F.col("needs"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def _hit_batches(batches, shared, widths):
    sketch, every = shared.value
    for whole in batches:
        for batch in slices(whole):
            ids, texts = [], []
            if widths:
                words = _words(batch)
                raw, hashes = words.data.tobytes(), words.hashes()[0]
                doc = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
                candidate = np.zeros(batch.num_rows, dtype=bool)
                found = [(k, *words.windows(hashes, k)) for k in widths]
                for _, at, h in found:
                    candidate[doc[at[in_bitmap(sketch, h)]]] = True
                names = batch.column("doc_id").to_pylist()
                for k, at, h in found if candidate.any() else ():
                    keep = candidate[doc[at]]
                    at, h = at[keep], h[keep]
                    keep = in_bitmap(every, h)
                    at, h = at[keep], h[keep]
                    _, once = np.unique(np.stack([doc[at].astype(np.uint64), h]), axis=1, return_index=True)
                    for i in at[once].tolist():
                        ids.append(names[doc[i]])
                        texts.append(_shingle_text(words, raw, i, k))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "shingle"])


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without those that contain an item. Rows without an id stay."""
    found = contamination(docs, items, threshold, shingle).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


SQL = f"""
with words as (
  select doc_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') as w from documents where doc_id is not null
), items as (
  select item_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') as w from benchmark where item_id is not null
), item_shingles as (
  select distinct item_id, least(5, len(w)) as k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as shingle
  from items, lateral (select unnest(range(1, greatest(2, len(w) - 3))) as i) where len(w) > 0
), sizes as (
  select item_id, count(*) as n from item_shingles group by item_id
), doc_shingles as (
  select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as shingle
  from words, (select distinct k from item_shingles) ks, lateral (select unnest(range(1, len(w) - k + 2)) as i)
)
select doc_id, item_id, n as n_shingles, count(*) as n_found, count(*) / n as containment
from doc_shingles join item_shingles using (k, shingle) join sizes using (item_id)
group by doc_id, item_id, n having count(*) >= 0.8 * n - 1e-9
"""
