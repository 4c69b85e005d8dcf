"""Substring deduplication: a count-min prefilter, then exact grouping of the windows estimated to repeat.

A window is ``k`` consecutive words. A word is removed if it is covered by a window whose words also start in a document
with a smaller doc_id.

Documents are packed into blocks, written once. Each block makes a count-min sketch of its windows; sketches are cut
into slices by the windows' hash, and each slice is merged by one task, whose width follows the number of windows. A
block gets back one bit for each cell it has touched: whether the merged count is two or more. Windows all of whose
cells say so may repeat, all others can't. Only these are grouped exactly, one entry for each block and key, and each entry gets
back one bit: whether a document of another block comes first. No window is lost, frequent windows meet as one entry for
each block, and only sketches, entries and bits are shuffled beside the blocks.

A key is 96 bits made of the words' 128-bit hashes under a random key drawn for each run, so texts can't be made to collide,
and two unequal windows share a key with a chance of 2^-96. Within a block equal words are told by their bytes.
"""

from __future__ import annotations

import secrets
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import SPACE, Words, mix, slices, staged, text_column, utf8

_BLOCK = 6 << 20
_LAST = np.iinfo(np.int64).max
_SEEDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A62)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each by planes of bytes, which leaves long runs of zeros to the compressor."""
    planes = [np.array([len(arrays), *map(len, arrays)], dtype=np.int64).tobytes()]
    planes += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _expand(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 8 * (1 + len(kinds))
    out = []
    for n, kind in zip(np.frombuffer(raw, np.int64, 1 + len(kinds))[1:].tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _pack_batches(batches, k):
    for whole in batches:
        for batch in slices(whole, _BLOCK):
            texts = text_column(batch)
            data, at = utf8(texts)
            words = Words(data, at, ~SPACE[data])
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()
            n = int(np.maximum(np.diff(words.first) - k + 1, 0).sum())
            blob = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_squeeze(ids, at)], pa.binary()), pa.array([blob], pa.binary())], ["windows", "rows", "texts"])


class _Block:
    """The windows of a block: text and first word of each, and their hashes."""

    def __init__(self, rows: bytes, texts: bytes, k: int, slices_: int, width: int, key: int):
        self.ids, self.at = _expand(rows, np.int64, np.int64)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        self.words = Words(data, self.at, ~SPACE[data])
        first, self.second = self.words.hashes(key)
        self.start, self.hash = self.words.windows(first, k)
        self.slice = ((self.hash >> np.uint64(40)) % np.uint64(slices_)).astype(np.int64)
        self.width = width
        self.slices = slices_

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (slice, cell) in order as one number, the cell of each window in them, and their counts."""
        cell = mix(self.hash ^ np.uint64(_SEEDS[row])) & np.uint64(self.width - 1)
        place = self.slice * self.width + cell.astype(np.int64)
        distinct, inverse, counts = np.unique(place, return_inverse=True, return_counts=True)
        return distinct, inverse.reshape(-1), counts

    def repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """Windows whose count is estimated at two or more, from the bits of each slice (both rows, one after the other)."""
        likely = np.ones(len(self.hash), dtype=bool)
        parts = {s: np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)) for s, b in bits.items()}
        used = dict.fromkeys(parts, 0)
        for row in range(len(_SEEDS)):
            distinct, inverse, _ = self.cells(row)
            many = np.zeros(len(distinct), dtype=bool)
            edges = np.searchsorted(distinct, np.arange(self.slices + 1) * self.width)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                n = edges[s + 1] - edges[s]
                many[edges[s] : edges[s + 1]] = parts[s][used[s] : used[s] + n]
                used[s] += n
            likely &= many[inverse]
        return np.flatnonzero(likely)

    def entries(self, likely: np.ndarray, k: int):
        """Distinct keys of the likely windows by slice and value (high, low), each window's key, each key's first document."""
        high = self.hash[likely]
        at, second = self.words.windows(self.second, k)
        low = (second[likely] >> np.uint64(32)).astype(np.uint32)
        doc = self.ids[np.searchsorted(self.words.first, self.start[likely], side="right") - 1]
        order = np.lexsort((doc, low, high, self.slice[likely]))
        h, lo, d = high[order], low[order], doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        key = np.empty(len(order), dtype=np.int64)
        key[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return self.slice[likely][order][first], h[first], lo[first], d[first], key, doc


_SLICED = "slice int, block long, data binary"


def _sketch_batches(batches, k, slices_, width, key):
    for batch in batches:
        for block, rows, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "texts"))):
            b = _Block(rows, texts, k, slices_, width, key)
            sketch = [b.cells(row) for row in range(len(_SEEDS))]
            edges = [np.searchsorted(distinct, np.arange(slices_ + 1) * width) for distinct, _, _ in sketch]
            out = []
            for s in range(slices_):
                arrays = []
                for (distinct, _, counts), edge in zip(sketch, edges):
                    cells = distinct[edge[s] : edge[s + 1]] - s * width
                    arrays += [np.diff(cells, prepend=0).astype(np.uint32), np.packbits(counts[edge[s] : edge[s + 1]] > 1)]
                if len(arrays[0]):
                    out.append((s, _squeeze(*arrays)))
            yield _sliced([s for s, _ in out], block, [x for _, x in out])


def _sliced(slices_: list[int], block, data: list[bytes]) -> pa.RecordBatch:
    blocks = block if isinstance(block, list) else [block] * len(data)
    return pa.RecordBatch.from_arrays([pa.array(slices_, pa.int32()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], ["slice", "block", "data"])


def _merge_slice(group: pa.Table, width: int) -> pa.Table:
    """Adds up the sketches of a slice, and tells each block which of its cells count two or more."""
    blobs = group.column("data").to_pylist()
    bits: list[list[np.ndarray]] = [[] for _ in blobs]
    for row in range(len(_SEEDS)):
        total = np.zeros(width, dtype=np.uint8)
        for once in (True, False):
            for i, blob in enumerate(blobs):
                deltas, many = _expand(blob, *[np.uint32, np.uint8] * len(_SEEDS))[2 * row : 2 * row + 2]
                cells = np.cumsum(deltas, dtype=np.int64)
                if once:
                    total[cells] = np.minimum(total[cells] + 1 + np.unpackbits(many, count=len(cells)), 2)
                else:
                    bits[i].append(total[cells] > 1)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.Table.from_batches([_sliced(group.column("slice").to_pylist(), group.column("block").to_pylist(), [squeeze(np.packbits(np.concatenate(b)).tobytes()) for b in bits])])


def _entry_batches(batches, k, slices_, width, key):
    for batch in batches:
        for block, rows, texts, bits in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "texts", "bits"))):
            b = _Block(rows, texts, k, slices_, width, key)
            slice_, high, low, first, _, _ = b.entries(b.repeated(_by_slice(bits)), k)
            edges = np.searchsorted(slice_, np.arange(slices_ + 1))
            out = []
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[s], edges[s + 1])
                names, local = np.unique(first[own], return_inverse=True)
                out.append((s, _squeeze(high[own], low[own], names, local.reshape(-1).astype(np.uint32))))
            yield _sliced([s for s, _ in out], block, [x for _, x in out])


def _by_slice(rows: list[dict] | None) -> dict[int, bytes]:
    return {r["slice"]: r["data"] for r in rows or ()}


def _first_slice(group: pa.Table) -> pa.Table:
    """Exact grouping of a slice's keys: a bit for each entry, whether its key starts in a smaller document elsewhere."""
    entries = [_expand(x, np.uint64, np.uint32, np.int64, np.uint32) for x in group.column("data").to_pylist()]
    high, low = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
    first = np.concatenate([e[2][e[3]] for e in entries])
    order = np.lexsort((first, low, high))
    h, lo, f = high[order], low[order], first[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    least = f[np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = np.empty(len(order), dtype=bool)
    earlier[order] = least < f
    parts = np.split(earlier, np.cumsum([len(e[0]) for e in entries])[:-1])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.Table.from_batches([_sliced(group.column("slice").to_pylist(), group.column("block").to_pylist(), [squeeze(np.packbits(p).tobytes()) for p in parts])])


def _cut_batches(batches, k, slices_, width, key):
    for batch in batches:
        for rows, texts, bits, earlier in zip(*(batch.column(c).to_pylist() for c in ("rows", "texts", "bits", "earlier"))):
            b = _Block(rows, texts, k, slices_, width, key)
            likely = b.repeated(_by_slice(bits))
            slice_, _, _, first, entry, doc = b.entries(likely, k)
            before = np.zeros(len(first), dtype=bool)
            edges = np.searchsorted(slice_, np.arange(slices_ + 1))
            for s, data in _by_slice(earlier).items():
                own = slice(edges[s], edges[s + 1])
                before[own] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=edges[s + 1] - edges[s])
            # A window goes if its key starts earlier in another block, or in a smaller document of this one.
            yield from _cut(b, b.start[likely][before[entry] | (first[entry] < doc)], k)


def _cut(b: _Block, start: np.ndarray, k: int):
    words, data = b.words, b.words.data.copy()
    depth = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + k, -1)
    kept = np.cumsum(depth[:-1]) == 0
    owner = np.repeat(np.arange(len(b.ids)), np.diff(words.first))
    at = np.flatnonzero(kept)
    # The bytes of kept words, and one blank before each but the first of a text.
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    edge[words.start[at]] += 1
    edge[words.end[at]] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    gap = words.start[at[1:][owner[at[1:]] == owner[at[:-1]]]] - 1
    data[gap] = 32
    inside[gap] = True
    cuts = np.concatenate([[0], np.cumsum(inside)])[b.at]
    text = data[inside].tobytes()
    n = np.diff(words.first)
    removed = n - np.bincount(owner[at], minlength=len(b.ids))
    for lo in range(0, len(b.ids), 1024):
        part = slice(lo, lo + 1024)
        ids = b.ids[part]
        edges = cuts[lo : lo + len(ids) + 1].tolist()
        texts = [text[s:e].decode() for s, e in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(n[part], pa.int64()), pa.array(removed[part], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def deduplicate(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for each row of ``docs`` (doc_id, text); ``text``: kept words joined by blanks.

    Null and empty texts have no words, texts of fewer than ``k`` words no window. Rows that share a doc_id are one
    document for the rule, and each has its row. A row without an id comes after all others. Other columns are ignored.
    No rows give no rows.
    """
    packed = docs.select("doc_id", "text").mapInArrow(partial(_pack_batches, k=k), "windows long, rows binary, texts binary")
    blocks = staged(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    windows = blocks.agg(F.sum("windows")).first()[0] or 0
    n_slices = max(64, -(-windows // (1 << 22)))
    width = 1 << max(8, int(np.ceil(np.log2(max(1, 4 * windows / n_slices)))))
    sizes = {"k": k, "slices_": n_slices, "width": width, "key": secrets.randbits(64)}

    def merge(group: pa.Table) -> pa.Table:
        return _merge_slice(group, width)

    def first(group: pa.Table) -> pa.Table:
        return _first_slice(group)

    def of_blocks(sliced: DataFrame, name: str) -> DataFrame:
        return sliced.groupBy("block").agg(F.collect_list(F.struct("slice", "data")).alias(name))

    sketches = blocks.select("block", "rows", "texts").mapInArrow(partial(_sketch_batches, **sizes), _SLICED)
    merged = staged(of_blocks(sketches.groupBy("slice").applyInArrow(merge, _SLICED), "bits"), "bits")
    known = blocks.select("block", "rows", "texts").join(merged, "block", "left")
    entries = known.mapInArrow(partial(_entry_batches, **sizes), _SLICED)
    earlier = staged(of_blocks(entries.groupBy("slice").applyInArrow(first, _SLICED), "earlier"), "earlier")
    return known.join(earlier, "block", "left").mapInArrow(partial(_cut_batches, **sizes), "doc_id long, n_words long, n_removed long, text string")


SQL = r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from texts, lateral (select unnest(range(1, len(w) - 11)) as i)
), firsts as (
  select s, min(doc_id) as least from windows group by s
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (s) where least < doc_id
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from texts
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text from words anti join gone using (doc_id, p) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from texts left join kept using (doc_id)
"""
