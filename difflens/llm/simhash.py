"""SimHash near-duplicates: fingerprints of word shingles, joined by walking pairs of nodes of a binary trie.

Texts are lower-cased (A to Z), split at white space and cut into 3-word shingles. A fingerprint bit is set when more
than half of the shingles' XXH64 values have it. Fingerprints that differ in at most ``max_bits`` bits are linked, and
a component is everything reachable over links.

The join is over *distinct* fingerprints, so copies cost nothing. Bits are dealt into ``max_bits + 1`` blocks: two
linked fingerprints agree in at least one whole block, which therefore is the root of a trie holding both. A root with
very many fingerprints is split into pairs of its own subtries, again only those whose prefixes are within the budget.
Inside a root the trie (a sorted array) is joined with itself: pairs of nodes carry the bits that differ so far and are
dropped beyond the budget, or when both nodes already belong to one component. A root gives its spanning links, never
all of its pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import LOWER, SPACE, Words, components, slices, staged, text_column, utf8

_CHUNK = 1 << 18
#: Most trie levels by which a root is split.
_HEAD = 12


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs`` (doc_id, text): the 64 fingerprint bits as a signed long.

    A text of fewer words is one shingle; a null text or one without words has fingerprint 0.
    """
    of = partial(_fingerprint_batches, shingle=shingle)
    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def _fingerprint_batches(batches, shingle):
    for whole in batches:
        for batch in slices(whole):
            data, at = utf8(text_column(batch))
            data = LOWER[data]
            words = Words(data, at, ~SPACE[data])
            raw = data.tobytes()
            w = [raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist())]
            first = words.first.tolist()
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for i in range(batch.num_rows):
                if first[i + 1] > first[i]:
                    out[i] = fingerprint(w[first[i] : first[i + 1]], shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])


_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's shingles, repeats included."""
    if len(words) < shingle:
        return _hash(b" ".join(words))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle))))), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        part = hashes[lo : lo + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def linked(fps: DataFrame, max_bits: int = 3, root_size: int = 1024) -> DataFrame:
    """Pairs (a, b) of distinct values of ``fps.fp`` that reach each other over links of at most ``max_bits`` bits.

    A root gives each value once, with the first value of its component there: the pairs connect exactly what the full
    link graph connects. Roots of more than about ``root_size``
    fingerprints are split into pairs of subtries; this moves work to more tasks and changes no result.
    """
    blocks = max_bits + 1
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    roots, low = [], 0
    for i, size in enumerate(sizes):
        roots.append((i, low, size))
        low += size
    # The value is rotated so that the agreeing block leads; the trie below it starts at the next bit.
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), lo, n).alias("root"), _turned(F.col("fp"), lo, n).alias("turned")) for i, lo, n in roots])).alias("r")).select("fp", "r.*")
    counts = dealt.groupBy("block", "root").agg(F.count("*").alias("n")).filter("n > 1")
    wide = F.least(F.ceil(F.log2(F.col("n") / F.lit(root_size))), F.lit(_HEAD)).cast("int")
    counts = counts.select("block", "root", F.greatest(wide, F.lit(0)).alias("levels"))
    placed = dealt.join(counts, ["block", "root"])
    small = placed.filter("levels = 0").withColumn("pair", F.lit(-1).cast("long")).withColumn("side", F.lit(0))
    # Heads within the budget of a head: those that differ from it by a mask of few bits.
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << _HEAD) if m.bit_count() <= max_bits])
    length = F.array(*[F.lit(n) for _, _, n in roots])[F.col("block")]
    large = placed.filter("levels > 0").withColumn("length", length)
    large = large.withColumn("head", F.expr("shiftrightunsigned(shiftleft(turned, length), 64 - levels)"))
    large = large.withColumn("other", F.explode(F.transform(F.filter(masks, lambda m: m < F.expr("shiftleft(1L, levels)")), lambda m: m.bitwiseXOR(F.col("head")))))
    large = large.select("fp", "block", "root", "turned", "levels", (F.least("head", "other") * 65536 + F.greatest("head", "other")).alias("pair"), F.when(F.col("head") == F.col("other"), 0).when(F.col("head") < F.col("other"), 1).otherwise(2).alias("side"))
    pieces = small.select("block", "root", "pair", "side", "fp").unionByName(large.select("block", "root", "pair", "side", "fp"))
    # One sorted stream per task; a task holds the roots of one batch at a time.
    # The trie takes values in unsigned order, so negative longs come last.
    pieces = pieces.repartition("block", "root", "pair").sortWithinPartitions("block", "root", "pair", "side", F.col("fp") < 0, "fp")
    return pieces.mapInArrow(partial(_join_roots, max_bits=max_bits), "a long, b long").distinct()


def _bits(fp: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _turned(fp: Column, low: int, n: int) -> Column:
    """Rotation that brings bits ``low`` to ``low + n - 1`` to the top."""
    up = 64 - low - n
    return F.shiftleft(fp, up).bitwiseOR(F.shiftrightunsigned(fp, 64 - up)) if up else fp


def _join_roots(batches, max_bits):
    for rows in whole_roots(batches):
        values = rows[4].view(np.uint64)
        child, root = trie_links(values, root_nodes(rows), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(rows[4, child]), pa.array(rows[4, root])], ["a", "b"])


def whole_roots(batches):
    """The rows of sorted batches as columns of integers, cut between roots only."""
    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        # The last root may go on in the next batch.
        last = int(np.argmax((rows[:3] == rows[:3, -1:]).all(axis=0)))
        held = rows[:, last:]
        if last:
            yield rows[:, :last]
    if held is not None:
        yield held


def root_nodes(rows: np.ndarray) -> np.ndarray:
    """The pairs of nodes with which the walk of each root begins; rows: block, root, pair, side, value, …"""
    n = rows.shape[1]
    change = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    lo = np.concatenate([[0], np.flatnonzero(change) + 1])
    hi = np.concatenate([lo[1:], [n]])
    # Side 0: a root joined with itself. Sides 1 and 2: two subtries of a root.
    split = lo + np.add.reduceat((rows[3] == 1).astype(np.int64), lo)
    own = rows[3, lo] == 0
    nodes = np.stack([lo, np.where(own, hi, split), np.where(own, lo, split), hi, np.zeros(len(lo), dtype=np.int64)], axis=1)
    return nodes[(nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])]


def _any(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.ones(len(i), dtype=bool)


def trie_links(values: np.ndarray, nodes: np.ndarray, max_bits: int, accept=_any) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of values at most ``max_bits`` bits apart, between the two nodes of any of the pairs ``nodes``.

    The links are positions in ``values``; ``accept`` may reject pairs of positions. A node is a range of ``values`` that is sorted; a pair is (from, to, from, to, bits that differ so far). The walk
    goes down bit by bit with all pairs that are alive; pairs of few values are compared outright.
    """
    parent = np.arange(len(values))
    own = nodes[nodes[:, 0] == nodes[:, 2]]
    # Neighbours in order are cheap to test and join most of a dense root at once.
    within = np.zeros(len(values) + 1, dtype=np.int64)
    within[own[:, 0]] += 1
    within[own[:, 1] - 1] -= 1
    near = np.flatnonzero((np.cumsum(within)[: len(values) - 1] > 0) & (np.bitwise_count(values[1:] ^ values[:-1]) <= max_bits))
    near = near[accept(near, near + 1)]
    _union(parent, near, near + 1)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, nodes)]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes) > 4096:
            stack += [(bit, part) for part in np.array_split(nodes, -(-len(nodes) // 4096))]
            continue
        nodes = _unsettled(nodes, parent)
        small = ((nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= 256) | (bit == 64)
        if small.any():
            _compare(values, nodes[small], parent, max_bits, accept)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, err = nodes.T
        ca, cb = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0])
        new = np.concatenate(
            [
                np.stack([a0, ca, b0, cb, err], axis=1),
                np.stack([ca, a1, cb, b1, err], axis=1),
                np.stack([a0, ca, cb, b1, err + 1], axis=1),
                np.stack([ca, a1, b0, cb, err + 1], axis=1)[a0 != b0],
            ]
        )
        stack.append((bit + 1, new[(new[:, 1] > new[:, 0]) & (new[:, 3] > new[:, 2]) & (new[:, 4] <= max_bits)]))
    root = _roots(parent)
    child = np.flatnonzero(root != np.arange(len(values)))
    return child, root[child]


def _unsettled(nodes, parent):
    """Node pairs that don't lie wholly inside one component."""
    root = _roots(parent)
    change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    flat = (change[nodes[:, 1] - 1] == change[nodes[:, 0]]) & (change[nodes[:, 3] - 1] == change[nodes[:, 2]])
    return nodes[~(flat & (root[nodes[:, 0]] == root[nodes[:, 2]]))]


def _compare(values, nodes, parent, max_bits, accept):
    a0, a1, b0, b1, _ = nodes.T
    n, m = a1 - a0, b1 - b0
    k = np.arange(int((n * m).sum())) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    mm = np.repeat(m, n * m)
    i, j = np.repeat(a0, n * m) + k // mm, np.repeat(b0, n * m) + k % mm
    root = _roots(parent)
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    near = np.flatnonzero(np.bitwise_count(values[i] ^ values[j]) <= max_bits)
    near = near[accept(i[near], j[near])]
    _union(parent, i[near], j[near])


def _union(parent, a, b):
    """Joins the components of ``a`` and ``b``, pair by pair; every root hangs below the smallest root it is paired with."""
    while len(a):
        root = _roots(parent)
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _roots(parent):
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def near_duplicates(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links, the row's own included. Null and empty texts have
    fingerprint 0 and are linked like any other. Repeated rows stay; other columns are ignored. No rows give no rows.
    """
    fps = staged(fingerprints(docs, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(linked(classes.select("fp"), max_bits))
    named = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(named.join(lows, "root").select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` without the documents of a component other than that with the smallest doc_id.

    All rows of a kept doc_id stay, repeated ones too, with all columns; a doc_id whose rows have several texts stays if one
    of them is the first of its component. Null and empty texts are one component. Rows without a doc_id stay. No rows
    give no rows."""
    found = near_duplicates(docs.select("doc_id", "text").filter("doc_id is not null"), max_bits, shingle)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).filter("not first").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
