"""Byte-level BPE encoding and decoding: speculate and verify.

Texts are cut into words by the tokenizer's public pattern. For words not seen before, greedy longest match proposes
tokens. A token sequence is the BPE result exactly if no merge would have crossed the border of any two adjacent
tokens, so all adjacent pairs of all new words are tested at once with array operations; only words with a failing
pair are merged step by step. Every distinct word is encoded once per task, within a bounded memory.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from difflens.llm.common import slices, text_column

# Fixed value: the word pattern of this family of tokenizers, white space being Unicode's.
_BLANK = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_FAR = np.int64(1 << 40)
_NEVER = 1 << 40
_SHORT = 48
#: Words of one generation of the memo; the generation before is kept, so that frequent words stay.
_MEMO = 100_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Codec:
    """Tables of a vocabulary. ``rank``, ``left`` and ``right``: the merge that makes a token (rank -1: none)."""

    tokens: list[bytes]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: dict[tuple[int, int], tuple[int, int]]
    ids: dict[bytes, int]
    proposed: dict[bytes, int]
    special: dict[str, int]
    memo: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Codec:
        """Reads a byte-level BPE vocabulary in the JSON form of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *special.values()])
        tokens = [b""] * n
        for token, i in vocab.items():
            tokens[i] = token
        for content, i in special.items():
            tokens[i] = content.encode()
        rank, left, right, merged = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            merged.setdefault((x, y), (r, z))
            if rank[z] < 0:
                rank[z], left[z], right[z] = r, x, y
        keys = np.array([x * n + y for x, y in merged], dtype=np.int64)
        order = np.argsort(keys)
        ranks = np.array([r for r, _ in merged.values()], dtype=np.int64)[order]
        codec = cls(tokens, rank, left, right, keys[order], ranks, merged, vocab, {}, special)
        # Only tokens that BPE makes of their own bytes may be proposed.
        codec.proposed = {t: i for t, i in vocab.items() if codec.merge(t) == [i]}
        return codec

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the adjacent pair of lowest rank is merged first, the leftmost of equals.

        A short word's ranks stand in a list, a longer word's pairs wait in a heap.
        """
        ids = [self.ids[bytes([b])] for b in word]
        n = len(ids)
        if n <= _SHORT:
            none = (_NEVER, 0)
            find = self.merged.get
            pairs = [find(p, none) for p in zip(ids, ids[1:])]
            while pairs and (best := min(pairs))[0] < _NEVER:
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = find((ids[i - 1], ids[i]), none)
                if i < len(pairs):
                    pairs[i] = find((ids[i], ids[i + 1]), none)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merged.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i] = self.merged[x, y][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := self.merged.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, ids[a], ids[b]))
        return [x for x, live in zip(ids, alive) if live]

    def propose(self, word: bytes, longest: int) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(word)
        find = self.proposed.get
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                if (i := find(word[at:end])) is not None:
                    break
            out.append(i)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between tokens ``a`` and ``b``, for all pairs at once.

        Both tokens are taken apart in the reverse order of their making. The pieces that meet at the border at some
        time must have no merge that would come before the merge that used one of them up: not earlier than one on the
        left, not earlier than or together with one on the right.
        """
        good = np.ones(len(a), dtype=bool)
        todo = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _FAR)
        while len(todo):
            key = x * len(self.rank) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _FAR)
            bad = r < limit
            good[todo[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            todo, x, y = todo[go], x[go], y[go]
            by_left = self.rank[x] > self.rank[y]
            limit = np.where(by_left, self.rank[x], self.rank[y] + 1)
            x, y = np.where(by_left, self.right[x], x), np.where(by_left, y, self.left[y])
        return good

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of new words into the memo."""
        longest = max(map(len, self.proposed))
        raw = [w.encode() for w in words]
        guess = [self.propose(w, longest) for w in raw]
        flat = np.array([i for g in guess for i in g], dtype=np.int64)
        owner = np.repeat(np.arange(len(guess)), [len(g) for g in guess])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failing = np.zeros(len(guess), dtype=bool)
        failing[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        for word, data, tokens, fails in zip(words, raw, guess, failing.tolist()):
            self.memo[word] = np.array(self.merge(data) if fails else tokens, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as bytes of 32-bit integers."""
        cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        words = []
        for text in texts:
            own, at = [], 0
            for m in cut.finditer(text) if cut and any(s in text for s in self.special) else ():
                own += _WORD.findall(text[at : m.start()])
                own.append(m.group())
                at = m.end()
            words.append(own + _WORD.findall(text[at:]) if at else _WORD.findall(text))
        if len(self.memo) > _MEMO:
            self.older, self.memo = self.memo, {}
        if not self.memo:
            self.memo.update({s: np.array([i], dtype=np.int32).tobytes() for s, i in self.special.items()})
        new = set().union(*words) - self.memo.keys()
        if known := new & self.older.keys():
            self.memo.update((w, self.older[w]) for w in known)
        if new := list(new - known):
            self.learn(new)
        return [b"".join(map(self.memo.__getitem__, own)) for own in words]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the token ids ``ids[at[i]:at[i + 1]]``; bytes that are no UTF-8 become U+FFFD."""
        sizes = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        starts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        n = sizes[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = table[np.repeat(starts[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = ends[at].tolist()
        return [data[s:e].decode("utf-8", "replace") for s, e in zip(cuts, cuts[1:])]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs, path), path)`` in one pass of Python: ``docs`` without ``text``, with ``ids`` and ``decoded``."""
    kept = docs.select(*[c for c in docs.columns if c not in ("text", "ids", "decoded")], "text")
    schema = T.StructType([*kept.drop("text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(partial(_round_trip_batches, shared=_shared(docs.sparkSession, path)), schema)


def _round_trip_batches(batches, shared):
    return _decode_batches(_encode_batches(batches, shared), shared)


_LOADED: dict[str, Codec] = {}


def _shared(spark: SparkSession, path: str):
    """The vocabulary's tables: read on the driver, of a fixed size, and sent to each executor once."""
    if path not in _LOADED:
        _LOADED[path] = Codec.load(path)
    return spark.sparkContext.broadcast(_LOADED[path])


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``column``, in the place of that column.

    Encodes as the vocabulary's own library does without adding special tokens: the special tokens' strings in a text
    become their ids. Null and empty texts have no ids. Texts of any length are encoded whole; repeated rows stay.
    """
    kept = [c for c in docs.columns if c not in (column, "ids")]
    kept = [c for c in kept if c != "text"]
    plain = docs.select(*kept, F.col(column).alias("text"))
    schema = T.StructType([*plain.drop("text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(partial(_encode_batches, shared=_shared(docs.sparkSession, path)), schema)


def _encode_batches(batches, shared):
    pa.default_memory_pool().release_unused()  # a worker that is used again holds what other work has freed
    codec = shared.value
    for whole in batches:
        for batch in slices(whole, 1 << 20):
            ids = codec.encode(text_column(batch).to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(ids))])
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.ListArray.from_arrays(pa.array(at), flat)], [*(n for _, n in kept), "ids"])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (… ids) with ``decoded``, the text of ``ids``, special tokens included. Null ids are no ids."""
    kept = tokens.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(partial(_decode_batches, shared=_shared(tokens.sparkSession, path)), schema)


def _decode_batches(batches, shared):
    codec = shared.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            lists = part.column("ids")
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], dtype=np.int64)
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])
