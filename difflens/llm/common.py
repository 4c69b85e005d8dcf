"""Shared helpers: tables, staged tables, word arithmetic on Arrow buffers, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words: blank and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower case of A to Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, where it may be unset, gets a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    made = spark.conf.get("difflens.llm.folder", "")
    if not made:
        made = tempfile.mkdtemp(prefix="difflens-llm-")
        spark.conf.set("difflens.llm.folder", made)
    return made


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column without nulls: a null text counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.string()).fill_null("") if column.null_count or column.type != pa.string() else column


def slices(batch: pa.RecordBatch, most: int = 1 << 20):
    """Runs of rows of at most ``most`` bytes (a longer row is a run of its own), so that arrays stay small."""
    lengths = np.diff(offsets(text_column(batch)))
    start, held = 0, 0
    for row, size in enumerate(lengths.tolist()):
        if held and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of an Arrow string array's rows, in its data buffer."""
    if not len(texts):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the row offsets in them, without a copy."""
    at = offsets(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch of texts: byte spans, and for every text the range of its words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, is_word: np.ndarray):
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        before = np.empty(len(data), dtype=bool)
        before[:1] = True
        np.logical_not(is_word[:-1], out=before[1:])
        self.start = np.flatnonzero(is_word & (before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        after[-1:] = True
        np.logical_not(is_word[1:], out=after[:-1])
        self.end = np.flatnonzero(is_word & (after | edge[1:])) + 1
        self.data = data
        #: Words ``first[i]`` to ``first[i + 1]`` are those of text ``i``.
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word, the halves of its keyed 128-bit hash. Equal words are found by
        their bytes, so each distinct word is hashed once."""
        lengths = self.end - self.start
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.start] += 1
        np.add.at(inside, self.end, -1)
        at = np.concatenate([[0], np.cumsum(lengths)])
        kept = self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, key) for w in words.dictionary.to_pylist()), dtype=np.uint64).reshape(-1, 2)
        of = words.indices.to_numpy()
        return both[of, 0], both[of, 1]

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``k`` words within one text. Words' hashes that nobody can predict make
        the runs' as good: unequal runs agree with a chance of 2^-64."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = hashes[:n].copy()
        for j in range(1, k):
            h *= np.uint64(0xC6A4A7935BD1E995)
            h += hashes[j : j + n]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text[:n] == text[k - 1 :])
        return at, mix(h[at])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the public splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b): each node with the smallest node it reaches (node, root).

    Each round hangs every neighbour of a node below the node's smallest neighbour, first the larger neighbours,
    then the smaller ones, until nothing changes; the links shrink to stars. Every round is written to the shared
    folder. Nodes without links are not in the result.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = staged(links.filter("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(*pair(F.col("b"), F.col("low"))).unionByName(low.select(*pair(F.col("a"), F.col("low"))))
        edges = staged(small.filter("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
