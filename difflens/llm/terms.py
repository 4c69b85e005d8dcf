"""Corpus counts of words: in how many documents each word occurs."""

from __future__ import annotations

import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import slices, text_column

#: Characters that are not part of a word at its edges.
EDGES = string.punctuation + "¿¡«»“”‘’„…–—·"
_MOST = 200_000


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of a text, without punctuation at the edges."""
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    words.discard("")
    return words


class Tally:
    """Document counts of one task; given away in parts, so that its size is bounded."""

    def __init__(self):
        self.counts: Counter = Counter()

    def add(self, text: str) -> None:
        self.counts.update(words_of(text))

    def take(self, all_: bool = False) -> Counter | None:
        if self.counts and (all_ or len(self.counts) > _MOST):
            out, self.counts = self.counts, Counter()
            return out
        return None


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, n): the number of rows of ``docs`` with the word in ``text``. Null texts have no words."""
    return docs.select("text").mapInArrow(_count_batches, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _count_batches(batches):
    tally = Tally()
    for whole in batches:
        for batch in slices(whole):
            for text in text_column(batch).to_pylist():
                tally.add(text)
            if (out := tally.take()) is not None:
                yield _rows(out)
    if (out := tally.take(True)) is not None:
        yield _rows(out)


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
