"""Secret scans: fixed forms of secrets, and values in credential context that would be hard to guess.

Fixed forms are assignments of long values, access keys and hex strings. Beside them, every value that stands in a
credential context (``password is …``, ``auth: …``) is scored by its guess cost: the cheapest way to cut it into
dictionary words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming. Values whose
cheapest way takes at least ``10 ** least`` guesses are added. The dictionary is the corpus itself: its most frequent
words with their ranks.
"""

from __future__ import annotations

import math
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import slices, staged, text_column
from difflens.llm.terms import document_counts

#: Kinds of fixed forms in the order of their listing; the added kind comes last.
KINDS = ("assign", "access", "hex")
GUESS = "guess"

# The forms of the base spans.
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}+")
_HEX = re.compile(r"[0-9a-f]{16,}+")

#: Words that announce a credential, and the value after them.
_CONTEXT = re.compile(
    r"(?<![A-Za-z0-9])(?:(?ai:passwords?|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credentials?|login)"
    r"[\"']?(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20{1,3}(?:is|was)\x20{1,3})(?![\"'`]?(?ai:bearer)\x20)"
    # After bearer and after options a blank is enough.
    r"|(?:(?ai:bearer)|(?<![^\s\"'`=(\[])--?(?ai:(?:[a-z0-9]+[_-])*(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|login)))\x20{1,3})"
    r"[\"'`]?([^\s\"'`<>,;]{6,})"
)
_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "auth", "bearer", "credential", "login")

#: Rows of a keyboard, for walks.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujm", "abcdefghijklmnopqrstuvwxyz")
_STEPS = {(a, b) for row in _ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
_DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"),
    re.compile(r"(?:19|20)\d\d"),
)
_LEET = str.maketrans("01345@$", "oleasas")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all fixed forms, by start and then kind."""
    low = text.lower()
    spans = []
    if any(h in low for h in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


class _Starts:
    """The cheapest start of a repeat or walk that ends at some place, over the starts of one run.

    A start ``i`` offers ``at + log10(end - i)``. Of two starts the later is the cheaper for near ends and the earlier for
    far ones, if they change at all, so a tree over the ends with one start in each node finds the cheapest; each place
    looks at no more starts than the tree is deep.
    """

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.kept: dict[tuple[int, int], tuple[float, int]] = {}

    @staticmethod
    def _offer(start: tuple[float, int], end: int) -> float:
        # Before a start is reached nothing ends there; the later start counts as the cheaper, as it is just behind.
        return start[0] + math.log10(end - start[1]) if end > start[1] else -math.inf

    def add(self, at: float, i: int) -> None:
        low, high, start = self.low, self.high, (at, i)
        while True:
            held = self.kept.get((low, high))
            if held is None:
                self.kept[low, high] = start
                return
            middle = (low + high) // 2
            if self._offer(start, middle) <= self._offer(held, middle):  # starts come in order, so this one is the later
                self.kept[low, high], start, held = start, held, start
            if low == high:
                return
            # Left of the middle only a later start can still be cheaper, right of it only an earlier one.
            if start[1] > held[1]:
                high = middle
            else:
                low = middle + 1

    def cheapest(self, end: int) -> float:
        low, high, best = self.low, self.high, math.inf
        while True:
            held = self.kept.get((low, high))
            if held is None:
                return best
            best = min(best, self._offer(held, end))
            if low == high:
                return best
            middle = (low + high) // 2
            low, high = (low, middle) if end <= middle else (middle + 1, high)


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33


def guess_cost(value: str, ranks: dict[str, int], longest: int) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``, over all segmentations.

    A word costs its rank (twice that with capitals or leet letters), a date the days of two centuries, a repeat or a
    walk of three or more characters the size of its first one's class times its length, and any other character the size
    of its class. Every segment but such a character costs a factor of two for the choice of what it is.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    step = math.log10(2)
    same = [i > 0 and value[i] == value[i - 1] for i in range(n)]
    walked = [i > 0 and (low[i - 1], low[i]) in _STEPS for i in range(n)]
    ends = []  # for each kind the end of the run that a place is in
    for linked in (same, walked):
        end, out = n, [n] * n
        for i in range(n - 1, -1, -1):
            out[i] = end
            end = end if linked[i] else i
        ends.append(out)
    runs: list[_Starts | None] = [None, None]
    for i in range(n):
        at = best[i]
        size = math.log10(_class_size(value[i]))
        best[i + 1] = min(best[i + 1], at + size)
        if value[i].isdigit():
            for form in _DATES:
                if m := form.match(value, i):
                    days = 200 * (365 if m.end() - i > 4 else 1)
                    best[m.end()] = min(best[m.end()], at + math.log10(days) + step)
        for end in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:end])
            rank = rank if rank is not None else ranks.get(plain[i:end])
            if rank is not None:
                cost = math.log10(rank * (1 if value[i:end] == low[i:end] and low[i:end] in ranks else 2)) + step
                best[end] = min(best[end], at + cost)
        # Whatever ends at i + 1 is known now but repeats and walks, whose starts are at least three places before.
        for kind, linked in enumerate((same, walked)):
            if not linked[i]:
                runs[kind] = None
            elif i >= 2 and linked[i - 1]:
                if runs[kind] is None:
                    runs[kind] = _Starts(i + 1, ends[kind][i])
                start = i - 2
                runs[kind].add(best[start] + math.log10(_class_size(value[start])) + step, start)
                best[i + 1] = min(best[i + 1], runs[kind].cheapest(i + 1))
    return best[n]


def guessed(text: str, ranks: dict[str, int], longest: int, least: float) -> list[tuple[int, int]]:
    """Values in credential context whose cost is ``least`` or more."""
    if not any(h in text.lower() for h in _HINTS):
        return []
    return [m.span(1) for m in _CONTEXT.finditer(text) if guess_cost(m.group(1), ranks, longest) >= least]


def dictionary(docs: DataFrame, size: int = 20_000) -> dict[str, int]:
    """Ranks of the words of three letters or more that occur in most documents, ``size`` of them or a little fewer:
    all words of the highest counts, and of the count at which that would be too many those that come first by hash."""
    words = document_counts(docs).filter((F.length("term") >= 3) & (F.length("term") <= 24) & (F.col("n") > 1))
    words = staged(words, "words")
    # The counts, in steps of a hundredth, say from which count on to take words; no task sends more than it has of these.
    level = F.floor(F.log("n") * 100)
    taken, whole, crossed = 0, None, F.lit(False)
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        rest = size - taken
        if r.words > rest:
            # Of this level about a thirty-second of what is free at a time, in the order of the words' hash.
            parts = max(1, 32 * r.words // max(1, rest))
            part = F.pmod(F.xxhash64("term"), F.lit(parts))
            found = words.filter((level == r.level) & (part < 64)).groupBy(part.alias("part")).agg(F.count("*").alias("words")).orderBy("part").collect()
            at = 0
            for f in found:
                if f.words > rest:
                    break
                rest -= f.words
                at = f.part + 1
            crossed = (level == r.level) & (part < at)
            break
        whole = r.level
        taken += r.words
    top = words.filter(crossed if whole is None else (level >= whole) | crossed).collect()
    return {r.term: i + 1 for i, r in enumerate(sorted(top, key=lambda r: (-r.n, r.term)))}


_SPAN = "struct<start:int,kind:int,end:int>"


def spans(docs: DataFrame, least: float = 10.0, words: int = 20_000) -> DataFrame:
    """(doc_id, base, guesses) for each row of ``docs`` (doc_id, text): spans (start, kind, end), ordered.

    Positions are code points, ends exclusive. Null and empty texts have none. Repeated rows stay; other columns are
    ignored. No rows give no rows. The dictionary is a top list of a fixed size, so it travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, words))
    return docs.select("doc_id", "text").mapInArrow(partial(_span_batches, shared=shared, least=least), f"doc_id long, base array<{_SPAN}>, guesses array<{_SPAN}>")


def _span_batches(batches, shared, least):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    ranks = shared.value
    longest = max(map(len, ranks), default=0)
    for whole in batches:
        for batch in slices(whole):
            base, guesses = [], []
            for text in text_column(batch).to_pylist():
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in base_spans(text)])
                guesses.append([{"start": s, "kind": len(KINDS), "end": e} for s, e in guessed(text, ranks, longest, least)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(base, kind), pa.array(guesses, kind)], ["doc_id", "base", "guesses"])


def listed(spans_: Column) -> Column:
    """Spans as ``kind:start:end``, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, GUESS)])
    return F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)), ",")
