"""Personal data and the terms that give it away: information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. All other words of a text that holds one
are terms that may reveal it. How strongly a term reveals an entity is estimated on the whole corpus: the pointwise
mutual information of both, over the information content of the entity,

    log(N * n(entity, term) / (n(entity) * n(term))) / log(N / n(entity)),

all counts being numbers of different texts. 1 means that the term identifies the entity. A pair that one text alone
shows is weak evidence: for it the share n(entity, term) / n(entity) is estimated as if the entity stood in ``prior``
more texts in which the term is as frequent as elsewhere. So an entity of a single text is revealed by words that
(nearly) no other text has. Terms from ``generalise`` on are replaced by their form, terms from ``remove`` on are
removed, wherever they stand in a text that holds the entity.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from difflens.llm.common import slices, staged, text_column
from difflens.llm.decontaminate import bitmap, in_bitmap
from difflens.llm.terms import EDGES, document_counts

#: Kinds of base spans in the order of their listing; the added kind comes last.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest local part before it (not reaching into the previous match) and a domain after it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)
            at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """Dotted chains of numbers are consumed four by four; a quadruple counts if all parts are at most 255."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, end))
            start = end + 1
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts twice, by its digit sum."""
    value = [int(d) for d in reversed(digits)]
    return (sum(value[::2]) + sum(sum(divmod(2 * d, 10)) for d in value[1::2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base spans, by start and then kind."""
    spans = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        spans += [(s, 1, e) for s, e in ips(text)] + [(s, 2, e) for s, e in cards(text)]
        if "+" in text:
            spans += [(s, 3, e) for s, e in phones(text)]
    return sorted(spans)


def words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) for the words of a text outside of its base spans."""
    covered = bytearray(len(text))
    for start, _, end in spans:
        covered[start:end] = b"\1" * (end - start)
    out = []
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        token = m.group()
        if covered.find(1, s, e) < 0 and (word := token.strip(EDGES)):
            s += len(token) - len(token.lstrip(EDGES))
            out.append((word.lower(), s, s + len(word)))
    return out


_SPAN = "struct<start:int,kind:int,end:int>"
_WORD = "struct<term:string,start:int,end:int>"
_FOUND = f"key long, same long, doc_id long, spans array<{_SPAN}>, entities array<string>, words array<{_WORD}>"


def _key() -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))


def _same() -> Column:
    """Is the same for copies of a text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def find(docs: DataFrame) -> DataFrame:
    """(key, same, doc_id, spans, entities, words) for each row: base spans, what they name, and the other words of a text that has some."""
    return docs.select(_key().alias("key"), _same().alias("same"), "doc_id", "text").mapInArrow(_find_batches, _FOUND)


def _find_batches(batches):
    types = {"spans": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), "words": pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))}
    for whole in batches:
        for batch in slices(whole, 1 << 18):
            spans, entities, other = [], [], []
            for text in text_column(batch).to_pylist():
                found = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                entities.append(sorted({f"{KINDS[k]}:{text[s:e].lower()}" for s, k, e in found}))
                other.append([{"term": t, "start": s, "end": e} for t, s, e in words(text, found)] if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("same"), batch.column("doc_id").cast(pa.int64()), pa.array(spans, types["spans"]), pa.array(entities, pa.list_(pa.string())), pa.array(other, types["words"])],
                ["key", "same", "doc_id", "spans", "entities", "words"],
            )


def text_counts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, n): the number of different texts with the word.

    Texts without a copy are counted where they are. Only texts whose hash falls into the bitmap of those with copies
    are brought together, so that one of each is counted.
    """
    copies = found.groupBy("same").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("same").alias("hash"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(copies))
    marked = docs.select(_same().alias("same"), F.coalesce("text", F.lit("")).alias("text"))
    alone, dealt = (marked.mapInArrow(partial(_choose_batches, shared=shared, copied=c), marked.schema) for c in (False, True))
    one = dealt.groupBy("same").agg(F.first("text").alias("text"))
    return document_counts(alone).unionByName(document_counts(one)).groupBy("term").agg(F.sum("n").alias("n"))


def _choose_batches(batches, shared, copied):
    for batch in batches:
        chosen = in_bitmap(shared.value, batch.column("same").to_numpy().view(np.uint64)) == copied
        yield batch.filter(pa.array(chosen))


def disclosing(docs: DataFrame, found: DataFrame, generalise: float = 0.8, remove: float = 0.95, prior: float = 2.0) -> DataFrame:
    """(key, start, end, gone): the words of ``found`` that disclose an entity of their text, and whether they are to go."""
    total = F.lit(float(found.select("same").distinct().count()))
    some = found.filter(F.size("spans") > 0)
    holds = some.select("same", F.explode("entities").alias("entity")).distinct()
    holds = staged(holds.join(holds.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity"), "entities")
    # A term of more texts than the entity reveals at most log(N / n(term)) / log(N / n(entity)).
    may = (F.col("n_term") <= F.col("n_entity")) | (F.log(total / F.col("n_term")) >= (generalise - 1e-9) * F.log(total / F.col("n_entity")))
    most = holds.groupBy("same").agg(F.max("n_entity").alias("n_entity"))
    terms = some.select("same", F.explode("words.term").alias("term")).distinct().join(text_counts(docs, found).withColumnRenamed("n", "n_term"), "term")
    terms = terms.join(most, "same").filter(may).drop("n_entity")
    pairs = staged(terms.join(holds, "same").filter(may), "pairs")
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    share = F.when(F.col("n_both") > 1, F.col("n_both") / F.col("n_entity")).otherwise((F.col("n_both") + prior * F.col("n_term") / total) / (F.col("n_entity") + prior))
    gain = F.log(total * share / F.col("n_term")) / F.log(total / F.col("n_entity"))
    strong = joint.withColumn("strength", F.when(F.col("n_entity") < total, gain).otherwise(0.0)).filter(F.col("strength") >= generalise)
    strong = strong.select("entity", "term", (F.col("strength") >= remove).alias("gone"))
    strong = pairs.select("same", "entity", "term").join(strong, ["entity", "term"]).groupBy("same", "term").agg(F.max("gone").alias("gone"))
    places = some.select("key", "same", F.explode("words").alias("w")).select("key", "same", "w.*")
    return places.join(strong, ["same", "term"]).groupBy("key", "start", "end").agg(F.max("gone").alias("gone"))


def spans(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, prior: float = 2.0) -> DataFrame:
    """(key, doc_id, base, terms) for each row of ``docs`` (doc_id, text).

    ``base``: the base spans by start and then kind; ``terms``: the disclosing words, with ``gone`` where they are to be
    removed. Positions are code points, ends exclusive. Null and empty texts have neither. Repeated rows stay; copies of
    a text count as one text; other columns are ignored. No rows give no rows.
    """
    found = staged(find(docs), "found")
    terms = disclosing(docs, found, generalise, remove, prior)
    terms = terms.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "gone"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,gone:boolean>>")
    return found.select("key", "doc_id", F.col("spans").alias("base")).join(terms, "key", "left").withColumn("terms", F.coalesce("terms", none))


def listed(base: Column, terms: Column) -> Column:
    """Base spans and terms as ``kind:start:end``, by start and then kind, joined by commas."""
    own = F.transform(terms, lambda t: F.struct(t.start.alias("start"), F.lit(len(KINDS)).alias("kind"), t.end.alias("end")))
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(F.array_sort(F.concat(base, own)), lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with texts in which base spans are replaced by their kind and disclosing words generalised or removed.

    Overlapping spans are replaced together, by the name of the first. A generalised word keeps its form only: letters
    become ``x``, digits ``0``. Null texts stay null. All rows and columns stay, whatever the columns' names; no rows give
    no rows.
    """
    found = spans(docs.select("doc_id", "text"), **options).filter((F.size("base") > 0) | (F.size("terms") > 0))
    found = staged(found.select("key", "base", "terms").dropDuplicates(["key"]), "replaced")
    # The user's columns travel as one, so that theirs and ours can't clash.
    marked = docs.select(_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(found, "key", "left")
    return marked.select("row", "base", "terms").mapInArrow(_replace_batches, T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def _replace_batches(batches):
    for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
        row, base, terms = (batch.column(i) for i in range(3))
        names = [row.type.field(i).name for i in range(row.type.num_fields)]
        columns = dict(zip(names, row.flatten()))
        rows = pc.indices_nonzero(base.is_valid())
        if len(rows):
            texts = columns["text"].to_pylist()
            for i, b, t in zip(rows.to_pylist(), base.take(rows).to_pylist(), terms.take(rows).to_pylist()):
                if texts[i] is not None:
                    texts[i] = replaced(texts[i], [(x["start"], x["kind"], x["end"]) for x in b], [(x["start"], x["end"], x["gone"]) for x in t])
            columns["text"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(columns.values()), names)], ["row"])


def replaced(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """``text`` with base spans (start, kind, end) and words (start, end, gone) replaced."""
    edits = sorted([(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base] + [(s, e, "" if gone else _form(text[s:e])) for s, e, gone in terms])
    out, at = [], 0
    for start, end, new in edits:
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join(out) + text[at:]


def _form(word: str) -> str:
    return "".join("0" if c.isdigit() else "x" if c.isalpha() else c for c in word)
