"""Periodic runs against a search that tries every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from difflens.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs int, words string, start string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _runs(w, least=6, repeats=4):
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, repeats * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "\u00a0 x\u2003y " * 9, "a b a b a b a b", "b " * 5000]
    for _ in range(120):
        k = rng.choice([1, 2, 2, 3, 6])
        w = [chr(97 + rng.randrange(k)) for _ in range(rng.randint(0, 50))]
        unit = [chr(97 + rng.randrange(k)) for _ in range(rng.randint(1, 11))] * rng.randint(2, 7)
        at = rng.randint(0, len(w))
        w[at:at] = unit[: rng.randint(1, len(unit))]
        out.append(rng.choice([" ", "\n", "\x0b\x0c"]).join(w * rng.choice([1, 1, 4])))
    long = [f"w{rng.randrange(400)}" for _ in range(30_000)]
    long[10_000:10_000] = [f"u{i}" for i in range(700)] * 5
    return [*out, " ".join(long), out[-1], out[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "w", "s") for i, t in enumerate(_texts())], SCHEMA).repartition(3).cache()


def test_runs_equal_all_periods_tried(docs):
    got = {r.doc_id: r for r in periodic.collapse(docs).collect()}
    texts = _texts()
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts[:-3] + texts[-2:]):
        i += i >= len(texts) - 3
        w = WORD.findall(text or "")
        if len(w) > 4000:
            continue
        runs = _runs(w)
        assert [tuple(r) for r in got[i].runs] == runs, text
        assert got[i].text == _kept(w, runs)
    assert [tuple(r) for r in got[8].runs] == [(0, 5000, 1)] and got[8].text == "b"
    big = got[len(texts) - 3]
    assert [tuple(r) for r in big.runs] == [(10_000, 3500, 700)] and len(big.text.split(" ")) == 30_700


@pytest.mark.parametrize("least, repeats", [(1, 4), (6, 5), (20, 4)])
def test_other_limits(least, repeats):
    rng = np.random.default_rng(least)
    for _ in range(150):
        texts = [rng.integers(0, 2, rng.integers(0, 40)) for _ in range(3)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start, length, period = periodic.find_runs(np.concatenate(texts).astype(np.int64), first, least, repeats)
        expected = [(s + first[i], n, q) for i, t in enumerate(texts) for s, n, q in _runs(t.tolist(), least, repeats)]
        assert list(zip(start, length, period)) == expected


def test_a_text_of_one_word_a_million_times_and_a_word_of_the_next_text():
    ids = np.zeros(1_000_000, dtype=np.int64)
    assert [x.tolist() for x in periodic.find_runs(ids, np.array([0, 1_000_000]))] == [[0], [1_000_000], [1]]
    assert [x.tolist() for x in periodic.find_runs(np.zeros(10, dtype=np.int64), np.array([0, 5, 10]))] == [[], [], []]
    assert [x.tolist() for x in periodic.find_runs(np.zeros(0, dtype=np.int64), np.array([0]))] == [[], [], []]


def test_limits_below_what_the_index_needs_are_refused(docs):
    with pytest.raises(ValueError):
        periodic.collapse(docs, repeats=3)


def test_empty_table(spark):
    assert periodic.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def _expected_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = _runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, _sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), _sha(_kept(w, runs)))


def test_query_on_a_fixture(spark, tmp_path, docs):
    kept = docs.filter("text is null or length(text) < 5000")
    kept.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic(spark, str(tmp_path))
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
        ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    expected = {r.doc_id: _expected_row(r.doc_id, r.text) for r in kept.collect()}
    assert {r.doc_id: tuple(r) for r in got.collect()} == expected


def test_query_on_the_given_table(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").filter("length(text) < 9000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic(spark, sf_small).collect()}
    assert sum(got[r.doc_id][1] > 0 for r in rows) > 5
    for r in rows:
        assert got[r.doc_id] == _expected_row(r.doc_id, r.text)
