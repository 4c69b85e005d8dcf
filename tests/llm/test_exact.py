"""What must hold exactly: equality of windows, the cheapest segmentation, products of any size, columns of any name."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from difflens.llm import ann, decontaminate, langid, pii, queries, secrets, simhash, substring
from difflens.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------- windows
def test_words_that_collide_under_every_polynomial(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicate(df).collect()}
    assert got == {1: (13, 0), 2: (13, 0), 3: (13, 13)}


# ------------------------------------------------------------------- guesses
RANKS = {"password": 1, "summer": 50, "apple": 3, "aaa": 900, "oooo": 700, "qwer": 20, "abcde": 4000, "bbb": 2}


def _cheapest(value, ranks, longest):
    """Every segment at every place, by the statement of the costs."""
    size = lambda c: 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33
    low, plain = value.lower(), value.lower().translate(str.maketrans("01345@$", "oleasas"))
    dates = [
        re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
        re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"),
        re.compile(r"(?:19|20)\d\d"),
    ]
    best = [0.0] + [math.inf] * len(value)
    for e in range(1, len(value) + 1):
        for i in range(e):
            part, costs = value[i:e], []
            if e - i == 1:
                costs.append(math.log10(size(part)))
            if e - i >= 3:
                if len(set(part)) == 1 or all(p in secrets._STEPS for p in zip(low[i:e], low[i + 1 : e])):
                    costs.append(math.log10(size(part[0])) + math.log10(e - i) + math.log10(2))
                if e - i <= longest:
                    rank = ranks.get(low[i:e], ranks.get(plain[i:e]))
                    if rank is not None:
                        costs.append(math.log10(rank * (1 if part == low[i:e] and part in ranks else 2)) + math.log10(2))
            for d in dates:
                if d.fullmatch(part):
                    costs.append(math.log10(200 * (365 if e - i > 4 else 1)) + math.log10(2))
            best[e] = min([best[e], *(best[i] + c for c in costs)])
    return best[-1]


def test_guess_cost_is_the_least_of_all_segmentations():
    rng = random.Random(4)
    pieces = [*RANKS, "P@ssword", "qwertyuiop", "1234567890", "asdf", "2019-05-01", "01021999", "1987", "zzzz", "x", "7", "-", "É", "oooooooo", "edcba", "ABCDEFG"]
    for _ in range(3000):
        value = "".join(rng.choice(pieces) * rng.choice([1, 1, 2]) if rng.random() < 0.7 else rng.choice("aob19!") * rng.randint(1, 9) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.3 and value:
            at = rng.randrange(len(value))
            value = value[at:] + value[:at]
        assert secrets.guess_cost(value, RANKS, 8) == pytest.approx(_cheapest(value, RANKS, 8), abs=1e-9), value
    assert secrets.guess_cost("qwertyuiopassword", RANKS, 8) < 3 and secrets.guess_cost("aaaaaapple", RANKS, 8) < 4


def test_guess_cost_of_long_values():
    for value in ("a" * 100_000, "1234567890" * 5_000, "ab" * 30_000):
        assert secrets.guess_cost(value, RANKS, 8) > 0
    assert secrets.guess_cost("a" * 100_000, {}, 8) == pytest.approx(math.log10(26 * 100_000 * 2))


def test_words_tied_at_the_dictionarys_limit(spark):
    rows = [(i, " ".join(f"word{j}x" for j in range(300))) for i in (1, 2)] + [(i, "often seen") for i in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.dictionary(df, size=40)
    assert 30 <= len(got) <= 40 and got["often"] == 1 and got["seen"] == 2
    assert len(secrets.dictionary(df, size=1000)) == 302 and secrets.dictionary(df.limit(0)) == {}


# ------------------------------------------------------------------- products
def _neighbours(rows, queries_, k):
    def score(a, b):
        with np.errstate(over="ignore", invalid="ignore"):
            plain = float((np.array(a) * np.array(b)).sum())
        if math.isfinite(plain):
            return plain
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b))
        return float(exact) if abs(exact) < Fraction(1.7e308) else math.inf if exact > 0 else -math.inf

    out = {}
    for q, v in rows:
        if q in queries_:
            order = sorted(((-score(v, w), i) for i, w in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in order]
    return out


@pytest.mark.parametrize("kind", ["int", "long"])
def test_vectors_of_any_size(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, [1e200 * (1 + i % 3), float(i), -1e200]) for i in range(20)]
    rows += [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-170, 150)).tolist()) for i in range(20, 50)]
    rows += [(50, [5e-324, 0.0, 0.0]), (51, [1e-310, 2e-310, 0.0]), (52, [1e308, 1e308, 1e308])]
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 5 = 0"), k=6, query_block=7, block=11).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = _neighbours(rows, {i for i, _ in rows if i % 5 == 0}, 6)
    assert set(got) == set(expected)
    for q in expected:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in expected[q]], rel=1e-12, abs=1e-322)
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]] or len({s for _, s in expected[q]}) < 6


# ------------------------------------------------------------------- columns
def test_users_columns_of_our_names_stay(spark):
    rows = [(i, t, 1, "b", "t", None, "r") for i, t in enumerate([None, "", "write to ann@example.com now", "write to ann@example.com now", "clean"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, _base string, _terms string, key long, `row` string")
    got = pii.sanitise(df)
    assert got.schema == df.schema
    assert sorted((r.doc_id, r.text or "") for r in got.collect())[2][1].startswith("write to [EMAIL]")
    assert [r.text for r in got.filter("doc_id = 0").collect()] == [None] and pii.sanitise(df.limit(0)).count() == 0


def test_one_of_each_group_of_fingerprints_stays(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(400))
    rows = [(5, long, 1), (3, long, 2), (9, long.replace("x200", "y200"), 3), (4, "other words altogether here", 4), (4, "other words altogether here", 5), (6, None, 6), (7, "", 7), (None, long, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df.filter("doc_id is not null")).collect()}
    expected = sorted([r[2] for r in rows if r[0] is None or found[r[0]] == r[0]])
    assert sorted(r.fp for r in got.collect()) == expected and {2, 4, 5, 6, 8} <= set(expected) and 1 not in expected and 7 not in expected
    assert simhash.keep_one(df.limit(0)).count() == 0


# ------------------------------------------------------------------- the pipeline
def test_pipeline_stage_by_stage(spark, sf_small):
    """Each stage on the smallest tables, against what its operator says of the same rows."""
    docs = table(spark, sf_small, "documents").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    fingerprints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    contaminated = {r.doc_id for r in decontaminate.contamination(docs, table(spark, sf_small, "benchmark")).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "tokens"]

    kept = stages["language_id"](spark, docs, sf_small)
    assert kept.columns == docs.columns
    predicted = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in predicted.items() if p != "und"}

    one = {r.doc_id for r in stages["near_dedup"](spark, docs, sf_small).collect()}
    assert one == {i for i, r in fingerprints.items() if r.component_id == i}

    clean = stages["decontamination"](spark, docs, sf_small)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(rows) - contaminated and contaminated

    safe = stages["personal_data"](spark, docs, sf_small)
    assert safe.schema == docs.schema
    for r in safe.collect():
        assert not pii.base_spans(r.text or "") or "[" in r.text
        assert r.n_chars == (None if r.text is None else len(r.text))
    texts = {r.doc_id: r.text for r in safe.collect()}
    touched = {r.doc_id for r in pii.spans(docs).filter("size(base) > 0 or size(terms) > 0").collect()}
    assert {i for i in rows if texts[i] != rows[i].text} == touched and touched

    ids = stages["tokens"](spark, docs, sf_small).collect()
    assert {r.doc_id for r in ids} == set(rows) and all(r.exact and r.n_tokens == len(r.ids) for r in ids)


def test_pipeline_end_to_end(spark, sf_small):
    out = corpus_pipeline.run(spark, sf_small)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    total = table(spark, sf_small, "documents").count()
    assert 0.5 * total < out.count() < total and out.filter("not exact").count() == 0


# ------------------------------------------------------------------- registered queries without SQL
def test_queries_return_their_contracts_columns(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_small, "documents").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op2_bpe(spark, sf_small)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    for r in got.collect():
        ids = tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))

    got = queries.op9_secrets(spark, sf_small)
    assert got.dtypes[:6] == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    for r in got.collect():
        base = secrets.base_spans(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == sha(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base))
        assert {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(filter(None, r.spans.split(",")))

    got = queries.op4_pii(spark, sf_small)
    assert got.dtypes[:7] == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")], ("base_sha256", "string"), ("spans", "string")]
    for r in got.collect():
        base = pii.base_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base))

    got = queries.op7_langid(spark, sf_small)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    truth = {r.doc_id: r.lang for r in table(spark, sf_small, "documents").collect()}
    judged = [r for r in got.collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.9 * len(judged) > 0

    vectors = table(spark, sf_small, "embeddings")
    data = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    got = queries.op1_ann(spark, sf_small)
    assert got.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    for q, ids in by.items():
        assert ids == sorted((i for i in data if i != q), key=lambda i: (-float((data[i] * data[q]).sum()), i))[:20]
    assert set(by) == {i for i in data if i % 20 == 0}

    got = queries.op3_simhash(spark, sf_small)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    values = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got.collect()}
    for i, (a, ca) in values.items():
        for j, (b, cb) in values.items():
            assert (a ^ b).bit_count() > 3 or ca == cb
    assert all(values[c][1] == c and c <= i for i, (_, c) in values.items())
