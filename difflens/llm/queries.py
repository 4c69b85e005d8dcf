"""Registered queries of the thirteen operators: each over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.llm import ann, bpe, decontaminate, htmltext, langid, periodic, pii, secrets, sharding, simhash, substring, urlfilter, whitening
from difflens.llm.common import table

#: The vocabulary of the BPE query.
VOCABULARY = "byte_bpe_50k.json"


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only here: the other queries do without

    path = public_tokenizers.path(VOCABULARY)
    tokens = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=3, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    none = F.array().cast("array<struct<start:int,end:int,gone:boolean>>")
    counts = [_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base"), none), 256).alias("base_sha256"), pii.listed(F.col("base"), F.col("terms")).alias("spans"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.deduplicate(table(spark, sf_dir, "documents"), k=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(table(spark, sf_dir, "documents"))
    counts = [_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)]
    every = secrets.listed(F.concat("base", "guesses"))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, components=16))


def op12_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(table(spark, sf_dir, "pages"), urlfilter.RULES)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts whose runs the query reports. In a tenth of the documents, chosen by a checksum of the id,
    the words from some place on repeat a few words; where and how many the checksum says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))  # null for a null id, whose text stays as it is
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("a", F.expr("g % nullif(size(words), 0)"))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(with_periodic_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(ended, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_ann, op2_bpe, op3_simhash, op4_pii, op5_sharding, op6_html, op7_langid, op8_substring, op9_secrets, op10_decontamination, op11_whitening, op12_urlfilter, op13_periodic, pipeline)
}

#: SQL for what SQL can express; the other queries are tested against brute force, the public library or held-out rows.
SQL = {"op8_substring": substring.SQL, "op10_decontamination": decontaminate.SQL}
