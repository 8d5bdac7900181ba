"""The `opN_<name>` queries, each a thin reading of its operator's result, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, htmltext, langid, mixing, neardup, quality, search, secrets, sharding


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from `labels` outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document, and whether the document stands for it."""
    return neardup.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit with the next one, and their likenesses."""
    return fingerprint.fingerprints(_documents(spark, sf_dir))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards by balanced label propagation, law `rows`."""
    out = sharding.assign(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for the whole text of every document whose id is divisible by 20."""
    return search.top_k(_documents(spark, sf_dir).select("doc_id", "text"), F.col("doc_id") % 20 == 0)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base patterns, and all spans."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = secrets.scan(docs, secrets.train(docs)).select("doc_id", "spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = joined(F.filter("spans", lambda x: x["kind"] != "cnn"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def word_vocabulary() -> bpe.Vocabulary:
    """The public word-end vocabulary of 49,408 ids."""
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    vocabulary = word_vocabulary()
    ids = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), vocabulary, keep_text=False)
    out = bpe.decode(ids, vocabulary)
    digits = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from `lang` outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the capped mix of sources."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return htmltext.extract_pages(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op1_quality": op1_quality, "op2_near_duplicates": op2_near_duplicates, "op3_fingerprint": op3_fingerprint, "op4_shard": op4_shard, "op5_search": op5_search, "op6_secrets": op6_secrets, "op7_bpe": op7_bpe, "op8_language": op8_language, "op9_mix": op9_mix, "op10_html": op10_html}
SQL = {"op9_mix": mixing.SQL}
