"""Training-data pipeline over `documents`: each stage works on all that the one before kept.

Language identification drops what it rejects; of each component of near-duplicates
one document stays; secrets are replaced by a mark; sources are mixed to target
weights, by repeating or leaving out whole documents; and what remains is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.llm import bpe, langid, mixing, neardup, secrets
from lumendex.llm.queries import word_vocabulary
from lumendex.runtime import saved, unused


def _around(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *added: str) -> DataFrame:
    """What `operator` makes of `docs`, in the columns of `docs`: own columns named as those it adds are put aside, and given back."""
    clash = [c for c in docs.columns if c.lower() in added]
    aside = dict(zip(clash, unused([*docs.columns, *added], *clash), strict=True))
    made = operator(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    return made.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty ones among them) or whose language is not recognised.

    Whole texts are read, however long; repeated rows and ties fare alike; an empty
    table stays empty; columns named like the operator's are kept.
    """
    model = langid.train(docs)
    return _around(docs, lambda d: langid.predict(d, model).filter(~F.col("rejected")), "lang_pred", "lang_score", "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component, the one of least doc_id.

    Null and wordless texts and rows without a doc_id all stay; rows equal in doc_id
    and text are one; an empty table stays empty; other columns may have any names.
    """
    return neardup.deduplicate(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text; n_chars follows.

    Null and empty texts stay as they are; overlapping spans are one mark; repeated
    rows fare alike; an empty table stays empty; columns named like the operator's are kept.
    """
    model = secrets.train(docs)

    def hide(d: DataFrame) -> DataFrame:
        changed = secrets.scan(d, model).withColumn("text", F.col("redacted"))
        if "n_chars" in d.columns:
            size = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
            changed = changed.withColumn("n_chars", size)
        return changed

    return _around(docs, hide, "spans", "redacted")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents, or leave them out, so that sources come to their targets.

    Null sources are one source; null and empty texts weigh nothing and repeat as
    their source does; rows of equal doc_id share their decision; an empty table
    stays empty; columns named like the operator's are kept.
    """
    return _around(docs, lambda d: mixing.expand(mixing.mix(d)), "size", "source_size", "target", "repeats", "taken")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (none for null and empty texts), and the text they decode to.

    Repeated rows are encoded each; an empty table stays empty; columns named ids,
    decoded or n_tokens are replaced, the text is left out, others are kept.
    """
    vocabulary = word_vocabulary()
    ids = saved(bpe.encode(docs, vocabulary, keep_text=False), "pipeline-ids")  # else both steps' workers run side by side
    return bpe.decode(ids, vocabulary).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learnt models and the tokenizer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
