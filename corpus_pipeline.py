"""A training corpus from ``documents``: five stages, each over all that the last one kept.

``documents`` has doc_id, text and lang; other columns pass through whatever their names
are, ``n_chars`` too where there is one.  Null and empty texts, and those without a letter,
have no language and go in the first stage; very long texts are read whole by all of them.
Rows without an id, and several of one id, are rows of their own; of equal texts one row
stays.  An empty table stays empty.  The last stage replaces columns named as its results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm import bpe, decontaminate, jaccard, langid, pii
from lucidgraph.llm.frames import free_name, stored

#: A document is rejected when its language has no larger share of the likelihood.
LEAST_SCORE = 0.5
#: Or when no larger share of its words is known, as in a language or script not learned.
LEAST_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, undecided ones and those
    of mostly unknown words go."""
    labelled = docs.where(~langid.held_out()).select("text", "lang")
    names = [free_name(docs, name) for name in ("lang_pred", "score", "known")]
    scored = langid.predict(docs, langid.train(labelled), "text", *names)
    found, score, known = (F.col(name) for name in names)
    kept = (found != langid.UNKNOWN) & (score > LEAST_SCORE) & (known > LEAST_KNOWN)
    return scored.where(kept).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each component of similar texts; of equal or no ids, one row."""
    row = free_name(docs, "row")
    # in the order of ids, so that it does not matter how the files lie
    order = ["doc_id", F.xxhash64("text")]
    sorted_ = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(sorted_.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.join(numbered.select(F.col(row).alias("doc_id"), "text"))
    members = found.select(F.col("doc_id").alias(row), "component_id").join(
        numbered.select(row, F.col("doc_id").alias("id")), row
    )
    # rows without an id come last
    order = F.struct(F.col("id").isNull(), "id", row)
    kept = members.where("component_id is not null").groupBy("component_id").agg(F.min(order)[row].alias("kept"))
    gone = members.join(kept, "component_id").where(F.col(row) != F.col("kept")).select(row)
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each span of personal data; ``n_chars`` follows."""
    base, spans = free_name(docs, "base"), free_name(docs, "spans")
    found = pii.find(docs, pii.fit(docs), base=base, spans=spans)
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.length("text").cast("long"))
        masked = masked.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return masked.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    pieces = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = docs.drop("ids", "n_tokens", "round_trip")
    encoded = bpe.encode(docs, pieces, public_tokenizers.PATTERN)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select(
        *(c for c in docs.columns if c != "text"),
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (bpe.decoded(F.col("ids"), pieces) == whole).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: Language likelihoods and token merges have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
