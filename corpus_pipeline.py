"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all that the one before has kept. Its result is written as Parquet in the shared folder and read
again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from causeway.llm import jaccard, packing, pii, quality, toxicity
from causeway.llm.common import materialize, read_table


def good_quality(spark, docs, sf_dir):
    """Documents that the ordinal model grades 1 or more with probability 1/2."""
    return quality.select(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def not_toxic(spark, docs, sf_dir):
    """Documents that the language models do not predict as toxic."""
    return toxicity.select(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def no_near_copies(spark, docs, sf_dir):
    """Of each group that shingle similarity of 0.75 links, the document with the least id."""
    return jaccard.one_of_each(docs)


def no_personal_data(spark, docs, sf_dir):
    """Documents with every span of personal data replaced by its kind; n_chars follows the text."""
    from pyspark.sql import functions as F

    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_copies", no_near_copies), ("personal_data", no_personal_data), ("packing", packed)]
#: SQL expresses none of the models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply every stage to the documents table.

    Null texts are empty ones for every stage; repeated ids are rows of their own until near copies, which keep one row of
    an id; a row with a null id is kept by the filters, meets no other row, and is packed. An empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
