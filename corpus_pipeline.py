"""A corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and all rows that the stage before kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from siltstone.llm import language_id, toxicity
from siltstone.llm.common import Scratch, table
from siltstone.llm.packing import pack_documents
from siltstone.llm.passage_dedup import without_repeats
from siltstone.llm.queries import byte_bpe_encoding
from siltstone.llm.similar_texts import one_of_each_group

#: A text stays if the largest marginals of its words have this mean at least (figures in the README).
LEAST_CERTAINTY = 0.7

#: No stage has an SQL form; the tests hold the pipeline against a plain version of each.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents that aren't held out; texts that score 0.5 or more go. Null and empty texts stay."""
    return toxicity.clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter go, and those whose words are labelled with less than LEAST_CERTAINTY; a clean text in several languages stays."""
    return language_id.known_languages(docs, language_id.fit(*language_id.training_sample(docs)), LEAST_CERTAINTY)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more on five-word shingles one row stays: that of least doc_id, those without one last.

    Candidates come from SimHash fingerprints by the byte-position index with count filtering, as in op10, and from MinHash bands, which find what is too far apart for that; each group's similarities are exact.
    """
    return one_of_each_group(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; bytes of characters cut in two go as well, and documents of which nothing but white space is left."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token lengths of whole texts, packed into sequences of the permitted lengths."""
    return pack_documents(docs, byte_bpe_encoding())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("packing", pack_into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        docs = scratch.write(made)
    return docs
