"""Names and titles by their trigrams and words, from one inverted table.

A row is a key (a gram or a word) of a text, with how many grams the text has: so the similarity of a
query's grams with all texts that share one comes from counting rows, without the texts. Only what is
left, a few rows, is looked up by id.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.text import PULL, SHA, STOPWORDS, TICKET, tokens, trigrams
from siltstone.store import literal_rows

@dataclass
class TextTables:
    """What grounding reads: entries and displays of names and of titles, and nodes by bare id."""

    name_index: DataFrame
    names: DataFrame
    bare_ids: DataFrame
    title_index: DataFrame
    titles: DataFrame


#: Folders of the tables that are looked up by id.
SHELVES = 16
#: What a text that holds all of a query's words is worth at least.
WORD_MATCH = 0.5


def entries(texts: DataFrame) -> DataFrame:
    """(customer_id, key, kind, id, label, size, seen) for each gram of `text` and each distinct word of `words`; of customer_id, id, label, text, words, seen."""
    grams = texts.select("customer_id", "id", "label", "seen", trigrams(F.col("text")).alias("keys"))
    grams = grams.select("customer_id", "id", "label", "seen", F.size("keys").alias("size"), F.lit("gram").alias("kind"), F.explode("keys").alias("key"))
    words = texts.select("customer_id", "id", "label", "seen", F.lit(0).alias("size"), F.lit("word").alias("kind"), F.explode(F.array_distinct(tokens(F.col("words")))).alias("key"))
    return grams.unionByName(words)


def _shelf(value: Column) -> Column:
    return F.pmod(F.hash(value), F.lit(SHELVES))


def displays(texts: DataFrame) -> DataFrame:
    """(customer_id, id, display) in SHELVES folders, of which a few ids read a few."""
    return texts.withColumn("shelf", _shelf(F.col("id")))


def query_grams(text: str) -> list[str]:
    """What siltstone.expr.text.trigrams gives, of a text that is at hand."""
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split(" ")
    return list(dict.fromkeys(f"  {w} "[i : i + 3] for w in words if w for i in range(len(w) + 1)))


def query_words(text: str) -> list[str]:
    """What siltstone.expr.text.tokens gives, each once."""
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9_]+", text.lower()) if len(w) >= 2))


def named_ids(text: str) -> list[str]:
    """The identifiers of siltstone.expr.text.bare_ids."""
    found = re.findall(TICKET, text, re.ASCII) + re.findall(PULL, text, re.ASCII)
    return list(dict.fromkeys(found + [s for s in re.findall(SHA, text, re.ASCII) if not any(s in f for f in found)]))


def content_words(text: str) -> list[str]:
    """The content words of siltstone.expr.text.grounding_tokens."""
    bare = (re.sub(r"^[^\w.]+|[^\w.]+$", "", t, flags=re.ASCII).lower() for t in re.split(r"\s+", text, flags=re.ASCII))
    return [t for t in bare if len(t) >= 2 and t not in STOPWORDS]


def probe(index: DataFrame, queries: list[tuple[str, list[str]]], floor: float) -> DataFrame:
    """(probe, id, label, seen, similarity, matched) of texts that reach the floor for a query or hold all of its words. A query: its text and the words asked for.

    Reads the keys of all queries once; a text's shared grams are counted from its rows.
    """
    spark = index.sparkSession
    asked = [(i, "gram", g, len(query_grams(q)), 0) for i, (q, _) in enumerate(queries) for g in query_grams(q)]
    asked += [(i, "word", w, len(query_grams(q)), len(words)) for i, (q, words) in enumerate(queries) for w in words]
    keys = sorted({k for _, _, k, _, _ in asked})
    rows = literal_rows(spark, asked, "probe int, kind string, key string, asked int, all_words int")
    read = index.where(F.col("key").isin(*keys) if keys else F.lit(False))
    near = read.join(F.broadcast(rows), ["key", "kind"])
    shared, matched = F.count_if(F.col("kind") == "gram"), F.count_if(F.col("kind") == "word")
    counted = near.groupBy("probe", "id", "label", "seen").agg(shared.alias("shared"), matched.alias("words"), F.max("size").alias("size"), F.max("asked").alias("asked"), F.max("all_words").alias("all_words"))
    similarity = F.when(F.col("shared") > 0, F.round(F.col("shared") / (F.col("size") + F.col("asked") - F.col("shared")), 6)).otherwise(0.0)
    scored = counted.select("probe", "id", "label", "seen", similarity.alias("similarity"), ((F.col("all_words") > 0) & (F.col("words") == F.col("all_words"))).alias("matched"))
    return scored.where((F.col("similarity") >= floor) | F.col("matched"))


def probe_names(index: DataFrame, names: DataFrame, queries: list[str], floor: float = 0.3, per_label: int = 5, total: int = 20, labels: tuple[str, ...] = ()) -> DataFrame:
    """(probe, label, canonical_id, name, similarity) by trigrams of names; a name that holds all of a query's words is worth WORD_MATCH at least. The best of each label, those seen last first, then the best of all."""
    found = probe(index, [(q, query_words(q)) for q in queries], floor)
    if labels:
        found = found.where(F.col("label").isin(*labels))
    worth = found.withColumn("similarity", F.when(F.col("matched"), F.greatest(F.col("similarity"), F.lit(WORD_MATCH))).otherwise(F.col("similarity")))
    order = [F.desc("similarity"), F.desc_nulls_last("seen"), F.asc("id")]
    best = worth.withColumn("rn", F.row_number().over(Window.partitionBy("probe", "label").orderBy(*order))).where(F.col("rn") <= per_label)
    few = best.withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*order))).where(F.col("place") <= total)
    return looked_up(few, names).select("probe", "label", F.col("id").alias("canonical_id"), F.col("display").alias("name"), "similarity", "place")


def probe_titles(index: DataFrame, titles: DataFrame, queries: list[str], floor: float = 0.3, cap: int = 10) -> DataFrame:
    """(probe, doc_id, title, updated_at, fts, similarity, place) of live documents by trigrams of their titles, or with all of the query's words in title and beginning."""
    found = probe(index, [(q, sorted({t.lower() for t in q.split()})) for q in queries], floor)
    order = [F.desc("fts"), F.desc("similarity"), F.desc("seen"), F.asc("id")]
    few = found.withColumnRenamed("matched", "fts").withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*order))).where(F.col("place") <= cap)
    return looked_up(few, titles).select("probe", F.col("id").alias("doc_id"), F.col("display").alias("title"), F.col("seen").alias("updated_at"), "fts", "similarity", "place")


def looked_up(few: DataFrame, shelved: DataFrame) -> DataFrame:
    """A few rows (id) with their display, from their shelves only. The rows are bounded by the caps before."""
    return shelved.select("shelf", "id", "display").join(F.broadcast(few.withColumn("shelf", _shelf(F.col("id")))), ["shelf", "id"])


def exact_ids(bare_ids: DataFrame, queries: list[str]) -> DataFrame:
    """(probe, label, canonical_id, name): nodes whose id, without its label, is an identifier that a query names."""
    asked = [(i, b) for i, q in enumerate(queries) for b in named_ids(q)]
    rows = literal_rows(bare_ids.sparkSession, asked, "probe int, bare string")
    found = bare_ids.where(F.col("bare").isin(*sorted({b for _, b in asked})) if asked else F.lit(False))
    return found.join(F.broadcast(rows), "bare").select("probe", "label", "canonical_id", "name")
