"""The functions as operators over grouped or whole columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType
from siltstone.functions import chunking
from siltstone.model.vocabulary import CHUNK_OVERLAP


def reconstructed(chunks: DataFrame, overlap: int = CHUNK_OVERLAP, separator: str = "\n\n") -> DataFrame:
    """(doc_id, text, lines) of each document from its live chunks in order.

    Two neighbours overlap if the last `overlap` tokens of one are the first of the next, all of them; a
    shorter agreement is chance, and the texts are set apart. A document is one row, as it was before.
    """
    live = chunks.where("valid_to is null").select("doc_id", "chunk_id", "chunk_index", "content")
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    tokens = live.withColumn("tokens", F.split("content", " ")).withColumn("before", F.lag("tokens").over(order))
    shared = (F.size("before") >= overlap) & (F.size("tokens") >= overlap) & (F.slice("before", -overlap, overlap) == F.slice("tokens", 1, overlap))
    rest = F.slice("tokens", overlap + 1, F.greatest(F.size("tokens") - overlap, F.lit(0)))
    joined = F.when(F.size(rest) > 0, F.concat(F.lit(" "), F.array_join(rest, " "))).otherwise("")
    piece = F.when(F.col("before").isNull(), F.col("content")).when(shared, joined).otherwise(F.concat(F.lit(separator), "content"))
    placed = tokens.select("doc_id", F.struct("chunk_index", "chunk_id", piece.alias("piece")).alias("p"))
    whole = placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"))
    return whole.withColumn("lines", (F.regexp_count("text", F.lit("\n")) + 1).cast("long"))


def segmented(sessions: DataFrame, budget: int) -> DataFrame:
    """(conv_id, segment, first_turn, turns, left_out): one group is one session; left_out counts the earlier turns that no segment has."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("turn")
        turns = [(r, t or "", False) for r, t in zip(ordered["role"], ordered["text"], strict=True)]
        segments, _ = chunking.segment_session(turns, budget)
        numbers = ordered["turn"].tolist()
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]] * len(segments), "segment": range(len(segments)), "first_turn": [numbers[s[0]] for s in segments], "turns": [len(s) for s in segments], "left_out": len(turns) - sum(map(len, segments))})

    return sessions.groupBy("conv_id").applyInPandas(cut, "conv_id long, segment long, first_turn long, turns long, left_out long")


def rendered(sessions: DataFrame) -> DataFrame:
    """(conv_id, turn, text, begin, first_line): each turn as it stands in its session's transcript, `ROLE: text` and a line end, and where. A missing text is empty."""
    text = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    shown = sessions.select("conv_id", "turn", text.alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return shown.select("conv_id", "turn", "text", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("begin"), (1 + F.coalesce(F.sum(lines).over(before), F.lit(0))).cast("long").alias("first_line"))


@F.pandas_udf(IntegerType())
def longest_border(previous: pd.Series, current: pd.Series) -> pd.Series:
    """The longest end of one text that is the beginning of the other; 0 where one is missing."""
    return pd.Series([(chunking.border_lengths(a, b) or [0])[0] if a and b else 0 for a, b in zip(previous, current, strict=True)], dtype="int32")


@F.pandas_udf(StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """A cut-off JSON value with what is open closed, as JSON; null where that isn't enough."""
    found = [None if t is None else chunking.repair_json(t) for t in text]
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in found], dtype=object)


def budgeted(hits: DataFrame, target: int, hard: int) -> DataFrame:
    """(response, rank, content) of each response's hits (response, rank, content) cut to a size in bytes as JSON: the longest contents are halved from the last hit on down to `target`, then last hits go down to `hard`. A response is one group, of as many hits as a search returns."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [{"rank": int(r), "content": c} for r, c in zip(pdf["rank"], pdf["content"], strict=True)]
        kept = chunking.fit_response(sorted(items, key=lambda i: i["rank"]), target, hard)
        return pd.DataFrame({"response": [pdf["response"].iloc[0]] * len(kept), "rank": [i["rank"] for i in kept], "content": [i["content"] for i in kept]})

    kind = hits.schema["response"].dataType.simpleString()
    return hits.groupBy("response").applyInPandas(fit, f"response {kind}, rank long, content string")


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, embedding, failed) of (id, text), embedded a batch at a time in each task. A batch that fails is halved until the texts that can't be embedded stand alone; those are marked, with no vector. A missing text is one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), batch):
                part = frame.iloc[begin : begin + batch]
                known = [i for i, t in enumerate(part["text"]) if t is not None]
                done, _ = chunking.bisect_batches([part["text"].iloc[i] for i in known], embed)
                vectors: list = [None] * len(part)
                for place, vector in done.items():
                    vectors[known[place]] = vector
                yield pd.DataFrame({"id": part["id"], "embedding": vectors, "failed": [v is None for v in vectors]})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<double>, failed boolean")


def split_symbols(symbols: DataFrame, most_tokens: int) -> DataFrame:
    """(symbol, piece, text) of (symbol, body): a symbol's body as pieces of so many tokens, each under its header."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, i, t) for s, body in zip(frame["symbol"], frame["body"], strict=True) for i, t in enumerate(chunking.split_symbol(body or "", f"# {s}", f"# {s} (more)", most_tokens))]
            yield pd.DataFrame(rows, columns=["symbol", "piece", "text"])

    return symbols.select("symbol", "body").mapInPandas(cut, "symbol string, piece int, text string")
