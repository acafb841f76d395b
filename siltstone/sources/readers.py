"""Scans and sinks: raw payload archive, uploads, pollers as Python data sources."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def write_raw(payloads: DataFrame, path: str) -> None:
    """Archives payloads (customer_id, source_system, payload, received_at) under their source and tenant."""
    payloads.write.mode("append").partitionBy("source_system", "customer_id").json(path)


def read_raw(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The archive with each row's file as its key; the source prunes folders."""
    schema = "payload string, received_at timestamp, source_system string, customer_id string"
    out = spark.read.schema(schema).json(path).withColumn("payload_key", F.col("_metadata.file_path"))
    return out if source is None else out.where(F.col("source_system") == source)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, text, problem): text, Markdown and DOCX; anything else is refused with its reason."""
    import pandas as pd

    @F.pandas_udf("text string, problem string")
    def parse(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_upload(n, bytes(c)) for n, c in zip(names, contents, strict=True)], columns=["text", "problem"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", parse("path", "content").alias("r")).select("path", "r.text", "r.problem")


def parse_upload(name: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, None), or (None, why it is refused). DOCX gives its paragraphs; white space at line ends and runs of blank lines go."""
    if name.lower().endswith(".docx") or content[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                xml = archive.read("word/document.xml").decode("utf-8", "replace")
        except (KeyError, zipfile.BadZipFile):
            return None, "not a document archive"
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
        text = "\n".join("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)) for p in paragraphs)
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = text.replace(entity, char)
    else:
        if b"\0" in content[:4096]:
            return None, "binary"
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = content.decode("latin-1")
            if sum(c.isprintable() or c.isspace() for c in text) < 0.95 * max(1, len(text)):
                return None, "not text"
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip(), None


class Poller:
    """Pulls one resource: a cursor counts what was pulled. latest() is how far there is something to pull; poll(cursor, most) gives
    the payloads from a cursor on, `most` at most. Offsets are cursors, so a replayed batch pulls the same again."""

    #: Payloads that one task pulls.
    page = 100

    def latest(self) -> int:
        raise NotImplementedError

    def poll(self, cursor: int, most: int) -> list[str]:
        raise NotImplementedError


POLLERS: dict[str, type[Poller]] = {}


def register_poller(name: str, poller: type[Poller]) -> None:
    POLLERS[name] = poller


class CountingPoller(Poller):
    """Ten numbered payloads, for tests and as an example."""

    page = 4

    def latest(self) -> int:
        return 10

    def poll(self, cursor: int, most: int) -> list[str]:
        return [f'{{"n": {i}}}' for i in range(cursor, min(cursor + most, self.latest()))]


register_poller("counting", CountingPoller)


class _Slice(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        super().__init__(begin)
        self.begin, self.end = begin, end


class _Pulling:
    """A range of cursors is cut into pages, each a task of its own."""

    def __init__(self, name: str) -> None:
        self.poller = POLLERS[name]()

    def slices(self, begin: int, end: int) -> list[_Slice]:
        return [_Slice(a, min(a + self.poller.page, end)) for a in range(begin, end, self.poller.page)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        cursor = partition.begin
        while cursor < partition.end:
            rows = self.poller.poll(cursor, partition.end - cursor)
            if not rows:
                return
            yield from ((row,) for row in rows)
            cursor += len(rows)


class _Stream(_Pulling, DataSourceStreamReader):
    """What is latest doesn't depend on what this run has seen; Spark keeps where the last one stopped."""

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        return {"cursor": self.poller.latest()}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        return self.slices(start["cursor"], end["cursor"])


class _Batch(_Pulling, DataSourceReader):
    def partitions(self) -> list[_Slice]:
        return self.slices(0, self.poller.latest())


class PollerSource(DataSource):
    """`spark.read.format("poller").option("poller", name)`, or readStream."""

    @classmethod
    def name(cls) -> str:
        return "poller"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["poller"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["poller"])


def due_cursors(cursors: DataFrame, now: str, seconds: int, limit: int) -> DataFrame:
    """Cursors that weren't polled for some time, the longest first."""
    return cursors.where(F.col("polled_at") < F.expr(f"timestamp'{now}' - INTERVAL {seconds} SECOND")).orderBy("polled_at", "resource_id").limit(limit)


def polled(cursors: DataFrame, now: str, seconds: int, limit: int) -> DataFrame:
    """One round of polling: (resource_id, poller, payloads, cursor, error, polled_at) of each due cursor (resource_id, poller, cursor, polled_at).

    Each due cursor is polled in a task of its own, a page at most; one that fails keeps its cursor and
    has its error, and the others go on. What advanced is a cursor table that advance_cursors takes.
    """

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for resource, name, cursor in zip(batch["resource_id"], batch["poller"], batch["cursor"], strict=True):
                try:
                    poller = pollers[name]()
                    payloads = poller.poll(int(cursor), poller.page)
                    rows.append((resource, name, payloads, int(cursor) + len(payloads), None))
                except Exception as error:
                    rows.append((resource, name, [], int(cursor), f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["resource_id", "poller", "payloads", "cursor", "error"])

    pollers = dict(POLLERS)
    numbered = F.row_number().over(Window.orderBy("polled_at", "resource_id")) - 1  # of `limit` rows at most
    due = due_cursors(cursors, now, seconds, limit).withColumn("task", numbered).repartitionById(limit, "task").select("resource_id", "poller", "cursor")
    found = due.mapInPandas(pull, "resource_id string, poller string, payloads array<string>, cursor long, error string")
    return found.withColumn("polled_at", F.lit(now).cast("timestamp"))


def connected(rows: DataFrame, tokens: DataFrame, always: tuple[str, ...] = ("custom", "manual_upload")) -> DataFrame:
    """Rows of sources with an active token; some sources need none."""
    active = tokens.where("active").select("customer_id", F.col("source").alias("source_system")).distinct()
    free = F.col("source_system").isin(*always)
    return rows.where(free).unionByName(rows.where(~free).join(active, ["customer_id", "source_system"], "left_semi"))
