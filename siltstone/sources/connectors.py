"""Connectors: each normalises one source's raw JSON payloads into documents and edges, as projections.

A connector is a function of a DataFrame with `payload` (JSON text) and `received_at`; it returns
documents (doc_id, source_system, doc_type, source_id, source_url, title, body, author_id, updated_at,
deleted) and edges (edge_type, from_label, from_id, to_label, to_id). Payload schemas are explicit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from siltstone.expr.text import issue_references

DOCUMENT = ["doc_id", "source_system", "doc_type", "source_id", "source_url", "title", "body", "author_id", "updated_at", "deleted"]


@dataclass(frozen=True)
class Profile:
    """What ranking and admission need to know of a source."""

    source: str
    prefix: str
    priority: int = 50
    multiplier: float = 1.0
    half_life: float = 120.0


@dataclass(frozen=True)
class Connector:
    profile: Profile
    documents: Callable[[DataFrame], DataFrame]
    edges: Callable[[DataFrame], DataFrame]


REGISTRY: dict[str, Connector] = {}


def register(profile: Profile, documents: Callable, edges: Callable) -> Connector:
    """A source registers once; a different profile under its name is an error."""
    if profile.source in REGISTRY and REGISTRY[profile.source].profile != profile:
        raise ValueError(f"{profile.source} is already registered with another profile")
    REGISTRY[profile.source] = Connector(profile, documents, edges)
    return REGISTRY[profile.source]


def profiles(spark) -> DataFrame:
    """The registered profiles, a small dimension table."""
    rows = [(c.profile.source, c.profile.prefix, c.profile.priority, c.profile.multiplier, c.profile.half_life) for c in REGISTRY.values()]
    return spark.createDataFrame(rows, "source_system string, prefix string, priority int, multiplier double, half_life double")


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select("*", F.from_json("payload", schema).alias("p"))


def _document(df: DataFrame, **columns: Column) -> DataFrame:
    made = {c: columns.get(c, F.lit(None).cast("string")) for c in DOCUMENT}
    made["deleted"] = columns.get("deleted", F.lit(False))
    return df.select(*[made[c].alias(c) for c in DOCUMENT])


def _edges(df: DataFrame, *edges: tuple[str, str, Column, str, Column]) -> DataFrame:
    """One row for each edge whose ends are both there."""
    structs = [F.struct(F.lit(t).alias("edge_type"), F.lit(a).alias("from_label"), x.alias("from_id"), F.lit(b).alias("to_label"), y.alias("to_id")) for t, a, x, b, y in edges]
    return df.select(F.explode(F.array(*structs)).alias("e")).select("e.*").where("from_id is not null and to_id is not null")


def _time(value: Column) -> Column:
    return F.to_timestamp(value)


# --- chat messages -------------------------------------------------------------------------------

CHAT = """team_id string, event struct<type: string, subtype: string, channel: string, user: string, text: string, ts: string, thread_ts: string, deleted_ts: string,
message: struct<user: string, text: string, ts: string, thread_ts: string>, previous_message: struct<user: string, text: string, ts: string, thread_ts: string>>"""


def _chat(raw: DataFrame) -> DataFrame:
    """A changed or deleted message is its inner one, at the time it was received; else its own time counts."""
    p = _parsed(raw, CHAT)
    kind = F.coalesce("p.event.subtype", F.lit(""))
    changed, deleted = kind == "message_changed", kind == "message_deleted"

    def own(name: str) -> Column:
        return F.when(changed, F.col(f"p.event.message.{name}")).when(deleted, F.col(f"p.event.previous_message.{name}")).otherwise(F.col(f"p.event.{name}"))

    ts = F.coalesce(own("ts"), F.col("p.event.deleted_ts"))
    return p.select(F.col("p.team_id").alias("team"), F.col("p.event.channel").alias("channel"), own("user").alias("user"), own("text").alias("text"), ts.alias("ts"), own("thread_ts").alias("thread_ts"), deleted.alias("deleted"), (changed | deleted).alias("edited"), "received_at")


def chat_documents(raw: DataFrame) -> DataFrame:
    c, m = F.col, _chat(raw)
    at = F.when(c("edited"), c("received_at")).otherwise(F.timestamp_micros((c("ts").cast("decimal(20,6)") * 1_000_000).cast("long")))
    threaded = c("thread_ts").isNotNull() & (c("thread_ts") != c("ts"))
    return _document(m, doc_id=F.concat_ws(":", F.lit("slack"), "team", "channel", "ts"), source_system=F.lit("slack"), doc_type=F.when(threaded, "slack.thread").otherwise("slack.message"), source_id=c("ts"), source_url=F.concat(F.lit("slack://"), c("channel"), F.lit("/"), c("ts")), title=F.substring(F.split_part(c("text"), F.lit("\n"), F.lit(1)), 1, 80), body=c("text"), author_id=c("user"), updated_at=at, deleted=c("deleted"))


def chat_edges(raw: DataFrame) -> DataFrame:
    c = F.col
    m = _chat(raw).withColumn("doc", F.concat_ws(":", F.lit("slack"), "team", "channel", "ts"))
    return _edges(m, ("MEMBER_OF", "Document", c("doc"), "Document", c("channel")), ("AUTHORED", "Person", c("user"), "Document", c("doc")), ("MEMBER_OF", "Person", c("user"), "Document", c("channel")))


# --- code hosting --------------------------------------------------------------------------------

PERSON = "struct<login: string, id: bigint>"
CODE = f"""action string, number bigint, ref string, repository struct<full_name: string, html_url: string>, sender {PERSON},
pull_request struct<number: bigint, title: string, body: string, html_url: string, user: {PERSON}, updated_at: string, merged: boolean>,
issue struct<number: bigint, title: string, body: string, html_url: string, user: {PERSON}, updated_at: string>,
review struct<id: bigint, body: string, html_url: string, user: {PERSON}, submitted_at: string>,
release struct<id: bigint, tag_name: string, name: string, body: string, html_url: string, published_at: string, created_at: string, author: {PERSON}>,
comment struct<id: bigint, body: string, commit_id: string, html_url: string, user: {PERSON}, updated_at: string>,
commits array<struct<id: string, message: string, timestamp: string, url: string, author: struct<name: string, email: string, username: string>, added: array<string>, removed: array<string>, modified: array<string>>>"""


def code_documents(raw: DataFrame) -> DataFrame:
    """Pull requests, issues, reviews, releases, commit comments, and each commit of a push; a deleted one is a tombstone."""
    c = F.col
    p = _parsed(raw, CODE).withColumn("repo", c("p.repository.full_name"))
    deleted = F.coalesce(c("p.action") == "deleted", F.lit(False))

    def one(there: str, kind: str, key: Column, url: str, title: Column, body: str, author: str, at: Column) -> DataFrame:
        rows = p.where(c(there).isNotNull())
        return _document(rows, doc_id=F.concat_ws(":", F.lit("github"), c("repo"), F.lit(kind), key.cast("string")), source_system=F.lit("github"), doc_type=F.lit(f"github.{kind}"), source_id=key.cast("string"), source_url=c(url), title=title, body=c(body), author_id=c(author), updated_at=_time(at), deleted=deleted)

    pulls = one("p.pull_request", "pull_request", c("p.pull_request.number"), "p.pull_request.html_url", c("p.pull_request.title"), "p.pull_request.body", "p.pull_request.user.login", c("p.pull_request.updated_at"))
    parts = [
        pulls,
        one("p.issue", "issue", c("p.issue.number"), "p.issue.html_url", c("p.issue.title"), "p.issue.body", "p.issue.user.login", c("p.issue.updated_at")),
        one("p.review", "review", c("p.review.id"), "p.review.html_url", F.concat(F.lit("Review of #"), c("p.pull_request.number").cast("string")), "p.review.body", "p.review.user.login", c("p.review.submitted_at")),
        one("p.release", "release", c("p.release.id"), "p.release.html_url", F.coalesce("p.release.name", "p.release.tag_name"), "p.release.body", "p.release.author.login", F.coalesce("p.release.published_at", "p.release.created_at")),
        one("p.comment", "commit_comment", c("p.comment.id"), "p.comment.html_url", F.concat(F.lit("Comment on "), F.substring("p.comment.commit_id", 1, 12)), "p.comment.body", "p.comment.user.login", c("p.comment.updated_at")),
    ]
    pushed = p.select("repo", F.explode("p.commits").alias("k"))
    parts.append(_document(pushed, doc_id=F.concat_ws(":", F.lit("github"), c("repo"), F.lit("commit"), c("k.id")), source_system=F.lit("github"), doc_type=F.lit("github.commit"), source_id=c("k.id"), source_url=c("k.url"), title=F.split_part(c("k.message"), F.lit("\n"), F.lit(1)), body=c("k.message"), author_id=F.coalesce("k.author.username", "k.author.email"), updated_at=_time(c("k.timestamp"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def code_edges(raw: DataFrame) -> DataFrame:
    """Authors and the repository that each document touches; commits' files too."""
    c = F.col
    docs = code_documents(raw)
    own = docs.withColumn("repo", F.split_part("doc_id", F.lit(":"), F.lit(2)))
    files = _parsed(raw, CODE).select(c("p.repository.full_name").alias("repo"), F.explode("p.commits").alias("k"))
    files = files.select(F.concat_ws(":", F.lit("github"), c("repo"), F.lit("commit"), c("k.id")).alias("doc_id"), F.explode(F.array_distinct(F.flatten(F.transform(F.array("k.added", "k.removed", "k.modified"), lambda a: F.coalesce(a, F.array().cast("array<string>")))))).alias("file"), "repo")
    return _edges(own, ("AUTHORED", "Person", c("author_id"), "Document", c("doc_id")), ("TOUCHES", "Document", c("doc_id"), "Repo", c("repo"))).unionByName(_edges(files, ("TOUCHES", "Document", c("doc_id"), "CodeSymbol", F.concat_ws(":", "repo", "file"))))


def owners(rules: DataFrame) -> DataFrame:
    """OWNS edges of an owners file (repo, line): a pattern and its owners; comments and blank lines are skipped."""
    words = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    rows = rules.select("repo", words.alias("w")).where(F.size("w") > 1)
    return rows.select("repo", F.element_at("w", 1).alias("pattern"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("owner"))


# --- tickets -------------------------------------------------------------------------------------

TICKET = """action string, type string, createdAt string, url string, data struct<id: string, identifier: string, title: string, description: string, body: string, url: string,
creator: struct<id: string, name: string, email: string>, assignee: struct<id: string, name: string, email: string>, team: struct<id: string, key: string>, issue: struct<id: string, identifier: string>, user: struct<id: string, name: string>, updatedAt: string, state: struct<name: string>>"""


def _tickets(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, TICKET)
    comment = c("p.type") == "Comment"
    return p.select(
        F.when(comment, F.concat(F.lit("linear:comment:"), c("p.data.id"))).otherwise(F.concat(F.lit("linear:"), c("p.data.identifier"))).alias("doc_id"),
        F.when(comment, "linear.comment").otherwise("linear.issue").alias("doc_type"),
        F.coalesce("p.data.identifier", "p.data.id").alias("source_id"),
        F.coalesce("p.data.url", "p.url").alias("source_url"),
        F.coalesce("p.data.title", F.concat(F.lit("Comment on "), c("p.data.issue.identifier"))).alias("title"),
        F.coalesce("p.data.description", "p.data.body").alias("body"),
        F.coalesce("p.data.creator.id", "p.data.user.id").alias("author_id"),
        c("p.data.assignee.id").alias("assignee"),
        c("p.data.issue.identifier").alias("parent"),
        _time(F.coalesce("p.data.updatedAt", "p.createdAt")).alias("updated_at"),
        (c("p.action") == "remove").alias("deleted"),
    )


def ticket_documents(raw: DataFrame) -> DataFrame:
    t = _tickets(raw)
    return _document(t, **{k: F.col(k) for k in DOCUMENT if k != "source_system"}, source_system=F.lit("linear"))


def ticket_edges(raw: DataFrame) -> DataFrame:
    c = F.col
    t = _tickets(raw)
    plain = _edges(t, ("LINKED_FROM", "Document", c("doc_id"), "Document", F.concat(F.lit("linear:"), c("parent"))), ("AUTHORED", "Person", c("author_id"), "Document", c("doc_id")), ("ASSIGNED_TO", "Document", c("doc_id"), "Person", c("assignee")))
    named = t.select("doc_id", F.explode(issue_references(F.concat_ws(" ", "title", "body"), c("source_id"))).alias("ref"))
    return plain.unionByName(_edges(named, ("MENTIONS", "Document", c("doc_id"), "Document", F.concat(F.lit("linear:"), c("ref")))))


# --- pages, errors, incidents, meetings, declared documents --------------------------------------


def page_documents(raw: DataFrame) -> DataFrame:
    """Pages and databases of block trees of any depth: all plain texts in order, as a variant's text fields."""
    c = F.col
    p = _parsed(raw, "entity struct<id: string, type: string>, workspace_id string, data struct<last_edited_time: string, last_edited_by: struct<id: string>>, body_markdown string, title string, url string, in_trash boolean")
    found = F.regexp_extract_all("payload", F.lit(r'"plain_text"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    texts = F.concat_ws("\n", F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>"))  # JSON strings, unescaped as such
    return _document(p, doc_id=F.concat(F.lit("notion:"), c("p.entity.id")), source_system=F.lit("notion"), doc_type=F.concat(F.lit("notion."), F.coalesce("p.entity.type", F.lit("page"))), source_id=c("p.entity.id"), source_url=c("p.url"), title=F.coalesce(c("p.title"), F.split_part(texts, F.lit("\n"), F.lit(1))), body=F.coalesce(c("p.body_markdown"), texts), author_id=c("p.data.last_edited_by.id"), updated_at=_time(c("p.data.last_edited_time")), deleted=F.coalesce("p.in_trash", F.lit(False)))


def page_edges(raw: DataFrame) -> DataFrame:
    d = page_documents(raw)
    people = raw.select(F.concat(F.lit("notion:"), F.get_json_object("payload", "$.entity.id")).alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all("payload", F.lit(r'"mention"\s*:\s*\{[^{}]*"user"\s*:\s*\{[^{}]*"id"\s*:\s*"([^"]+)"'), F.lit(1)))).alias("who"))
    return _edges(d, ("AUTHORED", "Person", F.col("author_id"), "Document", F.col("doc_id"))).unionByName(_edges(people, ("MENTIONS", "Document", F.col("doc_id"), "Person", F.col("who"))))


ERROR = """action string, actor struct<id: string, type: string>, data struct<issue: struct<id: string, shortId: string, title: string, culprit: string, permalink: string, lastSeen: string, assignedTo: struct<id: string>, project: struct<id: string, slug: string>>,
event: struct<event_id: string, groupID: string, title: string, culprit: string, web_url: string, timestamp: string>>, project struct<id: string, slug: string>"""


def error_documents(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, ERROR)
    issues = _document(p.where("p.data.issue is not null"), doc_id=F.concat(F.lit("sentry:issue:"), c("p.data.issue.id")), source_system=F.lit("sentry"), doc_type=F.lit("sentry.issue"), source_id=c("p.data.issue.id"), source_url=c("p.data.issue.permalink"), title=c("p.data.issue.title"), body=F.concat_ws("\n", "p.data.issue.title", "p.data.issue.culprit"), author_id=c("p.data.issue.assignedTo.id"), updated_at=_time(c("p.data.issue.lastSeen")))
    events = _document(p.where("p.data.event is not null"), doc_id=F.concat(F.lit("sentry:event:"), c("p.data.event.event_id")), source_system=F.lit("sentry"), doc_type=F.lit("sentry.event"), source_id=c("p.data.event.event_id"), source_url=c("p.data.event.web_url"), title=c("p.data.event.title"), body=F.concat_ws("\n", "p.data.event.title", "p.data.event.culprit"), updated_at=_time(c("p.data.event.timestamp")))
    return issues.unionByName(events)


def error_edges(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, ERROR)
    issue, event = F.concat(F.lit("sentry:issue:"), c("p.data.issue.id")), F.concat(F.lit("sentry:event:"), c("p.data.event.event_id"))
    return _edges(p, ("FIRES_IN", "Document", issue, "Project", c("p.data.issue.project.slug")), ("ASSIGNED_TO", "Document", issue, "Person", c("p.data.issue.assignedTo.id")), ("FIRES_IN", "Document", event, "Project", c("p.project.slug")), ("LINKED_FROM", "Document", event, "Document", F.concat(F.lit("sentry:issue:"), c("p.data.event.groupID"))))


INCIDENT = "event struct<event_type: string, occurred_at: string, agent: struct<id: string>, data: struct<id: string, number: bigint, title: string, status: string, html_url: string, service: struct<id: string, summary: string>, content: string, incident: struct<id: string>>>"


def incident_documents(raw: DataFrame) -> DataFrame:
    """The life of an incident is one document; annotations are its notes."""
    c = F.col
    p = _parsed(raw, INCIDENT)
    note = F.col("p.event.event_type") == "incident.annotated"
    return _document(p, doc_id=F.concat(F.when(note, "pagerduty:note:").otherwise("pagerduty:incident:"), c("p.event.data.id")), source_system=F.lit("pagerduty"), doc_type=F.when(note, "pagerduty.note").otherwise("pagerduty.incident"), source_id=c("p.event.data.id"), source_url=c("p.event.data.html_url"), title=F.coalesce("p.event.data.title", F.lit("Note")), body=F.coalesce(c("p.event.data.content"), F.concat_ws(" ", "p.event.data.title", "p.event.data.status")), author_id=c("p.event.agent.id"), updated_at=_time(c("p.event.occurred_at")))


def incident_edges(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, INCIDENT)
    return _edges(p, ("FIRES_IN", "Document", F.concat(F.lit("pagerduty:incident:"), c("p.event.data.id")), "Service", c("p.event.data.service.id")), ("LINKED_FROM", "Document", F.concat(F.lit("pagerduty:note:"), c("p.event.data.id")), "Document", F.concat(F.lit("pagerduty:incident:"), c("p.event.data.incident.id"))))


MEETING = "id string, title string, notes string, url string, owner struct<email: string>, updated_at string"


def meeting_documents(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, MEETING)
    return _document(p, doc_id=F.concat(F.lit("granola:"), c("p.id")), source_system=F.lit("granola"), doc_type=F.lit("granola.meeting"), source_id=c("p.id"), source_url=c("p.url"), title=c("p.title"), body=c("p.notes"), author_id=c("p.owner.email"), updated_at=_time(c("p.updated_at")))


def meeting_edges(raw: DataFrame) -> DataFrame:
    return _edges(meeting_documents(raw), ("AUTHORED", "Person", F.col("author_id"), "Document", F.col("doc_id")))


DECLARED = """source_key string, documents array<struct<id: string, title: string, body: string, url: string, author: string, updated_at: string, deleted: boolean,
entities: array<struct<label: string, id: string>>, edges: array<struct<type: string, to_label: string, to_id: string>>>>"""


def declared_documents(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, DECLARED).select("p.source_key", F.explode("p.documents").alias("d"))
    return _document(p, doc_id=F.concat_ws(":", F.lit("custom"), "source_key", "d.id"), source_system=F.lit("custom"), doc_type=F.lit("custom.document"), source_id=c("d.id"), source_url=c("d.url"), title=c("d.title"), body=c("d.body"), author_id=c("d.author"), updated_at=_time(c("d.updated_at")), deleted=F.coalesce("d.deleted", F.lit(False)))


def declared_edges(raw: DataFrame) -> DataFrame:
    c = F.col
    p = _parsed(raw, DECLARED).select("p.source_key", F.explode("p.documents").alias("d")).withColumn("doc", F.concat_ws(":", F.lit("custom"), "source_key", "d.id"))
    author = _edges(p, ("AUTHORED", "Person", c("d.author"), "Document", c("doc")))
    touched = p.select("doc", F.explode("d.entities").alias("e")).select(F.lit("TOUCHES").alias("edge_type"), F.lit("Document").alias("from_label"), c("doc").alias("from_id"), c("e.label").alias("to_label"), c("e.id").alias("to_id"))
    own = p.select("doc", F.explode("d.edges").alias("e")).select(c("e.type").alias("edge_type"), F.lit("Document").alias("from_label"), c("doc").alias("from_id"), c("e.to_label").alias("to_label"), c("e.to_id").alias("to_id"))
    return author.unionByName(touched).unionByName(own)


def rejected(raw: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """Payloads that aren't JSON objects with documents, or are too large, with the reason."""
    parsed = F.from_json("payload", DECLARED + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    reason = F.when(F.octet_length("payload") > most_bytes, "too large").when(parsed["broken"].isNotNull(), "not JSON").when(parsed["documents"].isNull(), "no documents")
    return raw.withColumn("reason", reason).where("reason is not null")


def session_documents(turns: DataFrame) -> DataFrame:
    """A transcript (conv_id, turn, role, text) as one document, its turns in order."""
    c = F.col
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.upper(t["role"]), F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    rows = turns.groupBy("conv_id").agg(F.concat_ws("\n", ordered).alias("body"))
    return _document(rows, doc_id=F.concat(F.lit("session:"), c("conv_id").cast("string")), source_system=F.lit("agent_session"), doc_type=F.lit("session"), source_id=c("conv_id").cast("string"), title=F.substring(F.split_part("body", F.lit("\n"), F.lit(1)), 1, 80), body=c("body"), updated_at=F.lit(None).cast("timestamp"))


def upload_documents(pages: DataFrame) -> DataFrame:
    """Uploaded markup (page_id, url, html) as documents: tags, scripts and repeated white space go."""
    c = F.col
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return _document(pages, doc_id=F.concat(F.lit("upload:"), c("page_id").cast("string")), source_system=F.lit("manual_upload"), doc_type=F.lit("manual.upload"), source_id=c("page_id").cast("string"), source_url=c("url"), title=F.nullif(title, F.lit("")), body=body, updated_at=F.lit(None).cast("timestamp"))


register(Profile("slack", "slack."), chat_documents, chat_edges)
register(Profile("github", "github."), code_documents, code_edges)
register(Profile("linear", "linear."), ticket_documents, ticket_edges)
register(Profile("notion", "notion."), page_documents, page_edges)
register(Profile("sentry", "sentry."), error_documents, error_edges)
register(Profile("pagerduty", "pagerduty.", priority=100, half_life=200.0), incident_documents, incident_edges)
register(Profile("granola", "granola."), meeting_documents, meeting_edges)
register(Profile("custom", "custom.", priority=75), declared_documents, declared_edges)
