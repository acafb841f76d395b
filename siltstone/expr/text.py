"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers.
TOKEN = "[A-Za-z0-9_]+"
TICKET = r"\b([A-Z]{2,10}-\d+)\b"
PULL = r"(?i)(?:#|\b(?:pr|issue)\s*[-#.]?\s*)(\d{1,6})\b"
SHA = r"\b([0-9a-f]{7,40})\b"
ID_SHAPES = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[A-Z][A-Z0-9]*-\d+$", r"^[A-Za-z0-9_.\-/]+#\d+$", r"(?i)^[0-9a-f]{12,40}$")

# Words that a grounding query leaves out.
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "i", "if", "in", "is", "it",
    "its", "me", "no", "not", "of", "on", "or", "our", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they",
    "this", "those", "to", "us", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you",
    "show", "find", "list", "get", "give", "tell", "fetch", "search", "look", "want", "need", "please", "can",
)

# Words that introduce an identifier.
INTRODUCTIONS = ("agent", "session", "ticket", "issue", "pr", "prs", "pull", "commit", "sha")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscores, of `least` characters at least."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= least)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two spaces before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all trigrams of two texts, by their trigram arrays."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def grounding_tokens(query: Column) -> Column:
    """White-space pieces without punctuation at their ends (dots stay), lower-cased, of two characters at least, stopwords left out."""
    bare = F.transform(F.split(query, r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[^\w.]+|[^\w.]+$", "")))
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def bare_ids(query: Column) -> Column:
    """Tickets, pull requests and commit hashes that a text names, as array of (kind, id); a hash inside an id already found is left out."""
    tickets = F.transform(F.regexp_extract_all(query, F.lit(TICKET), F.lit(1)), lambda x: F.struct(F.lit("ticket").alias("kind"), x.alias("id")))
    pulls = F.transform(F.regexp_extract_all(query, F.lit(PULL), F.lit(1)), lambda x: F.struct(F.lit("pr").alias("kind"), x.alias("id")))
    found = F.concat(tickets, pulls)
    fresh = F.filter(F.array_distinct(F.regexp_extract_all(query, F.lit(SHA), F.lit(1))), lambda s: ~F.exists(found, lambda f: F.contains(f["id"], s)))
    return F.concat(found, F.transform(fresh, lambda x: F.struct(F.lit("commit_sha").alias("kind"), x.alias("id"))))


def has_id_shape(value: Column) -> Column:
    """A UUID, a ticket key, repo#number or 12 to 40 hexadecimal digits."""
    shapes = [value.rlike(p) for p in ID_SHAPES]
    out = shapes[0]
    for shape in shapes[1:]:
        out = out | shape
    return F.coalesce(out, F.lit(False))


def residual(query: Column, ids: Column) -> Column:
    """What a query says beyond its identifiers (array) and the words that introduce them; null if that is nothing. Without identifiers: the query."""
    named = F.concat(F.regexp_extract_all(F.lower(F.array_join(ids, " ")), F.lit("[a-z0-9_]+"), F.lit(0)), F.array(*map(F.lit, INTRODUCTIONS)))
    rest = F.array_join(F.filter(F.regexp_extract_all(query, F.lit(TOKEN), F.lit(0)), lambda w: (F.length(w) > 1) & ~F.array_contains(named, F.lower(w))), " ")
    return F.nullif(F.when(F.size(ids) > 0, rest).otherwise(query), F.lit(""))


def hash_vector(text: Column, dimensions: int) -> Column:
    """A unit vector from hashes of a text, one for each component: stands in where there is no model."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda i: F.xxhash64(F.coalesce(text, F.lit("")), i) / F.lit(float(1 << 63)))
    norm = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x * x))
    return F.transform(parts, lambda x: x / norm)


def within_bytes(text: Column, most: int) -> Column:
    """The longest beginning of whole characters that fits a number of bytes."""
    raw = text.cast("binary")

    def inside(place: int) -> Column:
        """Whether the byte at a place (from 1) goes on with a character."""
        byte = F.hex(F.substring(raw, place, 1)) if place > 0 else F.lit("00")
        return byte.between("80", "BF")

    kept = F.lit(max(0, most - 3))
    for back in (2, 1, 0):
        kept = F.when(~inside(most + 1 - back), max(0, most - back)).otherwise(kept)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), kept).cast("string"))


def clean_citations(answer: Column) -> Column:
    """`[1, 2]` and `[ 1 ]` become `[1][2]` and `[1]`; repeats side by side are one."""
    apart = F.regexp_replace(answer, r"(?<=\[[0-9\s,]{0,200}[0-9])\s*,\s*(?=[0-9][0-9\s,]*\])", "][")
    return F.regexp_replace(F.regexp_replace(apart, r"\[\s*([0-9]+)\s*\]", "[$1]"), r"(\[[0-9]+\])(?:\s*\1)+", "$1")


def short_reason(why: Column) -> Column:
    """A reason of 200 characters at most."""
    return F.substring(why, 1, 200)


def without_namespace(value: Column) -> Column:
    """Lower-cased, without what stands before the last slash."""
    return F.regexp_replace(F.lower(value), "^.*/", "")


def without_opaque_ids(url: Column) -> Column:
    return F.regexp_replace(url, "/commit/[0-9a-f]{40}", "/commit/")


def issue_references(text: Column, own: Column) -> Column:
    """Ticket keys that a text names, each once, in order, but for its own."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(TICKET), F.lit(1))), F.array(own))


def known_author(author: Column) -> Column:
    """The sentinel `unknown` is no author."""
    return F.nullif(author, F.lit("unknown"))


def entity_kind(doc_id: Column) -> Column:
    return F.split_part(doc_id, F.lit(":"), F.lit(2))


def metadata_text(title: Column, source: Column, doc_id: Column, author: Column, url: Column, body: Column) -> Column:
    """`key: value` lines of what identifies a document; missing ones are left out."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))

    return F.concat_ws("\n", line("title", title), line("source", source), line("id", doc_id), line("author", author), line("url", without_opaque_ids(url)), line("preview", F.substring(F.split_part(body, F.lit("\n"), F.lit(1)), 1, 200)))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.coalesce(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.nullif(F.length(term), F.lit(0))).cast("long"), F.lit(0))


def repo_variants(full_name: Column) -> Column:
    """Spellings of a repository's name: as it is, snake, camel, Pascal, upper snake, and with its owner."""
    name = F.regexp_replace(full_name, "^.*/", "")
    parts = F.filter(F.split(name, "[-_.]+"), lambda s: s != "")
    capital = F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1_000_000))))
    camel = F.concat(F.element_at(parts, 1), F.array_join(F.slice(capital, 2, 1_000), ""))
    many = F.array(name, F.array_join(parts, "_"), camel, F.array_join(capital, ""), F.array_join(F.transform(parts, F.upper), "_"), full_name)
    return F.array_distinct(F.when(F.size(parts) > 1, many).otherwise(F.array(name, full_name)))
