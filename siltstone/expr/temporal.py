"""Temporal predicates over versioned rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Temporal:
    """mode: LATEST, AS_OF (at), CHANGED_BETWEEN (since, until; basis source or ingest) or ALL."""

    mode: str = "LATEST"
    at: str | None = None
    since: str | None = None
    until: str | None = None
    basis: str = "source"


def document_predicate(spec: Temporal) -> Column:
    """LATEST: still valid. AS_OF: valid_from <= t < valid_to. CHANGED_BETWEEN: the basis in [since, until), still valid."""
    live = F.col("valid_to").isNull()
    if spec.mode == "ALL":
        return F.lit(True)
    if spec.mode == "LATEST":
        return live
    if spec.mode == "AS_OF":
        return _holds_at(spec.at)
    if spec.mode == "CHANGED_BETWEEN":
        basis = F.col("updated_at" if spec.basis == "source" else "ingested_at")
        return (basis >= F.lit(spec.since).cast("timestamp")) & (basis < F.lit(spec.until).cast("timestamp")) & live
    raise ValueError(f"unknown temporal mode: {spec.mode}")


def chunk_predicate(spec: Temporal) -> Column:
    if spec.mode == "ALL":
        return F.lit(True)
    return _holds_at(spec.at) if spec.mode == "AS_OF" else F.col("valid_to").isNull()


def _holds_at(at: str | None) -> Column:
    t = F.lit(at).cast("timestamp")
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def resolve(symbolic: dict | None, now: datetime) -> tuple[Temporal | None, str | None]:
    """A relative or absolute time frame as a CHANGED_BETWEEN; (None, reason) where it has none.

    Ends are {"rel": offset in days} or {"abs": ISO time}; a missing start is 1970, a missing end is now.
    """
    if not symbolic:
        return None, None
    if symbolic.get("unresolvable_anchor"):
        return None, f"no date is known for the event '{symbolic['unresolvable_anchor']}'"

    def end(value: dict | None) -> datetime | None:
        if not value:
            return None
        if value.get("rel") is not None:
            return now + timedelta(days=float(value["rel"]))
        if value.get("abs"):
            at = datetime.fromisoformat(value["abs"].replace("Z", "+00:00"))
            return at if at.tzinfo else at.replace(tzinfo=UTC)
        return None

    since, until = end(symbolic.get("since")), end(symbolic.get("until"))
    if since is None and until is None:
        return None, None
    since, until = since or datetime(1970, 1, 1, tzinfo=UTC), until or now
    if until <= since:
        return None, "the end isn't after the start"
    basis = symbolic.get("basis")
    return Temporal("CHANGED_BETWEEN", since=since.isoformat(), until=until.isoformat(), basis=basis if basis in ("source", "ingest") else "source"), None
