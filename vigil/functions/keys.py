"""Deterministic keys and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column | str) -> Column:
    """The parts with bars between them, nulls as empty text."""
    return F.concat_ws("|", *(F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit("")) for p in parts))


def stable_key(prefix: str, *parts: Column | str) -> Column:
    """Prefix, underscore and the first 24 hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined(*parts), 256), 1, 24))


def event_key(source: Column, source_event_id: Column, integration: Column | None = None) -> Column:
    return stable_key("evk", source, integration if integration is not None else F.lit(""), source_event_id)


def entity_key(kind: str, source: Column, native_id: Column, provider: Column) -> Column:
    return stable_key("enk", F.lit(kind), source, provider, native_id)


def semantic_key(source: Column, actor: Column, event_type: Column, resource: Column, observed: Column) -> Column:
    """What makes two raw events the same event, whatever their ids."""
    return joined(source, actor, event_type, resource, observed)


def detection_id(event_id: Column, scenario: Column) -> Column:
    return F.concat(F.lit("det-"), F.substring(F.sha2(F.concat_ws(":", event_id, scenario), 256), 1, 12))


def idempotency_key(*parts: Column | str) -> Column:
    """Key of a collected page: its parts with colons between them."""
    return F.concat_ws(":", *parts)


def sort_key(text: Column) -> Column:
    """The first 8 bytes of the SHA-256 as an unsigned number, for paging through ties."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
