"""Event search: filters, text and token predicates, paging with keys, sorts, and search documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.keys import sort_key
from vigil.functions.scalars import contains_folded, epoch_ceiling, iso

#: Columns whose text a search looks at.
SEARCHED = ("event_id", "source", "source_event_id", "actor_email", "actor_name", "department", "role", "resource_id", "resource_name", "resource_kind", "sensitivity", "verb", "category", "geo", "incident_ticket", "scenario")
#: Order of sensitivities.
SENSITIVITY_RANK = {"critical": 4, "high": 3, "internal": 2, "low": 1}


def search_text() -> Column:
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in SEARCHED))


def _entity(key: str) -> Column:
    return F.concat(F.lit("entity::"), key)


def refers(reference: str, columns: Sequence[str], key: str) -> Column:
    """Whether the reference is one of the columns, the key, or its entity id."""
    return reduce(Column.__or__, [F.col(c) == reference for c in (*columns, key)]) | (_entity(key) == reference)


def filtered(events: DataFrame, *, start=None, end=None, sources=None, categories=None, sensitivities=None, principal: str | None = None, resource: str | None = None, text: str | None = None, tokens: Sequence[str] | None = None) -> DataFrame:
    """Conjunction of the given conditions. Simple comparisons come first, so they reach the scan."""
    if start is not None:
        events = events.where(F.col("observed_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("observed_at") <= F.lit(end).cast("timestamp_ntz"))
    for column, wanted in (("source", sources), ("category", categories), ("sensitivity", sensitivities)):
        if wanted:
            events = events.where(F.col(column).isin(*wanted))
    if principal is not None:
        events = events.where(refers(principal, ["actor_email"], "principal_key"))
    if resource is not None:
        events = events.where(refers(resource, ["resource_id", "resource_name"], "resource_key"))
    if text:
        events = events.where(contains_folded(search_text(), text))
    if tokens:
        events = events.where(has_tokens(tokens))
    return events


def in_postings(events: DataFrame, *postings: DataFrame) -> DataFrame:
    """Events whose id is in all of the id lists."""
    return reduce(lambda df, ids: df.join(ids.select("event_id"), "event_id", "left_semi"), postings, events)


def by_receipt(raw: DataFrame) -> DataFrame:
    """Raw rows by the time they came in, or else happened; latest first."""
    return raw.withColumn("received", F.coalesce("received_at", "observed_at")).orderBy(F.desc("received"), "source", "source_event_id")


def has_tokens(tokens: Sequence[str]) -> Column:
    """All tokens are among the words of the searched text."""
    words = F.split(F.lower(search_text()), "[^a-z0-9_]+")
    return reduce(Column.__and__, [F.array_contains(words, t.lower()) for t in tokens])


def page(events: DataFrame, limit: int, cursor: tuple[str, str] | None = None) -> DataFrame:
    """Newest first, below the cursor (time, event id), one row more than the limit to tell whether more follow."""
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
        events = events.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("event_id") < last)))
    return events.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(limit + 1)


def within(events: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Events from ``since`` up to before ``until`` as an index sees them that holds whole seconds: both bounds are rounded up, so part of a
    second at the start is left out and at the end is in. A null bound is open. Compares times themselves, so partitions and files are pruned.
    """
    whole = lambda text: F.timestamp_seconds(epoch_ceiling(F.lit(text).cast("timestamp_ntz"))).cast("timestamp_ntz")
    events = events if since is None else events.where(F.col("observed_at") >= whole(since))
    return events if until is None else events.where(F.col("observed_at") < whole(until))


def page_by_hash(events: DataFrame, limit: int, after: tuple[str, int] | None = None) -> DataFrame:
    """Newest first, ties by a hash of the id, after (time, hash)."""
    rows = events.withColumn("tie", sort_key(F.col("event_id")))
    if after is not None:
        at = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("tie") < F.lit(str(after[1])).cast("decimal(20,0)"))))
    return rows.orderBy(F.desc("observed_at"), F.desc("tie")).limit(limit)


def sorted_by(events: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """By a column; sensitivity by its rank. Ties by event id."""
    key = F.col(column)
    if column == "sensitivity":
        key = F.lit(0)
        for name, rank in SENSITIVITY_RANK.items():
            key = F.when(F.col(column) == name, rank).otherwise(key)
    return events.orderBy(key.desc() if descending else key.asc(), F.col("event_id"))


def documents(events: DataFrame) -> DataFrame:
    """One flat search document per event."""
    return events.select("event_id", "event_key", "source", iso(F.col("observed_at")).alias("observed_at"), F.unix_seconds(F.col("observed_at").cast("timestamp")).alias("observed_epoch"), F.col("actor_email").alias("principal_id"), _entity("principal_key").alias("principal_entity_id"), "department", "resource_id", _entity("resource_key").alias("resource_entity_id"), "sensitivity", "verb", "category", search_text().alias("search_text"))


def timeline(events: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` events of every principal."""
    latest = Window.partitionBy("actor_email").orderBy(F.desc("observed_at"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= n)


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


SQL_TEXT = "concat_ws(' ', " + ", ".join(f"{c}::VARCHAR" for c in SEARCHED) + ")"
