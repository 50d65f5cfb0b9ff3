"""Investigations: a name, a scope of files, a policy and conversations. What belongs to one is derived by joins, never copied.

A store is four tables: investigations (id, name, created, archived, local_only), scopes (id, file), talks (id, conversation), and
whatever items carry an investigation's id. All functions take and give DataFrames."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.plans.guard import Refused


def new_id(name: str, created: int) -> str:
    return f"inv-{hashlib.sha1(f'{name}{chr(0)}{created}'.encode()).hexdigest()[:12]}"


def created(store: DataFrame, name: str, at: int, local_only: bool = False) -> tuple[DataFrame, str]:
    """(the store with one more, its id). Names are trimmed, not empty, and unique whatever their case, archived ones too."""
    name = name.strip()
    if not name:
        raise Refused("an investigation needs a name")
    if not store.where(F.lower(F.trim("name")) == name.lower()).isEmpty():
        raise Refused(f"{name} is in use")
    own = new_id(name, at)
    return store.unionByName(store.sparkSession.createDataFrame([(own, name, at, False, local_only)], "id string, name string, created long, archived boolean, local_only boolean")), own


def archived(store: DataFrame, own: str, away: bool = True) -> DataFrame:
    """The store with one put away, or taken back; asking inside an archived one goes on as before."""
    return store.withColumn("archived", F.when(F.col("id") == own, F.lit(away)).otherwise(F.col("archived")))


def forked(store: DataFrame, scopes: DataFrame, talks: DataFrame, parent: str, name: str, at: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(store, scopes, talks, id) with a new line that begins with the parent's scope, policy and conversations; its pins and notes
    stay the parent's."""
    found = store.where(F.col("id") == parent).select("local_only").first()
    if found is None:
        raise Refused("there is no such investigation")
    more, own = created(store, name, at, found["local_only"])
    copy = lambda df, c: df.unionByName(df.where(F.col("id") == parent).select(F.lit(own).alias("id"), c).distinct())
    return more, copy(scopes, "file"), copy(talks, "conversation"), own


def resolved(asks: DataFrame, store: DataFrame, scopes: DataFrame) -> DataFrame:
    """(ask, files, local_only) of asks (ask, investigation, files): the files that a question names itself, else its
    investigation's scope; none means all files. An investigation that is not in the store changes nothing."""
    whole = scopes.groupBy("id").agg(F.sort_array(F.collect_set("file")).alias("_scope"))
    known = store.select("id", F.col("local_only").alias("_local")).join(whole, "id", "left")
    both = asks.join(known, asks.investigation == known.id, "left")
    kind = asks.schema["files"].dataType.simpleString()
    own = F.when(F.size(F.coalesce("files", F.array().cast(kind))) > 0, F.col("files"))
    return both.select("ask", F.coalesce(own, "_scope", F.array().cast(kind)).alias("files"), F.coalesce("_local", F.lit(False)).alias("local_only"))


def exported(own: str, store: DataFrame, scopes: DataFrame, talks: DataFrame, pins: DataFrame, notes: DataFrame, titles: dict[str, str] | None = None) -> str:
    """An investigation in Markdown: its state, scope, conversations by title where one is known, pins and notes by name; never the
    text of a conversation. pins: (id, title); notes: (id, name)."""
    found = store.where(F.col("id") == own).first()
    if found is None:
        raise Refused("there is no such investigation")
    column = lambda df, c: [r[0] for r in df.where(F.col("id") == own).select(c).distinct().orderBy(c).collect()]
    at = datetime.fromtimestamp(found["created"] / 1000, UTC).strftime("%Y-%m-%d %H:%M UTC")
    named = [f"{(titles or {})[c]} ({c})" if (titles or {}).get(c) else c for c in column(talks, "conversation")]
    lines = [f"# {found['name']}", "", f"- Created: {at}", f"- Status: {'Archived' if found['archived'] else 'Active'}", f"- Provider policy: {'local-only' if found['local_only'] else 'default'}"]
    for title, items, none in (("Scope", column(scopes, "file"), "- Whole vault"), ("Conversations", named, "_No conversations._"), ("Pins", column(pins, "title"), "_No pins._"), ("Notes", column(notes, "name"), "_No notes._")):
        lines += ["", f"## {title}", "", *([f"- {x}" for x in items] or [none])]
    return "\n".join(lines) + "\n"
