"""Saved items and their upkeep as tables: pins, boards, briefings, the answer cache, investigations and the audit log.

Every function takes and gives DataFrames, so a store is whatever table its caller keeps them in; each item is a row."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.plans.execute import within
from veritab.plans.guard import guard
from veritab.plans.wholes import whole_digest

#: How many of each are kept or shown.
PINS, CACHED = 20, 64
#: Seconds after which a briefing is due again, by its schedule; a manual one never is.
SCHEDULES = {"daily": 86_400, "weekly": 604_800}
GENESIS = "0" * 64
BRIEFING_ORDER = ("changed", "stale", "gone", "primed", "same", "unchecked")


def admit(pins: DataFrame, most: int = PINS) -> DataFrame:
    """The first `most` pins by created, with pin ids that follow from title and statement."""
    order = Window.partitionBy("owner").orderBy("created", "title")
    kept = pins.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("pin", F.concat(F.lit("pin-"), F.substring(F.sha1(F.concat_ws("\u0000", "title", "statement")), 1, 12)))


def newest_runs(runs: DataFrame) -> DataFrame:
    """One run of each (pin, created): the latest by `at` where runs have it, and of several at one time the failed one, then the
    one of the greatest digest."""
    time = [F.col("at")] if "at" in runs.columns else []
    last = F.max(F.struct(*time, F.col("failed").alias("failed"), F.col("digest").alias("digest"))).alias("r")
    return runs.groupBy("pin", "created").agg(last).select("pin", "created", "r.digest", "r.failed")


def rechecked(pins: DataFrame, runs: DataFrame) -> DataFrame:
    """(pin, state, digest): pins (pin, created, digest) after runs (pin, created, digest, failed).

    A first run primes, a failed one makes stale, and one with another digest is a change. A run of a pin that was made anew
    meanwhile (another `created`), and of one that is gone, counts for nothing."""
    seen = pins.select("pin", "created", F.col("digest").alias("_last")).join(newest_runs(runs).select("pin", "created", F.col("digest").alias("_now"), "failed"), ["pin", "created"], "left")
    state = F.when(F.col("failed").isNull(), "unchecked").when(F.col("failed"), "stale").when(F.col("_last").isNull(), "primed").when(F.col("_last") == F.col("_now"), "same").otherwise("changed")
    return seen.select("pin", state.alias("state"), F.when(F.col("failed") | F.col("_now").isNull(), F.col("_last")).otherwise(F.col("_now")).alias("digest"))


def board_cards(cards: DataFrame, pins: DataFrame) -> DataFrame:
    """(board, position, pin, title, gone): a board's cards in order; a card whose pin was removed stays as a tombstone."""
    out = cards.join(pins.select("pin", "title"), "pin", "left")
    return out.select("board", "position", "pin", "title", F.col("title").isNull().alias("gone"))


def due(briefings: DataFrame, now: Column) -> DataFrame:
    """Briefings (name, schedule, last_run) whose time has come: never run, or run longer ago than their schedule says."""
    seconds = F.coalesce(*[F.when(F.col("schedule") == k, F.lit(v)) for k, v in SCHEDULES.items()])
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_run")
    return briefings.where(seconds.isNotNull() & (F.col("last_run").isNull() | (waited >= seconds)))


def answer_key(question: Column, *parts: Column) -> Column:
    """SHA-256 of a normalised question and of all that its answer rests on; lists are sorted first."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower(question)), r"\s+", " "), r"[?!. ]+$", "")
    return F.sha2(F.concat_ws("\u0000", plain, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def candidate_digest(files: DataFrame) -> DataFrame:
    """One row (digest): tells of any change of the files (id, modified) that an answer may use, whatever their order."""
    each = files.select(F.sha2(F.concat_ws("\u0000", "id", F.col("modified").cast("string")), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"))


def cached(entries: DataFrame, most: int = CACHED) -> DataFrame:
    """The `most` entries that were used last."""
    return entries.orderBy(F.desc("used"), "key").limit(most)


def members(items: DataFrame, scopes: DataFrame) -> DataFrame:
    """(investigation, item): items (item, file) that rest on a file of the investigation's scope (investigation, file)."""
    return items.join(scopes, "file").select("investigation", "item").distinct()


def egress(calls: DataFrame) -> DataFrame:
    """(host, purpose, calls, last): what left for where, and when last."""
    return calls.groupBy("host", "purpose").agg(F.count("*").alias("calls"), F.max("at").alias("last"))


def hosts_since(calls: DataFrame, since: Column) -> DataFrame:
    """Hosts that were first called after a time."""
    return calls.groupBy("host").agg(F.min("at").alias("first")).where(F.col("first") > since).select("host")


def usage(statements: DataFrame, certified: DataFrame, least: int = 2) -> DataFrame:
    """(expression, entity, n, certified): how often each metric is used, from (expression, entity); those used `least` times
    and the certified ones."""
    counts = statements.groupBy("expression", "entity").agg(F.count("*").alias("n"))
    known = certified.select("expression", "entity").distinct().withColumn("certified", F.lit(True))
    out = counts.join(known, ["expression", "entity"], "left").withColumn("certified", F.coalesce("certified", F.lit(False)))
    return out.where(F.col("certified") | (F.col("n") >= least))


def link(key: str, before: str, payload: str) -> str:
    """HMAC-SHA256 of a record and of the link before it."""
    return hmac.new(key.encode(), f"{before}\u0000{payload}".encode(), hashlib.sha256).hexdigest()


def link_column(key: str, before: Column, payload: Column) -> Column:
    """`link` for columns: two rounds of SHA-256 under the key's pads."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.sha2(F.concat(pad(0x36), F.encode(F.concat(before, F.lit("\u0000"), payload), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def appended(log: DataFrame, records: list[dict], key: str) -> DataFrame:
    """(seq, payload, before, link): the log with a few records more, each chained to the one before. Only the last link is read."""
    last = log.orderBy(F.desc("seq")).select("seq", "link").head()
    seq, before = (last["seq"], last["link"]) if last else (0, GENESIS)
    rows = []
    for record in records:
        payload = json.dumps(record, sort_keys=True, ensure_ascii=False)
        seq, after = seq + 1, link(key, before, payload)
        rows.append((seq, payload, before, after))
        before = after
    return log.unionByName(log.sparkSession.createDataFrame(rows, "seq long, payload string, before string, link string"))


def chained(records: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., seq, payload, before, link): a log for each group of (by..., at, payload), chained in the order of at. Each log is
    one fold, so this is for logs of the size that one month or one conversation has."""
    whole = records.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("r"))
    start = F.struct(F.lit(GENESIS).alias("last"), F.array().cast("array<struct<payload:string,before:string,link:string>>").alias("out"))

    def put(state: Column, x: Column) -> Column:
        after = link_column(key, state["last"], x["payload"])
        return F.struct(after.alias("last"), F.concat(state["out"], F.array(F.struct(x["payload"].alias("payload"), state["last"].alias("before"), after.alias("link")))).alias("out"))

    folded = whole.select(*by, F.posexplode(F.aggregate("r", start, put)["out"]).alias("at", "x"))
    return folded.select(*by, (F.col("at") + 1).cast("long").alias("seq"), "x.payload", "x.before", "x.link")


def verified(log: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by..., records, broken): how many records a log has, and the first seq that stands twice, was changed or does not follow
    from the one before; null if all do. A log that lacks its end is known by its number of records alone.

    Each seq is grouped first and meets its forerunner by an equi-join, so a log is checked in parallel, whatever its
    length, and a repeated record multiplies nothing. by: the columns that tell logs apart."""
    by = by or []
    one = log.groupBy(*by, "seq").agg(F.count("*").alias("n"), F.min(F.struct("before", "payload", "link")).alias("r"))
    former = one.select(*by, (F.col("seq") + 1).alias("seq"), F.col("r.link").alias("_former"))
    both = one.join(former, [*by, "seq"], "left")
    own = F.coalesce(link_column(key, F.col("r.before"), F.col("r.payload")) == F.col("r.link"), F.lit(False))
    follows = F.coalesce(F.col("r.before") == F.when(F.col("seq") == 1, GENESIS).otherwise(F.col("_former")), F.lit(False))
    return both.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.min(F.when(~(own & follows & (F.col("n") == 1)), F.col("seq"))).alias("broken"))


# Many saved statements at once.


def refreshed(spark: SparkSession, pins: DataFrame, tables: list[str], now: Column, seconds: float = 60.0) -> DataFrame:
    """(pin, created, digest, rows, failed, at): a run of each of a board's pins (pin, created, statement), at most `PINS` for each
    owner as `admit` keeps them.

    Each statement passes the guard. Its whole result is digested where its rows are; all digests come in one job a
    statement, three numbers each. A statement that is refused, fails or takes too long is a failed run."""
    runs = []
    for r in pins.select("pin", "created", "statement").collect():
        try:
            guard(spark, r["statement"], tables)
            rows, digest = within(spark, seconds, lambda s=r["statement"]: whole_digest(spark.sql(s)))
            runs.append((r["pin"], r["created"], digest, rows, False))
        except Exception:
            runs.append((r["pin"], r["created"], None, None, True))
    kind = pins.schema["created"].dataType.simpleString()
    return spark.createDataFrame(runs, f"pin string, created {kind}, digest string, rows long, failed boolean").withColumn("at", now)


def advanced(pins: DataFrame, runs: DataFrame) -> DataFrame:
    """The pins with their new digests: only a pin that still is the one that was run takes it (compare `created`, then set); a
    failed run changes nothing."""
    done = newest_runs(runs).where(~F.col("failed")).select("pin", "created", F.col("digest").alias("_new"))
    return pins.join(done, ["pin", "created"], "left").withColumn("digest", F.coalesce("_new", "digest")).drop("_new").select(*pins.columns)


def board_refresh(cards: DataFrame, pins: DataFrame, runs: DataFrame) -> DataFrame:
    """(board, position, pin, title, state): a board's cards after a refresh; gone where the pin is."""
    states = rechecked(pins, runs).select("pin", "state")
    shown = board_cards(cards, pins).join(states, "pin", "left")
    return shown.select("board", "position", "pin", "title", F.when(F.col("gone"), "gone").otherwise(F.coalesce("state", F.lit("unchecked"))).alias("state"))


def briefing_text(name: str, cards: DataFrame, most: int = PINS) -> str:
    """A briefing in Markdown: what changed first, then what failed, then the rest, each in the board's order."""
    order = F.array_position(F.array(*map(F.lit, BRIEFING_ORDER)), F.col("state"))
    rows = cards.orderBy(order, "position", "pin").limit(most).collect()
    changed = sum(r["state"] == "changed" for r in rows)
    lines = [f"# {name}", "", f"{changed} of {len(rows)} changed."] + [""] * bool(rows)
    return "\n".join([*lines, *[f"- {r['title'] or r['pin']}: {r['state']}" for r in rows]])
