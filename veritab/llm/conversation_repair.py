"""Conversation structure repair by weighted finite-state composition (operator 11).

Three machines are composed lazily: the input acceptor of a conversation's rows, the transducer of edits (Keep, Rerole,
Delete, Insert) and the acceptor of the role grammar `(s?(ua)+)?`. A state of the composition is (row, inserts since the last
row, grammar state); only states that are reached are ever made. Weights are (cost, label string) under lexicographic
order; the best one of each state is found in topological order, rows first, then inserts. Three inserts in a row would come
back to a grammar state at a cost, so the edit machine allows two. Of two equally dear paths over the same rows neither
label string begins the other, as what follows could only be inserts, which cost; so the order of prefixes is that of whole
strings, and a path's best continuation doesn't depend on how it got there.

Rows are dealt by ranges of conversation, turn, role and the text's first characters, so a conversation of any size is
spread over tasks, and a task reads its rows once, in order. A conversation inside one range is done there. For the two at a
range's ends the task gives their rows and, for each grammar state at entry, the best weight of each state at exit: these
are multiplied in order, as matrices of the same semiring, and the messages are then written row by row. No task holds more
than the rows of one conversation inside a range, however long a conversation is; its labels alone stay together.

Defined results: a null role or text is one space; an empty role, or one that begins with another letter than s, u or a,
cannot be kept; equal turns stand in the order of role and text, equal rows beside each other; null turns come first; a null
conversation is one conversation; an empty table has no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm._common import discard, materialise, table

SPACE = " \t\n\v\f\r"
NAMES = {"u": "user", "a": "assistant"}
#: The role grammar: state -> {role initial: next state}. "" is the start, other states are the last initial.
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FINAL = ("", "a")
INSERT, REROLE, DELETE, UNTRIMMED = 2, 2, 3, 1
MOST_INSERTS = 2
#: Rows after which labels are put by, so that no string grows with the conversation.
BLOCK = 256
#: Characters of a text that ranges are cut by.
RANGE_CHARS = 32
FAULTS = ("", "blank", "duplicate", "truncated")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Weight = tuple[int, int, str]


def fault_of(text: str, repeated: bool) -> int:
    """The row's first fault as an index of FAULTS."""
    bare = text.rstrip(SPACE)
    return 1 if not bare else 2 if repeated else 3 if bare[-1] not in ".!?" else 0


def insertions(weights: dict[str, Weight]) -> dict[str, Weight]:
    """Best weights after up to MOST_INSERTS inserted messages."""
    best, layer = dict(weights), weights
    for _ in range(MOST_INSERTS):
        made: dict[str, Weight] = {}
        for state, (cost, rank, label) in layer.items():
            for initial, after in GRAMMAR[state].items():
                if initial in NAMES:
                    new = (cost + INSERT, rank, label + "I")
                    if after not in made or new < made[after]:
                        made[after] = new
        for state, weight in made.items():
            if state not in best or weight < best[state]:
                best[state] = weight
        layer = made
    return best


def consumed(weights: dict[str, Weight], initial: str, fault: int) -> dict[str, Weight]:
    """Best weights after one more row."""
    best: dict[str, Weight] = {}

    def offer(state: str, weight: Weight) -> None:
        if state not in best or weight < best[state]:
            best[state] = weight

    more = UNTRIMMED if fault == 3 else 0
    for state, (cost, rank, label) in insertions(weights).items():
        offer(state, (cost + DELETE, rank, label + "D"))
        if fault not in (1, 2):
            for letter, after in GRAMMAR[state].items():
                if letter == initial:
                    offer(after, (cost + more, rank, label + "K"))
                elif letter in NAMES:
                    offer(after, (cost + more + REROLE, rank, label + "R"))
    return best


class Paths:
    """Best paths from one grammar state over the rows seen so far.

    A weight is (cost, rank of its put-by label among those of all states, label since): where costs are equal, the whole
    labels are ordered as (rank, label since)."""

    def __init__(self, start: str):
        self.weights: dict[str, Weight] = {start: (0, 0, "")}
        self.chain: list[list[tuple[int, str]]] = []
        self.rows = 0

    def add(self, initial: str, fault: int) -> None:
        self.weights = consumed(self.weights, initial, fault)
        self.rows += 1
        if self.rows % BLOCK == 0:
            ranked = sorted({w[1:] for w in self.weights.values()})
            self.chain.append(ranked)
            self.weights = {q: (w[0], ranked.index(w[1:]), "") for q, w in self.weights.items()}

    def _whole(self, rank: int, label: str) -> str:
        parts = [label]
        for ranked in reversed(self.chain):
            rank, part = ranked[rank]
            parts.append(part)
        return "".join(reversed(parts))

    def exits(self) -> dict[str, tuple[int, str]]:
        """(cost, label) by the grammar state after the last row."""
        return {q: (cost, self._whole(rank, label)) for q, (cost, rank, label) in self.weights.items()}

    def best(self) -> tuple[int, str]:
        """(cost, label) of the best path that the grammar accepts."""
        cost, rank, label = min(w for q, w in insertions(self.weights).items() if q in FINAL)
        return cost, self._whole(rank, label)


def followed(paths: dict[str, tuple[int, str]], table: dict[str, dict[str, list]]) -> dict[str, tuple[int, str]]:
    """paths times the matrix of the rows that come next."""
    best: dict[str, tuple[int, str]] = {}
    for state, (cost, label) in paths.items():
        for after, (more, further) in table[state].items():
            new = (cost + more, label + further)
            if after not in best or new < best[after]:
                best[after] = new
    return best


def accepted(paths: dict[str, tuple[int, str]]) -> tuple[int, str]:
    last = insertions({q: (cost, 0, label) for q, (cost, label) in paths.items()})
    cost, _, label = min(w for q, w in last.items() if q in FINAL)
    return cost, label


def messages(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a conversation's rows under its edits."""
    state = ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        letter = role[:1] if edit == "K" else "a" if state == "u" else "u"
        state = GRAMMAR[state][letter]
        yield (role if edit == "K" else NAMES[letter]), text


class Part:
    """What a stretch of a conversation's rows adds up to."""

    def __init__(self, starts: tuple[str, ...]):
        self.paths = {q: Paths(q) for q in starts}
        self.counts = dict.fromkeys(FAULTS[1:], 0)
        self.turns = [None, None, 0]
        self.ends: list[str | None] = [None, None]
        self.illegal = self.rows = 0
        self.last: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, before: bool) -> int:
        """The row's fault. before: an earlier turn has the same role and text."""
        fault = fault_of(text, before or self.last == (role, text, turn))
        self.last = (role, text, turn)
        if fault:
            self.counts[FAULTS[fault]] += 1
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if self.rows:
            self.illegal += illegal(self.ends[1], role[:1])
        self.ends = [self.ends[0] if self.rows else role[:1], role[:1]]
        self.rows += 1
        for paths in self.paths.values():
            paths.add(role[:1], fault)
        return fault

    def summary(self) -> dict:
        return {"rows": self.rows, "counts": self.counts, "turns": self.turns, "ends": self.ends, "illegal": self.illegal, "paths": {q: p.exits() for q, p in self.paths.items()}}


def illegal(left: str, right: str) -> bool:
    return left + right not in ("su", "ua", "au") or not left


def counts_of(parts: list[dict]) -> dict:
    """Counts, cost and audit of a conversation from the summaries of its parts in order."""
    total = dict.fromkeys(COUNTS, 0)
    paths: dict[str, tuple[int, str]] = {"": (0, "")}
    lowest = highest = last = None
    distinct = 0
    for part in parts:
        if not part["rows"]:
            continue
        for name, n in part["counts"].items():
            total[name] += n
        total["illegal"] += part["illegal"] + (last is not None and illegal(last, part["ends"][0]))
        last = part["ends"][1]
        low, high, n = part["turns"]
        if n:
            distinct += n - (low == highest)
            lowest, highest = low if lowest is None else lowest, high
        paths = followed(paths, part["paths"])
    total["gaps"] = highest - lowest + 1 - distinct if distinct else 0
    total["cost"], audit = accepted(paths)
    return total | {"audit": audit}


def digest(repaired: Iterator[tuple[str, str]]) -> str:
    """SHA-256 of `role:text` joined by line feeds, message by message."""
    whole, behind = hashlib.sha256(), b""
    for role, text in repaired:
        whole.update(behind + f"{role}:{text}".encode())
        behind = b"\n"
    return whole.hexdigest()


def as_list(repaired: Iterator[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in repaired]


MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def repairs(rows: DataFrame, fold: Callable[[Iterator[tuple[str, str]]], object] = as_list, kind: T.DataType = MESSAGES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation.

    rows: (conv_id, turn, role, text), and there: false for a row that only says that its conversation exists. fold: what
    becomes of the stream of a conversation's repaired (role, text), a value of the Spark type `kind`; the messages
    themselves by default."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "there")
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull(), "turn")
    # Roles and texts that stand at several turns of a conversation: seen earlier in all but the first of them.
    spread = rows.where("there").groupBy("conv_id", same.alias("same")).agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final")
    known = materialise(spread.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first"))
    met = rows.withColumn("same", same).join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    dealt = met.select("conv_id", "turn", "role", "text", "there", F.coalesce(place > F.col("first"), F.lit(False)).alias("before"))
    dealt = dealt.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", *COUNTS, "audit", "repaired"]
    id_type, value_type = to_arrow_type(rows.schema["conv_id"].dataType), to_arrow_type(kind)
    types = [id_type, *[pa.int64()] * len(COUNTS), pa.string(), value_type]
    done_type = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired", kind)])
    open_type = T.StructType([*done_type, T.StructField("part", T.LongType()), T.StructField("summary", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    open_names = [*names, "part", "summary", "role", "text"]
    open_types = [*types, pa.int64(), pa.string(), pa.string(), pa.string()]

    def written(lines: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in lines], t) for c, t in zip(names, types, strict=True)], names=names)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                yield from zip(*(c.to_pylist() for c in batch.slice(start, BLOCK).columns), strict=True)

    def result(conv, found: dict, texts: Iterator[tuple[str, str]]) -> dict:
        return {"conv_id": conv, **found, "repaired": fold(messages(found["audit"], texts))}

    def in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        lines: list[dict] = []
        part, conv, held, first = None, None, [], True

        def opened() -> Iterator[dict]:
            yield {"conv_id": conv, "part": number, "summary": json.dumps(part.summary())}
            for role, text in held:
                yield {"conv_id": conv, "part": number, "role": role, "text": text}

        for new, turn, role, text, there, before in in_order(batches):
            if part is None or new != conv:
                if part is not None:
                    lines += opened() if first else [result(conv, counts_of([part.summary()]), iter(held))]
                    first = False
                conv, held, part = new, [], Part(tuple(GRAMMAR) if part is None else ("",))
            if there:
                part.add(turn, role, text, before)
                if first:
                    lines.append({"conv_id": conv, "part": number, "role": role, "text": text})
                else:
                    held.append((role, text))
            if len(lines) >= BLOCK:
                yield written(lines, open_names, open_types)
                lines = []
        if part is not None:
            lines += opened()
        yield written(lines, open_names, open_types)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations one after another: summaries by part, then rows by part and place."""
        stream = in_order(batches)
        line = next(stream, None)
        lines: list[dict] = []
        while line is not None:
            conv, parts = line[0], []
            while line is not None and line[0] == conv and line[1] is not None:
                parts.append(json.loads(line[1]))
                line = next(stream, None)

            def texts() -> Iterator[tuple[str, str]]:
                nonlocal line
                while line is not None and line[0] == conv:
                    yield line[2], line[3]
                    line = next(stream, None)

            rest = texts()
            lines.append(result(conv, counts_of(parts), rest))
            for _ in rest:  # deleted rows at the end
                pass
            if len(lines) >= BLOCK:
                yield written(lines, names, types)
                lines = []
        if lines:
            yield written(lines, names, types)

    # Rows of a part are written in order; a number within the part keeps that order in the next shuffle.
    first = materialise(dealt.mapInArrow(in_range, open_type).withColumn("at", F.monotonically_increasing_id()))
    discard(known)
    edges = first.where("part IS NOT NULL").select("conv_id", "summary", "role", "text", "part", "at")
    ordered = edges.repartition("conv_id").sortWithinPartitions("conv_id", F.col("summary").isNull(), "part", "at")
    rest = ordered.select("conv_id", "summary", "role", "text").mapInArrow(across, done_type)
    return first.where("part IS NULL").select(*names).unionAll(rest)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): each row damaged by the crc32 of `conv_id:turn`, modulo 20."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy")).drop("copy")


def op11_repair_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repairs(damaged(table(spark, sf_dir, "conversations")), digest, T.StringType())
    return found.withColumnRenamed("repaired", "repaired_sha256")
