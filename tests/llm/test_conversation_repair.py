"""Operator 11 against an exhaustive search over edits that follows the contract word by word."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veritab.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def searched(rows):
    """What the contract asks for one conversation's damaged rows, by best-first search over whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        kept = NOT_SPACE.findall(text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] if a[1] and b[1] else "" for a, b in zip(rows, rows[1:])]
    counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    counts["illegal"] = sum(p not in ("su", "ua", "au") for p in pairs)
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done, best = [(0, "", 0, "", ())], [], None
    seen_states = set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        if (audit, initials) in seen_states:
            continue
        seen_states.add((audit, initials))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = cost
            done.append((audit, out))
            continue
        steps = [("I", 2, i, x, (x_name, "")) for x, x_name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 3, i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    steps.append(("K", more, i + 1, role[:1], (role, text)))
                steps += [("R", 2 + more, i + 1, x, (x_name, text)) for x, x_name in (("u", "user"), ("a", "assistant"))]
        for edit, more, j, x, message in steps:
            if re.fullmatch("s?(ua)*u?", initials + x):
                heapq.heappush(heap, (cost + more, audit + edit, j, initials + x, out + ((message,) if message else ())))
    audit, out = min(done)
    said = "\n".join(f"{r}:{t}" for r, t in out)
    return counts | {"cost": best, "audit": audit, "repaired": out, "sha": hashlib.sha256(said.encode()).hexdigest()}


def random_rows(seed, conversations, most):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ape"]
    texts = ["One.", "Two!", "three", " \t\n", "", None, "Four?\x0b ", "five .\x0c", "six\xa0", "Say.\n\n"]
    return [(c, r.choice([t, t, t, None, t + 2]), r.choice(roles), r.choice(texts)) for c in range(conversations) for t in range(r.randint(1, most))]


def found(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("x"), "audit": F.lit(1), "there": F.lit(None), "kind": F.lit(2)})
    lists = repair.repairs(repair.damaged(extra)).collect()
    return {x.conv_id: x for x in lists}, len(lists)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_repairs_equal_the_search(spark, coalesce):
    rows = random_rows(11, 60, 5) + [(None, 1, "user", "No id."), (None, 2, "assistant", "Fine."), (900, 5, "user", "x"), (900, 5, "user", "x"), (901, None, None, None)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got, n = found(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == len({r[0] for r in rows}) == len(got)
    for conv in got:
        want = searched([r[1:] for r in damaged_rows(rows) if r[0] == conv])
        x = got[conv]
        for name in repair.COUNTS:
            assert x[name] == want[name], (conv, name)
        assert x.audit == want["audit"]
        assert [(m.role, m.text) for m in x.repaired] == list(want["repaired"])
    assert got[dropped].audit == "" and got[dropped].cost == 0 and got[dropped].repaired == []


def test_a_conversation_over_many_ranges_equals_the_plain_machine(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice([f"Line {t}.", f"cut {t}", "", "Same again."])) for t in range(2500)]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.conv_id: x for x in repair.repairs(repair.damaged(spark.createDataFrame(rows, SCHEMA)), repair.digest, repair.T.StringType()).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = sorted([x[1:] for x in damaged_rows(rows) if x[0] == 7], key=lambda x: (x[0], x[1].encode(), x[2].encode()))
    weights, seen = {"": (0, 0, "")}, set()
    for _, role, text in plain:
        weights = repair.consumed(weights, role[:1], repair.fault_of(text, (role, text) in seen))
        seen.add((role, text))
    cost, _, audit = min(w for q, w in repair.insertions(weights).items() if q in repair.FINAL)
    assert (got[7].cost, got[7].audit) == (cost, audit)
    assert got[7].repaired == repair.digest(repair.messages(audit, iter([(a, b) for _, a, b in plain])))
    assert got[7].gaps == max(t for t, _, _ in plain) - min(t for t, _, _ in plain) + 1 - len({t for t, _, _ in plain})
    assert got[8].audit == searched([x[1:] for x in damaged_rows(rows) if x[0] == 8])["audit"]


def test_blocks_of_labels_give_the_same_path(monkeypatch):
    r = random.Random(9)
    for _ in range(200):
        rows = [(r.choice("suax"), r.choice([0, 0, 1, 3])) for _ in range(r.randint(0, 12))]
        best = set()
        for block in (1, 2, 5, 256):
            monkeypatch.setattr(repair, "BLOCK", block)
            paths = repair.Paths("")
            for row in rows:
                paths.add(*row)
            best.add(paths.best())
            matrix = {q: repair.Paths(q) for q in repair.GRAMMAR}
            for p in matrix.values():
                for row in rows:
                    p.add(*row)
            best.add(repair.accepted(repair.followed({"": (0, "")}, {q: p.exits() for q, p in matrix.items()})))
        assert len(best) == 1


def test_empty_table(spark):
    assert repair.repairs(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
