"""Investigations and chart requests."""

import json

import pytest

from veritab.operators import investigations as inv
from veritab.operators.charts import Directive, decided_chart, fault_of, parse_directive, without_directive
from veritab.plans.guard import Refused

STORE = "id string, name string, created long, archived boolean, local_only boolean"


def test_create_fork_archive_export(spark):
    frame = spark.createDataFrame
    store, own = inv.created(frame([], STORE), " Costs ", 1_700_000_000_000, True)
    scopes, talks = frame([(own, "b.csv"), (own, "a.csv"), ("other", "x")], "id string, file string"), frame([(own, "t1"), (own, "t2")], "id string, conversation string")
    for bad in ("", "  ", "costs", "COSTS "):
        with pytest.raises(Refused):
            inv.created(store, bad, 2)
    with pytest.raises(Refused):
        inv.forked(store, scopes, talks, "none", "New", 3)
    store2, scopes2, talks2, fork = inv.forked(inv.archived(store, own), scopes, talks, own, "Costs again", 1_700_000_100_000)
    rows = {r.id: (r.name, r.archived, r.local_only) for r in store2.collect()}
    assert rows == {own: ("Costs", True, True), fork: ("Costs again", False, True)} and fork == inv.new_id("Costs again", 1_700_000_100_000)
    assert sorted(r.file for r in scopes2.where(f"id = '{fork}'").collect()) == ["a.csv", "b.csv"] and talks2.where(f"id = '{fork}'").count() == 2
    pins, notes = frame([(own, "Total by month")], "id string, title string"), frame([], "id string, name string")
    text = inv.exported(own, store2, scopes2, talks2, pins, notes, {"t1": "First talk", "t2": ""})
    assert text == "# Costs\n\n- Created: 2023-11-14 22:13 UTC\n- Status: Archived\n- Provider policy: local-only\n\n## Scope\n\n- a.csv\n- b.csv\n\n## Conversations\n\n- First talk (t1)\n- t2\n\n## Pins\n\n- Total by month\n\n## Notes\n\n_No notes._\n"
    assert "_No pins._" in inv.exported(fork, store2, scopes2, talks2, pins, notes)
    asks = frame([(1, own, None), (2, own, ["z"]), (3, "gone", None), (4, None, []), (5, "bare", [])], "ask int, investigation string, files array<string>")
    with_bare = store.unionByName(frame([("bare", "Bare", 1, False, False)], STORE))
    assert {r.ask: (r.files, r.local_only) for r in inv.resolved(asks, with_bare, scopes).collect()} == {1: (["a.csv", "b.csv"], True), 2: (["z"], True), 3: ([], False), 4: ([], False), 5: ([], False)}


def fenced(**body):
    return f"Here.\n\n```chart-request\n{json.dumps(body)}\n```\n\nDone."


def test_chart_requests(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5, 2.0, "x"), ("b", 3.0, 2.0, 4.0, "y")], "k string, v double, lo double, hi double, t string")
    good = fenced(kind="line", label_column="k", series_columns=["v"], sort="desc", title=" T\u0007x ", values=[9])
    assert parse_directive(good) == Directive("line", "k", ("v",), title="Tx", sort="desc")
    chart = decided_chart(good, df)
    assert chart.kind == "line" and [r["label"] for r in chart.rows.collect()] == ["b", "a"] and without_directive(good) == "Here.\n\nDone."
    band = fenced(kind="band", label_column="k", series_columns=["v"], lower_column="lo", upper_column="hi")
    assert decided_chart(band, df).series == ["v", "lo", "hi"]
    assert decided_chart(fenced(kind="none"), df) is None
    for bad in ("no fence", "```chart-request\n{\"kind\": \"bar\"", "```chart-request\n[1]\n```", "```chart-request\nx\n```", fenced(kind="pie", label_column="k", series_columns=["v"]), fenced(kind="bar", label_column=1, series_columns=["v"]), fenced(kind="bar", label_column="k", series_columns="v"), fenced(kind="bar", label_column="k", series_columns=["v"], sort="up")):
        assert parse_directive(bad) is None
        assert decided_chart(bad, df.select("k", "v")).kind == "bar"
    for d, why in ((Directive("bar", "no", ("v",)), "unknown label column no"), (Directive("bar", "k", ()), "1 to 3 series"), (Directive("bar", "k", ("t",)), "t is not numeric"), (Directive("bar", "k", ("q",)), "unknown column q"), (Directive("band", "k", ("v",), "lo"), "a band has"), (Directive("band", "k", ("v",), "lo", "t"), "t is not numeric")):
        assert fault_of(d, df).startswith(why)
    assert fault_of(Directive("none"), df) is None and fault_of(Directive("area", "k", ("v", "lo", "hi")), df) is None
