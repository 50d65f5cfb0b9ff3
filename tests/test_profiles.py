"""Profiles as text and the map of what can be asked."""

import random
from datetime import date

from veritab.operators import profile, recipes


def test_profile_text_equals_plain_sums(spark):
    r = random.Random(6)
    rows = [(date(2019 + r.randrange(4), 1 + r.randrange(12), 3) if r.random() < 0.9 else None, r.choice(["b", "a", "c", "", None]), r.choice([1.5, -2.25, 100.0, None]), r.randrange(50), f"id{k}") for k in range(80)]
    df = spark.createDataFrame(rows, "day date, kind string, v double, n int, name string")
    text = profile.profile_text("sales", df)
    lines = text.split("\n")
    assert lines[1] == "rows: 80" and lines[0].startswith("Profile of sales")
    vs, ns = [x[2] for x in rows if x[2] is not None], [x[3] for x in rows]
    num = profile.plain_number
    assert f"v (number: sum {num(sum(vs))}, mean {num(sum(vs) / len(vs))}, min -2.25, max 100); n (number: sum {sum(ns)}, mean {num(sum(ns) / 80)}, min {min(ns)}, max {max(ns)}); name (text: 80 distinct)" in lines[2]

    def by(key, value):
        out = {}
        for x in rows:
            if x[value] is not None and (k := key(x)) not in (None, ""):
                out[str(k)] = out.get(str(k), 0) + x[value]
        return " · ".join(f"{k}: {num(s)}" for k, s in sorted(out.items()))

    year = lambda x: x[0] and x[0].year
    assert lines[3:] == [f"sum of v by year(day): {by(year, 2)}", f"sum of n by year(day): {by(year, 3)}", f"sum of v by kind: {by(lambda x: x[1], 2)}", f"sum of n by kind: {by(lambda x: x[1], 3)}"]
    assert profile.profile_text("sales", df, 100) == text[:99] + "…" and profile.profile_text("sales", df.repartition(3)) == text
    assert profile.profile_text("none", df.limit(0)).split("\n")[1] == "rows: 0"
    assert [num(x) for x in (None, -0.001, 12.0, 1.005, -3.5)] == ["0", "0", "12", "1", "-3.5"]


def test_map_of_what_can_be_asked(spark):
    dated = spark.createDataFrame([(date(2024, 1, 1), "a", 1.0)], "d date, k string, v double")
    pairs, reports, more = recipes.capabilities({"sales": dated, "names": dated.select("k")})
    assert reports == ["sales"] and more == 0 and pairs == [*[(r, "sales") for r in recipes.RECIPES], ("data-quality-audit", "names")]
    assert recipes.capabilities({f"t{k}": dated for k in range(5)})[2] == 35 - recipes.CARDS
