"""Answers and boards as single HTML files: nothing is fetched, everything is escaped, the same inputs give the same bytes."""

from __future__ import annotations

import html
import os
from dataclasses import dataclass
from datetime import UTC, datetime

from veritab.operators.charts import Chart
from veritab.plans.cards import format_sql
from veritab.plans.direct import Direct
from veritab.plans.execute import COLUMNS, ROWS, Result

STYLE = "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}td.n{text-align:right}pre{background:#f6f6f6;padding:1em;overflow:auto}.stale{color:#a00}footer,.stamp{color:#666}"


def moment(at: float) -> str:
    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%d %H:%M UTC")


def table_html(result: Result, rows: int = ROWS) -> str:
    """A result's first rows and columns; numbers stand to the right, null is empty."""

    def cell(v: object) -> str:
        mark = ' class="n"' if isinstance(v, (int, float)) and not isinstance(v, bool) else ""
        return f"<td{mark}>{'' if v is None else html.escape(str(v))}</td>"

    head = "".join(f"<th>{html.escape(c)}</th>" for c in result.columns[:COLUMNS])
    lines = "\n".join(f"<tr>{''.join(map(cell, r[:COLUMNS]))}</tr>" for r in result.rows[:rows])
    return f"<table>\n<thead><tr>{head}</tr></thead>\n<tbody>\n{lines}\n</tbody>\n</table>"


def bars_svg(rows: list[tuple[str, float | None]], width: int = 480) -> str:
    """One series of labels and values as bars from a common zero; a missing value has no bar."""
    values = [v for _, v in rows if v is not None]
    if not values:
        return ""
    low, high = min(0.0, *values), max(0.0, *values)
    unit = width / ((high - low) or 1)
    lines = []
    for k, (label, v) in enumerate(rows):
        y = 22 * k
        lines.append(f'<text x="0" y="{y + 14}" font-size="12">{html.escape(str(label))}</text>')
        if v is not None:
            lines.append(f'<rect x="{160 + (min(v, 0.0) - low) * unit:.1f}" y="{y + 3}" width="{abs(v) * unit:.1f}" height="14"><title>{v:g}</title></rect>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{160 + width}" height="{22 * len(rows)}">{"".join(lines)}</svg>'


def chart_svg(chart: Chart | None, most: int = 24) -> str:
    """The first series of a chart, its first rows; empty without a chart."""
    return "" if chart is None else bars_svg([(r["label"], r[1]) for r in chart.rows.limit(most).collect()])


def document(title: str, parts: list[str]) -> str:
    body = "\n".join(parts)
    return f'<!doctype html>\n<html lang="en">\n<head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head>\n<body>\n{body}\n</body>\n</html>\n'


def section(title: str, *inner: str) -> str:
    return "\n".join(["<section>", f"<h2>{html.escape(title)}</h2>", *inner, "</section>"])


def evidence_pack(question: str, answer: str, sql: str, run: Direct, at: float) -> str:
    """A question, its answer in paragraphs, the rows, the chart, the statement that ran, how fresh the files are and which they
    were. Each file is named once, by name and place."""
    told = [f"<p>{html.escape(p)}</p>" for p in answer.split("\n\n") if p.strip()]
    notes = [f"<p>{html.escape(line)}</p>" for line in run.footer]
    files = dict.fromkeys(f for t in run.tables for f in t.files)
    named = [f"<li>{html.escape(os.path.basename(f))}{'' if os.path.basename(f) == f else ' — ' + html.escape(f)}</li>" for f in files]
    parts = [f"<header>\n<h1>{html.escape(question)}</h1>\n<p class=\"stamp\">Generated {moment(at)}</p>\n</header>", section("Answer", *told, table_html(run.result))]
    if svg := chart_svg(run.chart):
        parts.append(section("Chart", f"<figure>{svg}</figure>"))
    parts.append(section("Query used", f"<pre><code>{html.escape(format_sql(sql))}</code></pre>"))
    parts.append(section("Provenance", *notes, f"<ol>\n{chr(10).join(named)}\n</ol>"))
    return document(question, [*parts, f"<footer>Generated {moment(at)}. Every number was computed from the files above; digest {run.result.digest}.</footer>"])


@dataclass
class Card:
    """A board's card as it is shown: without a result it was not computed now, and says so."""

    title: str
    sql: str
    freshness: str
    result: Result | None = None
    footer: str = ""
    stale: str = ""


def board_pack(title: str, cards: list[Card], at: float) -> str:
    """A board's cards in order, and all their statements at the end with what each says of its own basis."""
    parts = [f"<header>\n<h1>{html.escape(title)}</h1>\n<p class=\"stamp\">Generated {moment(at)}</p>\n</header>"]
    if not cards:
        return document(title, [*parts, "<section><p>This board has no cards.</p></section>"])
    for c in cards:
        shown = [table_html(c.result)] if c.result is not None else []
        parts.append(section(c.title, *shown, f'<p class="stamp">{html.escape(c.freshness)}</p>', *([f'<p class="stale">{html.escape(c.stale)}</p>'] if c.stale else [])))
    queries = [x for c in cards for x in (f"<h3>{html.escape(c.title)}</h3>", f"<pre><code>{html.escape(format_sql(c.sql))}</code></pre>", f"<p>{html.escape(c.footer or c.freshness)}</p>")]
    return document(title, [*parts, section("Queries", *queries)])
