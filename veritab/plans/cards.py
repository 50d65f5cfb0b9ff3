"""What a planner of statements is told about tables, and what an answer says of its own basis."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import looks_temporal, number
from veritab.operators.recipes import kinds
from veritab.plans.guard import reads

CARD_CHARS, SAMPLE_ROWS, RANKED, FACT_ROWS = 1200, 3, 3, 200
#: Rows of a column that vote on its kind, and the share that decides.
VOTERS, SHARE = 50, 0.8
#: Words and phrases that ask for figures, and those that ask for several steps.
FIGURE_WORDS = ("sum", "total", "totals", "average", "avg", "mean", "median", "count", "top", "largest", "smallest", "highest", "lowest", "max", "maximum", "min", "minimum", "trend", "trends", "breakdown", "distribution", "percent", "percentage", "share", "ratio", "rank", "ranking", "monthly", "yearly", "quarterly", "analyze", "analyse", "analysis")
FIGURE_PHRASES = ("how many", "how much", "group by", "per")
#: Words and phrases that ask for more than one document, and those that ask for what was asked before.
ACROSS_WORDS = ("across", "compare", "compared", "comparing", "comparison", "versus", "vs", "synthesize", "synthesise", "combine", "combined", "overall", "differ", "differs", "difference", "differences", "trend", "trends", "all my files", "all my documents", "all my docs", "all the files", "all the documents", "all of my", "all of the", "each file", "each document", "each doc", "each of", "every file", "every document", "both files", "both documents", "both reports", "these files", "these documents", "my files", "my documents", "between the")
RECALL_PHRASES = ("what did i ask", "what did i conclude", "what did we conclude", "what did i say", "what did i decide", "did i ask", "have i asked", "what did i find", "what have i asked")
STEP_WORDS = ("compare", "compared", "comparing", "versus", "vs", "difference", "differences", "why", "driver", "drivers", "explain", "explains", "explained", "what caused", "change between", "breakdown of the change", "changed between")


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind) of every column; a text column is numeric or a date if 0.8 of its first 50 filled cells are."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        found = kinds(df)
        texts = [c for c, k in found.items() if k == "text" and dict(df.dtypes)[c] == "string"]
        if texts:
            some = df.select(*texts).limit(VOTERS)
            votes = [v for c in texts for v in (F.count_if(F.trim(c) != ""), F.count(number(F.col(c))), F.count_if(looks_temporal(F.trim(c))))]
            told = some.agg(*[v.alias(f"v{k}") for k, v in enumerate(votes)]).first()
            for k, c in enumerate(texts):
                filled, numeric, dated = told[3 * k : 3 * k + 3]
                found[c] = "text" if not filled else "date" if dated >= SHARE * filled else "numeric" if numeric >= SHARE * filled else "text"
        rows += [(name, c, k) for c, k in found.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")


def schema_card(name: str, df: DataFrame) -> str:
    """A table's rows, columns with types and three sample rows, cut at 1200 characters."""
    lines = [f"{name} ({df.count():,} rows)", ", ".join(f"{c} {t.upper()}" for c, t in df.dtypes)]
    lines += [" | ".join("" if v is None else str(v) for v in r) for r in df.head(SAMPLE_ROWS)]
    text = "\n".join(lines)
    return text if len(text) <= CARD_CHARS else text[: CARD_CHARS - 1] + "…"


def matched_columns(catalog: DataFrame, question: str, synonyms: DataFrame | None = None) -> DataFrame:
    """The catalog's columns with `matched`: a word of the question, three letters and more, has the column's name in it or is in
    it; or a synonym (term, column_name) of the column stands in the question."""
    words = sorted(set(re.findall(r"[^\W_]{3,}", question.lower())))
    name = F.lower("column_name")
    own = F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: name.contains(w) | w.contains(name))
    if synonyms is None:
        return catalog.withColumn("matched", own)
    meant = synonyms.where(F.lit(question.lower()).contains(F.lower("term"))).select(F.lower("column_name").alias("_meant")).distinct()
    both = catalog.join(meant, name == F.col("_meant"), "left")
    return both.withColumn("matched", own | F.col("_meant").isNotNull()).drop("_meant")


def planned_tables(catalog: DataFrame, question: str, synonyms: DataFrame | None = None, n: int = RANKED) -> DataFrame:
    """(table_name, score): three times a table's matched columns and twice the question's words in its name; the n best, ties by
    name, and n tables even where no word speaks for any."""
    words = sorted(set(re.findall(r"[^\W_]{3,}", question.lower())))
    hits = matched_columns(catalog, question, synonyms).groupBy("table_name").agg(F.count_if("matched").alias("c"))
    named = F.size(F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.lower("table_name").contains(w)))
    return hits.select("table_name", (3 * F.col("c") + 2 * named).alias("score")).orderBy(F.desc("score"), "table_name").limit(n)


def ranked_tables(catalog: DataFrame, question: Column, n: int = RANKED) -> DataFrame:
    """(table_name, score): three times the question's words among a table's columns and twice those in its name; the n best, ties
    in the catalog's order of names."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    asked = words(question)
    each = catalog.groupBy("table_name").agg(F.array_distinct(F.flatten(F.collect_list(words(F.col("column_name"))))).alias("c"))
    score = 3 * F.size(F.array_intersect("c", asked)) + 2 * F.size(F.array_intersect(words(F.col("table_name")), asked))
    return each.select("table_name", score.alias("score")).orderBy(F.desc("score"), "table_name").limit(n)


def pruned_columns(columns: list[str], question: str) -> list[str]:
    """The first two columns and those that share a word with the question."""
    asked = set(re.findall(r"[a-z0-9]{2,}", question.lower()))
    return [c for k, c in enumerate(columns) if k < 2 or asked & set(re.findall(r"[a-z0-9]{2,}", c.lower()))]


def pruned_card(name: str, df: DataFrame, question: str) -> str:
    kept = pruned_columns(df.columns, question)
    sample = df.select(*kept).head(1)
    return f"{name}: " + ", ".join(f"{c} {t.upper()}" + (f" (e.g. {sample[0][c]})" if sample and sample[0][c] is not None and k > 1 else "") for k, (c, t) in enumerate(df.select(*kept).dtypes))


def fact_sheet(result: DataFrame, rows: int = FACT_ROWS) -> DataFrame:
    """(column_name, n, total, least, most) of each column of the shown rows that is numeric throughout, as it is or as text."""
    shown = result.limit(rows)
    value = {c: F.col(c).cast("double") if k == "numeric" else number(F.col(c).cast("string")) for c, k in kinds(result).items() if k != "date"}
    if not value:
        return result.sparkSession.createDataFrame([], "column_name string, n long, total double, least double, most double")
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias("filled"), F.round(F.sum(v), 2).alias("total"), F.min(v).alias("least"), F.max(v).alias("most")) for c, v in value.items()]
    told = shown.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return told.where("n > 0 AND n = filled").drop("filled")


def mentions(sql: str, table: str) -> bool:
    """Whether a statement's text names a table, as a whole word of any case."""
    return re.search(rf"(?<![A-Za-z0-9_]){re.escape(table)}(?![A-Za-z0-9_])", sql, re.I) is not None


AGES = ((60, "minute"), (3600, "hour"), (86_400, "day"), (604_800, "week"), (2_592_000, "month"), (31_536_000, "year"))


def age(seconds: float) -> str:
    """How long ago, in the largest whole unit."""
    size, unit = next(((s, u) for s, u in reversed(AGES) if seconds >= s), (0, ""))
    if not unit:
        return "just now"
    n = int(seconds // size)
    return f"{n} {unit}{'s' if n > 1 else ''} ago"


def freshness(spark: SparkSession, sql: str, saved: dict[str, list[float]], now: float) -> str:
    """When the files of the tables that a statement reads were saved; of several files of a table the newest. saved: seconds
    since the epoch by table."""
    parts = []
    for name in reads(spark, sql):
        if times := saved.get(name.lower()):
            parts.append(f"{name} ({'' if len(times) == 1 else f'{len(times)} files, newest '}saved {age(now - max(times))})")
    return f"Based on {', '.join(parts)}." if parts else ""


def row_cap_notes(capped: dict[str, tuple[int, int]]) -> list[str]:
    """A line for each table of which only the first rows were read: (read, in all)."""
    return [f"{name}: the first {read:,} of {total:,} rows were read." for name, (read, total) in capped.items() if read < total]


def extract_sql(reply: str) -> str | None:
    """The first fenced block of a reply, or what begins with its first SELECT or WITH; without closing semicolons."""
    fenced = re.search(r"```(?:sql)?\s*\n(.*?)```", reply, re.S | re.I)
    bare = re.search(r"(?is)\b(?:select|with)\b.*", reply)
    text = fenced[1] if fenced else bare[0] if bare else ""
    return text.strip().rstrip("; \n\t") or None


CLAUSES = r"\b(select|from|where|group by|having|order by|limit|union all|union|intersect|except|(?:left |right |full |inner |cross )?(?:outer )?join|with)\b"
LINE = 72


def format_sql(sql: str) -> str:
    """The statement with clauses on lines of their own and long lists wrapped; only white space changes, none in quotes."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)
    held, text = [], ""
    for k, part in enumerate(parts):
        if k % 2:
            held.append(part if not part.startswith("--") else part + "\n")
            text += f"\x00{len(held) - 1}\x00"
        else:
            text += re.sub(r"\s+", " ", part)
    depth, out, at = 0, [], 0
    for m in re.finditer(r"[()]|" + CLAUSES, text, re.I):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth == 0 and m.start() > 0:
            out.append(text[at : m.start()].strip())
            at = m.start()
    out.append(text[at:].strip())
    lines: list[str] = []
    for clause in filter(None, out):
        while len(clause) > LINE and (cut := clause.rfind(", ", 0, LINE)) > 0:
            lines.append(clause[: cut + 1])
            clause = "  " + clause[cut + 2 :]
        lines.append(clause)
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], "\n".join(lines))


def has_cue(question: Column, words: Iterable[str] = FIGURE_WORDS + FIGURE_PHRASES) -> Column:
    """Whether a question has one of the words or phrases, as whole words."""
    bare = F.concat(F.lit(" "), F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "), F.lit(" "))
    return F.coalesce(bare.rlike(" (" + "|".join(sorted(map(re.escape, words))) + ") "), F.lit(False))


def asks_steps(question: Column) -> Column:
    """Whether a question asks for figures and also for a comparison or a reason."""
    return has_cue(question) & has_cue(question, STEP_WORDS)


def asks_across(question: Column) -> Column:
    """Whether a question is about several documents at once."""
    return has_cue(question, ACROSS_WORDS)


def asks_recall(question: Column) -> Column:
    """Whether a question is about what was asked, said or found before."""
    return has_cue(question, RECALL_PHRASES)


def answerable(question: str, columns: list[str]) -> bool:
    """Whether a question shares a content word with the columns' names."""
    words = lambda x: {w.rstrip("s") for w in re.findall(r"[a-z0-9]{3,}", x.lower())}
    return bool(words(question) & set().union(*map(words, columns)) if columns else False)


def last_statement(answers: list[str], most: int = 800) -> str | None:
    """The statement of the latest answer that shows one, on one line."""
    for text in reversed(answers):
        if found := re.findall(r"```sql\s*\n(.*?)```", text, re.S | re.I):
            return re.sub(r"\s+", " ", found[-1]).strip()[:most]
    return None
