"""Questions that ask for a list of files, the list, and what is known of one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators.index_store import Snapshot
from veritab.operators.recipes import first_of, kinds

#: Words of a question that asks for a list, and of one that surely does.
VERBS = ("show", "list", "give", "display", "name", "what", "which", "enumerate", "tell", "how many")
STRONG = ("all", "every", "each", "list", "enumerate", "catalog", "catalogue", "how many")
#: Words that such a question may have besides.
FILLER = ("show", "me", "list", "give", "please", "can", "could", "would", "you", "display", "name", "names", "enumerate", "tell", "what", "which", "how", "many", "much", "are", "there", "is", "do", "does", "did", "i", "we", "my", "our", "the", "a", "an", "all", "every", "each", "of", "in", "on", "to", "get", "see", "view", "find", "catalog", "catalogue", "count", "number", "total", "available", "included", "uploaded", "stored", "have", "has", "any")
#: What is asked for, and the extensions that are meant by it; none: every file.
DATASETS = (".csv", ".tsv", ".xlsx", ".xlsm", ".xls", ".parquet", ".json", ".arrow", ".feather")
DOCUMENTS = (".md", ".markdown", ".txt", ".text", ".rst", ".doc", ".docx", ".pdf", ".rtf", ".odt")
NOUNS = {"file": (), "dataset": DATASETS, "document": DOCUMENTS, "doc": DOCUMENTS, "pdf": (".pdf",), "spreadsheet": (".csv", ".tsv", ".xlsx", ".xlsm", ".xls"), "csv": DATASETS, "table": DATASETS, "source": ()}
#: Names of formats that narrow a list.
FORMATS = {
    "csv": (".csv",), "tsv": (".tsv",), "xlsx": (".xlsx",), "xlsm": (".xlsm",), "xls": (".xls",), "parquet": (".parquet",), "json": (".json",), "arrow": (".arrow",), "feather": (".feather",),
    "md": (".md", ".markdown"), "markdown": (".md", ".markdown"), "txt": (".txt", ".text"), "text": (".txt", ".text"), "rst": (".rst",), "rtf": (".rtf",), "odt": (".odt",), "docx": (".docx",), "xml": (".xml",), "html": (".html",),
}
#: Names that a list shows.
LISTED = 50


def listing_extensions(question: Column) -> Column:
    """The extensions that a question asks a list of, an empty array for all files, null for a question that asks for none.

    A question asks for a list if it has a noun for files and a verb, in the plural or with a word like `all`, and nothing
    else of content. Formats that it names narrow the list."""
    text = F.lower(question)
    words = F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))
    known = F.array(*map(F.lit, NOUNS))
    bare = lambda w: F.when(F.array_contains(known, w), w).otherwise(F.regexp_replace(w, "s$", ""))
    noun = F.get(F.filter(words, lambda w: F.array_contains(known, bare(w))), F.lit(0))
    has = lambda phrases: text.rlike(r"(?<!\w)(?:" + "|".join(phrases) + r")(?!\w)")
    plural = ~F.array_contains(known, noun)
    free = [*FILLER, *NOUNS, *[f"{n}s" for n in NOUNS], *FORMATS]
    content = F.size(F.array_except(words, F.array(*map(F.lit, free)))) > 0
    by_word = F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    named = F.filter(words, lambda w: F.map_contains_key(by_word, w) | F.map_contains_key(by_word, F.regexp_replace(w, "s$", "")))
    narrowed = F.array_distinct(F.flatten(F.transform(named, lambda w: F.coalesce(F.try_element_at(by_word, w), F.try_element_at(by_word, F.regexp_replace(w, "s$", ""))))))
    by_noun = F.create_map(*[x for k, v in NOUNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    asked = noun.isNotNull() & has(VERBS) & (plural | has(STRONG)) & ~content
    return F.when(asked, F.when(F.size(named) > 0, narrowed).otherwise(F.try_element_at(by_noun, bare(noun))))


def listed(files: DataFrame, extensions: list[str], most: int = LISTED) -> DataFrame:
    """(name, of): the first `most` names of files (name) with such an extension, and how many there are in all."""
    own = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    met = files.where(own.isin(extensions)) if extensions else files
    return met.select("name").orderBy("name").limit(most).withColumn("of", met.agg(F.count("*").alias("n")).select("n").scalar())


def listing_text(rows: list[tuple[str, int]], label: str = "files") -> str:
    """The list as it is answered, with how many names it leaves out."""
    if not rows:
        return f"No {label} found."
    of = rows[0][1]
    return "\n".join([f"{of:,} {label}:", *[f"- {name}" for name, _ in rows], *([f"…and {of - len(rows):,} more"] if of > len(rows) else [])])


#: Characters of a file's text that an inspection shows.
PREVIEW = 2000
TABULAR = (".csv", ".tsv", ".xlsx", ".xlsm", ".xls", ".parquet")


def inspections(files: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
    """(file, name, mode, preview, chunks, indexed, fresh) of files (file, name, version, text): how each is cut, the beginning of
    its text, and what the index has of it: its chunks, the version that they are of, and whether that is the file's. A
    file that the index has not seen has nulls there; nothing is built or changed by looking."""
    own = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    shown = files.select("file", "name", "version", F.when(own.isin(*TABULAR), "tabular").otherwise("prose").alias("mode"), F.substring("text", 1, PREVIEW).alias("preview"))
    if snapshot is None:
        return shown.select("file", "name", "mode", "preview", F.lit(None).cast("long").alias("chunks"), F.lit(None).cast("string").alias("indexed"), F.lit(None).cast("boolean").alias("fresh"))
    both = shown.join(snapshot.files.select("file", F.col("version").alias("indexed"), "chunks"), "file", "left")
    fresh = F.when(F.col("indexed").isNotNull(), F.col("indexed") == F.coalesce(F.col("version").cast("string"), F.lit("")))
    return both.select("file", "name", "mode", "preview", "chunks", "indexed", fresh.alias("fresh"))


def search_file(snapshot: Snapshot, file: object, words: list[str], k: int = 5) -> DataFrame:
    """(ordinal, score, chunk): the k chunks of one file that a question's words find, scored as in a search over all files."""
    hits = snapshot.search(words).where(F.col("file") == F.lit(file)).orderBy(F.desc("score"), "ordinal").limit(k)
    return hits.join(snapshot.chunks.where(F.col("file") == F.lit(file)).select("ordinal", "chunk"), "ordinal").select("ordinal", "score", "chunk").orderBy(F.desc("score"), "ordinal")


#: Tables that suggestions look at, and suggestions given.
SUGGEST_TABLES, SUGGESTED = 3, 4


def suggested_asks(tables: list[tuple[str, DataFrame, float]], newest: int = SUGGEST_TABLES, most: int = SUGGESTED) -> list[tuple[str, str]]:
    """(label, question) of questions that the newest tables (name, frame, saved) surely can answer, as they name their columns."""
    out: dict[str, str] = {}
    for name, df, _ in sorted(tables, key=lambda t: (-t[2], t[0]))[:newest]:
        found = kinds(df)
        number, text, date = (first_of(df, k) if k in found.values() else None for k in ("numeric", "text", "date"))
        if number and text:
            out.setdefault(f"Total {number} by {text}", f"Total {number} by {text} in {name}")
        if number and date:
            out.setdefault(f"Monthly trend of {number}", f"Monthly trend of {number} in {name}")
    return list(out.items())[:most]


