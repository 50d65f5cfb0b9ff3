"""Scalar functions over text columns, all built of Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the tokeniser leaves out.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "for", "on", "with", "as", "at", "by", "from", "this", "that", "it", "be", "do", "does", "have", "any", "there", "my", "our", "your", "you", "me", "i")


def sanitize(name: str) -> str:
    """A table or column identifier: lower case, runs of other characters as one underscore."""
    out = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    return f"t_{out}" if out[:1].isdigit() else out or "table"


def sanitized(name: Column) -> Column:
    """`sanitize` for a column of names."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "table").when(out.rlike("^[0-9]"), F.concat(F.lit("t_"), out)).otherwise(out)


def number(text: Column, currencies: str = "$€£¥") -> Column:
    """A lenient number: currency signs, thousands separators, percent signs; parentheses mean negative."""
    bare = F.regexp_replace(F.trim(text), f"[{re.escape(currencies)},%\\s]", "")
    inner = F.regexp_extract(bare, r"^\((.+)\)$", 1)
    value = F.when(inner != "", -inner.try_cast("double")).otherwise(bare.try_cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def year(text: Column) -> Column:
    """The year of an ISO date or of m/d/yyyy and m.d.yyyy."""
    iso, other = F.regexp_extract(text, r"^(\d{4})-\d{2}", 1), F.regexp_extract(text, r"^\d{1,2}[/.]\d{1,2}[/.](\d{4})$", 1)
    return F.coalesce(F.when(iso != "", iso), F.when(other != "", other)).try_cast("int")


def looks_temporal(label: Column) -> Column:
    """Four digits between 1900 and 2100, YYYY-MM..., or Qn YYYY."""
    whole = label.rlike(r"^\d{4}$") & label.try_cast("int").between(1900, 2100)
    return F.coalesce(whole | label.rlike(r"^\d{4}-\d{2}") | label.rlike(r"(?i)^q[1-4] \d{4}$"), F.lit(False))


def id_like(name: str) -> bool:
    return bool(re.search(r"(^|_)(id|sku|code)s?$", name.lower()))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters or digits that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def singular(word: Column) -> Column:
    """A word without a closing s, if three letters and more are left."""
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def name_tokens(name: Column) -> Column:
    """The singular words of a file's name without its extension."""
    return F.array_distinct(F.transform(tokens(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")), singular))


def compact_number(value: Column) -> Column:
    """A number for an axis: thousands, millions and billions as k, M and B with one digit at most, else two."""

    def trimmed(v: Column, digits: int) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", F.round(v, digits)), r"(\.\d*?)0+$", "$1"), r"\.$", "")

    size = F.abs(value)
    out = F.when(size >= 1e9, F.concat(trimmed(value / 1e9, 1), F.lit("B"))).when(size >= 1e6, F.concat(trimmed(value / 1e6, 1), F.lit("M")))
    return out.when(size >= 1e3, F.concat(trimmed(value / 1e3, 1), F.lit("k"))).otherwise(trimmed(value, 2))


def grouped_number(value: Column) -> Column:
    """A number with thousands apart and two digits at most, without closing zeros."""
    plain = F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, 2), 2), r"0+$", ""), r"\.$", "")
    return F.when(value.isNotNull(), F.when(plain == "-0", "0").otherwise(plain))


def token_estimate(text: Column) -> Column:
    """Half of the digits and a quarter of the other characters, each rounded up."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (F.ceil(digits / 2) + F.ceil((F.length(text) - digits) / 4)).cast("long")


def question_key(text: Column) -> Column:
    """A question without case, extra spaces and closing marks."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), r"[?!. ]+$", "")


def number_tokens(text: Column) -> Column:
    """The distinct numbers of a text without separators and citation marks, sorted."""
    bare = F.regexp_replace(text, r"\[\d+\]", " ")
    found = F.regexp_extract_all(bare, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", ""))))


def unverified_numbers(answer: Column, verified: Column) -> Column:
    """Numbers of an answer that are neither verified ones nor their integer parts."""
    known = number_tokens(verified)
    return F.array_except(number_tokens(answer), F.concat(known, F.transform(known, lambda x: F.substring_index(x, ".", 1))))


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: * and ? stay within a segment, ** spans segments."""
    out = []
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out.append({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)))
    return "^" + "".join(out) + "$"
