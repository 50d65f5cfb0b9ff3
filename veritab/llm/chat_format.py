"""Chat formatting by event-sourced reconstruction (operator 4, native).

A log of events (conversation, sequence, message, kind, role, text) is folded: of each message, what comes before its
last `edit` or `regenerate` is void, an edit's text starts it anew, and the streamed deltas after that are appended in
sequence; a `delete` voids the message until a later edit or regeneration. Final messages stand in the order of their
first events and are rendered under a template of control strings that cannot occur inside texts, as each is escaped.

Messages are first put together in blocks of `BLOCK` turns and then to a conversation, so what meets for one
conversation is one row a block; the conversation's text itself is one value, as the contract asks for.

Defined results: a null text is empty, a null role is the empty role, a null conversation forms one conversation; rows
with one turn number stand in the order of role and text, each a message of its own. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm._common import table

START, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: A text's control strings: an opening bracket, any backslashes, and what makes it a mark of this or a common template.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
BLOCK = 64
RESETS = ("edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """One backslash more inside each control string."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def fold(events: DataFrame, *within: str) -> DataFrame:
    """(conv_id, within..., seq, role, text): the final messages of a log (conv_id, seq, message, kind, role, text).

    seq may be of any ordered type. within: columns that a message's events share, so that rows dealt by them stay."""
    keys = ["conv_id", *within]
    whole = events.groupBy(*keys, "message").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"), "kind"))).alias("log"), F.max("role").alias("role"))
    reset = F.array_max(F.transform(F.filter("log", lambda e: e["kind"].isin(*RESETS)), lambda e: e["seq"]))
    cut = whole.select(*keys, F.col("log")[0]["seq"].alias("seq"), "role", "log", reset.alias("reset"))
    living = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    done = cut.select(*keys, "seq", "role", living.alias("log")).where(~F.exists("log", lambda e: e["kind"] == "delete"))
    return done.select(*keys, "seq", "role", F.array_join(F.transform("log", lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, segments): each conversation's text in order as array<struct<text, loss>>; loss marks assistant texts.

    messages: (conv_id, block, seq, role, text)."""
    role = F.coalesce("role", F.lit(""))
    own = F.array(
        F.struct(F.concat(F.lit(START), F.url_encode(role), F.lit(AFTER_ROLE)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.coalesce("text", F.lit(""))).alias("text"), (role == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )
    placed = messages.select("conv_id", "block", "seq", own.alias("own"))
    blocks = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "own"))).alias("m"))
    blocks = blocks.select("conv_id", "block", F.flatten(F.col("m.own")).alias("own"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "own"))).alias("b"))
    return whole.select("conv_id", F.flatten(F.col("b.own")).alias("segments"))


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: t != "")

    def turn(t: Column) -> Column:
        body = F.substring(t, F.lit(len(START) + 1), F.length(t))
        return F.struct(F.url_decode(F.substring_index(body, AFTER_ROLE, 1)).alias("role"), unescape(F.regexp_replace(body, r"^[^\n]*\n", "")).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column) -> Column:
    """All text under the loss mask, unescaped, read from the marks of a formatted conversation: what stands between an
    assistant's mark and the next end. No text can hold a mark, as each is escaped."""
    said = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>\n"), F.lit(1))
    return F.array_join(F.transform(said, unescape), "")


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: each row is a message that was streamed in one delta.

    Rows are dealt once by conversation and block of turns, which serves all that is done within a block."""
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)
    dealt = conversations.select("conv_id", block.alias("block"), "turn", "role", "text").repartition("conv_id", "block")
    nth = F.row_number().over(Window.partitionBy("conv_id", "block", "turn").orderBy("role", "text"))
    rows = dealt.select("conv_id", "block", F.struct(F.col("turn"), nth.alias("nth")).alias("seq"), "role", "text")
    return rows.select("conv_id", "block", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def op4_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    done = render(fold(log_of(own.unionByName(extra)), "block")).select("conv_id", text_of(F.col("segments")).alias("formatted"))
    read = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The same rows from DuckDB; formatted_chars counts the template's marks, the encoded role and the escapes.
OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(24 + length(replace(replace(replace(url_encode(role), '%20', '+'), '%2A', '*'), '~', '%7E')) + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
