"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs and sorted by turn, then role, then text. Adjacent turns of one role become one
block: ``<s>role``, a line break, the texts with ``<sep>`` between, ``</s>``. All but the assistant's stand between ``[INST]`` and
``[/INST]``. The loss mask has one span (start, length) per assistant text, in code points of the formatted string.

Control strings inside a text or role get a backslash after their first character, behind any backslashes that are there, so no text
holds a bare one and removing one backslash gives the text back. A line break in a role is written ``<nl>``.

Null texts and roles count as empty, null turns come first, and rows with a null conv_id are one conversation. Repeated rows are
turns of their own. An empty table gives no conversations. A conversation is one row of the result, so it must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

ASSISTANT = "assistant"
_CONTROL = r"(/?s>|sep>|nl>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _blocks(turns: Column) -> Column:
    """Runs of turns of one role: array of (role, texts)."""
    n = F.size(turns)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(
        starts,
        lambda a, k: F.struct(
            F.get(turns, a)["role"].alias("role"),
            F.transform(F.slice(turns, a + 1, F.coalesce(F.get(starts, k + 1), n) - a), lambda t: t["text"]).alias("texts"),
        ),
    )


def _head(block: Column) -> Column:
    mark = F.when(block["role"] == ASSISTANT, F.lit("")).otherwise(F.lit("[INST]"))
    return F.concat(F.lit("<s>"), block["role"], F.lit("\n"), mark)


def _tail(block: Column) -> Column:
    return F.when(block["role"] == ASSISTANT, F.lit("</s>\n")).otherwise(F.lit("[/INST]</s>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation from rows of conv_id, turn, role and text: conv_id, formatted, loss_mask."""
    role = F.regexp_replace(escape(F.coalesce(F.col("role"), F.lit(""))), "\n", "<nl>")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_plain"), role.alias("role"), F.coalesce("text", F.lit("")).alias("_raw"))
    turn = F.struct("turn", F.col("_plain"), F.col("_raw"), "role", escape(F.col("_raw")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = sorted_turns.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(_head(b), F.array_join(b["texts"], "<sep>"), _tail(b))), "")

    def of_block(acc: Column, block: Column) -> Column:
        """Position behind the block, and the spans so far with those of the block."""
        inside = F.aggregate(
            block["texts"],
            F.struct((acc["at"] + F.length(_head(block))).alias("at"), acc["spans"].alias("spans")),
            lambda x, t: F.struct(
                (x["at"] + F.length(t) + 5).alias("at"),
                F.when(block["role"] == ASSISTANT, F.concat(x["spans"], F.array(F.struct(x["at"].alias("start"), F.length(t).alias("length"))))).otherwise(x["spans"]).alias("spans"),
            ),
        )
        return F.struct((inside["at"] - 5 + F.length(_tail(block))).alias("at"), inside["spans"].alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    mask = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), none.alias("spans")), of_block, lambda acc: acc["spans"])
    return merged.select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))


def read_chats(formatted: Column) -> Column:
    """The turns that a formatted string holds: array of (role, text)."""
    blocks = F.filter(F.split(formatted, "</s>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block))
        body = F.when(F.startswith(body, F.lit("[INST]")), F.substring(body, 7, F.length(body) - 13)).otherwise(body)
        plain = unescape(F.regexp_replace(F.substring(role, 4, F.length(role)), "<nl>", "\n"))
        return F.transform(F.split(body, "<sep>"), lambda t: F.struct(plain.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), u AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|sep>|nl>|/?INST\])')) AS n,
         length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|sep>|nl>|/?INST\])')) + 3 * (length(role) - length(replace(role, chr(10), ''))) AS m
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN before IS DISTINCT FROM role THEN 3 + m + 1 + CASE WHEN role = 'assistant' THEN 0 ELSE 6 END ELSE 5 END
                  + CASE WHEN after IS DISTINCT FROM role THEN 5 + CASE WHEN role = 'assistant' THEN 0 ELSE 7 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id"""


@query("op6_chat_format", SQL)
def op6_chat_format(spark, sf_dir):
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    told = chats.select("conv_id", read_chats(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").alias("n"))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
