"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and
only its text is trainable. Turns after the last assistant turn (all turns, where there is
none) are kept by one more example without a trainable part, so the output holds every turn.

The template writes a turn as ``<|start|>role<|text|>text<|end|>``. Inside roles and texts
each ``<``, ``[`` and ``\\`` is followed by an added ``\\``; so no control string of this or
of the usual templates (``</s>``, ``[INST]``, ``<|...|>``) can stand there, and dropping the
character after each of the three, left to right, restores the text.

Turns are ordered by turn (null first), then role, then text; repeated rows are all kept.
Null text or role counts as empty. Null conversation ids form one conversation. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def examples(conversations: DataFrame, reply: str = "assistant") -> DataFrame:
    """Rows conv_id, example (from 1), text, loss_start, loss_end (code points; equal: nothing trainable)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = escape(text)
    head = F.concat(F.lit(START), escape(role), F.lit(TEXT))
    turn = F.struct("turn", role.alias("role"), text.alias("said"), F.concat(head, marked, F.lit(END)).alias("piece"),
                    F.length(head).alias("head"), F.length(marked).alias("long"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (F.get(F.col("turns"), k - 1)["role"] == reply) | (k == n))
    made = whole.select("conv_id", "turns", F.posexplode(ends).alias("pos", "k"))
    last = F.get(F.col("turns"), F.col("k") - 1)
    body = F.array_join(F.transform(F.slice("turns", 1, F.col("k")), lambda t: t["piece"]), "")
    made = made.select("conv_id", (F.col("pos") + 1).alias("example"), body.alias("text"), last.alias("last"))
    start = F.length("text") - len(END) - F.col("last.long")
    answers = F.col("last.role") == reply
    return made.select("conv_id", "example", "text", F.when(answers, start).otherwise(0).alias("loss_start"),
                       F.when(answers, start + F.col("last.long")).otherwise(0).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses examples: for each conversation its turns (array of role, text) and trained texts, in order."""
    loss = F.struct("example", F.expr("substring(text, loss_start + 1, loss_end - loss_start)").alias("loss"))
    whole = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"), F.sort_array(F.collect_list(loss)).alias("losses"), F.sum(F.length("text")).alias("formatted_chars"))
    cut = F.transform(F.slice(F.split("longest", r"<\|end\|>", -1), 1, F.size(F.split("longest", r"<\|end\|>", -1)) - 1), lambda t: F.split(t, r"<\|text\|>", -1))
    turns = F.transform(cut, lambda t: F.struct(unescape(F.substring(F.get(t, 0), len(START) + 1, 2**31 - 1)).alias("role"), unescape(F.get(t, 1)).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: unescape(x["loss"])).alias("losses"), "formatted_chars")


def digest(conversations: DataFrame) -> DataFrame:
    """The examples of all conversations and of conversation -1, read back and digested."""
    spark = conversations.sparkSession
    hard = "</s>[INST] ok [/INST]"
    two = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"))
    more = two.withColumn("text", F.lit(hard))
    every = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    back = read_back(examples(every))
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


#: DuckDB SQL for digest().
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, 24 + length(regexp_replace(role, '[<\[\\]', 'xx', 'g')) + length(regexp_replace(text, '[<\[\\]', 'xx', 'g')) AS piece,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
e AS (SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
