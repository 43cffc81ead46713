"""Chat formatting: collapse logged snapshots of a conversation into the longest, then render."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged) of the conversations that no longer one begins with; of equal ones the least conv_id.

    A turn is its role and text (null as empty); turns stand in order of turn, role, text, nulls first. Two rolling
    64-bit hashes, of the turns so far with their places, stand for a prefix. Full hashes that are among the hashes
    of proper prefixes go by anti-join. Prefixes are made distinct first, so a first turn that a third of the
    conversations share is one row. n_logged: the equal conversations, this one included. Rows whose conv_id is null
    belong to no conversation.
    """
    t = turns.filter("conv_id is not null").select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # texts are shuffled here too: they set turns of equal (turn, role) in order
    t = t.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(7), "role").alias("h2"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("k", F.row_number().over(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select(
        "conv_id", "k",
        F.bit_xor(F.xxhash64("k", "h1")).over(so_far).alias("p1"), F.bit_xor(F.xxhash64("h2", "k")).over(so_far).alias("p2"),
        F.lead("k").over(w).isNull().alias("last"),
    )
    keys = ["k", "p1", "p2"]
    full = t.filter("last").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    proper = t.filter("not last").select(*keys).distinct()
    return full.join(proper, keys, "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_logged")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation in order, each as ``<|im_start|>role``, its text, ``<|im_end|>``."""
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), line.alias("line"))
    rows = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return rows.select("conv_id", F.array_join(F.col("all.line"), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, text) of the maximal conversations; only their turns are shuffled with their texts."""
    kept = maximal_conversations(turns)
    texts = render(turns.join(kept.select("conv_id"), "conv_id", "left_semi"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_logged", "text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), c as (
  select conv_id, count(*) as n_turns, list(struct_pack(r := role, t := text) order by turn, role, text) as whole,
    string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' order by turn, role, text) as rendered
  from t group by conv_id
), d as (
  select min(conv_id) as conv_id, n_turns, count(*) as n_logged, whole, min(rendered) as text from c group by n_turns, whole
), p as (
  select distinct whole[1:k] as part from (select whole, unnest(range(1, n_turns)) as k from d)
)
select conv_id, n_turns, n_logged, text from d where whole not in (select part from p)
"""
