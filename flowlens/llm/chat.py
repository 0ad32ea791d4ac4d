"""Chat formatting by cumulative-snapshot collapse.

Logs often hold a conversation several times, once after each turn. A rolling hash over the turns
names every prefix; a conversation whose whole hash is a proper prefix of another goes, by an
anti-join, and what is left is rendered. DataFrame functions only.

Scale: a conversation is one row from the first aggregate on, as its rendered text must be; prefixes
are made distinct map-side before any join, so one very common first turn is one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.lineage import cut

#: The marks of the public ChatML format.
START, END = "<|im_start|>", "<|im_end|>"


def _next_hash(done: Column, turn: Column) -> Column:
    """Hash of a prefix from the hash of the prefix one turn shorter."""
    before = F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
    return F.sha2(F.concat(before, F.length(turn["role"]).cast("string"), F.lit(":"), turn["role"], turn["text"]), 256)


def _render(turn: Column) -> Column:
    body = F.replace(turn["text"], F.lit("<|"), F.lit("< |"))  # a text cannot forge a mark
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), body, F.lit(f"{END}\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, text.

    Turns are ordered by turn (null first), role and text; a repeated row is a repeated turn. A null
    role or text is empty. Of conversations with the same turns the smallest conv_id stays; rows
    with a null conv_id form one conversation. Other columns are not read.
    """
    blank = F.lit("")
    packed = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("turns"))
    hashes = F.aggregate("turns", F.array().cast("array<string>"), lambda done, t: F.concat(done, F.array(_next_hash(done, t))))
    convs = cut(convs.withColumn("hashes", hashes).withColumn("whole", F.element_at("hashes", -1)))
    prefixes = convs.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("whole")).distinct()
    longest = convs.groupBy("whole").agg(F.min("conv_id").alias("keep")).join(prefixes, "whole", "left_anti")
    kept = convs.alias("c").join(longest.alias("l"), F.expr("c.conv_id <=> l.keep and c.whole = l.whole"), "left_semi")
    return kept.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", _render)).alias("text"),
    )


SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations),
p as (
  select conv_id, k, count(*) over (partition by conv_id) as n,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (partition by conv_id order by k) as prefix
  from t),
longest as (
  select min(conv_id) as conv_id from p w
  where k = n and prefix not in (select prefix from p where k < n) group by prefix)
select t.conv_id, count(*) as n_turns,
  string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by k) as text
from t join longest on t.conv_id is not distinct from longest.conv_id group by t.conv_id
"""
