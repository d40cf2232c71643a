"""Preference formatting of chat conversations, in DataFrame functions only.

A pair holds a chosen and a rejected conversation, each a list of turns (role, text). Their longest
common prefix of equal turns is rendered once as the prompt; what is left of each side is its
completion, with a mask of runs (n, trained): n characters (code points), trained if they are the text
of an assistant's turn with its end mark. The marks of the format are not escaped inside texts.

A null list of turns counts as empty; null roles and texts render as empty and equal each other. Equal
sides give two empty completions; if one side begins with all of the other, the shorter one's
completion is empty. Repeated pairs give repeated results, an empty table an empty one.

with_swapped_reply() makes pairs from plain conversations: rejected is the conversation with its last
assistant turn replaced by the last assistant turn of its partner, the conversation whose id differs
in the last bit. Without a partner, or if the partner has no reply, rejected ends before that turn.
Without an assistant turn rejected equals chosen. Rows that repeat whole are one turn; several turns of
one number go by role and text. Null ids form one conversation without a partner. A conversation is
one training example and has to fit in a row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    def run(text: Column, trained: Column) -> Column:
        return F.struct(F.char_length(text).alias("n"), trained.alias("trained"))

    return F.flatten(F.transform(turns, lambda t: F.array(
        run(_head(t), F.lit(False)), run(_body(t), F.coalesce(t["role"] == TRAINED, F.lit(False))))))


def prefix_length(a: Column, b: Column) -> Column:
    """Number of turns that both lists begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def format_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """(key, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) for every row of pairs
    (key, chosen, rejected: array<struct<role, text>>)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    p = pick(pairs, key, "chosen", "rejected").toDF("_key", "_chosen", "_rejected").select(
        "_key", F.coalesce("_chosen", none).alias("_chosen"), F.coalesce("_rejected", none).alias("_rejected"))
    p = p.withColumn("_n", prefix_length(F.col("_chosen"), F.col("_rejected")))
    rest = {c: F.slice(F.col(f"_{c}"), F.col("_n") + 1, F.size(f"_{c}") - F.col("_n")) for c in ("chosen", "rejected")}
    return p.select(F.col("_key").alias(key), F.col("_n").alias("prompt_turns"), render(F.slice("_chosen", F.lit(1), F.col("_n"))).alias("prompt"),
                    *[render(t).alias(c) for c, t in rest.items()], *[mask(t).alias(f"{c}_mask") for c, t in rest.items()])


def with_swapped_reply(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation of turns (conv_id, turn, role, text). The rows
    are shuffled once, by what two partners have in common."""
    t = pick(turns, "conv_id", "turn", "role", "text").withColumn("pair", F.shiftright("conv_id", 1))
    each = (t.repartition("pair").groupBy("pair", "conv_id")
            .agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
            .select("pair", "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("chosen")))
    backwards = F.reverse(F.transform("chosen", lambda x: F.coalesce(x["role"] == TRAINED, F.lit(False))))
    at = F.array_position(backwards, True)
    each = (each.withColumn("at", F.when(at > 0, F.size("chosen") - at + 1).otherwise(0).cast("int"))
            .withColumn("reply", F.when(F.col("at") > 0, F.get("chosen", F.col("at") - 1))))
    by = Window.partitionBy("pair").orderBy("conv_id")
    other = F.when(F.col("pair").isNotNull(), F.coalesce(F.lag("reply").over(by), F.lead("reply").over(by)))
    each = each.withColumn("other", other)
    rejected = (F.when(F.col("at") == 0, F.col("chosen"))
                .when(F.col("other").isNull(), F.slice("chosen", F.lit(1), F.col("at") - 1))
                .otherwise(F.transform("chosen", lambda x, i: F.when(i == F.col("at") - 1, F.col("other")).otherwise(x))))
    return each.select("conv_id", "chosen", rejected.alias("rejected"))


def mask_text(runs: Column) -> Column:
    """A mask as text: n+ for trained runs and n- for others."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["n"].cast("string"), F.when(r["trained"], "+").otherwise("-"))), "")


SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
conv AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chosen,
         list(coalesce(role, '') = '{TRAINED}' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS replies
  FROM turns GROUP BY conv_id),
placed AS (
  SELECT conv_id, chosen, coalesce(list_max(list_transform(range(1, len(replies) + 1), lambda i: CASE WHEN replies[i] THEN i ELSE 0 END)), 0) AS spot
  FROM conv),
paired AS (
  SELECT a.conv_id, a.chosen, a.spot, CASE WHEN b.spot > 0 THEN b.chosen[b.spot] END AS other
  FROM placed a LEFT JOIN placed b ON b.conv_id = xor(a.conv_id, 1)),
sides AS (
  SELECT conv_id, chosen, CASE WHEN spot = 0 THEN chosen WHEN other IS NULL THEN chosen[1:spot - 1]
         ELSE list_transform(range(1, len(chosen) + 1), lambda i: CASE WHEN i = spot THEN other ELSE chosen[i] END) END AS rejected
  FROM paired),
cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1),
         lambda i: i > len(chosen) OR i > len(rejected) OR chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) AS n
  FROM sides),
parts AS (
  SELECT conv_id, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM cut)
SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns,
  {{p}} AS prompt, {{c}} AS chosen, {{r}} AS rejected, {{mc}} AS chosen_mask, {{mr}} AS rejected_mask
FROM parts
"""
_head_sql = f"'{START}' || coalesce(x.role, '') || chr(10)"
_body_sql = f"coalesce(x.text, '') || '{END.strip()}' || chr(10)"
for _name, _list in (("p", "p"), ("c", "c"), ("r", "r")):
    SQL = SQL.replace("{" + _name + "}", f"coalesce(array_to_string(list_transform({_list}, lambda x: {_head_sql} || {_body_sql}), ''), '')")
for _name, _list in (("mc", "c"), ("mr", "r")):
    SQL = SQL.replace("{" + _name + "}", f"""coalesce(array_to_string(list_transform({_list}, lambda x: length({_head_sql}) || '-' || length({_body_sql})
    || CASE WHEN x.role = '{TRAINED}' THEN '+' ELSE '-' END), ''), '')""")
