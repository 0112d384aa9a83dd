"""Perspective rotation: one rendering of a dialogue for every participant.

The participant of a rendering speaks as the assistant; all others are users under their own
names; system turns stay system turns. The loss mask covers what the assistant says and its end
mark, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, participant, n_turns, rendered, mask, trained_chars), a row per participant.

    ``mask`` is a run-length list ``flag:length`` in characters of ``rendered``; the lengths add
    up to its length. Turns are ordered by (turn, role, text), nulls first, so ties have one order
    and repeated rows are repeated turns. A null role is the participant ``unknown``, a null text
    is empty, a null conversation id is a conversation. System turns make no participant; a
    dialogue of system turns only gives no rows. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    talks = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    talkers = F.array_remove(F.array_distinct(F.col("_turns.role")), "system")
    views = talks.select("_conv", "_turns", F.explode(talkers).alias("_me"))

    def head(t):
        return (
            F.when(t["role"] == F.col("_me"), F.lit("<|assistant|>\n"))
            .when(t["role"] == "system", F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), t["role"], F.lit("|>\n")))
        )

    def runs(t):
        kept = F.length(t["text"]) + len(END)
        mine = F.concat_ws("", F.lit("0:"), F.length(head(t)), F.lit(",1:"), kept, F.lit(",0:1"))
        return F.when(t["role"] == F.col("_me"), mine).otherwise(
            F.concat_ws("", F.lit("0:"), F.length(head(t)) + kept + 1)
        )

    said = F.transform("_turns", lambda t: F.concat(head(t), t["text"], F.lit(END + "\n")))
    counts = F.transform(
        F.filter("_turns", lambda t: t["role"] == F.col("_me")),
        lambda t: (F.length(t["text"]) + len(END)).cast("bigint"),
    )
    return views.select(
        F.col("_conv").alias(conv),
        F.col("_me").alias("participant"),
        F.size("_turns").alias("n_turns"),
        F.array_join(said, "").alias("rendered"),
        F.array_join(F.transform("_turns", runs), ",").alias("mask"),
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("trained_chars"),
    )


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
talkers AS (SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> 'system'),
views AS (
  SELECT k.conv_id, k.participant, t.turn, t.role, t.text, t.role = k.participant AS mine,
    CASE WHEN t.role = k.participant THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
         ELSE '<|user:' || t.role || '|>' END || chr(10) AS head
  FROM talkers k JOIN turns t ON t.conv_id IS NOT DISTINCT FROM k.conv_id)
SELECT conv_id, participant, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || text || '{END}' || chr(10), ''
             ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered,
  string_agg(CASE WHEN mine THEN '0:' || length(head) || ',1:' || (length(text) + {len(END)}) || ',0:1'
                  ELSE '0:' || (length(head) + length(text) + {len(END) + 1}) END, ','
             ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS mask,
  CAST(sum(CASE WHEN mine THEN length(text) + {len(END)} ELSE 0 END) AS BIGINT) AS trained_chars
FROM views GROUP BY conv_id, participant"""
