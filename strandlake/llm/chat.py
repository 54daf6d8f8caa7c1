"""Preference formatting of conversations, with DataFrame functions only.

Chosen and rejected conversations of a pair are compared turn by turn; the longest common prefix is rendered once as the prompt, and what is left
of each side as its completion. A mask marks the characters that count for the loss: the texts of the assistant's turns in the completions, with their end
marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for every pair_id of either side.

    Both sides have rows (pair_id, turn, role, text). Turns are in the order of turn (null first), then role and text, so that repeated rows and ties have
    a place; numbers need not be consecutive. Turns are equal if role and text are (null equals null); null texts and roles render as
    empty. A side without rows has an empty completion, as has one that is a prefix of the other. Masks are "start:end" in code points
    of the completion, end exclusive, comma-joined. A null pair_id is a pair. Other columns are not used, whatever their names. Very
    long conversations and texts are rendered whole. Empty tables give no rows.
    """
    sides = [
        side.select("pair_id", F.struct("turn", "role", "text").alias("t"), F.lit(name).alias("side")) for side, name in ((chosen, "c"), (rejected, "r"))
    ]
    # one row for each pair: the turns of a conversation stay together, as a training row holds them anyway
    pairs = sides[0].union(sides[1]).groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in "cr"))
    common = F.least(F.size("c"), F.size("r"))
    places = F.when(common > 0, F.sequence(F.lit(1), common)).otherwise(F.array().cast("array<int>"))

    def same(i: Column) -> Column:
        a, b = F.element_at("c", i), F.element_at("r", i)
        return a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text)

    differs = F.filter(places, lambda i: ~same(i))
    prefix = F.when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(common)
    pairs = pairs.withColumn("prompt_turns", prefix)

    def text_of(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: rendered(t.role, t.text)), "")

    def mask(turns: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            head = F.length(F.concat(F.lit(OPEN), F.coalesce(t.role, F.lit("")), F.lit(MIDDLE)))
            end = acc.at + F.length(rendered(t.role, t.text))
            span = F.concat_ws(":", acc.at + head, end)
            return F.struct(end.alias("at"), F.when(F.coalesce(t.role == LEARNED, F.lit(False)), F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

        return F.array_join(F.aggregate(turns, empty, step).spans, ",")

    rest = {s: F.expr(f"slice({s}, prompt_turns + 1, greatest(size({s}) - prompt_turns, 0))") for s in "cr"}
    return pairs.select(
        "pair_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        text_of(F.expr("slice(c, 1, prompt_turns)")).alias("prompt"),
        text_of(rest["c"]).alias("chosen"),
        text_of(rest["r"]).alias("rejected"),
        mask(rest["c"]).alias("chosen_mask"),
        mask(rest["r"]).alias("rejected_mask"),
    )


def preference_sides(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations (conv_id, turn, role, text): chosen is the conversation; in rejected, the text of its last assistant turn is
    that of the last assistant turn of conversation conv_id + 1. Conversations without either have no rejected side."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = rows.where(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("m.text").alias("other"))
    plan = last.join(other, "pair_id").select("pair_id", F.col("m.turn").alias("last_turn"), "other")
    rejected = rows.join(plan, "pair_id").where(F.col("turn") <= F.col("last_turn"))
    replaced = (F.col("turn") == F.col("last_turn")) & (F.col("role") == LEARNED)
    return rows, rejected.select("pair_id", "turn", "role", F.when(replaced, F.col("other")).otherwise(F.col("text")).alias("text"))


ORACLE = """
WITH last AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS m FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
plan AS (SELECT a.conv_id, a.m.turn AS last_turn, b.m.text AS other FROM last a JOIN last b ON b.conv_id = a.conv_id + 1),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text FROM conversations),
r0 AS (SELECT v.conv_id, turn, role, CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END AS text
       FROM conversations v JOIN plan USING (conv_id) WHERE turn <= last_turn),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text FROM r0),
sizes AS (SELECT conv_id, (SELECT count(*) FROM c WHERE c.conv_id = i.conv_id) AS nc, (SELECT count(*) FROM r WHERE r.conv_id = i.conv_id) AS nr
          FROM (SELECT DISTINCT conv_id FROM conversations) i),
cut AS (SELECT s.conv_id, coalesce(min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN c.k - 1 END), any_value(least(nc, nr))) AS p
        FROM sizes s LEFT JOIN c ON c.conv_id = s.conv_id LEFT JOIN r ON r.conv_id = c.conv_id AND r.k = c.k
        WHERE r.k IS NOT NULL OR nr = 0 GROUP BY s.conv_id),
turns AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
shown AS (SELECT side, t.conv_id, k, p, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
                 '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS full_text
          FROM turns t JOIN cut USING (conv_id)),
placed AS (SELECT *, sum(CASE WHEN k > p THEN length(full_text) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY k) AS ends FROM shown)
SELECT conv_id AS pair_id, any_value(p)::BIGINT AS prompt_turns,
       coalesce(string_agg(CASE WHEN side = 'c' AND k <= p THEN full_text END, '' ORDER BY k), '') AS prompt,
       coalesce(string_agg(CASE WHEN side = 'c' AND k > p THEN full_text END, '' ORDER BY k), '') AS chosen,
       coalesce(string_agg(CASE WHEN side = 'r' AND k > p THEN full_text END, '' ORDER BY k), '') AS rejected,
       coalesce(string_agg(CASE WHEN side = 'c' AND k > p AND role = 'assistant' THEN (ends - length(full_text) + length(head))::BIGINT || ':' || ends::BIGINT END, ',' ORDER BY k), '') AS chosen_mask,
       coalesce(string_agg(CASE WHEN side = 'r' AND k > p AND role = 'assistant' THEN (ends - length(full_text) + length(head))::BIGINT || ':' || ends::BIGINT END, ',' ORDER BY k), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
