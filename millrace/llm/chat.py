"""Preference formatting: shared turns of two conversations rendered once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_with_hot_keys, written

#: How a turn is rendered, around its role and its text.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text in order of turn) of each conversation.

    Null roles and texts are empty. Turns of one number are in order of role and text; exact repeats of a row
    count once. A null turn comes first. Rows without conv_id belong to no conversation.
    """
    part = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A conversation becomes one string in the end, so one row holds it.
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), part.alias("p"))
    sorted_turns = each.groupBy("conv_id").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return sorted_turns.select("conv_id", F.transform("p", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))).alias("turns"))


def _rendered(turns: str) -> str:
    return f"transform({turns}, t -> concat('{OPEN}', t.role, '{AFTER_ROLE}', t.text, '{CLOSE}'))".replace("\n", "\\n")


def _spans(turns: str) -> str:
    """From and to (code points in the completion) of each assistant turn's text and end mark: what is trained on."""
    ends = f"aggregate({_rendered(turns)}, cast(array() as array<int>), (a, s) -> concat(a, array(coalesce(try_element_at(a, -1), 0) + length(s))))"
    pairs = f"zip_with({turns}, {ends}, (t, e) -> if(t.role = '{ASSISTANT}', struct(cast(e - length(t.text) - {len(CLOSE)} as long) as start, cast(e as long) as stop), null))"
    return f"filter({pairs}, x -> x is not null)".replace("\n", "\\n")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with columns prompt, n_prompt_turns, chosen_text, rejected_text, chosen_mask, rejected_mask.

    pairs has arrays of (role, text) chosen and rejected. The prompt is the longest prefix of turns that are
    equal in role and text, rendered once; a completion is the rendered rest of its side. A mask is an array of
    (start, stop) in code points of the completion: the assistant's texts with their end marks; all else isn't
    trained on. Equal conversations have empty completions; so has the side that is a prefix of the other. A
    null side is an empty conversation.
    """
    sides = pairs.withColumns({s: F.expr(f"coalesce({s}, cast(array() as array<struct<role:string,text:string>>))") for s in ("chosen", "rejected")})
    least = "least(size(chosen), size(rejected))"
    differs = f"array_position(if({least} = 0, cast(array() as array<boolean>), transform(sequence(0, greatest({least} - 1, 0)), i -> chosen[i] <=> rejected[i])), false)"
    shared = sides.withColumn("_at", F.expr(differs)).withColumn("n_prompt_turns", F.expr(f"cast(if(_at = 0, {least}, _at - 1) as int)")).drop("_at")
    rest = shared.withColumns({f"_{s}": F.expr(f"slice({s}, n_prompt_turns + 1, greatest(size({s}) - n_prompt_turns, 0))") for s in ("chosen", "rejected")})
    out = rest.withColumn("prompt", F.expr(f"array_join({_rendered('slice(chosen, 1, n_prompt_turns)')}, '')"))
    for s in ("chosen", "rejected"):
        out = out.withColumn(f"{s}_text", F.expr(f"array_join({_rendered(f'_{s}')}, '')")).withColumn(f"{s}_mask", F.expr(_spans(f"_{s}")))
    return out.drop("_chosen", "_rejected")


def pair_up(convs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected: one pair for each conversation, as far as there is one.

    Conversations begin alike if their first turns are equal. Each is paired with the first (least conv_id)
    that begins as it does; the one with more assistant text is chosen, at a tie the one of smaller conv_id.
    So a group of n conversations makes n - 1 such pairs, by an equi-join against one row a group, in which a hot
    first turn is dealt out (join_with_hot_keys). The first of its group has nothing to be paired with:
    its last reply is chosen against its reply before, said again in that place (an empty one if there is no
    other). It makes no pair if there is no reply at all.
    """
    said = F.expr(f"aggregate(turns, 0L, (n, t) -> n + if(t.role = '{ASSISTANT}', length(t.text), 0))")
    marked = convs.select("conv_id", "turns", said.alias("said"), F.expr("sha2(concat(length(turns[0].role), ' ', turns[0].role, turns[0].text), 256)").alias("k"))
    marked = written(marked, "conversations")
    first = marked.groupBy("k").agg(F.min_by(F.struct("conv_id", "turns", "said"), "conv_id").alias("a"), F.count("*").alias("n"))
    both = join_with_hot_keys(marked, first, "k", "n", marked.count(), "conv_id")
    wins = F.col("said") > F.col("a.said")
    pick = lambda c, own: F.when(own, F.col(c)).otherwise(F.col(f"a.{c}"))
    pairs = both.where("a.conv_id <> conv_id").select(pick("conv_id", wins).alias("chosen_id"), pick("conv_id", ~wins).alias("rejected_id"), pick("turns", wins).alias("chosen"), pick("turns", ~wins).alias("rejected"))
    replies = F.expr(f"filter(transform(turns, (t, i) -> if(t.role = '{ASSISTANT}', i, null)), i -> i is not null)").alias("r")
    alone = both.where("a.conv_id = conv_id").select("conv_id", "turns", replies).where("size(r) > 0").select("conv_id", "turns", F.expr("element_at(r, -1)").alias("last"), F.expr("try_element_at(r, -2)").alias("before"))
    stale = f"concat(slice(turns, 1, last), array(struct('{ASSISTANT}' as role, coalesce(get(turns, before).text, '') as text)))"
    return pairs.unionByName(alone.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.expr("slice(turns, 1, last + 1)").alias("chosen"), F.expr(stale).alias("rejected")))


def preferences(turns: DataFrame) -> DataFrame:
    """One row per pair of pair_up: chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    chosen and rejected are the completions; masks are text (`start-stop` joined by commas). turns has conv_id,
    turn, role, text; other columns aren't read; an empty table has no pairs.
    """
    done = format_pairs(pair_up(conversations(turns)))
    mask = lambda s: F.expr(f"array_join(transform({s}_mask, m -> concat(m.start, '-', m.stop)), ',')").alias(f"{s}_mask")
    return done.select("chosen_id", "rejected_id", "n_prompt_turns", "prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), mask("chosen"), mask("rejected"))


#: The result of preferences() over the table conversations, for DuckDB.
SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
c AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said, max(i) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id),
b AS (SELECT t.conv_id, max(t.i) AS before FROM t JOIN c USING (conv_id) WHERE role = 'assistant' AND i < last GROUP BY t.conv_id),
f AS (SELECT conv_id, first_value(conv_id) OVER (PARTITION BY role, text ORDER BY conv_id) AS a FROM t WHERE i = 1),
p AS (SELECT CASE WHEN x.said > y.said THEN x.conv_id ELSE y.conv_id END AS chosen_id, CASE WHEN x.said > y.said THEN y.conv_id ELSE x.conv_id END AS rejected_id
  FROM f JOIN c x USING (conv_id) JOIN c y ON y.conv_id = f.a WHERE f.a <> f.conv_id),
s AS (SELECT chosen_id, rejected_id, 'chosen' AS side, i, role, text FROM p JOIN t ON t.conv_id = chosen_id
  UNION ALL SELECT chosen_id, rejected_id, 'rejected', i, role, text FROM p JOIN t ON t.conv_id = rejected_id
  UNION ALL SELECT f.conv_id, f.conv_id, 'chosen', i, role, text FROM f JOIN c USING (conv_id) JOIN t ON t.conv_id = f.conv_id WHERE f.a = f.conv_id AND i <= last
  UNION ALL SELECT f.conv_id, f.conv_id, 'rejected', i, role, text FROM f JOIN c USING (conv_id) JOIN t ON t.conv_id = f.conv_id WHERE f.a = f.conv_id AND i < last
  UNION ALL SELECT f.conv_id, f.conv_id, 'rejected', last, 'assistant', coalesce(t.text, '') FROM f JOIN c USING (conv_id) LEFT JOIN b ON b.conv_id = f.conv_id
    LEFT JOIN t ON t.conv_id = f.conv_id AND t.i = b.before WHERE f.a = f.conv_id AND last IS NOT NULL),
e AS (SELECT chosen_id, rejected_id, i, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM s GROUP BY chosen_id, rejected_id, i),
k AS (SELECT chosen_id, rejected_id, (coalesce(min(i) FILTER (WHERE NOT same), max(i) + 1) - 1)::INTEGER AS n_prompt_turns FROM e GROUP BY chosen_id, rejected_id),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS s FROM s JOIN k USING (chosen_id, rejected_id)),
g AS (SELECT *, sum(CASE WHEN i > n_prompt_turns THEN length(s) ELSE 0 END) OVER (PARTITION BY chosen_id, rejected_id, side ORDER BY i)::BIGINT AS e FROM r)
SELECT chosen_id, rejected_id, any_value(n_prompt_turns) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i <= n_prompt_turns), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i > n_prompt_turns), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'rejected' AND i > n_prompt_turns), '') AS rejected,
  coalesce(string_agg((e - length(text) - 9) || '-' || e, ',' ORDER BY i) FILTER (WHERE side = 'chosen' AND i > n_prompt_turns AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((e - length(text) - 9) || '-' || e, ',' ORDER BY i) FILTER (WHERE side = 'rejected' AND i > n_prompt_turns AND role = 'assistant'), '') AS rejected_mask
FROM g GROUP BY chosen_id, rejected_id
"""
