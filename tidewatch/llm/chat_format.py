"""Preference formatting: the turns that chosen and rejected share once as prompt, then two masked completions.

A turn is rendered as `<|role|>`, newline, text, `<|end|>`, newline. In a completion only what an assistant says is trained
on: its text and end mark, not the headers and not other roles' turns. Masks are spans of characters, so
they hold for any tokenizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.merkle import placed
from tidewatch.sources.storage import checkpointed

_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) from one row per turn: a conversation's turns in the order (turn, role, text), nulls first.

    Rows with a null id belong to no conversation and are left out; repeated rows are repeated turns.
    """
    return (turns.where(F.col(id_col).isNotNull())
            .groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))).alias("turns")))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """Character spans of what assistants say in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(done, turn):
        begin = done["at"] + F.length(_header(turn))
        end = begin + F.length(_body(turn))
        mine = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(done["spans"], mine)).otherwise(done["spans"]).alias("spans"))
    return F.aggregate(turns, start, step, lambda done: done["spans"])


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds to (.., chosen turns, rejected turns): n_prompt_turns, prompt, and for both sides the completion and its spans.

    Turns are equal if role and text are (nulls equal each other); the turn number doesn't count. If one side is the
    beginning of the other, its completion is empty, as both are for equal sides. A null text or role is rendered empty, a
    null side has no turns. Rows that repeat give a result each. Other columns stay, but for those with the name of a result,
    which the result replaces. Sides are rendered whole, whatever their length: a row is as large as its conversation.
    """
    sides = {x: F.coalesce(F.col(f"`{c}`"), F.array().cast(_TURNS)) for x, c in (("chosen", chosen), ("rejected", rejected))}
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *_RESULTS)]
    both = pairs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("kept"), sides["chosen"].alias("c"), sides["rejected"].alias("r"))
    n = F.least(F.size("c"), F.size("r"))
    same = lambda i: F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | ~same(i))
    both = both.withColumn("n", F.get(differ, F.lit(0)))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    values = [F.col("n"), _rendered(F.slice("c", F.lit(1), F.col("n"))), _rendered(rest("c")), _rendered(rest("r")), _spans(rest("c")), _spans(rest("r"))]
    return both.select(*[F.col(f"kept.`{c}`") for c in kept], *[v.alias(name) for v, name in zip(values, _RESULTS)])


_RESULTS = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")


def exchanged_answers(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, chosen, rejected): each conversation that has an answer, and the same with the answers of the next one that has any.

    Next is by id, the last one's next is the first; a single answered conversation makes no pair. The n-th answer of one takes
    the place of the n-th of the other; where that has fewer, the own ones stay. All other turns, also after the last answer, are
    those of both sides. So the sides part at the first answer that differs, and are equal if none does.
    """
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    rows = checkpointed(rows.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
                        .withColumn("answer", F.when(F.col("role") == "assistant", F.row_number().over(Window.partitionBy("id", "role").orderBy(*order)))), "turns")
    answers = rows.where("answer IS NOT NULL").select("id", "answer", F.col("text").alias("other"))
    ids = placed(answers.select(F.lit("").alias("tree"), "id").distinct(), ["id"]).where("n > 1")
    following = ids.select("id", ((F.col("place") + 1) % F.col("n")).alias("place")).join(ids.select("place", F.col("id").alias("next")), "place").select("id", "next")
    theirs = following.join(answers.withColumnRenamed("id", "next"), "next").select("id", "answer", "other", F.lit(True).alias("taken"))
    both = rows.join(following.select("id"), "id", "left_semi").join(theirs, ["id", "answer"], "left")
    side = lambda text: F.transform(F.sort_array(F.collect_list(F.struct("at", "turn", "role", text.alias("text")))), lambda t: t.dropFields("at"))
    return both.groupBy("id").agg(side(F.col("text")).alias("chosen"), side(F.when(F.col("taken"), F.col("other")).otherwise(F.col("text"))).alias("rejected")
                                  ).withColumnRenamed("id", id_col)


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    """Each answered conversation as chosen; as rejected the same with the answers of the next answered one."""
    pairs = exchanged_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return preference_pairs(pairs).select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


def _side(name: str, text: str) -> str:
    return f"""
{name} AS (SELECT conv_id, string_agg(head || body, '' ORDER BY p) AS {name},
    string_agg((till - length(body)) || '-' || till, ',' ORDER BY p) FILTER (role = 'assistant') AS {name}_spans
  FROM (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id ORDER BY p)::BIGINT AS till
        FROM (SELECT conv_id, p, role, '<|' || coalesce(role, '') || e'|>\n' AS head, coalesce({text}, '') || e'<|end|>\n' AS body
              FROM side JOIN parts USING (conv_id) WHERE p >= parts)) GROUP BY conv_id)"""


ORACLE = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p,
    row_number() OVER (PARTITION BY conv_id, role ORDER BY turn NULLS FIRST, text NULLS FIRST) AS j FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next, count(*) OVER () AS n
        FROM (SELECT DISTINCT conv_id FROM t WHERE role = 'assistant')),
side AS (SELECT t.conv_id, t.p, t.role, t.text, CASE WHEN o.j IS NULL THEN t.text ELSE o.text END AS other
         FROM t JOIN ids ON ids.conv_id = t.conv_id AND n > 1
         LEFT JOIN t o ON o.conv_id = ids.next AND o.role = 'assistant' AND t.role = 'assistant' AND o.j = t.j),
parts AS (SELECT conv_id, coalesce(min(p) FILTER (text IS DISTINCT FROM other), count(*) + 1) AS parts FROM side GROUP BY conv_id),
prompt AS (SELECT conv_id, string_agg('<|' || coalesce(role, '') || e'|>
' || coalesce(text, '') || e'<|end|>
', '' ORDER BY p) AS prompt
           FROM side JOIN parts USING (conv_id) WHERE p < parts GROUP BY conv_id),""" + _side("chosen", "text") + "," + _side("rejected", "other") + """
SELECT conv_id, (parts - 1)::INTEGER AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected_spans, '') AS rejected_spans
FROM parts LEFT JOIN prompt USING (conv_id) LEFT JOIN chosen USING (conv_id) LEFT JOIN rejected USING (conv_id)
"""
