"""Preference formatting of conversations, with DataFrame functions only.

A pair of conversations (chosen, rejected) shares the turns up to their first
difference. Those are rendered once as the prompt; the turns after it are the
two completions, in which assistant turns are trained on and others are masked.
A record holds prompt, both completions and their masks; a pair of very many
turns is given as several records in order, each of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Turn numbers per record. A longer conversation gives further records; nothing is cut.
CHUNK_TURNS = 256


def turn_text(role: Column, text: Column) -> Column:
    """One turn in role-tagged form."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def clean_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): nulls of role and text as empty; of rows with one id and turn the least stays.

    Rows without conversation id or turn number cannot be placed and are left out.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("body"),
    ).where("conv_id is not null and turn is not null")
    return rows.groupBy("conv_id", "turn").agg(F.min("body").alias("body")).select("conv_id", "turn", "body.role", "body.text")


def with_rejected(turns: DataFrame) -> DataFrame:
    """Both sides of every conversation of ``clean_turns``: (pair_id, is_chosen, turn, role, text).

    Chosen is the conversation as it stands. Rejected is the same up to its last
    assistant turn, which is replaced by the last assistant turn of the
    conversation with the next id; where that has none or the same text, by the
    first half of the own one; an empty own turn is left out instead. A
    conversation without an assistant turn has no rejected side.
    """
    last = materialize(turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", F.col("m.turn").alias("at"), F.col("m.text").alias("reply")))
    donor = last.select(F.expr("try_subtract(conv_id, 1L)").alias("conv_id"), F.col("reply").alias("other"))
    half = F.when(F.length("reply") > 0, F.expr("substring(reply, 1, length(reply) div 2)"))
    replaced = last.join(donor, "conv_id", "left").select("conv_id", "at", F.when(F.col("other") != F.col("reply"), F.col("other")).otherwise(half).alias("text"))
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit(True).alias("is_chosen"), "turn", "role", "text")
    before = turns.join(replaced.select("conv_id", "at"), "conv_id").where("turn < at").select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("is_chosen"), "turn", "role", "text")
    ending = replaced.where("text is not null").select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("is_chosen"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen.unionByName(before).unionByName(ending)


def preference_turns(sides: DataFrame) -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen, rejected), turn, role, rendered, trained.

    ``sides`` has (pair_id, is_chosen, turn, role, text), one row per pair, side
    and turn. The sides meet turn by turn; the first turn that differs or that
    one side lacks ends the prompt. A side without partner is all completion, so
    no turn is lost. A completion keeps its masked turns (``trained`` false)
    next to the trained ones.
    """
    # each (pair, turn) has at most two rows; the group is bounded
    both = materialize(
        sides.groupBy("pair_id", "turn").agg(
            F.max(F.when(F.col("is_chosen"), F.struct("role", "text"))).alias("c"), F.max(F.when(~F.col("is_chosen"), F.struct("role", "text"))).alias("r")
        )
    )
    # a gap in the numbering is a difference too: turn t is shared only if all smaller numbers present are
    fork = materialize(both.where(~F.coalesce(F.col("c") == F.col("r"), F.lit(False))).groupBy("pair_id").agg(F.min("turn").alias("fork")))
    told = both.join(fork, "pair_id", "left")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("body")))).otherwise(
        F.filter(F.array(F.struct(F.lit("chosen").alias("part"), F.col("c").alias("body")), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("body"))), lambda p: p["body"].isNotNull())
    )
    return told.select("pair_id", "turn", F.explode(parts).alias("p")).select(
        "pair_id",
        "p.part",
        "turn",
        "p.body.role",
        turn_text(F.col("p.body.role"), F.col("p.body.text")).alias("rendered"),
        ((F.col("p.part") != "prompt") & (F.col("p.body.role") == "assistant")).alias("trained"),
    )


def preference_records(parts: DataFrame, *, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Paired records: pair_id, chunk, prompt, chosen, rejected, chosen_trained, rejected_trained.

    A mask is an array of (start, end) stretches, in code points of the record's
    completion, that are trained on. A chunk spans ``chunk_turns`` turn numbers,
    so a record gathers at most that many turns of each part; the records of a
    pair in the order of ``chunk`` hold all its turns. Missing parts are empty.
    """
    chunk = F.floor(F.col("turn") / chunk_turns).cast("long") if chunk_turns & (chunk_turns - 1) else F.shiftright("turn", chunk_turns.bit_length() - 1)
    rows = parts.withColumn("chunk", chunk).groupBy("pair_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "part", "rendered", "trained"))).alias("turns"))

    def of(part: str) -> Column:
        return F.filter("turns", lambda x: x["part"] == part)

    def text(part: str) -> Column:
        return F.array_join(F.transform(of(part), lambda x: x["rendered"]), "")

    kind = "struct<at:int,out:array<struct<start:int,end:int>>>"

    def mask(part: str) -> Column:
        def step(s: Column, x: Column) -> Column:
            end = s["at"] + F.length(x["rendered"])
            return F.struct(end.alias("at"), F.when(x["trained"], F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

        return F.aggregate(of(part), F.from_json(F.lit('{"at":0,"out":[]}'), kind), step, lambda s: s["out"])

    return rows.select("pair_id", "chunk", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), mask("chosen").alias("chosen_trained"), mask("rejected").alias("rejected_trained"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Paired records of a table (conv_id, turn, role, text), each conversation against its altered form.

    Null roles and texts are empty; rows without id or turn are left out; of
    repeated rows and of ties in (id, turn) one row counts, the least; other
    columns are not read; an empty table gives an empty result. Texts of any
    length are rendered whole.
    """
    return preference_records(preference_turns(with_rejected(clean_turns(turns))))


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")


#: The records in SQL, masks as text.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS body
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), c AS (SELECT conv_id AS pair_id, turn, body.role AS role, body.text AS text FROM t),
l AS (SELECT pair_id, max(turn) AS last, arg_max(text, turn) AS reply FROM c WHERE role = 'assistant' GROUP BY pair_id),
p AS (
  SELECT l.pair_id, l.last, CASE WHEN o.reply <> l.reply THEN o.reply WHEN length(l.reply) > 0 THEN left(l.reply, length(l.reply) // 2) END AS text
  FROM l LEFT JOIN l o ON o.pair_id = l.pair_id + 1
), r AS (
  SELECT c.pair_id, c.turn, c.role, c.text FROM c JOIN p USING (pair_id) WHERE c.turn < p.last
  UNION ALL SELECT pair_id, last, 'assistant', text FROM p WHERE text IS NOT NULL
), b AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text,
         coalesce(c.role = r.role AND c.text = r.text, FALSE) AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn
), f AS (SELECT pair_id, min(turn) AS fork FROM b WHERE NOT same GROUP BY pair_id),
s AS (SELECT b.*, (f.fork IS NULL OR b.turn < f.fork) AS shared FROM b LEFT JOIN f USING (pair_id)),
o AS (
  SELECT pair_id, 'prompt' AS part, turn, c_role AS role, c_text AS text FROM s WHERE shared
  UNION ALL SELECT pair_id, 'chosen', turn, c_role, c_text FROM s WHERE NOT shared AND c_role IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, r_role, r_text FROM s WHERE NOT shared AND r_role IS NOT NULL
), d AS (
  SELECT pair_id, CAST(floor(turn / 256.0) AS BIGINT) AS chunk, part, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x, part <> 'prompt' AND role = 'assistant' AS trained FROM o
), e AS (SELECT *, sum(length(x)) OVER (PARTITION BY pair_id, chunk, part ORDER BY turn) AS z FROM d)
SELECT pair_id, chunk, coalesce(string_agg(x, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(x, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(x, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg((z - length(x)) || ':' || z, ',' ORDER BY turn) FILTER (part = 'chosen' AND trained), '') AS chosen_trained,
       coalesce(string_agg((z - length(x)) || ':' || z, ',' ORDER BY turn) FILTER (part = 'rejected' AND trained), '') AS rejected_trained
FROM e GROUP BY pair_id, chunk
"""
