"""Chat formatting: every participant's view of a dialogue, with that speaker as the assistant and a mask of the speaker's words.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import stored, table

# Turns of one row of the result; a longer dialogue goes on in further parts.
PART_TURNS = 256
SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"

# The pieces of one turn as seen by `speaker`: what comes before the words, the words with their end mark, and whether they count.
_HEAD = """concat('<|im_start|>', case when t.who in ({system}) then 'system' when t.who = speaker then 'assistant'
    else concat('user name=', regexp_replace(t.who, '[\\\\s<>|]+', '_')) end, '\\n')"""
# Marks inside the words are broken up, so that no text can end a turn.
_BODY = "concat(replace(t.said, '<|im_', '<| im_'), '<|im_end|>')"


def _pieces(told: DataFrame, part_turns: int) -> DataFrame:
    """`told` with the turns of overfull parts, in order, dealt to further parts of at most `part_turns`.

    Places are counted in ranges, which cut a part into several, and the turns of the part in the ranges before are added.
    """
    over = stored(told.groupBy("conv", "part").agg(F.count("*").alias("n")).where(F.col("n") > part_turns).select(F.col("conv").alias("c"), F.col("part").alias("p")))
    if over.isEmpty():
        return told
    at = told.conv.eqNullSafe(over.c) & (told.part == over.p)
    ranges = stored(told.join(over, at, "left_semi").repartitionByRange("conv", "part", "turn", "who", "said").withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("conv", "part", "range").agg(F.count("*").alias("n"))
    before = counts.selectExpr("conv as c", "part as p", "range as r", "coalesce(sum(n) over (partition by conv, part order by range rows between unbounded preceding and 1 preceding), 0L) as n_before")
    inside = ranges.withColumn("place", F.expr("row_number() over (partition by conv, part, range order by turn, who, said) - 1"))
    placed = inside.join(before, inside.conv.eqNullSafe(before.c) & (inside.part == before.p) & (inside.range == before.r))
    piece = F.expr(f"part + shiftleft(bigint(floor((place + n_before) / {part_turns}D)), 48)")
    return told.join(over, at, "left_anti").unionByName(placed.withColumn("part", piece).select(*told.columns))


def perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
                 system_roles: tuple[str, ...] = SYSTEM_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """(conversation, speaker, part, n_turns, rendered, mask): one row for each participant of each dialogue and each part of it.

    In `rendered` the participant's turns are the assistant's, other participants are named users, and turns of
    `system_roles` stay the system's; these take no view of their own. `mask` has the character spans (from, to) of the
    participant's words with their end marks. Part p holds the turns numbered from p * part_turns on; part -1 holds turns
    without a number too, before the others. A part of more than part_turns turns (repeated or missing numbers) goes on in
    further rows, the n-th of them with part + n * 2^48, so no row holds more than part_turns turns. Turns with one number follow by speaker, then text;
    a turn that repeats another in every column counts once. A null speaker is `unknown`, a null text is empty, and
    a null conversation is one like any other. A dialogue of system turns only, and an empty table, give no rows. Further
    columns are not read. The participants of a dialogue are a distinct over its turns, combined before the shuffle, and
    the join of parts and participants can be split by adaptive execution.
    """
    system = ", ".join("'" + r.replace("\\", "\\\\").replace("'", "\\'") + "'" for r in system_roles) or "''"
    told = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("who"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said")).distinct()
    told = told.withColumn("part", F.expr(f"coalesce(bigint(floor(turn / {part_turns}D)), -1L)"))
    parts = _pieces(told, part_turns).groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("turns"))
    people = told.where(f"who not in ({system})").select("conv", F.col("who").alias("speaker")).distinct()
    met = parts.join(people, parts.conv.eqNullSafe(people.conv)).select(parts.conv, "speaker", "part", "turns")
    pieces = met.withColumn("pieces", F.expr(f"transform(turns, t -> struct({_HEAD.format(system=system)} as head, {_BODY} as body, t.who = speaker as own))"))
    sized = pieces.withColumn("starts", F.expr("transform(pieces, (p, i) -> aggregate(slice(pieces, 1, i), 0L, (s, x) -> s + length(x.head) + length(x.body) + 1) + length(p.head))"))
    return sized.select(
        F.col("conv").alias(conversation), F.col("speaker"), F.col("part"), F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(pieces, p -> concat(p.head, p.body, '\\n')), '')").alias("rendered"),
        F.expr("transform(filter(arrays_zip(pieces, starts), x -> x.pieces.own), x -> struct(x.starts as `from`, x.starts + length(x.pieces.body) as `to`))").alias("mask"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives(table(spark, sf_dir, "conversations"))
    return views.withColumn("mask", F.expr("array_join(transform(mask, m -> concat(m.`from`, ':', m.`to`)), ',')"))
