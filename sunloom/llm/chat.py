"""Multi-party perspective rotation (operator 2, DataFrame functions only).

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant, the others as
named users, and masks over what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import keep, table

#: Turn numbers that one row of the result spans at most, and turns that it holds at most.
BLOCK = 256


def _parts(t: DataFrame, block: int) -> DataFrame:
    """Adds part: a turn's rank among the turns of its conversation and block, from 0, divided by `block`.

    Ranks are counted without bringing a conversation together: turns are ordered over all partitions, ranked within
    each, and moved on by the numbers of turns that earlier partitions hold of the same block.
    """
    own = t.withColumn("i", F.monotonically_increasing_id())  # spreads equal rows, whose order is immaterial
    own = keep(own.repartitionByRange("conv_id", "block", "turn", "role", "said", "i").withColumn("pid", F.spark_partition_id()))
    keys = ["pid", "conv_id", "block"]
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("conv_id", "block").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"s_{c}") for c in keys], before.alias("before"))  # a block has a row a partition at most
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("turn", "role", "said", "i")) - 1
    same = (F.col("pid") == F.col("s_pid")) & F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("block") == F.col("s_block"))
    return own.withColumn("rank", rank).join(sizes, same).withColumn("part", F.floor((F.col("rank") + F.col("before")) / block)).select(*t.columns, "part")


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, perspective, block, part, n_turns, n_target, text, mask) from columns conv_id, turn, role, text.

    perspective is a speaker of the conversation; a null role is the speaker "unknown" and a null text is empty. Turns
    stand in the order (turn, role, text), null turns first; turns of one number and repeated rows are all rendered. "<|"
    in a text or name becomes "<||", so none can hold a mark; replacing it back restores them. A
    row holds turns whose number has the same quotient by `block`, `block` of them at most: part counts the rows that a
    block of more turns needs, as do turns without a number, which are block -1 (a `turn` that is no number is null), and
    turns that share one. Blocks and parts in order make up the dialogue. mask lists the character spans [start, end) of
    the row's text that the assistant says, its end mark included. Other columns are neither read nor returned; an empty
    table gives no rows; a null conv_id is a conversation of its own.
    """
    turn = F.expr("try_cast(turn AS BIGINT)")
    t = turns.select(
        "conv_id",
        turn.alias("turn"),
        F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("<||")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<||")).alias("said"),
        F.coalesce(F.floor(turn / F.lit(int(block))), F.lit(-1)).cast("long").alias("block"),
    )
    t = _parts(t, int(block))
    speakers = t.select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    mine = F.col("role") == F.col("perspective")
    head = F.when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>\n")))
    seen = t.join(speakers, t.conv_id.eqNullSafe(speakers.c)).drop("c").withColumn("head", head)
    seen = seen.withColumn("segment", F.concat("head", "said", F.lit("<|end|>\n"))).withColumn("mine", mine)
    in_block = W.partitionBy("conv_id", "perspective", "block", "part").orderBy("turn", "role", "said").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = seen.withColumn("end", F.sum(F.length("segment")).over(in_block)).withColumn("k", F.count(F.lit(1)).over(in_block))
    target = F.struct((F.col("end") - F.length("segment") + F.length("head")).alias("start"), (F.col("end") - 1).alias("end"))
    rows = seen.groupBy("conv_id", "perspective", "block", "part").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.col("mine").cast("long")).alias("n_target"),
        F.array_sort(F.collect_list(F.struct("k", "segment"))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("mine"), target))).alias("mask"),
    )
    return rows.select("conv_id", "perspective", "block", "part", "n_turns", "n_target", F.array_join(F.col("parts.segment"), "").alias("text"), "mask")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


OP2_SQL = """
WITH u AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<||') AS role, replace(coalesce(text, ''), '<|', '<||') AS said,
                  CAST(coalesce(floor(turn / 256.0), -1) AS BIGINT) AS block FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, said) - 1) // 256 AS part FROM u),
s AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t),
v AS (SELECT t.*, perspective, role = perspective AS mine,
             CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || role || '|>' || chr(10) END AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c),
x AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM v),
y AS (SELECT *, sum(length(segment)) OVER w AS e, count(*) OVER w AS k FROM x
      WINDOW w AS (PARTITION BY conv_id, perspective, block, part ORDER BY turn NULLS FIRST, role, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, block, part, count(*) AS n_turns, CAST(sum(CAST(mine AS INT)) AS BIGINT) AS n_target,
       string_agg(segment, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(e - length(segment) + length(head) AS BIGINT) || '-' || CAST(e - 1 AS BIGINT), ',' ORDER BY k) FILTER (mine), '') AS mask
FROM y GROUP BY conv_id, perspective, block, part
"""
