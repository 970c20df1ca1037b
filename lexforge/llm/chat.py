"""Chat formatting with cumulative-snapshot collapse.

Logs often hold each state of a conversation as a conversation of its own. Hashes of every turn prefix roll along the turns
(running bit_xor of two position-salted 64-bit hashes of role and text: one step a turn). A conversation whose whole hash occurs
as a proper prefix of another goes (anti-join); of conversations with the same turns, the least conv_id stays. What remains is
rendered. Shuffles: one on conv_id, one on the hashes.

Defined results: null roles read as "unknown", null texts as empty; turns go by (turn, role, text), null turns first, and
repeated turn rows count as turns; a null conv_id is a conversation like any other. Markers within texts and roles are broken up; texts of any length are rendered whole. No new column meets those of the input, whatever their names. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """One row a turn: its position k, the hash (h1, h2) of the turns up to it, and the conversation's number of turns n."""
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        t.withColumn("k", F.row_number().over(w))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
        .withColumn("h1", F.bit_xor(F.xxhash64("k", "role", "text")).over(upto))
        .withColumn("h2", F.bit_xor(F.xxhash64("text", F.lit("~"), "k", "role")).over(upto))
    )


def maximal(turns: DataFrame) -> DataFrame:
    """prefixes() of the conversations that stay."""
    p = prefixes(turns)
    whole = p.filter("k = n").select("conv_id", "h1", "h2", "n")
    proper = p.filter("k < n").select("h1", "h2", F.col("k").cast("long").alias("n"))
    w = Window.partitionBy("h1", "h2", "n").orderBy(F.col("conv_id").asc_nulls_last())
    kept = whole.join(proper, ["h1", "h2", "n"], "left_anti").withColumn("r", F.row_number().over(w)).filter("r = 1")
    kept = kept.select(F.col("conv_id").alias("kept_id"))
    return p.join(kept, F.expr("conv_id <=> kept_id"), "left_semi")


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): one row for each conversation that isn't a prefix or copy of another."""
    body = F.expr(f"concat('{OPEN}', replace(role, '<|', '< |'), '\\n', replace(text, '<|', '< |'), '{CLOSE}\\n')")
    return (
        maximal(turns)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("k", body.alias("b")))).alias("x"))
        .select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda e: e["b"]), "").alias("rendered"))
    )


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS pre
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
kept AS (SELECT min(conv_id) AS conv_id FROM p WHERE k = n AND pre NOT IN (SELECT pre FROM p WHERE k < n) GROUP BY pre)
SELECT p.conv_id, count(*) AS n_turns,
  string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10), '' ORDER BY k) AS rendered
FROM p JOIN kept USING (conv_id) GROUP BY p.conv_id"""
