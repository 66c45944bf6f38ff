"""Multi-party perspective rotation of dialogues.

A dialogue is rendered once for each participant: that speaker's turns as the
assistant's, the others' as users' with their names, system turns as they are. Turns that are not
the assistant's have an empty mask at their start, and only users' have a name.
The mask covers what the assistant says and the mark that ends it, nothing else.

A rendering is a sequence of segments, one for each turn, with its place in the
whole, so a dialogue of any length stays distributed: joining segments by start
gives the text. Places are prefix sums in two levels, within stretches of
STRETCH turns and over stretches, so that no task needs a dialogue's turns at
once. Only participants of a dialogue meet its turns.

Defined cases: a null speaker is ``unknown``; null text is empty; a null turn
comes first; equal turn numbers go by speaker, then text; repeated rows are
rendered each; a dialogue of system turns only has no participant and no row;
rows without a dialogue id form one dialogue; marks inside a text are broken by
a space, so that text cannot end a turn; signs that would end a head are spelt
out in names, each its own way; texts of any length are one segment; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.llm.common import cut

STRETCH = 256
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Signs that a shown name must not hold, and the one that spells them, so that different speakers have different names.
SPELT = {c: f"%{ord(c):02X}" for c in "% \t\n\x0b\x0c\r<|>"}


def rotate(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """Per dialogue, perspective and turn: role, name, segment, start, mask_start, mask_length (places in the whole, in characters)."""
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    safe = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    name = speaker
    for sign, spelt in SPELT.items():
        name = F.replace(name, F.lit(sign), F.lit(spelt))
    turns = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), name.alias("shown"), safe.alias("said"))
    turns = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60))))
    people = turns.filter(F.col("speaker") != system).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    people = cut(people)
    seen = turns.join(people, turns["conv_id"].eqNullSafe(people["of"])).drop("of")
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("shown")).otherwise(""))
    head = F.concat(F.lit(OPEN), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    seen = seen.withColumn("head", F.length(head).cast("long")).withColumn("segment", F.concat(head, "said", F.lit(CLOSE + "\n")))
    size = F.length("segment").cast("long")
    order = [F.col("turn").asc_nulls_first(), "speaker", "said"]
    inner = W.partitionBy("conv_id", "perspective", "stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sizes = seen.groupBy("conv_id", "perspective", "stretch").agg(F.sum(size).alias("size"))
    outer = W.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), F.coalesce(F.sum("size").over(outer), F.lit(0)).alias("base")
    )
    met = seen.withColumn("within", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    met = met.join(bases, met["conv_id"].eqNullSafe(bases["c"]) & (met["perspective"] == bases["p"]) & (met["stretch"] == bases["s"]))
    start = F.col("base") + F.col("within")
    own = F.col("role") == "assistant"
    return met.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"),
        (start + F.when(own, F.col("head")).otherwise(0)).alias("mask_start"),
        F.when(own, F.length("said") + len(CLOSE)).otherwise(0).cast("long").alias("mask_length"),
    )


_SHOWN = "coalesce(role, 'unknown')"
for _sign, _spelt in SPELT.items():
    _SHOWN = f"replace({_SHOWN}, chr({ord(_sign)}), '{_spelt}')"

#: DuckDB: the same rows with one window over each rendering.
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, {_SHOWN} AS shown,
         replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
  SELECT t.*, p.perspective,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
named AS (
  SELECT *, CASE WHEN role = 'user' THEN shown ELSE '' END AS name,
         '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || shown ELSE '' END || chr(10) AS head FROM seen),
placed AS (
  SELECT *, head || said || '{CLOSE}' || chr(10) AS segment,
         coalesce(sum(length(head) + length(said) + {len(CLOSE) + 1}) OVER (
           PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM named)
SELECT conv_id, perspective, turn, role, name, segment, start,
       start + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start,
       CASE WHEN role = 'assistant' THEN length(said) + {len(CLOSE)} ELSE 0 END::BIGINT AS mask_length
FROM placed
"""
