"""Mixing sources to target weights.

Method: Pfair scheduling. A source's documents, in hash order, are cut into blocks of
``block_chars`` characters. With integer target weights ``w`` of sum ``W``, block ``j``
(from 0) of a source is released at slot ``floor(j*W/w)`` and due at ``ceil((j+1)*W/w)``;
every slot takes the released block with the earliest deadline. At every slot each
source has then had its share to within less than one block. The schedule repeats
after ``W`` slots, so it is made for one such round (a table of ``W`` rows, whose number
follows the sources, at most ``MAX_SOURCES``, and not their rows) and a block's slot
follows from its number by a join.

A source that has no blocks left leaves its slots empty; the others go on in their
proportions, so every document gets a slot. Running sums within a source are taken in
two levels, over hash buckets and inside a bucket, so that a source with a third of
all rows is spread over all tasks.

Without given weights a source weighs the square root of its characters, rounded to
about ``RESOLUTION`` slots in all (``SLOTS_A_SOURCE`` for each source, where that is
more), at least one.

Defined cases: a null source is the source with the empty name; null and empty texts
have no characters and share the next document's block; a text longer than a block lies
in the block of its first character; equal hashes are ordered by id and then by size; repeated rows are rows of
their own; a source that the given weights do not name weighs one; other columns are
not read (``schedule``) or are kept (``mixed``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import saved

RESOLUTION = 1000
SLOTS_A_SOURCE = 16
STEP_BITS = 3
MAX_SOURCES = 1_000_000  # a round is one table of about SLOTS_A_SOURCE rows for each source
BLOCK_CHARS = 65536
_OWN = "__mix_"


def _weights(totals: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """(source, weight); derived weights share ``RESOLUTION`` slots, or ``SLOTS_A_SOURCE`` for each source where that is more."""
    if weights is None:
        n, roots = totals.agg(F.count("*"), F.sum(F.sqrt("total"))).first()
        weight = F.greatest(F.lit(1), F.round(max(RESOLUTION, SLOTS_A_SOURCE * n) * F.sqrt("total") / F.lit(roots or 1.0)))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]) if weights else F.create_map().cast("map<string,int>")
        weight = F.greatest(F.lit(1), F.coalesce(F.try_element_at(named, F.col("source")), F.lit(1)))
    return totals.select("source", weight.cast("long").alias("weight"))


def round_of(totals: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """One round of the schedule from (source, total): (source, weight, every, turn, slot),
    ``turn`` counting a source's blocks in the round from 0.

    Blocks and slots are rows. Earliest deadline first is a schedule by fixed ranks, so
    which slots the blocks up to a rank fill does not depend on later ranks: a slot is
    filled when more of them are released than the slots before it have taken, which is a
    running minimum. Cutting the ranks in eight again and again, each time with the slots that
    they fill, leaves each slot with its one block."""
    spark = totals.sparkSession
    own = _weights(totals, weights)
    n, every = own.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources, at most {MAX_SOURCES} can be mixed; group them by a coarser column")
    bits = max(0, every - 1).bit_length()
    blocks = own.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("weight") - 1)))
    blocks = blocks.withColumns({"release": F.expr(f"turn * {every} div weight"), "due": F.expr(f"((turn + 1) * {every} + weight - 1) div weight")})
    blocks = saved(blocks.withColumn("rank", F.row_number().over(Window.orderBy("due", "source")).cast("long") - 1), "blocks")
    rows = (blocks.select(F.col("release").alias("at"), F.lit(0).alias("is_slot"), "rank", F.lit(0).cast("long").alias("part"))
            .unionAll(spark.range(every).select(F.col("id").alias("at"), F.lit(1).alias("is_slot"), F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("part"))))
    so_far = "over (partition by part order by at, is_slot, rank rows between unbounded preceding and current row)"
    until = "over (partition by part order by at, is_slot, rank rows between unbounded preceding and 1 preceding)"
    for low in reversed(range(0, bits, STEP_BITS)):
        sides = range(1, 1 << min(STEP_BITS, bits - low))
        rows = rows.selectExpr("*", f"shiftright(rank, {low}) & {sides.stop - 1} as side")
        rows = rows.selectExpr("*", f"sum(is_slot) {so_far} - 1 as place", *[f"count_if(side < {c}) {so_far} as released{c}" for c in sides])
        rows = rows.selectExpr("*", *[f"min(if(is_slot = 1, released{c} - place, null)) {until} as gap{c}" for c in sides])
        free = " + ".join(f"if(released{c} > coalesce(least(place, place - 1 + gap{c}), 0), 0, 1)" for c in sides)
        rows = rows.selectExpr("at", "is_slot", "rank", f"part * {sides.stop} + if(is_slot = 0, side, {free}) as part")
    slots = rows.where("is_slot = 1").select(F.col("part").alias("rank"), F.col("at").alias("slot"))
    return saved(blocks.join(slots, "rank").select("source", "weight", F.lit(every).cast("long").alias("every"), "turn", "slot"), "round")


def _scheduled(docs: DataFrame, weights: dict[str, int] | None, block_chars: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``docs`` with the schedule in columns that begin with ``__mix_``."""
    o = _OWN
    docs = docs.withColumns({
        f"{o}source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        f"{o}size": F.coalesce(F.length(text_col), F.lit(0)).cast("long"),
        f"{o}hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))})
    docs = docs.withColumn(f"{o}bucket", F.substring(f"{o}hash", 1, 3))
    sums = saved(docs.groupBy(f"{o}source", f"{o}bucket").agg(F.sum(f"{o}size").alias("n")), "source-sums")
    before = sums.select(F.col(f"{o}source").alias(f"{o}s"), F.col(f"{o}bucket").alias(f"{o}b"),
                         (F.sum("n").over(Window.partitionBy(f"{o}source").orderBy(f"{o}bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias(f"{o}before"))
    inside = (Window.partitionBy(f"{o}source", f"{o}bucket").orderBy(f"{o}hash", id_col, f"{o}size").rowsBetween(Window.unboundedPreceding, 0))
    docs = docs.withColumn(f"{o}inside", F.sum(f"{o}size").over(inside) - F.col(f"{o}size"))
    docs = docs.join(before, (F.col(f"{o}source") == F.col(f"{o}s")) & (F.col(f"{o}bucket") == F.col(f"{o}b"))).drop(f"{o}s", f"{o}b")
    docs = docs.withColumn(f"{o}at", F.col(f"{o}before") + F.col(f"{o}inside")).withColumn(f"{o}block", F.floor(F.col(f"{o}at") / block_chars).cast("long"))
    totals = sums.groupBy(F.col(f"{o}source").alias("source")).agg(F.sum("n").alias("total"))
    turns = round_of(totals, weights)
    turns = turns.select(*[F.col(c).alias(f"{o}t_{c}") for c in turns.columns])
    first = turns.groupBy(F.col(f"{o}t_source").alias(f"{o}w_source")).agg(F.first(f"{o}t_weight").alias(f"{o}weight"), F.first(f"{o}t_every").alias(f"{o}every"))
    docs = docs.join(first, F.col(f"{o}source") == F.col(f"{o}w_source")).drop(f"{o}w_source")
    turn = F.col(f"{o}block") % F.col(f"{o}weight")
    docs = docs.join(turns, (F.col(f"{o}source") == F.col(f"{o}t_source")) & (turn == F.col(f"{o}t_turn")))
    return docs.withColumn(f"{o}slot", F.floor(F.col(f"{o}block") / F.col(f"{o}weight")) * F.col(f"{o}every") + F.col(f"{o}t_slot"))


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block_chars: int = BLOCK_CHARS,
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, source, size, source_offset (characters of the source
    before it), block, release, deadline and slot of the block, weight and weight_sum."""
    o = _OWN
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    df = _scheduled(df, weights, block_chars, "doc_id", "source", "text")
    w, every, b = F.col(f"{o}weight"), F.col(f"{o}every"), F.col(f"{o}block")
    return df.select("doc_id", F.col(f"{o}source").alias("source"), F.col(f"{o}size").alias("size"), F.col(f"{o}at").alias("source_offset"), b.alias("block"),
                     F.floor(b * every / w).alias("release"), F.ceil((b + 1) * every / w).alias("deadline"), F.col(f"{o}slot").alias("slot"),
                     w.alias("weight"), every.alias("weight_sum"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_chars: int = BLOCK_CHARS,
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, sorted by slot and then by their order in the source."""
    df = _scheduled(docs, weights, block_chars, id_col, source_col, text_col)
    return df.orderBy(f"{_OWN}slot", f"{_OWN}at", f"{_OWN}hash").select(*docs.columns)


def oracle_sql(block_chars: int = BLOCK_CHARS) -> str:
    """``schedule`` with derived weights as DuckDB SQL over ``documents``."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS source_offset FROM d),
t AS (SELECT source, sum(size) AS total FROM d GROUP BY source),
w AS (SELECT source, greatest(1, round((SELECT greatest({RESOLUTION}, {SLOTS_A_SOURCE} * count(*)) FROM t) * sqrt(total) / (SELECT CASE WHEN sum(sqrt(total)) > 0 THEN sum(sqrt(total)) ELSE 1 END FROM t)))::BIGINT AS weight FROM t),
a AS (SELECT list(source ORDER BY source) AS s, list(weight ORDER BY source) AS ws, sum(weight)::BIGINT AS every FROM w),
r(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), NULL::BIGINT FROM a
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, ws, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: floor(done[i] * every / ws[i]) <= t + 1),
          lambda i: ceil((done[i] + 1) * every / ws[i])::BIGINT * 1000000 + i)) % 1000000 AS p
        FROM r, a WHERE t + 1 < every)),
turns AS (SELECT s[pick] AS source, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM r, a WHERE t >= 0),
b AS (SELECT c.*, source_offset // {block_chars} AS block, weight, every FROM c JOIN w USING (source), a)
SELECT doc_id, source, size, source_offset, block, floor(block * every / weight)::BIGINT AS release, ceil((block + 1) * every / weight)::BIGINT AS deadline,
  block // weight * every + slot AS slot, weight, every AS weight_sum
FROM b JOIN turns USING (source) WHERE turn = block % weight"""
