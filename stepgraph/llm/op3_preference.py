"""Preference formatting: chosen and rejected conversations share one prompt.

The longest common prefix of turns of a pair is found by a join of the two sides on their turn number and the
smallest number at which they differ; the prefix is rendered once as the prompt, the rest of each side as its
completion. Rendered turns stay rows: a conversation may hold a third of all turns, so a side is never gathered
into one row or task. Only grouping with map-side combining and equi-joins are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"  # turn marks of the rendered text
TRAINED_ROLES = ("assistant",)
WORDLESS = "..."


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(f"{CLOSE}\n"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn): role, text. A null role or text counts as empty, a null conv_id or turn
    takes no part; of rows with the same number the smallest (role, text) stays, so repeated rows count once."""
    clean = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
    )
    return clean.groupBy("conv_id", "turn").agg(F.min("said").alias("said")).select("conv_id", "turn", "said.role", "said.text")


def preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered turns of each pair (pair_id, chosen_id, rejected_id of conversations).

    Returns pair_id, part ('prompt', 'chosen' or 'rejected'), turn, role, rendered, train and n_prompt (turns of the
    prompt). Turns of the common prefix come once, as 'prompt'; a turn that is missing on one side ends the prefix.
    train marks what the loss counts: turns of TRAINED_ROLES in a completion, never the prompt. If a side is a prefix
    of the other (or both are equal) its completion has no rows; a conversation that has no turns has none either.
    Joined in turn order, 'prompt' and 'chosen' rows give the chosen conversation, 'prompt' and 'rejected' the other.
    Null ids pair nothing; repeated pairs count once; further columns of either input are not used.
    """
    turns = turns_of(conversations)
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id").where("pair_id IS NOT NULL").distinct()
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("x")).select("pair_id", "x.side", "x.conv_id")
    placed = sides.join(turns, "conv_id").select("pair_id", "side", "turn", "role", "text")
    # One group for each (pair, turn) holds two rows at most, so nothing grows with a conversation's length.
    said = F.struct("role", "text")
    both = placed.groupBy("pair_id", "turn").agg(F.max(F.when(F.col("side") == "chosen", said)).alias("chosen"), F.max(F.when(F.col("side") == "rejected", said)).alias("rejected"))
    differ = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    splits = both.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("split"), F.count("turn").alias("n_turns"))
    # the prefix's length, counted before the split is known to each row
    known = both.join(splits, "pair_id")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    n_prompt = known.groupBy("pair_id").agg(F.count(F.when(shared, 1)).alias("n_prompt"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said")))
    )
    out = known.select("pair_id", "turn", F.explode(parts).alias("x")).where("x.said IS NOT NULL").join(n_prompt, "pair_id")
    role, text = F.col("x.said.role"), F.col("x.said.text")
    return out.select("pair_id", F.col("x.part").alias("part"), "turn", role.alias("role"), rendered(role, text).alias("rendered"), ((F.col("x.part") != "prompt") & role.isin(*TRAINED_ROLES)).alias("train"), "n_prompt")


def alternatives(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and pairs for a table that has no rejected side of its own.

    A conversation's rejected side has the same turns up to its last answer (turn of a trained role) and another answer
    there: that of the conversation whose conv_id differs in the lowest bit, if ids are integers and that one has another;
    else the first half of its own, and WORDLESS for an empty one. So both sides have a completion with an answer, and what comes
    before is their prompt. A conversation without answers is paired with itself and is all prompt. Sides are told
    apart by a letter before the id, so no two ids clash; the pair has the conversation's own id.
    """
    turns = turns_of(conversations)
    answer = F.col("role").isin(*TRAINED_ROLES)
    last = turns.groupBy("conv_id").agg(F.max(F.when(answer, F.struct("turn", "role", "text"))).alias("own"))
    answers = last.where("own IS NOT NULL")
    ids = turns.schema["conv_id"].dataType
    partner = F.col("conv_id").bitwiseXOR(F.lit(1)) if isinstance(ids, IntegralType) else F.lit(None).cast(ids)
    other = answers.select(partner.alias("conv_id"), F.col("own.text").alias("another"))
    text = F.col("own.text")
    half = F.when(text != "", F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(F.lit(WORDLESS))
    given = answers.join(other, "conv_id", "left").select("conv_id", "own.turn", "own.role", F.when(F.col("another") != text, F.col("another")).otherwise(half).alias("text"))
    before = turns.join(last, "conv_id").where("own IS NULL OR turn < own.turn").select("conv_id", "turn", "role", "text")
    side = lambda rows, mark: rows.withColumn("conv_id", F.concat(F.lit(mark), F.col("conv_id").cast("string")))
    pairs = last.select(F.col("conv_id").alias("pair_id"), *[F.concat(F.lit(m), F.col("conv_id").cast("string")).alias(c) for m, c in (("c", "chosen_id"), ("r", "rejected_id"))])
    return side(turns, "c").unionByName(side(before.unionByName(given), "r")), pairs


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each against its alternative: pair_id, part, turn, role, rendered, train, n_prompt."""
    return preferences(*alternatives(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


ORACLE_SQL = """
WITH turns AS (SELECT conv_id, turn, min(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
lasts AS (SELECT conv_id, max(turn) FILTER (WHERE said.role = 'assistant') AS last FROM turns GROUP BY conv_id),
answers AS (SELECT t.conv_id, t.turn, t.said.text AS text FROM turns t JOIN lasts l ON t.conv_id = l.conv_id AND t.turn = l.last),
given AS (SELECT a.conv_id, a.turn, CASE WHEN o.text <> a.text THEN o.text WHEN a.text <> '' THEN left(a.text, length(a.text) // 2) ELSE '...' END AS text FROM answers a LEFT JOIN answers o ON o.conv_id = xor(a.conv_id, 1)),
rejected AS (SELECT t.conv_id, t.turn, t.said FROM turns t JOIN lasts l USING (conv_id) WHERE l.last IS NULL OR t.turn < l.last
  UNION ALL SELECT conv_id, turn, struct_pack(role := 'assistant', text := text) FROM given),
both_sides AS (SELECT coalesce(c.conv_id, r.conv_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.said AS chosen, r.said AS rejected
  FROM turns c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.turn = r.turn),
splits AS (SELECT pair_id, min(turn) FILTER (WHERE chosen IS DISTINCT FROM rejected) AS split FROM both_sides GROUP BY pair_id),
known AS (SELECT b.*, (s.split IS NULL OR b.turn < s.split) AS shared FROM both_sides b JOIN splits s USING (pair_id)),
lengths AS (SELECT pair_id, count(*) FILTER (WHERE shared) AS n_prompt FROM known GROUP BY pair_id),
parts AS (SELECT pair_id, turn, 'prompt' AS part, chosen AS said FROM known WHERE shared
  UNION ALL SELECT pair_id, turn, 'chosen', chosen FROM known WHERE NOT shared AND chosen IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', rejected FROM known WHERE NOT shared AND rejected IS NOT NULL)
SELECT p.pair_id, p.part, p.turn, p.said.role AS role, '<|im_start|>' || p.said.role || chr(10) || p.said.text || '<|im_end|>' || chr(10) AS rendered,
  (p.part <> 'prompt' AND p.said.role = 'assistant') AS train, l.n_prompt FROM parts p JOIN lengths l USING (pair_id)
"""
