"""Mixing sources to target weights by iterative proportional fitting, with SQL expressions only.

Token counts of (source, language, topic) cells are raked: each step scales the
weights of one dimension's members to their target share.  The ratio of a cell's
raked to its own tokens, times one common factor, is the probability with which its
documents are kept; the factor is the largest on a fixed grid whose expected tokens
stay within the budget, lowered where a cell would go beyond a probability of 1.  So no
cell is cut and the expected tokens have the target shares; a budget that they do not
allow is not used up.  The draw is a hash of the document's id, so it is repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Rounds over the dimensions.
ROUNDS = 6
#: A member's target share is proportional to its tokens to this power, unless given.
FLATTEN = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Expected tokens after sampling, as a share of all.
BUDGET = 0.8
#: The common factor is 2 ** (j / 16) for a whole j in this range.
GRID = (-160, 160)

def _marks(marks: str) -> str:
    """SQL for the number of the characters ``marks`` in the text."""
    return "(" + " + ".join(f"length(text) - length(replace(text, '{m}', ''))" for m in marks) + ")"


#: A proxy for the topic from how dense the marks of a kind of text are, the first that is dense enough:
#: marks for each thousand characters.  A column with a real topic can be given in its place.
TOPIC_SQL = (
    f"CASE WHEN length(text) < 400 THEN 'note' WHEN {_marks('|')} * 1000 >= 4 * length(text) THEN 'table'"
    f" WHEN {_marks('#*<>={}@')} * 1000 >= 3 * length(text) THEN 'markup' ELSE 'prose' END"
)


def _placed(docs: DataFrame, topic_sql: str) -> DataFrame:
    named = {"source": F.coalesce(F.col("source"), F.lit("-")), "lang": F.coalesce(F.col("lang"), F.lit("-")), "topic": F.coalesce(F.expr(topic_sql), F.lit("-"))}
    tokens = F.expr("greatest(1L, cast(octet_length(coalesce(text, '')) as bigint) div 4L)")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    return docs.select(whole, *(named[d].alias(f"{d}_") for d in DIMENSIONS), tokens.alias("tokens_"), key.alias("key_"))


def raked_cells(placed: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``source_, lang_, topic_, tokens, w``: tokens and raked tokens of each cell.

    ``targets`` gives a share for members of a dimension; members it leaves out get
    share zero, dimensions it leaves out follow FLATTEN.
    """
    names = [f"{d}_" for d in DIMENSIONS]
    cells = placed.groupBy(*names).agg(F.sum("tokens_").cast("double").alias("tokens"))
    cells = cells.withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    for d in DIMENSIONS:
        if targets and d in targets:
            given = F.create_map(*(F.lit(x) for pair in targets[d].items() for x in pair))
            cells = cells.withColumn(f"goal_{d}", F.coalesce(given[F.col(f"{d}_")], F.lit(0.0)))
        else:
            own = F.sum("tokens").over(Window.partitionBy(f"{d}_"))
            # each cell brings its part of its member's goal, so that their sum is over members
            cells = cells.withColumn("m", own).withColumn("m", F.pow("m", F.lit(FLATTEN[d])))
            whole = F.sum(F.col("m") * F.col("tokens") / F.col("own")).over(Window.partitionBy(F.lit(0)))
            cells = cells.withColumn("own", own).withColumn("whole", whole).withColumn(f"goal_{d}", F.col("m") / F.col("whole")).drop("m", "own", "whole")
    cells = materialize(cells.withColumn("w", F.col("tokens")), "cells")
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = F.sum("w").over(Window.partitionBy(f"{d}_"))
            cells = cells.withColumn("now", now).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col(f"goal_{d}") * F.col("all") / F.col("now")).otherwise(0.0)).drop("now")
    return cells.select(*names, "tokens", "w")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = 11, topic_sql: str = TOPIC_SQL) -> DataFrame:
    """Every row with its probability and draw: ``doc, source_, lang_, topic_, tokens_, key_, p_, drawn_``.

    ``docs`` has doc_id, text, source and lang, and ``doc`` is the row as it was, so other
    columns may have any name; tokens are a quarter of the UTF-8
    bytes, one at least.  Null sources, languages and texts are members of their own
    ("-", and the empty text).  Rows with equal doc_ids are drawn alike if they are in
    one cell; null doc_ids are one id.  An empty table gives no rows.

    Cells are members of all three dimensions together and are raked by windows over one dimension, so
    sources should be collections and not, say, all hosts of a crawl.
    """
    placed = _placed(docs, topic_sql)
    cells = materialize(raked_cells(placed, targets, rounds).withColumn("g", F.col("w") / F.col("tokens")), "raked")
    lo, hi = GRID
    steps = F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda j: F.pow(F.lit(2.0), j / F.lit(16.0)))
    spread = cells.select("tokens", "g", F.explode(steps).alias("factor"))
    sums = spread.groupBy("factor").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * F.col("g"))).alias("kept"), F.sum("tokens").alias("all"))
    best = sums.where(F.col("kept") <= F.lit(budget) * F.col("all")).agg(F.max("factor").alias("f")).first()
    factor = best.f if best.f is not None else 2.0 ** (lo / 16)
    most = cells.agg(F.max("g").alias("g")).first().g
    factor = min(factor, 1 / most) if most else factor
    toss = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key_")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    p = F.least(F.lit(1.0), F.lit(factor) * F.col("g_"))
    factors = cells.select(*(f"{d}_" for d in DIMENSIONS), F.col("g").alias("g_"))
    out = placed.join(factors, [f"{d}_" for d in DIMENSIONS]).withColumn("p_", p)
    return out.withColumn("drawn_", toss.cast("double") / F.lit(float(1 << 52)) < F.col("p_")).drop("g_")


def oracle_sql(rounds: int = ROUNDS, budget: float = BUDGET, seed: int = 11) -> str:
    """The same draw for DuckDB."""
    goals = ", ".join(f"power(sum(tokens) OVER (PARTITION BY {d}_), {FLATTEN[d]}) AS m_{d}, sum(tokens) OVER (PARTITION BY {d}_) AS own_{d}" for d in DIMENSIONS)
    shares = ", ".join(f"m_{d} / sum(m_{d} * tokens / own_{d}) OVER () AS goal_{d}" for d in DIMENSIONS)
    steps, last = [], "c2"
    for r in range(rounds):
        for d in DIMENSIONS:
            name = f"r{r}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (w * goal_{d} * every / sum(w) OVER (PARTITION BY {d}_) AS w) FROM {last})")
            last = name
    return f"""
WITH p AS (
  SELECT doc_id, coalesce(source, '-') AS source_, coalesce(lang, '-') AS lang_, {TOPIC_SQL} AS topic_,
    greatest(1, strlen(coalesce(text, '')) // 4) AS tokens_, coalesce(CAST(doc_id AS VARCHAR), '-') AS key_ FROM documents
), c0 AS (SELECT source_, lang_, topic_, CAST(sum(tokens_) AS DOUBLE) AS tokens FROM p GROUP BY ALL),
c1 AS (SELECT *, {goals}, sum(tokens) OVER () AS every FROM c0),
c2 AS MATERIALIZED (SELECT *, {shares}, tokens AS w FROM c1),
{", ".join(steps)},
g AS (SELECT source_, lang_, topic_, tokens, w / tokens AS g FROM {last}),
f AS (SELECT least(max(factor), (SELECT 1 / max(g) FROM g)) AS factor FROM (
  SELECT factor FROM g, (SELECT power(2.0, j / 16.0) AS factor FROM range({GRID[0]}, {GRID[1] + 1}) t(j))
  GROUP BY factor HAVING sum(tokens * least(1.0, factor * g)) <= {budget} * sum(tokens))),
o AS (SELECT p.*, least(1.0, factor * g) AS prob FROM p JOIN g USING (source_, lang_, topic_), f)
SELECT doc_id, source_ AS source, lang_ AS lang, topic_ AS topic, CAST(tokens_ AS BIGINT) AS tokens, round(prob, 6) AS p FROM o
WHERE CAST('0x' || substr(md5('{seed}:' || key_), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < prob
""".strip()
