"""Mixing sources to target weights by weighted fair queueing.

Documents of each source stand in a hashed order. A document's virtual finish time is its source's tokens up to and with it,
divided by the source's target weight; in the order of finish times every prefix holds the sources in proportion to their weights,
as long as they last. That order is cut off at the total budget.

No source is one task: hash keys fall into ``buckets`` equal ranges, whose token sums give each range its start, and ranges are
summed up by themselves. The global order is a range sort, whose ranges hold equal numbers of documents however finish times are
spread; their token sums tell which range holds the cut, and only that one is summed up row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.names import fresh
from sigloom.session import cut, table

#: Target weights of the sources; a source that is not named has OTHERS.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 1.5, "src3": 0.5}
OTHERS = 1.0
#: Budget as a share of all tokens, and the seed of the order.
SHARE, SEED = 0.75, "mix-1"
BUCKETS = 1024


def tokens(text: Column) -> Column:
    """Words: runs of characters that are no white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of the MD5 of id and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def row_key() -> Column:
    return F.xxhash64(F.lit(9), "doc_id", "source", "text")


def schedule(
    docs: DataFrame, weights: dict[str, float] | None = None, others: float = OTHERS, share: float = SHARE, seed: str = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, rid, source, n_tokens, finish) of the documents within the budget.

    The budget is floor(share * all tokens); documents are taken in the order of (finish, source, hash key, doc_id, rid) as long as
    the running total stays within it. Rows of equal id, source and text are one document with all their tokens. A null source is
    the source "", null and empty texts have 0 tokens, null ids hash like "". Weights must be positive. An empty table gives an
    empty result.
    """
    weights = WEIGHTS if weights is None else weights
    if min([others, *weights.values()]) <= 0:
        raise ValueError("weights must be positive")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", row_key().alias("rid"), source.alias("source"), tokens(F.col("text")).alias("n"))
    once = rows.groupBy("rid", "doc_id", "source").agg(F.sum("n").alias("n_tokens")).withColumn("key", order_key(F.col("doc_id"), seed))
    once = cut(once.withColumn("bucket", F.expr(f"key div {(1 << 60) // buckets}")), "tokens")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = once.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    starts = starts.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.lit(others)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    done = once.withColumn("sum", F.sum("n_tokens").over(within)).join(starts, ["source", "bucket"])
    done = done.select("doc_id", "rid", "source", "n_tokens", "key", ((F.col("before") + F.col("sum")) / weight).alias("finish"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = cut(done.repartitionByRange(ranges, "finish", "source", "key", "doc_id", "rid").withColumn("part", F.spark_partition_id()), "finish")
    parts = cut(done.groupBy("part").agg(F.sum("n_tokens").alias("t")), "parts")  # a row a range
    budget = math.floor(share * (parts.agg(F.sum("t")).first()[0] or 0))
    sums = parts.select("part", "t", F.sum("t").over(Window.orderBy("part")).alias("upto"))
    edge = sums.where(F.col("upto") > budget).agg(F.min_by(F.struct("part", F.expr("upto - t").alias("taken")), "part")).first()[0]
    if edge is not None:
        order = Window.orderBy("finish", "source", "key", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
        last = done.where(F.col("part") == edge["part"]).withColumn("upto", F.sum("n_tokens").over(order))
        last = last.where(F.col("upto") <= budget - edge["taken"]).drop("upto")
        done = done.where(F.col("part") < edge["part"]).unionByName(last)
    return done.select("doc_id", "rid", "source", "n_tokens", "key", "finish")


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs within the budget, in mixing order, with docs' columns. Options and odd cases: see schedule()."""
    plan = schedule(docs.select("doc_id", "source", "text"), **options)
    rid, own, finish, source, key = fresh(docs.columns, "rid", "own_id", "finish", "source_name", "key")
    plan = plan.select(F.col("rid").alias(rid), F.col("doc_id").alias(own), F.col("finish").alias(finish), F.col("source").alias(source), F.col("key").alias(key))
    met = docs.join(plan, (row_key() == F.col(rid)) & F.col("doc_id").eqNullSafe(F.col(own)))
    return met.orderBy(finish, source, key, own, rid).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents")).orderBy("finish", "source", "key", "doc_id").select("doc_id", "source", "n_tokens", "finish")


_CASE = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())
SQL = f"""
WITH once AS (
  SELECT doc_id, coalesce(source, '') AS source, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+')))::BIGINT AS n_tokens, text,
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 15) AS BIGINT) AS key
  FROM documents GROUP BY ALL),
done AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT / CASE source {_CASE} ELSE {OTHERS}::DOUBLE END AS finish
  FROM once),
cumulated AS (SELECT *, sum(n_tokens) OVER (ORDER BY finish, source, key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM done)
SELECT doc_id, source, n_tokens, finish FROM cumulated WHERE upto <= (SELECT floor({SHARE} * sum(n_tokens)) FROM once)
"""
