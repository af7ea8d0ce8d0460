"""Exact nearest signatures: top-k of queries, and of every signature against all others.

Both sides are packed into blocks of rows. A task takes a block of queries and reads those of the signatures, one after the other, from the
shared folder; a pair of blocks is one vectorised step, and only the k best of each query so far are held, so that what is held is bounded
and what is shuffled grows with the queries, not with the pairs. Neither side has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.bits import hamming, word_columns
from sigloom.operators.signatures import numbered
from sigloom.session import cut, new_path, stored

#: Rows of a block and of a tile of pairs(), results that a task holds, and bits for a signature's place in the order of ties.
BLOCK, TILE, HELD, PLACE = 4096, 512, 4_000_000, 44


def blocks(df: DataFrame, key: list[str], order: list, arrays: list[str], names: list[str], rows: int, prefix: str) -> DataFrame:
    """Blocks of about ``rows`` rows by a hash of the key, each sorted by ``order``; an array for each of the columns."""
    count = max(1, -(-df.count() // rows))
    block = F.pmod(F.xxhash64(F.lit(17), *key), F.lit(count))
    each = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(n) for c, n in zip(arrays, names, strict=True)])
    packed = df.groupBy(block.alias(f"{prefix}block")).agg(F.sort_array(F.collect_list(each)).alias("x"))
    return packed.select(f"{prefix}block", *[F.col(f"x.{n}").alias(f"{prefix}{n}") for n in names])


def in_parts(sides: DataFrame, block: str, parts: int) -> tuple[str, DataFrame]:
    """Blocks written to the shared folder, where workers read those of a part in ``/part=N``; and the parts (part) that have any."""
    path, spark = new_path(sides.sparkSession, "blocks"), sides.sparkSession
    sides = sides.withColumn("part", F.pmod(block, F.lit(parts)).cast("int"))
    (sides if parts == 1 else sides.repartition(parts, "part")).write.partitionBy("part").parquet(path)
    return path, spark.read.schema("part int").parquet(path).select("part").distinct()


class _Best:
    """The k best rows of each query so far, by numbers that hold their distance and, in the lower PLACE bits, their place among ties."""

    def __init__(self, queries: int, k: int, ids: np.ndarray) -> None:
        self.k, self.all = k, np.arange(queries)
        self.keys = np.full((queries, k), np.iinfo(np.int64).max)
        self.ids = np.empty((queries, k), dtype=ids.dtype)
        self.far = np.full(queries, np.iinfo(np.int64).max >> PLACE)
        self.open: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        self.open.append((query, key, ids))
        self.size += len(query)
        if self.size >= self.keys.size:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        query, key, ids = (np.concatenate(x) for x in zip((np.repeat(self.all, self.k), self.keys.ravel(), self.ids.ravel()), *self.open, strict=True))
        by = np.lexsort((key, query))
        first = np.searchsorted(query[by], self.all)
        by = by[first[:, None] + np.arange(self.k)]
        self.keys, self.ids = key[by], ids[by]
        self.far = self.keys[:, -1] >> PLACE
        self.open, self.size = [], 0


def _meet(best: _Best, q: np.ndarray, m: np.ndarray | None, s: np.ndarray, place: np.ndarray, ids: np.ndarray, group: np.ndarray | None) -> None:
    """Adds a block of signatures, in the order of places, to the best of the queries; of rows of a group only the first counts."""
    n, k = len(s), best.k
    step = max(1, (1 << 17) // n)
    if group is not None:
        by = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) != 0]))
    for a in range(0, len(q), step):
        dist = np.zeros((len(q[a : a + step]), n), dtype=np.uint16)
        for j in range(q.shape[1]):
            x = q[a : a + step, j, None] ^ s[None, :, j]
            if m is not None:
                x &= m[a : a + step, j, None]
            dist += np.bitwise_count(x.view(np.uint64))
        near = np.flatnonzero(dist <= np.minimum(best.far[a : a + step], 65535).astype(np.uint16)[:, None])
        if len(near) > 2 * k * len(dist):  # the nearest of this block by themselves
            key = dist.astype(np.int64) * n + np.arange(n)
            if group is not None:
                key = np.minimum.reduceat(key[:, by], first, axis=1)
            if key.shape[1] > k:
                key = np.partition(key, k - 1, axis=1)[:, :k]
            row, at, d = np.repeat(np.arange(len(dist)), key.shape[1]), (key % n).ravel(), (key // n).ravel()
        else:
            row, at = near // n, near % n
            d = dist.ravel()[near].astype(np.int64)
            if group is not None and len(near):
                order = np.lexsort((at, d, group[at], row))
                row, at, d = row[order], at[order], d[order]
                once = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group[at]) != 0)])
                row, at, d = row[once], at[once], d[once]
        key = d << PLACE | place[at]
        kept = key < best.keys[a + row, -1]
        if kept.any():
            best.add(a + row[kept], key[kept], ids[at[kept]])


def nearest(
    queries: DataFrame, signatures: DataFrame, query: str, key: str, k: int = 10, ties: list | None = None, group: str | None = None, block: int = BLOCK
) -> DataFrame:
    """(query, key, dist, rank): the k nearest signatures of each query, ordered by distance, then ``ties``.

    ``query`` and ``key`` name unique columns. Queries have words w* and, if only some bits count, masks m*. ties are columns of
    signatures that are sorted ascending (the key, by default; it always comes last). With ``group`` only the best signature of each
    group is taken. Fewer than k signatures give fewer rows. k must be 1 at least.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    spark, w = signatures.sparkSession, word_columns(signatures.columns)
    masks = word_columns(queries.columns, "m")
    kind, same = dict(queries.dtypes)[query], dict(signatures.dtypes)[key]
    ties = [*(ties or []), F.col(key)]
    lists = F.array(*w)
    s = signatures.select(F.col(key).alias("id"), *[t.alias(f"t{i}") for i, t in enumerate(ties)], *([F.col(group).alias("g")] if group else []), lists.alias("w"))
    s = numbered(s, *[f"t{i}" for i in range(len(ties))]).withColumnRenamed("doc_num", "__place")
    q = queries.select(F.col(query), F.array(*w).alias("w"), *([F.array(*masks).alias("m")] if masks else []))
    names, own = ["w", *(["m"] if masks else [])], ["id", *(["g"] if group else []), "w"]
    # many queries are shared out by themselves; where they are few, signatures are in parts too, so that all cores have work
    cores = spark.sparkContext.defaultParallelism
    most = max(1, min(block, HELD // k, max(256, -(-q.count() // (2 * cores)))))
    asked = cut(blocks(q, [query], [F.col(query)], [query, *names], ["id", *names], most, "q_"), "queries")
    count = asked.count()
    parts = max(1, -(-cores // max(1, count)))
    sides = blocks(s, ["g"] if group else ["id"], [F.col("__place")], ["__place", *own], ["place", *own], block, "s_")
    path, there = in_parts(sides, "s_block", parts)
    columns = ["s_place", *[f"s_{n}" for n in own]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                qw, best = np.stack(row.q_w), None
                qm = np.stack(row.q_m) if masks else None
                for batch in stored(f"{path}/part={row.part}", columns, 1):
                    for i in range(len(batch)):
                        flat = {c: batch.column(c).slice(i, 1).flatten() for c in columns}
                        sw = flat["s_w"].flatten().to_numpy().reshape(-1, len(w))
                        ids = flat["s_id"].to_pandas().to_numpy()
                        best = best or _Best(len(qw), k, ids)
                        _meet(best, qw, qm, sw, flat["s_place"].to_numpy(), ids, pd.factorize(flat["s_g"].to_pandas().to_numpy(), use_na_sentinel=False)[0] if group else None)
                best.merge()
                i, j = np.nonzero(best.keys < np.iinfo(np.int64).max)
                found = best.keys[i, j]
                yield pd.DataFrame({"query": np.asarray(row.q_id)[i], "key": best.ids[i, j], "dist": found >> PLACE, "place": found & (1 << PLACE) - 1, "rank": j + 1})

    pairs_ = asked.crossJoin(F.broadcast(there)).repartition(count * parts or 1)
    found = pairs_.mapInPandas(run, f"query {kind}, key {same}, dist int, place long, rank int")
    if parts > 1:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "place"))).where(F.col("rank") <= k)
    return found.select(F.col("query").alias(query), F.col("key").alias(key if key != query else f"{key}_found"), "dist", "rank")


def search(signatures: DataFrame, queries: DataFrame, k: int = 10, allow_duplicates: bool = False) -> DataFrame:
    """(topic_id, rank, score, dist, and the columns of signatures without bits): the k best of each query.

    Ordered by distance in the query's mask, then quality, larger first, doc_id and offset_begin; only the best segment of a document
    counts unless duplicates are allowed. signatures need doc_num, which is unique.
    """
    meta = [c for c in signatures.columns if c not in word_columns(signatures.columns)]
    order = [(-F.col("quality")).alias("q"), F.col("doc_id"), F.col("offset_begin")]
    found = nearest(queries, signatures, "topic_id", "doc_num", k, order, None if allow_duplicates else "doc_id")
    score = (1_000_001 - F.col("rank")).alias("score")
    return found.join(signatures.select(*meta), "doc_num").select("topic_id", "rank", score, "dist", *meta)


def docsim(signatures: DataFrame, k: int = 10, first: int | None = None, last: int | None = None, exclude_self: bool = False) -> DataFrame:
    """(doc_num, found_num, dist, rank): the k nearest signatures of each one numbered first to last, itself among them unless excluded.

    Ordered by distance, then number. Signatures all of whose bits differ are not found.
    """
    width = 64 * len(word_columns(signatures.columns))
    asked = signatures.where(F.col("doc_num") >= first) if first is not None else signatures
    asked = asked.where(F.col("doc_num") <= last) if last is not None else asked
    w = word_columns(signatures.columns)
    found = nearest(asked.select(F.col("doc_num").alias("asked"), *w), signatures.select("doc_num", *w), "asked", "doc_num", k + exclude_self)
    found = found.where(F.col("dist") < width)
    if exclude_self:
        rank = F.row_number().over(Window.partitionBy("asked").orderBy("rank"))
        found = found.where("asked != doc_num").withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("asked").alias("doc_num"), F.col("doc_num").alias("found_num"), "dist", "rank")


def pairs(signatures: DataFrame) -> DataFrame:
    """(a, b, dist) of all pairs of numbers a < b.

    Tiles of TILE signatures, in the order of numbers, meet every one before their last, and are spread only then: nothing is shuffled or
    broadcast but the signatures, once. Rows come tile by tile: a stays for a tile and b repeats its numbers, so their dictionaries stay
    small and written rows take little more than their distances.
    """
    names = word_columns(signatures.columns)
    rows = cut(numbered(signatures.select(F.col("doc_num").alias("a"), *[F.col(n).alias(f"a{n}") for n in names]), "a"), "rows")
    each = F.struct("a", *[f"a{n}" for n in names])
    own = rows.groupBy(F.floor(F.col("doc_num") / TILE).alias("at")).agg(F.sort_array(F.collect_list(each)).alias("x"))
    tiles = cut(own.select(F.col("x.a").alias("bs"), *[F.col(f"x.a{n}").alias(f"b{n}") for n in names]), "tiles")
    count = tiles.count()
    tiles = tiles.repartition(max(1, min(count, max(8 * signatures.sparkSession.sparkContext.defaultParallelism, -(-count // 16)))))
    met = tiles.join(rows.drop("doc_num").coalesce(1).hint("shuffle_replicate_nl"), F.col("a") < F.element_at("bs", -1))
    spread = met.select("*", F.posexplode("bs").alias("at", "b")).where(F.col("a") < F.col("b"))
    return spread.select("a", "b", hamming([F.col(f"a{n}") for n in names], [F.get(f"b{n}", F.col("at")) for n in names]).alias("dist"))
