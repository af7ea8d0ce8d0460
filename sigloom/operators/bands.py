"""Signatures of rows of numbers (bands of pixels), their classification by neighbours, and its evaluation.

Pixels are numbered row by row; truth is (pixel, code, confidence) with code 0 for unknown; a run is (pixel, found, rank, hd).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.bits import pack, words
from sigloom.session import cut


def normalised(rows: DataFrame, bands: list[str]) -> DataFrame:
    """(band, value, share): for each whole number between a band's least and largest, the share of rows below it.

    Shares are of the rows below the largest value, so that one has share 1; of a band with one value only it is null.
    """
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(b).cast("bigint").alias("value")) for i, b in enumerate(bands)])).alias("x"))
    counts = each.select("x.*").where("value is not null").groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.groupBy("band").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    grid = ranges.select("band", "b", F.explode(F.sequence("a", "b")).alias("value"))
    met = grid.join(counts, ["band", "value"], "left")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("band").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumn("below", below)
    most = F.max("below").over(Window.partitionBy("band"))
    return met.select("band", "value", F.try_divide(F.col("below").cast("double"), most).alias("share"))


def kernel_signatures(
    rows: DataFrame, key: str, bands: list[str], width: int = 64, kernels: int = 8, spread: float = 1.0, weights: dict[str, float] | None = None,
    shares: DataFrame | None = None, least: float = 0.0, most: float = 10_000.0, seed: int = 0,
) -> DataFrame:
    """(key, words): a band's value is a mixture of the random vectors of the kernels near it, by a triangle; bits are set where the weighted
    mean over bands is 1/2 at least.

    Values are normalised by ``shares`` (band, value, share), a row for each value of a band, which is joined; else linearly from
    least to most. Bands without weight are left out. Bands that no kernel reaches set no bit.
    """
    order = np.random.default_rng(seed).random((kernels, len(bands), width))
    weight = np.array([1.0 if weights is None else weights.get(b, 0.0) for b in bands])
    rows, linear = rows.select(key, *bands), shares is None
    if shares is not None:
        for i, b in enumerate(bands):
            own = shares.where(F.col("band") == i).select(F.col("value").alias("__value"), F.col("share").alias("__share"))
            rows = rows.join(own, F.col(b).cast("bigint") == F.col("__value"), "left").withColumn(b, F.col("__share")).drop("__value", "__share")
    reach = spread / (kernels - 1)
    at = np.arange(kernels) / (kernels - 1)
    names = words(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[bands].to_numpy(dtype=float)
            if linear:
                x = (x - least) / (most - least)
            near = np.maximum(reach - np.abs(at[None, None, :] - x[:, :, None]), 0.0)
            with np.errstate(invalid="ignore", divide="ignore"):
                mixed = np.einsum("rbk,kbw->rbw", near, order) / near.sum(axis=2)[:, :, None]
                mean = np.einsum("rbw,b->rw", mixed, weight) / weight.sum()
            packed = pack(mean >= 0.5)
            yield pd.DataFrame({key: pdf[key]} | {n: packed[:, i] for i, n in enumerate(names)})

    columns = ", ".join(f"{n} long" for n in names)
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {columns}")


def contrast(distances: DataFrame, truth: DataFrame, code: int) -> DataFrame:
    """(coded, uncoded, contrast): mean distance (pixel, hd) of the pixels of a code and of all others, and the difference."""
    met = truth.join(distances, "pixel", "left").withColumn("hd", F.coalesce("hd", F.lit(0)))
    mean = lambda c: F.avg(F.when(c, F.col("hd")))
    out = met.agg(mean(F.col("code") == code).alias("coded"), mean(F.col("code") != code).alias("uncoded"))
    return out.select("coded", "uncoded", (F.col("uncoded") - F.col("coded")).alias("contrast"))


def confidence(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(pixel, code, confidence): the share of a pixel's found pixels of known code that have its own; 0 where its own is unknown or none is known."""
    own = truth.select("pixel", "code")
    known = run.join(own.where("code != 0").select(F.col("pixel").alias("found"), F.col("code").alias("other")), "found")
    met = own.join(known.select("pixel", "other"), "pixel", "left")
    share = F.avg((F.col("other") == F.col("code")).cast("double"))
    out = met.groupBy("pixel", "code").agg(share.alias("s"))
    return out.select("pixel", "code", F.when(F.col("code") == 0, F.lit(0.0)).otherwise(F.coalesce("s", F.lit(0.0))).alias("confidence"))


def fold_range(width: int, height: int, folds: int, fold: int, direction: str = "h") -> tuple[int, int, int, int]:
    """(x0, x1, y0, y1) of a validation part: strips of rows (h) or columns (v), or cells of a grid (g)."""
    if direction == "h":
        return 0, width, fold * height // folds, (fold + 1) * height // folds
    if direction == "v":
        return fold * width // folds, (fold + 1) * width // folds, 0, height
    across = int(folds**0.5)
    down = folds // across
    x, y = fold % across, fold // across
    return x * width // across, (x + 1) * width // across, y * height // down, (y + 1) * height // down


def folded(truth: DataFrame, width: int, height: int, folds: int, fold: int, direction: str = "h") -> tuple[DataFrame, DataFrame]:
    """(training, validation): the part's codes are unknown in training, all others in validation."""
    x0, x1, y0, y1 = fold_range(width, height, folds, fold, direction)
    x, y = F.col("pixel") % width, F.floor(F.col("pixel") / width)
    inside = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
    blank = lambda c: truth.withColumn("code", F.when(c, 0).otherwise(F.col("code"))).withColumn("confidence", F.when(c, 0.0).otherwise(F.col("confidence")))
    return blank(inside), blank(~inside)


def classified(run: DataFrame, training: DataFrame, width: int, decay: float = 1.0) -> DataFrame:
    """(pixel, code): the code with most votes among a pixel's found pixels of known code, in other rows and columns than its own.

    A vote is confidence * (1 - decay * (hd - the first vote's hd)), where positive; of equal sums the code found first. Pixels
    without votes have no row.
    """
    known = training.where("code != 0").select(F.col("pixel").alias("found"), "code", "confidence")
    apart = (F.col("found") % width != F.col("pixel") % width) & (F.floor(F.col("found") / width) != F.floor(F.col("pixel") / width))
    votes = run.where(apart).join(known, "found")
    start = F.first("hd").over(Window.partitionBy("pixel").orderBy("rank"))
    vote = F.greatest(F.lit(0.0), (1.0 - (F.col("hd") - start) * decay) * F.col("confidence"))
    sums = votes.select("pixel", "code", "rank", vote.alias("v")).groupBy("pixel", "code").agg(F.round(F.sum("v"), 9).alias("v"), F.min("rank").alias("first"))
    best = F.row_number().over(Window.partitionBy("pixel").orderBy(F.desc("v"), "first"))
    return sums.withColumn("n", best).where("n = 1").select("pixel", "code")


def smoothed(codes: DataFrame, width: int, height: int, radius: int = 1, least: int = 6, scheme: str = "111", rounds: int = 1) -> DataFrame:
    """codes where a pixel takes the one code that has ``least`` votes or more around it, if exactly one has.

    A pixel votes by the digit of the scheme for its distance, in rows plus columns; beyond the scheme 0.
    """
    steps = [(dx, dy, int(scheme[d]) if (d := abs(dx) + abs(dy)) < len(scheme) else 0) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(v).alias("v")) for dx, dy, v in steps if v])
    for step in range(rounds):
        x, y = (F.col("pixel") % width).cast("int"), F.floor(F.col("pixel") / width).cast("int")
        cast = codes.select(x.alias("x"), y.alias("y"), "code", F.inline(moves))
        to = cast.select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "code", "v")
        to = to.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
        sums = to.groupBy((F.col("y") * width + F.col("x")).cast("bigint").alias("p"), "code").agg(F.sum("v").alias("v")).where(F.col("v") >= least)
        only = sums.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("new")).where("n = 1")
        codes = codes.join(only, F.col("pixel") == F.col("p"), "left").select("pixel", F.coalesce("new", "code").alias("code"))
        if step < rounds - 1:
            codes = cut(codes, "smoothed")
    return codes


def error_rate(codes: DataFrame, validation: DataFrame) -> DataFrame:
    """(wrong, n, rate) over the pixels of known code; a pixel without a code is wrong."""
    met = validation.where("code != 0").select("pixel", F.col("code").alias("truth")).join(codes, "pixel", "left")
    wrong = (~F.col("truth").eqNullSafe(F.col("code"))).cast("int")
    return met.agg(F.coalesce(F.sum(wrong), F.lit(0)).alias("wrong"), F.count(F.lit(1)).alias("n")).withColumn("rate", F.try_divide(F.col("wrong").cast("double"), F.col("n")))


def plot(values: DataFrame, width: int, height: int, most: int = 255) -> DataFrame:
    """(y, value): the lines of a plain PGM picture of (pixel, value), below its header as line -1; missing pixels are 0."""
    spark = values.sparkSession
    grid = spark.range(width * height).select(F.col("id").alias("pixel")).join(values, "pixel", "left")
    v = F.least(F.greatest(F.coalesce(F.col("value").cast("int"), F.lit(0)), F.lit(0)), F.lit(most))
    rows = grid.select(F.floor(F.col("pixel") / width).cast("int").alias("y"), F.struct(F.col("pixel"), v.cast("string").alias("v")).alias("p"))
    lines = rows.groupBy("y").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"]), " ").alias("value"))
    head = spark.range(1).select(F.lit(-1).alias("y"), F.lit(f"P2 {width} {height}\n{most}").alias("value"))
    return reduce(DataFrame.unionByName, [head, lines]).orderBy("y")
