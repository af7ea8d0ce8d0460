"""MinHash near-duplicates by fast similarity sketching.

Each document's set of word 3-grams is sketched in ``t`` coordinates (Dahlgaard, Knudsen, Thorup, 2017): in round i < t every
element is thrown into one hashed bin, in round t + j all elements go to bin j, and a bin keeps the least value of the first
round that reached it. After 2t rounds no coordinate is empty, and the share of equal coordinates is concentrated about the
Jaccard similarity as if the coordinates were independent. Bands of ``rows`` coordinates give candidates, exact Jaccard
similarities decide, and connected components are the groups.

The number of comparisons follows the input: documents of equal words are one node; in a bucket all are compared with its first
document, those that differ from it with the first of them, and so on for ``LEADERS`` rounds. A document that differed from its bucket's
first may still be like any other there; such pairs, if nothing links them yet, are found by prefixes: of a set of n shingles, the rarest
first, one of the n - ceil(similarity * n) + 1 at the beginning is also at the beginning of every set that is similar enough. So pages of
one template, which share what is common and differ in what is rare, are not compared with each other. Pairs left out join documents
that are linked already, so the components are those of all pairs of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.names import fresh
from sigloom.llm.words import Batch, mix, slices, stretches
from sigloom.session import cut, table

SHINGLE, COORDINATES, ROWS, SIMILARITY = 3, 128, 4, 0.6
LEADERS = 2
#: Ids of candidates are broadcast up to this number, which is checked (16 MB); beyond it, texts and ids meet in a shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row: rows of equal id and text are one document."""
    return F.xxhash64(F.lit(7), F.col(doc_id), F.col(text))


def fill(doc: np.ndarray, element: np.ndarray, docs: int, t: int) -> np.ndarray:
    """Sketches, docs x t, of the sets given as (doc, element); documents without elements stay empty.

    Bins of powers of two are cut from the high bits of a round's hash; its low bits are the value.
    """
    sketch = np.full(docs * t, _EMPTY, dtype=np.uint64)
    shift, low = np.uint64(64 - (t.bit_length() - 1)), np.uint64((1 << (64 - (t.bit_length() - 1))) - 1)
    for i in range(t):
        if not len(doc):
            break
        h = mix(element ^ _SEEDS[i])
        at = doc * t + (h >> shift).astype(np.int64)
        if i:
            free = sketch[at] == _EMPTY
            at, h = at[free], h[free]
        np.minimum.at(sketch, at, h & low)
        open_ = (sketch.reshape(docs, t) == _EMPTY).any(axis=1)
        stay = open_[doc]
        doc, element = doc[stay], element[stay]
    if len(doc):
        open_ = sketch.reshape(docs, t) == _EMPTY
        for j in range(t):
            mine = open_[doc, j]
            if mine.any():
                np.minimum.at(sketch, doc[mine] * t + j, mix(element[mine] ^ _SEEDS[t + j]) & low)
    return sketch.reshape(docs, t)


def sketch_texts(texts: list[str | None], shingle: int = SHINGLE, t: int = COORDINATES, rows: int = ROWS) -> pd.DataFrame:
    """For each text: h1, h2 (hashes of its word sequence), n (shingles with repeats) and its bands, of which a text without words has none."""
    parts = []
    data = [(x or "").lower().encode() for x in texts]
    for a, b in slices(data):
        batch = Batch(data[a:b])
        doc, element = batch.shingles(shingle)
        sketch = fill(doc, element, batch.size, t)
        n = np.bincount(doc, minlength=batch.size)
        bands = [stretches(sketch.ravel(), np.arange(batch.size) * t + i, np.arange(batch.size) * t + i + rows) + np.uint64(i) for i in range(0, t, rows)]
        found = mix(np.stack(bands, axis=1)).view(np.int64) if batch.size else np.zeros((0, t // rows), dtype=np.int64)
        first = batch.first
        h1 = stretches(batch.hash, first[:-1], first[1:]).view(np.int64)
        h2 = stretches(mix(batch.hash ^ _SEEDS[-1]), first[:-1], first[1:]).view(np.int64)
        parts.append(pd.DataFrame({"h1": h1, "h2": h2, "n": n, "bands": [row if c else [] for row, c in zip(found, n, strict=True)]}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"h1": [], "h2": [], "n": [], "bands": []})


def sketches(docs: DataFrame, shingle: int = SHINGLE, t: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """A row (rid, doc_id, h1, h2, n, bands) for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = sketch_texts(list(pdf["text"]), shingle, t, rows)
            yield pd.concat([pdf[["rid", "doc_id"]].reset_index(drop=True), found], axis=1)

    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select(row_key().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInPandas(run, f"rid long, doc_id {kind}, h1 long, h2 long, n long, bands array<long>")


def jaccards(left: pd.Series, right: pd.Series, shingle: int = SHINGLE) -> pd.Series:
    """Exact Jaccard similarities of the shingle sets of pairs of texts."""
    out = np.zeros(len(left))
    pairs = [(str(x or "").lower().encode(), str(y or "").lower().encode()) for x, y in zip(left, right, strict=True)]
    for a, b in slices([x + y for x, y in pairs]):
        sets = []
        for side in (0, 1):
            doc, element = Batch([p[side] for p in pairs[a:b]]).shingles(shingle)
            sets.append((np.split(element, np.searchsorted(doc, np.arange(1, b - a)))))
        for i, (x, y) in enumerate(zip(*sets, strict=True)):
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[a + i] = both / max(1, len(x) + len(y) - both)
    return pd.Series(out)


def _same(node: str, doc_id: str, rid: str) -> Column:
    return F.col(f"{node}.doc_id").eqNullSafe(F.col(doc_id)) & (F.col(f"{node}.rid") == F.col(rid))


def _equal(a: str, b: str) -> Column:
    """Null-safe equality that is no join key: rows stay partitioned by the other key alone."""
    return F.size(F.array_distinct(F.array(F.col(a), F.col(b)))) == 1


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, rid, text) of the nodes (node), once each; of documents only those are moved."""
    ids = cut(nodes.select(F.col("node.doc_id").alias("i"), F.col("node.rid").alias("r")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", row_key().alias("rid"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(ids) if few else ids, (F.col("rid") == F.col("r")) & _equal("doc_id", "i"), "left_semi")
    return met.groupBy("doc_id", "rid").agg(F.first("text").alias("text"))  # rows that are repeated are one


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """pairs (a, b: struct<doc_id, rid>) with ``same``, whether their texts are similar enough."""
    ta, tb = (texts.select(F.col("doc_id").alias(f"i{x}"), F.col("rid").alias(f"r{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    met = pairs.join(tb, _same("b", "ib", "rb")).join(ta, _same("a", "ia", "ra"))
    score = F.pandas_udf(lambda x, y: jaccards(x, y, shingle), "double")
    return met.select("a", "b", score("ta", "tb").alias("jaccard")).withColumn("same", F.col("jaccard") >= similarity)


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """texts with ``elements``, their different shingles, instead of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data, parts = [(x or "").lower().encode() for x in pdf["text"]], []
            for a, b in slices(data):
                doc, element = Batch(data[a:b]).shingles(shingle)
                order = np.argsort(doc, kind="stable")
                parts += [np.unique(x).view(np.int64) for x in np.split(element[order], np.searchsorted(doc[order], np.arange(1, b - a)))]
            yield pdf[["doc_id", "rid"]].assign(elements=parts)

    return texts.mapInPandas(run, f"doc_id {dict(texts.dtypes)['doc_id']}, rid long, elements array<long>")


def by_prefixes(nodes: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of unlinked nodes that can be similar, at least one of them with ``x``. nodes: (node, x); roots: (node, root) of those that are linked."""
    linked = roots.select(F.col("node.doc_id").alias("ri"), F.col("node.rid").alias("rr"), F.xxhash64("root").alias("linked"))
    sets = shingle_sets(texts, shingle).select(F.struct("doc_id", "rid").alias("node"), "elements")
    wanted = nodes.select(F.col("node.doc_id").alias("wi"), F.col("node.rid").alias("wr"), "x")
    sets = sets.join(wanted, _same("node", "wi", "wr")).join(linked, _same("node", "ri", "rr"), "left")
    sets = cut(sets.select("node", "x", "elements", F.coalesce("linked", F.xxhash64("node")).alias("root")), "sets")
    each = sets.select("node", "x", "root", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = each.groupBy("e").agg(F.count(F.lit(1)).alias("f"), F.min("root").alias("least"), F.max("root").alias("most")).where("f > 1")
    often = often.select("e", "f", (F.col("least") != F.col("most")).alias("mixed"))  # what only one component has links nothing new
    lists = each.join(often, "e").groupBy("node", "x", "root", "n").agg(F.sort_array(F.collect_list(F.struct("f", "e", "mixed"))).alias("s"))
    rare = F.col("n") - F.size("s")  # elements that no other set has come first
    taken = F.greatest(F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1 - rare, F.lit(0))
    prefixes = cut(lists.select("node", "x", "root", "n", F.explode(F.slice("s", 1, taken)).alias("s")).where("s.mixed").select("node", "x", "root", "n", "s.e"), "prefixes")
    p, q = prefixes.where("x").alias("p"), prefixes.alias("q")
    close = (F.col("p.n") >= F.col("q.n") * similarity - 1e-9) & (F.col("q.n") >= F.col("p.n") * similarity - 1e-9)
    met = p.join(q, (F.col("p.e") == F.col("q.e")) & (F.col("p.root") != F.col("q.root")) & close)
    return met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Alternating large and small stars: each round is a few shuffles of the edges; rounds grow with the logarithm of the longest chain. A
    node's least neighbour is found combined and joined, as in _stars().
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = cut(large.where("a != b").distinct(), "large")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.*").where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(buckets: DataFrame) -> DataFrame:
    """(band, a, b) of buckets (head, band): a is one of the band, that of least hash, b each other one.

    The least are found combined, and joined, so that a band which a third of all documents share is divided like any other.
    """
    rows = buckets.select("band", "head", F.xxhash64("head").alias("hash"))
    least = rows.groupBy("band").agg(F.min("hash").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = cut(rows.join(least, "band"), "buckets")
    first = met.where("hash = least").groupBy("band").agg(F.min("head").alias("a"))
    return met.join(first, "band").where("head != a").select("band", "a", F.col("head").alias("b"))


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, t: int = COORDINATES, rows: int = ROWS
) -> DataFrame:
    """(doc_id, rid, duplicate_of) for every document that is not the first, by doc_id, of its group of near-duplicates.

    Texts are compared as sets of ``shingle`` words, lower-cased and without punctuation. Texts of fewer words are one shingle;
    null texts and texts without words are duplicates of nothing. Null ids come before all others. Rows of equal id and text are
    one document; rows of one id and different texts are different ones. An empty table gives an empty result.
    """
    marks = cut(sketches(docs.select("doc_id", "text"), shingle, t, rows).where("n > 0"), "sketches")
    node = F.struct("doc_id", "rid")
    heads = marks.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "bands")).alias("m"))
    heads = heads.select("h1", "h2", F.struct("m.doc_id", "m.rid").alias("head"), "m.bands")
    stars = cut(_stars(heads.select("head", F.explode("bands").alias("band"))), "stars")
    texts = cut(texts_of(stars.select(F.explode(F.array("a", "b")).alias("node")), docs), "texts")
    left, edges = stars, None
    for turn in range(LEADERS):
        near = cut(verified(left.select("a", "b").distinct(), texts, shingle, similarity), "near")
        found = near.where("same").select("a", "b")
        edges = found if edges is None else edges.union(found)
        apart = cut(left.join(near.where("not same").select("a", "b"), ["a", "b"], "left_semi").select("band", F.col("b").alias("x")), "apart")
        left = _stars(apart.select(F.col("x").alias("head"), "band"))
        if turn == 0:
            contested = apart
    if contested.take(1):
        # whoever differed from a first, and those it may be like: all others of its buckets
        others = stars.join(contested.select("band").distinct(), "band", "left_semi").select(F.col("b").alias("node"), F.lit(False).alias("x"))
        nodes = contested.select(F.col("x").alias("node"), F.lit(True).alias("x")).union(others).groupBy("node").agg(F.max("x").alias("x"))
        rest = cut(by_prefixes(nodes, texts, components(edges), shingle, similarity), "rest")
        edges = edges.union(verified(rest, texts, shingle, similarity).where("same").select("a", "b"))
    roots = components(edges).withColumnRenamed("node", "head")
    heads = heads.select("h1", "h2", "head").join(roots, "head", "left").select("h1", "h2", F.coalesce("root", "head").alias("keep"))
    found = marks.select("h1", "h2", node.alias("node")).join(heads, ["h1", "h2"]).where("node != keep").select("node", "keep").distinct()
    return found.select("node.doc_id", "node.rid", F.col("keep.doc_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that near_duplicates() names, and with one of each set of rows of equal id and text."""
    rid, own, out, whole = fresh(docs.columns, "rid", "own_id", "out", "row")
    found = near_duplicates(docs, similarity).select(F.col("doc_id").alias(own), F.col("rid").alias(out))
    rows = docs.withColumn(rid, row_key())
    kept = rows.join(found, (F.col(rid) == F.col(out)) & _equal("doc_id", own), "left_anti")
    # rows that are repeated meet combined: however many there are, a task sends one
    once = kept.groupBy("doc_id", rid).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(whole))
    return once.select(*[F.col(f"`{whole}`.`{c}`") for c in docs.columns])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "duplicate_of")
