"""Steps that must not grow faster than their input: the same rows as by brute force, and how the work is shared out."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.operators import runs, search, sequences, signatures, slices


def plan(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_kmers_of_many_windows_are_added_up_at_once(spark):
    """Weights of repeated, known and unknown k-mers as a loop over each place gives them; a small file is dealt over all cores."""
    one = sequences._Genome([3, 4], 64, 1, 1.0, "X", 50, 50, {"A": "C"})
    texts, known, all_ = ["ACGTACGTAAACG", "XX", "TTTTTTTT", "ACGXACG"], {"ACG": 2, "CGTA": 900, "TTT": 1}, 1000
    counts, bits = one.batch(texts, [known] * len(texts), all_)
    for text, n, row in zip(texts, counts, bits, strict=True):
        total, mass, seen, used = np.zeros(64), 0.0, 0, set()
        for k in (3, 4):
            for kmer in sequences.kmers(text, [k]):
                ll = math.log(all_ / known[kmer] / max(1, len(text) - k)) if kmer in known else 0
                weight = ll - (0 if kmer in used else 0.5) if ll > 0 else 1.0
                used |= {kmer} if ll > 0 else set()
                for term, x in sequences.variants(kmer, 1, {"A": "C"}):
                    total, mass = total + x * weight * sequences.uniform_vectors([term], 64)[0], mass + x * weight
                seen += 1
        assert n == seen and (row == (total / mass >= 0.5 if mass else np.zeros(64, dtype=bool))).all()
    records = spark.createDataFrame([(i, "ACGTACGT") for i in range(64)], "doc_id int, residues string").coalesce(1)
    assert sequences.genome_signatures(records, [3], 64).rdd.getNumPartitions() >= 4
    assert [tuple(r) for r in sequences.kmer_stats(records, [8]).collect()] == [("ACGTACGT", 64, 64)]


def test_cosines_meet_in_blocks(spark, monkeypatch):
    """Pairs of string ids over several small blocks, as by brute force; no row of a pair is joined or grouped."""
    monkeypatch.setattr(runs, "DOCS", 7)
    monkeypatch.setattr(runs, "ASKED", 3)
    rng = np.random.default_rng(5)
    tf = {f"d{i}": {f"t{t}": int(c) for t, c in zip(rng.integers(0, 60, 6), rng.integers(1, 9, 6), strict=True)} | ({"all": 2} if i % 3 else {}) for i in range(40)}
    terms = spark.createDataFrame([(d, t, c) for d, x in tf.items() for t, c in x.items()] + [(None, "all", 1)], "doc_id string, term string, cnt long")
    norm = {d: math.sqrt(sum(c * c for c in x.values())) for d, x in tf.items()}
    wanted = {(a, b): sum(c * tf[b][t] for t, c in x.items() if t in tf[b]) / (norm[a] * norm[b]) for a, x in tf.items() for b in tf if a < b and x.keys() & tf[b].keys()}
    found = runs.cosine_pairs(terms)
    assert {(r["a"], r["b"]): r["cosine"] for r in found.collect()} == wanted
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)


def test_pairs_come_tile_by_tile(spark, monkeypatch):
    """All pairs of sparse numbers and two words, as by brute force; a written file repeats a few numbers b for each a, and nothing is broadcast."""
    monkeypatch.setattr(search, "TILE", 8)
    rng = np.random.default_rng(6)
    rows = [(int(i) * 1000, *(int(x) for x in rng.integers(-(2**63), 2**63, 2))) for i in rng.permutation(45)]
    found = search.pairs(spark.createDataFrame(rows, "doc_num long, w0 long, w1 long"))
    bits = {i: (a % 2**64) << 64 | b % 2**64 for i, a, b in rows}
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b, (bits[a] ^ bits[b]).bit_count()) for a in bits for b in bits if a < b)
    assert "Broadcast" not in plan(found)
    runs_ = [key for part in found.select("a", "b").rdd.glom().collect() for key, _ in itertools.groupby((r["a"], r["b"] // 8000) for r in part)]
    assert len(runs_) == len(set(runs_))


def test_nearest_holds_the_best_of_each_query(spark):
    """Over many small blocks, with ties, masks and groups, few queries and many, as by brute force; with many no pair is ranked outside of its task."""
    rng = np.random.default_rng(7)
    made = [(f"s{i:03}", int(rng.integers(0, 3)), f"g{rng.integers(0, 40)}" if i % 9 else None, *(int(x) for x in rng.integers(0, 4, 2))) for i in range(150)]
    table = spark.createDataFrame(made, "id string, worth int, g string, w0 long, w1 long")
    for n, mask in ((90, False), (3, True)):
        asked = [(i, *(int(x) for x in rng.integers(0, 4, 2)), *((1, 2) if mask else ())) for i in range(n)]
        queries = spark.createDataFrame(asked, "q int, w0 long, w1 long" + (", m0 long, m1 long" if mask else ""))
        for group in (None, "g"):
            found = search.nearest(queries, table, "q", "id", 6, [-F.col("worth")], group, block=8)
            wanted = set()
            for q, a, b, *m in asked:
                rows, seen = [], set()
                for d, _, name, g in sorted((((a ^ w0) & (m or [-1, -1])[0]).bit_count() + ((b ^ w1) & (m or [-1, -1])[1]).bit_count(), -worth, name, g or "") for name, worth, g, w0, w1 in made):
                    if group is None or g not in seen:
                        rows.append((d, name))
                        seen.add(g)
                wanted |= {(q, name, d, i + 1) for i, (d, name) in enumerate(rows[:6])}
            assert {tuple(r) for r in found.collect()} == wanted
            assert mask or "Window" not in plan(found)
    assert search.nearest(queries, table.limit(0), "q", "id").count() == 0 and search.nearest(queries.limit(0), table, "q", "id").count() == 0


def test_most_votes_are_counted_in_place(spark, monkeypatch):
    """The first of each query as ranking all votes gives them, over many blocks, from signatures or lists, also where scores are 0; no pair is grouped."""
    monkeypatch.setattr(slices, "LISTED", 16)
    monkeypatch.setattr(slices, "ASKED", 8)
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(int(i) * 3, int(x)) for i, x in enumerate(rng.integers(0, 1 << 20, 90))], "doc_num long, w0 long").cache()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("votes"), "found"))
    for radius, queries in ((2, table.where("doc_num % 2 = 0")), (6, table.limit(2))):
        wanted = {tuple(r) for r in slices.votes(table, 6, radius, queries=queries).withColumn("place", place).where("place <= 5").drop("place").collect()}
        for index in (None, slices.build(table, 6)):
            found = slices.most_votes(table, 5, 6, radius, queries=queries, index=index)
            assert {tuple(r) for r in found.withColumn("place", place).where("place <= 5").drop("place").collect()} == wanted
            assert "HashAggregate(keys=[query" not in plan(found)
    assert slices.search(table, 3, 5, 6, 2, queries=table.limit(0)).count() == 0


def test_common_terms_meet_their_statistics_in_place(spark, monkeypatch):
    """As a left join gives it, for common, rare and unknown terms; rows of a common term are not shuffled."""
    monkeypatch.setattr(signatures, "COMMON", 2)
    each = spark.createDataFrame([(i, t) for i in range(30) for t in ("all", "most", "rare", "none")], "doc_id int, term string")
    stats = spark.createDataFrame([("all", 30, 40), ("most", 20, 30), ("rare", 3, 3), ("other", 2, 2)], "term string, df long, ctf long")
    found = signatures.with_stats(each, stats).select("doc_id", "term", "df", "ctf")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, each.join(stats, "term", "left").select("doc_id", "term", "df", "ctf").collect()), key=repr)
    assert "Union" in plan(found) and "BroadcastHashJoin" in plan(found)
