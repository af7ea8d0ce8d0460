"""Every registered query: against its SQL where it has one, else that it gives rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sigloom import catalog
from sigloom.operators import search as exact
from sigloom.operators import signatures
from sigloom.plans import search
from tests.oracle import difference, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SMALL)
    if name in catalog.oracle_sql():
        assert difference(df, con, catalog.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["issl_search", "issl_search_stored"])
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_issl_search_recall(spark, sf, name):
    """Of the 10 nearest by exhaustive search, at least nine in ten are found; queries are numbers divisible by EVERY."""
    rows = lambda name: {(r["doc_num"], r["found_num"]) for r in catalog.queries()[name](spark, f"/root/testdata/{sf}").where(F.col("doc_num") % search.EVERY == 0).collect()}
    wanted = rows("exhaustive_docsim")
    assert len(wanted & rows(name)) >= 0.9 * len(wanted)


def test_topic_refine_searches_by_the_first_line(spark):
    stats, sig = search.stats(spark, SMALL), search.documents(spark, SMALL)
    lines = search.topics(spark, SMALL).toPandas()
    lines["text"] = [t.split("\n")[0] for t in lines["text"]]
    asked = signatures.query_signatures(spark.createDataFrame(lines), search.MD5, stats)
    wanted = {(r["topic_id"], r["doc_id"]) for r in exact.search(sig, asked, search.FED).collect()}
    assert {(r["topic_id"], r["doc_id"]) for r in catalog.queries()["topic_refine"](spark, SMALL).collect()} == wanted


def split(text, most):
    """Segments of a text as lists of [term, count, begin, end]."""
    out, now = [], {}
    for m in re.finditer(rb"[A-Za-z0-9]+", text.encode()):
        if len(m[0]) > 127:
            continue
        x = now.setdefault(m[0].decode().lower(), [0, m.start(), 0])
        x[0], x[2] = x[0] + 1, m.end()
        if len(now) >= most:
            out.append(now)
            now = {}
    return [[[t, *v] for t, v in seg.items()] for seg in [*out, now] if seg]


def overlapping(text, most):
    """The same, with the terms of the segment before, and what each term is weighed against."""
    out, last = [], []
    for own in split(text, most):
        upto = list(itertools.accumulate(x[1] for x in last))
        total = sum(x[1] for x in [*last, *own])
        out.append([[*x, n] for x, n in zip([*last, *own], upto + [total] * len(own), strict=True)])
        last = own
    return out


def test_segments_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    for name, expected in (("split_hard", split), ("split_overlapping", overlapping)):
        wanted = sorted((d["doc_id"], seg, *x) for d in docs for seg, rows in enumerate(expected(d["text"], 128)) for x in rows)
        assert sorted(tuple(r) for r in catalog.queries()[name](spark, SMALL).collect()) == wanted


def test_overlapping_signatures_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    stats = {r["term"]: r["ctf"] for r in search.stats(spark, SMALL).collect()}
    n = sum(stats.values())
    rows = {(r["doc_id"], r["seg"]): r for r in catalog.queries()["signature_overlapping"](spark, SMALL).collect()}
    wanted = {(d["doc_id"], i): seg for d in docs for i, seg in enumerate(overlapping(d["text"], 128))}
    assert rows.keys() == wanted.keys()
    for key, seg in list(wanted.items())[::3]:
        sums = [0] * 64
        for term, c, _, _, total in seg:
            ll = math.log(c / total * n / stats.get(term, c))
            weight = int(ll * (c - 0.5) * 1000) if ll > 0 else c * 1000
            bits = int.from_bytes(hashlib.md5(term.encode()).digest()[:8], "big")
            sums = [s + (weight if bits >> (63 - i) & 1 else -weight) for i, s in enumerate(sums)]
        row = rows[key]
        assert row["bits"] == "".join("1" if s > 0 else "0" for s in sums)
        assert (row["unique_terms"], row["total_terms"]) == (len(seg), sum(x[1] for x in seg))


def test_cosines_of_stems_match_brute_force(spark):
    from sigloom.functions.porter import porter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    tf = {d["doc_id"]: Counter(porter(t.lower()) for t in re.findall("[A-Za-z0-9]+", d["text"]) if len(t) <= 127) for d in docs}
    norm = {d: math.sqrt(sum(c * c for c in x.values())) for d, x in tf.items()}
    wanted = {}
    for a in tf:
        for b in tf:
            if a % search.EVERY == 0 and a != b and tf[a].keys() & tf[b].keys():
                wanted[a, b] = sum(c * tf[b][t] for t, c in tf[a].items()) / (norm[a] * norm[b])
    got = {(r["a"], r["b"]): r["cosine"] for r in catalog.queries()["cosine_docsim_porter"](spark, SMALL).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - v) < 1e-8 for k, v in wanted.items())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["topic_id", "rank", "score", "dist", "doc_id", "quality"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
