"""Readers, exchange formats, results, the modes, and operators that the queries' SQL doesn't cover."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom import engine
from sigloom.config import EngineConfig
from sigloom.functions.bits import words
from sigloom.functions.tokenizer import Splitting
from sigloom.operators import bands, feedback, runs, search, sequences, signatures, slices, tables
from sigloom.operators.vectors import Projection, accumulated, term_vectors, vectors
from sigloom.sources import binary, collections, results, topics


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_readers(spark, tmp_path):
    def put(name, data):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
        return [str(path)]

    assert list(texts(collections.read_files(spark, [str(tmp_path / "d")] if put("d/one.txt", b"hi there") else [])).values()) == ["hi there"]
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as archive:
        for name in ("a.txt", "NULL", "b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            archive.addfile(info, io.BytesIO(b"xy"))
    assert texts(collections.read_tar(spark, put("x.tar", buffer.getvalue()))) == {"a.txt": "xy", "b.txt": "xy"}
    sgml = b"<DOC>\n<DOCNO> W1 </DOCNO> one </DOC>\n<DOC><DOCNO> W2 </DOCNO> two </DOC>\n"
    assert texts(collections.read_sgml(spark, put("w.sgml", sgml)))["W2"] == "<DOC><DOCNO> W2 </DOCNO> two </DOC>"
    assert set(texts(collections.read_sgml(spark, put("w.gz2", gzip.compress(sgml)), "gz"))) == {"W1", "W2"}
    assert set(texts(collections.read_sgml(spark, put("w.bz", bz2.compress(sgml)), "bz2"))) == {"W1", "W2"}
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nwarc-trec-id: %s\r\nContent-Length: 5\r\n\r\nab\0de\r\n\r\n"
    warc = record % (b"warcinfo", b"i") + record % (b"response", b"r1")
    assert texts(collections.read_warc(spark, put("x.warc", warc))) == {"r1": "ab_de"}
    assert list(collections.warc_records("p", warc))[0][0] == "r1"
    with pytest.raises(ValueError):
        list(collections.warc_records("p", warc[:-8]))
    assert texts(collections.read_newline(spark, put("n.txt", b"a\nb\nc\n"))) == {"0001": "a", "0002": "b", "0003": "c"}
    assert collections.newline_documents("a\nb\nc", strict=True) == [("0001", "b")]
    assert texts(collections.read_records(spark, put("k.txt", b"#UID:u1\n#CONTENT:text one\n#EOR\n#UID:u2\n#CONTENT:two\n#EOR\n"))) == {"u1": "text one", "u2": "two"}
    assert texts(collections.read_photos(spark, put("m.xml", b'<x><photo id="7" t="q">in</photo><photo a="b" id="8"/>o</photo></x>'))) == {"7": ' id="7" t="q">in', "8": ' a="b" id="8"/>o'}
    fasta = put("f.fasta", b">s1 first\nACGT\nAC\n>s2,x\nGG\n")
    assert {r["doc_id"]: r["residues"] for r in collections.read_fasta(spark, fasta).collect()} == {"s1": "ACGTAC", "s2": "GG"}
    one = (1).to_bytes(4, "little")
    feature = one + (2).to_bytes(4, "little") + one + one + b"\x03pic" + one + b"\x01\0\x02\0" + b"\x05\0\x06\0" + b"\xab\xcd"
    assert [tuple(r) for r in collections.read_features(spark, put("p.bin", feature)).collect()] == [("pic_5,6", bytearray(b"\xab\xcd"))]
    config = EngineConfig().with_values([("TARGET-PATH", str(tmp_path / "d")), ("DOCID-FORMAT", "basename")])
    assert texts(collections.read_collection(spark, config)) == {"one": "hi there"}
    assert collections.targets(config.with_values({"TARGET-PATH-2": "", "TARGET-PATH-3": "x"})) == [str(tmp_path / "d"), "x"]


def test_topics(spark, tmp_path):
    (tmp_path / "t.txt").write_text("51 airline subsidies\n52 trade\n")
    assert [tuple(r) for r in topics.read(spark, f"{tmp_path}/t.txt").orderBy("topic_num").collect()] == [(0, "51", "airline subsidies"), (1, "52", "trade")]
    (tmp_path / "q.txt").write_text("first line\nthe rest")
    (tmp_path / "l.txt").write_text(f"9 {tmp_path}/q.txt\n")
    assert tuple(topics.read(spark, f"{tmp_path}/l.txt", "filelist_rf").first()) == (0, "9", "first line", "first line\nthe rest")
    (tmp_path / "p.txt").write_text("A. B. A sentence. Dé end. rest")
    found = topics.read(spark, f"{tmp_path}/p.txt", "plagdet").orderBy("topic_num").collect()
    assert [(r["topic_id"], r["text"]) for r in found] == [("0", "A. B."), ("5", " A sentence."), ("17", " D? end.")]
    with pytest.raises(ValueError):
        topics.read(spark, "x", "plain")


def test_format_language(spark):
    row = spark.createDataFrame([(3, "T3", 5, "D5", 1, 1_000_000, 17, 42)], "topic_num int, topic_id string, doc_num int, doc_id string, rank int, score int, dist int, unique_terms int")
    assert row.select(results.formatted(r"%T\t%D\_%h%%\n").alias("v")).first()["v"] == "T3\tD5 17%\n"
    assert row.select(results.formatted(r"%t %d %r %s %1\\").alias("v")).first()["v"] == "3 5 1 1000000 42\\"
    for bad in ("%x", "\\q", "%"):
        with pytest.raises(ValueError):
            results.pieces(bad)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i:02d}", " ".join(f"word{(i * k) % 23}" for k in range(1, 30)) + ". More text here.") for i in range(40)]
    return spark.createDataFrame([*rows, ("empty", ""), ("none", None)], "doc_id string, text string")


def test_build_agrees_with_vectors(spark, docs):
    p = Projection(width=128, density=8)
    rows = {r["doc_id"]: (r["w0"], r["w1"]) for r in signatures.build(docs, p).collect()}
    assert len(rows) == 40
    for r in docs.where("length(text) > 0").collect():
        tokens = [t.lower() for t in __import__("re").findall("[A-Za-z0-9]+", r["text"])]
        sums = vectors(tokens, p).astype(int).sum(axis=0)
        expected = [int("".join("1" if v > 0 else "0" for v in sums[i : i + 64]), 2) for i in (0, 64)]
        assert [x % 2**64 for x in rows[r["doc_id"]]] == expected
    assert accumulated([["a"]], [np.array([5])], p).shape == (1, 128)
    found = term_vectors(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "term string"), p).collect()
    assert sorted(r["term"] for r in found) == ["a", "b"] and all(len(r["pos"]) == len(r["neg"]) == 8 for r in found)


def test_split_signatures_number_segments(docs):
    found = signatures.numbered(signatures.build(docs, Projection(width=64), splitting=Splitting("hard", 5, 10))).orderBy("doc_num").collect()
    assert [r["doc_num"] for r in found] == list(range(len(found)))
    assert [(r["doc_id"], r["seg"]) for r in found] == sorted((r["doc_id"], r["seg"]) for r in found)


def test_binary_round_trip(spark, docs, tmp_path):
    header = binary.Header(name_length=15, width=128, density=8, method="SKIP")
    table = signatures.numbered(signatures.build(docs, Projection(width=128, density=8, method="SKIP")))
    assert binary.write_signatures(table, f"{tmp_path}/s.sig", header) == 40
    back, own = binary.read_signatures(spark, f"{tmp_path}/s.sig")
    assert own == header
    columns = ["doc_num", "doc_id", *signatures.META, *words(128)]
    assert back.select(columns).orderBy("doc_num").collect() == table.select(columns).orderBy("doc_num").collect()
    stats = spark.createDataFrame([("a", 2, 3), ("b", 4, 5)], "term string, df int, ctf int")
    assert binary.write_stats(stats, f"{tmp_path}/t.bin") == 2
    assert sorted((r["df"], r["ctf"]) for r in binary.read_stats(spark, f"{tmp_path}/t.bin").collect()) == [(2, 3), (4, 5)]
    index = slices.build(table, 8)
    binary.write_index(index, f"{tmp_path}/i.bin", 128, 8, 40)
    assert sorted(map(repr, binary.read_index(spark, f"{tmp_path}/i.bin").collect())) == sorted(map(repr, index.collect()))


def test_wide_radius_equals_exhaustive(docs):
    """With the slice width as radius every signature gets votes, so re-ranking all gives the exact nearest."""
    table = signatures.numbered(signatures.build(docs, Projection(width=64)))
    exact = search.docsim(table, 5).orderBy("doc_num", "rank").collect()
    assert slices.search(table, 5, rerank_k=1000, slice_width=8, radius=8).orderBy("doc_num", "rank").collect() == exact
    alone = search.docsim(table, 3, exclude_self=True).collect()
    assert all(r["doc_num"] != r["found_num"] for r in alone)
    small = search.nearest(table.selectExpr("doc_num AS q", "w0"), table, "q", "doc_num", 5, block=8).orderBy("q", "rank").collect()
    assert [(r["q"], r["doc_num"]) for r in small] == [(r["doc_num"], r["found_num"]) for r in exact]


def test_feedback_without_rerank_changes_nothing(docs):
    table = signatures.numbered(signatures.build(docs, Projection(width=64))).drop("seg")
    found = search.docsim(table, 8).selectExpr("doc_num AS topic_id", "rank", "dist", "found_num AS doc_num").join(table.select("doc_num", "doc_id", "quality", "offset_begin"), "doc_num")
    same = feedback.blind(found, table, 3, 0)
    assert sorted(map(repr, same.collect())) == sorted(map(repr, found.collect()))
    clamped = feedback.blind(found, table, 100, 100)
    assert sorted(r["rank"] for r in clamped.where("topic_id = 0").collect()) == list(range(1, 9))


def test_runs(spark):
    rows = [("1", "a", 3), ("1", "b", 3), ("1", "c", 5), ("2", "a", 1)]
    run = spark.createDataFrame([(t, d, 1, 1, "r", h) for t, d, h in rows], "topic_id string, doc_id string, rank int, score int, run string, hd int")
    assert runs.merged(run, 1).count() == 3 and runs.merged(run, 1, hard=True).count() == 2
    line = spark.createDataFrame([("1 Q0 a 1 1000000 run 7",), ("bad",)], "value string")
    assert [tuple(r)[:6] for r in runs.parsed(line).collect()] == [("1", "a", 1, 1_000_000, "run", 7)]
    truth = spark.createDataFrame([("1", 1, 1), ("1", 2, 2)], "topic_id string, rank int, hd int")
    found = spark.createDataFrame([("1", 1, 2), ("1", 2, 2)], "topic_id string, rank int, hd int")
    assert [r["ratio"] for r in runs.distance_ratio(truth, found).orderBy("rank").collect()] == [0.5, 0.75]
    mixed = spark.createDataFrame([("x1", d, "r", h) for d, h in (("x_5", 1), ("y", 2), ("x_7", 3), ("z", 4), ("x_7b", 5))], "topic_id string, doc_id string, run string, hd int")
    counts = {r["pct"]: r["n"] for r in runs.focused_histogram(mixed, 2).collect() if r["n"]}
    assert counts == {5: 1, 7: 1}
    spans = [("s", 0, 10, 5, 9)]
    assert "<td>10</td>" in runs.span_report(spans)
    frame = spark.createDataFrame(spans, "source string, begin int, length int, source_begin int, source_length int")
    assert 'source_reference="s.txt"' in runs.span_lines(frame).first()["value"]


def test_sequences(spark):
    assert sequences.windows("abcdefg", 3, 2) == [(0, "abc"), (2, "cde"), (4, "efg")]
    assert sequences.windows("abcdef", 4, 3) == [(0, "abcd"), (2, "cdef")] and sequences.windows("", 4, 3) == []
    assert sequences.kmers("ABXCD", [2]) == ["AB", "CD"]
    assert sorted(sequences.variants("AB", 1)) == sorted([("AB", 1.0), ("*B", 0.5), ("A*", 0.5)])
    assert sorted(t for t, _ in sequences.variants("AB", 0, {"A": "C", "B": "D"})) == ["AB", "AD", "CB", "CD"]
    sparse = sequences.uniform_vectors(["AC", "GT"], 200, 0.2)
    assert 0.1 < (sparse > 0).mean() < 0.3 and (sparse[1] == sequences.uniform_vectors(["GT"], 200, 0.2)[0]).all()
    order = sequences.position_shuffles(3, 64)
    assert all(sorted(r) == list(range(64)) for r in order.tolist())
    records = spark.createDataFrame([("s", "ACGTACGTAA"), ("t", "XX"), ("u", None)], "doc_id string, residues string")
    found = sequences.genome_signatures(records, [3], 64, size=5, advance=3).collect()
    assert [(r["doc_id"], r["seg"], r["offset_begin"]) for r in found] == [("s", 0, 0), ("s", 1, 3), ("s", 2, 5)]
    stats = sequences.kmer_stats(records, [3], size=5, advance=3)
    known, one = {r["term"]: r["df"] for r in stats.collect()}, sequences._Genome([3], 64, 1, 0.5, "X", 5, 3, None)
    total = sum(r["ctf"] for r in stats.collect())
    rows = sequences.genome_signatures(records, [3], 64, 1, 0.5, size=5, advance=3, stats=stats).orderBy("seg").collect()
    wanted = [(0, 5), (3, 8), (5, 10)]
    assert [(r["offset_begin"], r["offset_end"]) for r in rows] == wanted
    for r, (a, b) in zip(rows, wanted, strict=True):
        n, bits = one.bits("ACGTACGTAA"[a:b], known, total)
        assert r["kmers"] == n and r["w0"] & (2**64 - 1) == int("".join("1" if x else "0" for x in bits), 2)


def test_bands(spark):
    assert bands.fold_range(10, 8, 4, 1) == (0, 10, 2, 4) and bands.fold_range(10, 8, 4, 3, "g") == (5, 10, 4, 8)
    codes = spark.createDataFrame([(y * 3 + x, 2 if (x, y) == (1, 1) else 1) for y in range(3) for x in range(3)], "pixel long, code int")
    assert {r["code"] for r in bands.smoothed(codes, 3, 3, least=6).collect()} == {1}
    truth = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 0.0)], "pixel long, code int, confidence double")
    assert tuple(bands.error_rate(spark.createDataFrame([(0, 1)], "pixel long, code int"), truth).first()) == (1, 2, 0.5)
    lines = [r["value"] for r in bands.plot(truth.selectExpr("pixel", "code AS value"), 2, 2).collect()]
    assert lines == ["P2 2 2\n255", "1 2", "0 0"]


def test_tables(docs):
    table = signatures.numbered(signatures.build(docs, Projection(width=128, density=8)))
    merged = tables.merged(table, 4)
    assert merged.count() == 10 and tables.merged_words(merged, 512).count() == 10
    assert tables.dealt(table, 3).select("part").distinct().count() <= 3
    with pytest.raises(ValueError):
        tables.concatenated([table, tables.trimmed(table, 64)])


def test_modes(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in range(12):
        (tmp_path / "docs" / f"{i:02d}.txt").write_text(" ".join(f"term{(i * k) % 7} and{i}" for k in range(1, 20)))
    base = {"TARGET-PATH": tmp_path / "docs", "DOCID-FORMAT": "basename", "SIGNATURE-WIDTH": 128, "SIGNATURE-PATH": tmp_path / "sig", "TERMSTATS-PATH": tmp_path / "stats", "ISSL-PATH": tmp_path / "issl", "K": 4, "ISSL-SLICEWIDTH": 8}
    config = EngineConfig().with_values([(k, str(v)) for k, v in base.items()])
    assert engine.run(spark, "termstats", config).count() > 0
    assert engine.run(spark, "index", config).count() == 12
    best = engine.run(spark, "query", config.with_values({"QUERY-TEXT": "and7 and7 term0"})).orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2, 3, 4]
    (tmp_path / "topics").write_text("t1 term1 and3\nt2 and5\n")
    asked = config.with_values({"TOPIC-PATH": str(tmp_path / "topics"), "PSEUDO-FEEDBACK-SAMPLE": "2", "PSEUDO-FEEDBACK-RERANK": "4", "RESULTS-PATH": str(tmp_path / "out")})
    assert engine.run(spark, "topic", asked).count() == 8
    assert spark.read.text(f"{tmp_path}/out").count() == 8
    assert engine.run(spark, "create-issl", config).count() > 0
    assert {"00", "11"} <= {r["doc_id"] for r in engine.run(spark, "search-issl", config).collect()}
    near = engine.run(spark, "exhaustive-docsim", config)
    assert near.where("rank = 1 AND topic_id = doc_id AND dist = 0").count() == 12
    assert engine.run(spark, "histogram", config).agg(F.sum("n")).first()[0] == 66
    steps = list(engine.feedback_session(spark, config, [("t", "term1")], lambda topic, best_: ["and3 and3"]))
    assert len(steps[0][1]) == 12
    with pytest.raises(ValueError):
        engine.run(spark, "none", config)


def test_streamed_append(spark, tmp_path):
    from sigloom.streaming.append import append

    spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, text string").parquet(f"{tmp_path}/in")
    append(stream, f"{tmp_path}/out", f"{tmp_path}/check", Projection(width=64), available_now=True).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_names_are_clipped_and_suffixes_weigh(spark):
    """Long names are cut off; a term like word:3 counts three times as much as without its number."""
    rows = [("n" * 300, "apple pear"), ("short", "apple:3 pear:0.5 plum")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    p = Projection(width=64, method="MD5")
    found = {r["doc_id"]: r for r in signatures.build(docs, p, mask="all", multiplier=True, longest_name=255).collect()}
    assert found.keys() == {"n" * 255, "short"}
    sums = sum(w * vectors([t], p)[0].astype(int) for t, w in (("apple", 3000), ("pear", 500), ("plum", 1000)))
    assert found["short"]["w0"] & (2**64 - 1) == int("".join("1" if s > 0 else "0" for s in sums), 2)


def test_slice_search_of_a_range_and_of_an_index(spark):
    """Queries first to last only; posting lists give what signatures give."""
    rows = [(i, i, (i * 0x9E3779B97F4A7C15) % 2**63) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_num long, doc_id long, w0 long")
    all_ = {tuple(r) for r in slices.search(table, 5, 20, 8, 1).collect()}
    some = {tuple(r) for r in slices.search(table, 5, 20, 8, 1, first=10, last=19).collect()}
    assert some == {r for r in all_ if 10 <= r[0] <= 19} and len({r[0] for r in some}) == 10
    assert {tuple(r) for r in slices.search(table, 5, 20, 8, 1, index=slices.build(table, 8)).collect()} == all_


def test_copies_of_several_texts(spark):
    """Texts that are looked at together give what each gives alone."""
    rows = [(t, n * 10, f"d{(n * (t + 1)) % 3}", 1, n * 7, n * 7 + 5) for t in range(3) for n in range(8)]
    rows += [(t, n * 10, f"d{n % 2}", 2, n, n + 3) for t in range(3) for n in range(8)]
    run = spark.createDataFrame(rows, "text int, topic_num int, doc_id string, rank int, offset_begin int, offset_end int")
    votes = runs.source_votes(run, 1, 0.3, 2, text="text")
    spans = runs.copied_spans(run, votes, 1, text="text")
    for t in range(3):
        own = run.where(F.col("text") == t)
        alone = runs.source_votes(own, 1, 0.3, 2)
        assert sorted(map(tuple, votes.where(F.col("text") == t).drop("text").collect())) == sorted(map(tuple, alone.collect()))
        wanted = sorted(map(tuple, runs.copied_spans(own, alone, 1).collect()))
        assert sorted(map(tuple, spans.where(F.col("text") == t).drop("text").collect())) == wanted
    assert spans.count() > 3
