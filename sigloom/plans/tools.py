"""Queries on signature tables, runs, sequences and bands."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.bits import bit_string, hex_string
from sigloom.operators import bands, runs, sequences, signatures, tables
from sigloom.operators import search as S
from sigloom.operators.terms import doc_terms
from sigloom.plans.search import EMBEDDED, EVERY, ISSL_SEARCH, _docsim_sql, _indexed, documents, embedded
from sigloom.plans.text import DOCS, Entry, tf_sql
from sigloom.session import cut, table
from sigloom.sources.topics import SHORTEST, sentence_topics, sentences

N = 7
#: Hexadecimal digits of a bit string.
_HEX = "lower(list_reduce(list_transform(range(16), lambda j: substr('0123456789abcdef', (1 + list_sum(list_transform(range(4), lambda k: CASE WHEN substr(bits, (4 * j + k + 1)::BIGINT, 1) = '1' THEN 8 // (1 << k::INT) ELSE 0 END)))::BIGINT, 1)), lambda a, b: a || b))"
_BYTE = "list_sum(list_transform(range(8), lambda k: CASE WHEN substr(bits, (8 * j + k + 1)::BIGINT, 1) = '1' THEN (128 >> k::INT) ELSE 0 END))::INT"


def _filtered(mode: str) -> Entry:
    """The signatures whose vector is, or is not, among the labelled ids."""
    word = {"include": "IN", "exclude": "NOT IN"}[mode]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _bits(tables.filtered(embedded(spark, sf), table(spark, sf, "labels"), mode))

    return run, f"WITH {EMBEDDED} SELECT doc_num, doc_id, bits FROM sig WHERE doc_id {word} (SELECT doc_id FROM labels)"


def _sig(make: Callable[[DataFrame], DataFrame], sql: str | None) -> Entry:
    """A query on the signatures of embeddings; SQL behind the CTE sig (doc_num, doc_id, label, bits)."""
    return (lambda spark, sf: make(embedded(spark, sf))), None if sql is None else f"WITH {EMBEDDED} {sql}"


def _bits(df: DataFrame) -> DataFrame:
    return df.select("doc_num", "doc_id", bit_string([F.col("w0")]).alias("bits"))


def _merged(df: DataFrame) -> DataFrame:
    return tables.merged(df, N).select("chunk", "doc_id", "bits")


def gstats(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.statistics(documents(spark, sf))
    return found.select("n", "total", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "least", "most")


GSTATS = f"WITH {tf_sql(DOCS)} SELECT count(*) AS n, sum(total)::BIGINT AS total, round(avg(total), 6) AS mean, round(stddev_pop(total), 6) AS stdev, min(total)::INT AS least, max(total)::INT AS most FROM totals"

TABLES: dict[str, Entry] = {
    "gstats": (gstats, GSTATS),
    "topcat": _sig(lambda s: _bits(tables.concatenated([s, s])), "SELECT doc_num, doc_id, bits FROM sig UNION ALL SELECT doc_num, doc_id, bits FROM sig"),
    "topcut": _sig(lambda s: _bits(tables.first(s, 100)), "SELECT doc_num, doc_id, bits FROM sig WHERE doc_num < 100"),
    "topfilt_include": _filtered("include"),
    "topfilt_exclude": _filtered("exclude"),
    "topshrink": _sig(tables.name_length, "SELECT max(length(doc_id::VARCHAR))::INT AS longest, (max(length(doc_id::VARCHAR)) // 8 * 8 + 7)::INT AS shrunk FROM sig"),
    "toptrim": _sig(lambda s: _bits(tables.trimmed(s, 40)), "SELECT doc_num, doc_id, substr(bits, 1, 40) || repeat('0', 24) AS bits FROM sig"),
    "topsplit": _sig(lambda s: tables.split(s, N).select("doc_num", "doc_id", "chunk"), f"SELECT doc_num, doc_id, doc_num // {N} AS chunk FROM sig"),
    "subsig_merge": _sig(_merged, f"SELECT doc_num // {N} AS chunk, arg_min(doc_id, doc_num) AS doc_id, string_agg({_HEX}, '' ORDER BY bits) AS bits FROM sig GROUP BY chunk"),
    "sigview_diff": _sig(
        lambda s: tables.viewed(s),
        """, seen AS (SELECT *, lag(bits) OVER (ORDER BY doc_num) AS before FROM sig)
SELECT doc_num, doc_id, bits, CASE WHEN before IS NOT NULL THEN list_reduce(list_transform(range(64), lambda i: CASE WHEN substr(bits, (i + 1)::BIGINT, 1) = substr(before, (i + 1)::BIGINT, 1) THEN '.' ELSE 'x' END), lambda a, b: a || b) END AS changed FROM seen""",
    ),
    "sigfile_to_text": _sig(tables.decimal_bytes, f"SELECT doc_num, array_to_string(list_transform(range(8), lambda j: {_BYTE}), ' ') AS value FROM sig"),
    "text_to_sigfile": _sig(
        lambda s: _bits(tables.from_decimal_bytes(tables.decimal_bytes(s), 64)), "SELECT doc_num, doc_num::VARCHAR AS doc_id, bits FROM sig"
    ),
    "texthash": _sig(tables.texthash, f"SELECT doc_num, {_HEX} || ' ' || doc_id AS value FROM sig"),
    "output_sig_txt": _sig(
        tables.short_words,
        f", raw AS (SELECT doc_num, list_transform(range(8), lambda j: {_BYTE}) AS b FROM sig) SELECT doc_num, array_to_string(list_transform(range(4), lambda i: b[2 * i + 1] + 256 * b[2 * i + 2]), ' ') AS value FROM raw",
    ),
    "ktree_ids": _sig(
        lambda s: tables.tree_ids(s, ["quality", "offset_begin"]).select("doc_num", "value", F.lower(F.hex("bits")).alias("bits")),
        f"SELECT doc_num, doc_id || '_0_0' AS value, {_HEX} AS bits FROM sig",
    ),
    "topdeal": _sig(lambda s: tables.dealt(s, 4).select("doc_num", "part"), None),
    "topshuf": _sig(lambda s: _bits(tables.shuffled(s)), None),
    "random_signatures": _sig(lambda s: _bits(signatures.random_bits(s)), None),
}

# ---- runs: the nearest vectors of each vector, once by all 64 bits and once by the first 32 ----


def _run(spark: SparkSession, sf: str, width: int = 64, k: int = 10) -> DataFrame:
    sig = embedded(spark, sf)
    found = S.docsim(sig if width == 64 else tables.trimmed(sig, width), k)
    rows = found.select(F.col("doc_num").alias("topic_id"), F.col("found_num").alias("doc_id"), "rank", (1_000_001 - F.col("rank")).alias("score"), F.lit("r").alias("run"), F.col("dist").alias("hd"))
    return cut(rows, "run")


_RUN = f"WITH {EMBEDDED}, {_docsim_sql(10)}, run AS (SELECT doc_num AS topic_id, found_num AS doc_id, rank, 1000001 - rank AS score, 'r' AS run, dist AS hd FROM near)"
_SHORT = "short AS (SELECT q.doc_num AS topic_id, s.doc_num AS doc_id, bit_count(xor(q.bits[:32]::BIT, s.bits[:32]::BIT))::INT AS hd FROM sig q, sig s), short_run AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY hd, doc_id)::INT AS rank FROM short QUALIFY rank <= 10)"


def resmerge(spark: SparkSession, sf: str) -> DataFrame:
    both = _run(spark, sf).unionByName(_run(spark, sf, 32))
    return runs.merged(both, 5).select("topic_id", "doc_id", "rank", "hd", "count")


def trec_dedup(spark: SparkSession, sf: str) -> DataFrame:
    both = _run(spark, sf).unionByName(_run(spark, sf, 32))
    return runs.without_duplicates(both, 8).select("topic_id", "doc_id", "rank", "score", "hd")


_BOTH = f"{_RUN}, {_SHORT}, pooled AS (SELECT topic_id, doc_id, hd FROM run UNION ALL SELECT topic_id, doc_id, hd FROM short_run), best AS (SELECT topic_id, doc_id, min(hd) AS hd, count(*) AS count FROM pooled GROUP BY ALL)"
RESMERGE = f"""{_BOTH} SELECT topic_id, doc_id, (row_number() OVER (PARTITION BY topic_id ORDER BY hd, count DESC, doc_id))::INT AS rank, hd, count FROM best
QUALIFY rank() OVER (PARTITION BY topic_id ORDER BY hd, count DESC) <= 5"""
TREC_DEDUP = f"{_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY hd, doc_id)::INT AS rank FROM best) SELECT topic_id, doc_id, rank, 1000001 - rank AS score, hd FROM r WHERE rank <= 8"


def _ratio(df: DataFrame) -> DataFrame:
    return df.select("rank", F.round("ratio", 9).alias("ratio"), "topics")


def hdr_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The full search as truth against the slice index."""
    rows = _indexed(False)[0](spark, sf).select(F.col("doc_num").alias("topic_id"), "rank", F.col("dist").alias("hd"))
    return _ratio(runs.distance_ratio(_run(spark, sf), rows))


def hdr_eval_csim(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of the vectors themselves as truth for the distances of their signatures."""
    run, one = _run(spark, sf), table(spark, sf, "embeddings")
    a, b = (one.select(F.col("vec_id").alias(k), F.col("embedding").cast("array<double>").alias(v)) for k, v in (("topic_id", "a"), ("doc_id", "b")))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda t, i: t + i)
    csim = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    truth = run.join(a, "topic_id").join(b, "doc_id").withColumn("csim", F.round(csim, 9)).drop("a", "b")
    return _ratio(runs.distance_ratio(runs.cosine_distances(truth, 64), run))


_CSIM = "round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9)"


_RATIO = """, paired AS (SELECT topic_id, rank, sum(t) OVER w AS t, sum(f) OVER w AS f FROM (SELECT t.topic_id, t.rank, t.hd AS t, f.hd AS f FROM truth t JOIN found f USING (topic_id, rank)) WINDOW w AS (PARTITION BY topic_id ORDER BY rank))
SELECT rank, round(avg(CASE WHEN f > 0 THEN t / f ELSE 1 END), 9) AS ratio, count(*) AS topics FROM paired GROUP BY rank"""


def _hdr_sql() -> str:
    return f"{_RUN}, truth AS (SELECT topic_id, rank, hd FROM run), found AS (SELECT doc_num AS topic_id, rank, dist AS hd FROM ({ISSL_SEARCH})) {_RATIO}"


def _cosine(stemmer: str) -> Entry:
    """Every twentieth document against all others."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        terms = cut(doc_terms(table(spark, sf, "documents").select("doc_id", "text"), stemmer=stemmer), "terms")
        return runs.cosine_pairs(terms, EVERY).select("a", "b", F.round("cosine", 9).alias("cosine"))

    return run, COSINE if stemmer == "none" else None


COSINE = f"""WITH {tf_sql("SELECT doc_id, text FROM documents")}, norms AS (SELECT doc_id, sqrt(sum(cnt * cnt)::DOUBLE) AS norm FROM tf GROUP BY doc_id)
SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.cnt * y.cnt) / (any_value(nx.norm) * any_value(ny.norm)), 9) AS cosine
FROM tf x JOIN tf y ON x.term = y.term AND x.doc_id <> y.doc_id AND x.doc_id % {EVERY} = 0 JOIN norms nx ON nx.doc_id = x.doc_id JOIN norms ny ON ny.doc_id = y.doc_id GROUP BY ALL"""


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The run with vectors as sentences of one text, at offsets 10 times their number; found vectors are named by their label."""
    sig = embedded(spark, sf).select(F.col("doc_id").alias("found"), F.col("label").cast("string").alias("label"))
    rows = _run(spark, sf).withColumnRenamed("doc_id", "found").join(sig, "found")
    begin = F.col("found") * 10
    return rows.select((F.col("topic_id") * 10).alias("topic_num"), F.col("label").alias("doc_id"), "rank", begin.alias("offset_begin"), (begin + 9).alias("offset_end"))


def plag_votes(spark: SparkSession, sf: str) -> DataFrame:
    return runs.source_votes(_sentences(spark, sf), share=0.1, run_length=2)


def plag_spans(spark: SparkSession, sf: str) -> DataFrame:
    run = _sentences(spark, sf)
    return runs.copied_spans(run, runs.source_votes(run, share=0.1, run_length=2))


_VOTES = f"""{_RUN}, sent AS (SELECT topic_id * 10 AS topic_num, s.label::VARCHAR AS doc_id, rank, r.doc_id * 10 AS offset_begin, r.doc_id * 10 + 9 AS offset_end FROM run r JOIN sig s ON s.doc_num = r.doc_id),
places AS (SELECT topic_num, row_number() OVER (ORDER BY topic_num) AS place, lead(topic_num) OVER (ORDER BY topic_num) AS next FROM (SELECT DISTINCT topic_num FROM sent)),
v AS (SELECT doc_id, count(*) FILTER (rank <= 8) AS votes FROM sent GROUP BY doc_id),
seen AS (SELECT DISTINCT topic_num, doc_id, place FROM sent JOIN places USING (topic_num) WHERE rank <= 100),
isles AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS isle FROM seen),
longest AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, isle, count(*) AS n FROM isles GROUP BY ALL) GROUP BY doc_id),
voted AS (SELECT doc_id, votes, longest, votes >= 0.1::DOUBLE * (SELECT sum(votes) FROM v) AND longest >= 2 AS source FROM v JOIN longest USING (doc_id))"""
PLAG_SPANS = f"""{_VOTES}, named AS (SELECT * FROM sent WHERE rank <= 8 AND doc_id IN (SELECT doc_id FROM voted WHERE source)),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY topic_num ORDER BY rank) = 1),
spanned AS (SELECT *, CASE WHEN lag(doc_id) OVER (ORDER BY topic_num) IS NOT DISTINCT FROM doc_id THEN 0 ELSE 1 END AS new FROM firsts),
grouped AS (SELECT g.*, coalesce(next, g.topic_num) AS upto, sum(new) OVER (ORDER BY g.topic_num) AS span FROM spanned g JOIN places USING (topic_num))
SELECT doc_id AS source, min(topic_num) AS begin, max(upto) - min(topic_num) AS length, min(offset_begin) AS source_begin, max(offset_end) - min(offset_begin) AS source_length FROM grouped GROUP BY span, doc_id"""


def plag_errors(spark: SparkSession, sf: str) -> DataFrame:
    truth = spark.range(5).select(F.col("id").cast("string").alias("doc_id"))
    return runs.vote_errors(plag_votes(spark, sf), truth)


PLAG_ERRORS = f"""{_VOTES}, told AS (SELECT source AS said, doc_id::INT < 5 AS real FROM voted)
SELECT count(*) FILTER (said AND real) AS true_positives, count(*) FILTER (said AND NOT real) AS false_positives, count(*) FILTER (NOT said AND real) AS false_negatives, count(*) FILTER (NOT said AND NOT real) AS true_negatives FROM told"""


def plag_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return runs.cluster_pairs(table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), "vec_id"), F.col("vec_id") % 3 == 0)


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return runs.category_tags(table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "props"), "props", 100)


TAGS = """WITH parts AS (SELECT event_id AS doc_id, unnest(string_split_regex(props, '[,\\n]')) AS part FROM events),
tags AS (SELECT doc_id, regexp_extract(part, '(?s)[A-Za-z].*') AS tag FROM parts)
SELECT doc_id, tag FROM tags WHERE tag <> '' AND tag IN (SELECT tag FROM tags GROUP BY tag HAVING count(*) >= 100)"""


def titles(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"))
    return runs.titled(_run(spark, sf), names).select("topic_id", "doc_id", "rank", "title")


def title_links(spark: SparkSession, sf: str) -> DataFrame:
    return runs.linked(_run(spark, sf), "wiki/")


def topic_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "pages").select(F.col("page_id").alias("doc_num"), F.col("url").alias("doc_id"))
    return runs.named_topics(_run(spark, sf), names).select("topic_id", "doc_id", "rank")


def percents(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors named label_number, topics by their label."""
    sig = embedded(spark, sf)
    name = F.concat_ws("_", F.col("label").cast("string"), (F.col("doc_id") % 100 + 1).cast("string"))
    a, b = sig.select(F.col("doc_id").alias("topic_id"), F.col("label").cast("string").alias("topic")), sig.select("doc_id", name.alias("name"))
    run = _run(spark, sf).join(a, "topic_id").join(b, "doc_id").select(F.col("topic").alias("topic_id"), F.col("name").alias("doc_id"), "run", "hd")
    return runs.percent_histogram(runs.merged(run, 30, hard=True))


PERCENTS = f"""{_RUN}, named AS (SELECT q.label::VARCHAR AS topic_id, s.label || '_' || (s.doc_id % 100 + 1) AS doc_id, hd FROM run r JOIN sig q ON q.doc_num = r.topic_id JOIN sig s ON s.doc_num = r.doc_id),
best AS (SELECT topic_id, doc_id, min(hd) AS hd, count(*) AS c FROM named GROUP BY ALL), kept AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY hd, c DESC, doc_id) <= 30),
own AS (SELECT split_part(doc_id, '_', 2)::INT AS p, count(*) AS c FROM kept WHERE starts_with(topic_id, split_part(doc_id, '_', 1)) GROUP BY p)
SELECT i::INT AS pct, coalesce(c, 0)::BIGINT AS n FROM range(1, 101) r(i) LEFT JOIN own ON p = i"""


def sentence_query(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of the documents one behind the other, each document for itself."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.inline(sentences(F.col("text")))).select("doc_id", "begin", "text")


def _sentences_sql(text: str) -> str:
    """The list of struct(b, t) of the sentences of a text."""
    none = "[]::STRUCT(b INT, t VARCHAR)[]"
    return f"""list_reduce(list_transform(regexp_extract_all(regexp_replace({text}, '[^\\x00-\\x7F]', '?', 'g'), '[^.]*\\.'), lambda x: {{'at': 0, 'open': x, 'done': {none}}}),
  lambda s, x: CASE WHEN length(s.open || x.open) >= {SHORTEST} THEN {{'at': (s.at + length(s.open || x.open))::INT, 'open': '', 'done': list_append(s.done, {{'b': s.at, 't': s.open || x.open}})}}
    ELSE {{'at': s.at, 'open': s.open || x.open, 'done': s.done}} END, {{'at': 0, 'open': '', 'done': {none}}}).done"""


SENTENCES = f"""SELECT doc_id, s.b AS "begin", s.t AS text FROM (SELECT doc_id, unnest({_sentences_sql("text")}) AS s FROM documents)"""
SENTENCE_TOPICS = f"""SELECT (row_number() OVER (ORDER BY s.b) - 1)::INT AS topic_num, s.b::VARCHAR AS topic_id, s.t AS text
FROM (SELECT unnest({_sentences_sql("value")}) AS s FROM (SELECT string_agg(text, '. ' ORDER BY item_id) AS value FROM benchmark))"""

RUNS: dict[str, Entry] = {
    "resmerge": (resmerge, RESMERGE),
    "resmerge_percentages": (percents, PERCENTS),
    "trec_dedup": (trec_dedup, TREC_DEDUP),
    "hdr_eval": (hdr_eval, _hdr_sql()),
    "hdr_eval_csim": (hdr_eval_csim, f"{_RUN}, truth AS (SELECT topic_id, rank, trunc((1.0::DOUBLE - {_CSIM}) * 64)::INT AS hd FROM run r JOIN embeddings a ON a.vec_id = topic_id JOIN embeddings b ON b.vec_id = r.doc_id), found AS (SELECT * FROM run) {_RATIO}"),
    "cosine_docsim": _cosine("none"),
    "cosine_docsim_porter": _cosine("porter"),
    "plag_votes": (plag_votes, f"{_VOTES} SELECT * FROM voted"),
    "plag_spans": (plag_spans, PLAG_SPANS),
    "plag_errors": (plag_errors, PLAG_ERRORS),
    "plag_cluster": (plag_cluster, "SELECT label AS cluster, (count(*) FILTER (vec_id % 3 = 0) * count(*) FILTER (vec_id % 3 <> 0))::BIGINT AS pairs FROM embeddings GROUP BY label"),
    "category_tags": (tags, TAGS),
    "title_lookup": (titles, f"{_RUN} SELECT topic_id, doc_id, rank, coalesce(url, '(unknown)') AS title FROM run LEFT JOIN pages ON page_id = doc_id"),
    "link_lookup": (title_links, f"{_RUN} SELECT topic_id, rank, '<a href=\"wiki/' || doc_id || '\">' || doc_id || '</a>' AS value FROM run"),
    "topic2docname": (topic_names, f"{_RUN} SELECT coalesce(url, topic_id::VARCHAR) AS topic_id, doc_id, rank FROM run LEFT JOIN pages ON page_id = topic_id"),
    "topic_sentences": (sentence_query, SENTENCES),
    "sentence_topics": (lambda s, d: sentence_topics(table(s, d, "benchmark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), ". ").alias("value"))), SENTENCE_TOPICS),
    "col2csv": (
        lambda s, d: runs.zipped([table(s, d, "benchmark").agg(F.min_by("text", "item_id").alias("value")), table(s, d, "benchmark").agg(F.max_by("text", "item_id").alias("value"))]),
        """WITH ends AS (SELECT string_split_regex(trim(arg_min(text, item_id)), '\\s+') AS a, string_split_regex(trim(arg_max(text, item_id)), '\\s+') AS b FROM benchmark)
SELECT i::INT AS pos, a[i + 1] || ',' || b[i + 1] AS value FROM ends, range(0, least(len(a), len(b))) r(i)""",
    ),
}

# ---- sequences and bands ----

BANDS = ["l_quantity", "l_linenumber"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("residues"))


KMERS = """WITH rec AS (SELECT regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS r FROM part),
each AS (SELECT row_number() OVER () AS id, r FROM rec), grams AS (SELECT id, unnest(list_transform(range(1, length(r) - 2), lambda i: substr(r, i, 4))) AS term FROM each WHERE length(r) >= 4)
SELECT term, count(DISTINCT id) AS df, count(*) AS ctf FROM grams WHERE NOT contains(term, 'X') GROUP BY term"""


def genome(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    found = sequences.genome_signatures(records, [4], 64, starred=1, stats=sequences.kmer_stats(records, [4]))
    return found.select("doc_id", "seg", "kmers", "offset_begin", "offset_end", hex_string([F.col("w0")]).alias("bits"))


def protein(spark: SparkSession, sf: str) -> DataFrame:
    order = np.random.default_rng(1)
    residues = {chr(65 + i): order.choice([-1, 1], 64).tolist() for i in range(26)}
    found = sequences.protein_signatures(_records(spark, sf), residues, 4)
    return found.select("doc_id", "seg", "kmers", hex_string([F.col("w0")]).alias("bits"))


NORMALISED = """WITH each AS (SELECT unnest([0, 1])::INT AS band, unnest([l_quantity::BIGINT, l_linenumber::BIGINT]) AS value FROM lineitem),
counts AS (SELECT band, value, count(*) AS n FROM each GROUP BY ALL), ranges AS (SELECT band, min(value) AS a, max(value) AS b FROM counts GROUP BY band),
grid AS (SELECT band, unnest(range(a, b + 1)) AS value FROM ranges),
below AS (SELECT g.band, g.value, coalesce(sum(n) OVER (PARTITION BY g.band ORDER BY g.value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM grid g LEFT JOIN counts c ON c.band = g.band AND c.value = g.value)
SELECT band, value, p / max(p) OVER (PARTITION BY band) AS share FROM below"""


def kernels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = bands.kernel_signatures(rows, "key", BANDS, shares=bands.normalised(rows, BANDS))
    return found.select("key", hex_string([F.col("w0")]).alias("bits"))


WIDE = 25


def _pixels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Embeddings as pixels, WIDE in a row: their run, and their labels as codes, of which 0 is unknown."""
    rows = table(spark, sf, "embeddings")
    run = _run(spark, sf).select(F.col("topic_id").alias("pixel"), F.col("doc_id").alias("found"), "rank", "hd")
    truth = rows.select(F.col("vec_id").alias("pixel"), F.col("label").alias("code"), F.lit(1.0).alias("confidence"))
    return run, truth, -(-rows.count() // WIDE)


_PIXELS = f"{_RUN}, truth AS (SELECT vec_id AS pixel, label AS code FROM embeddings)"
_VOTED = f"""votes AS (SELECT r.topic_id AS pixel, t.code, r.rank, greatest(0.0::DOUBLE, 1 - 0.1::DOUBLE * (r.hd - first_value(r.hd) OVER (PARTITION BY r.topic_id ORDER BY r.rank))) AS v
  FROM run r JOIN truth t ON t.pixel = r.doc_id AND t.code <> 0 WHERE r.doc_id % {WIDE} <> r.topic_id % {WIDE} AND r.doc_id // {WIDE} <> r.topic_id // {WIDE}),
sums AS (SELECT pixel, code, round(sum(v), 9) AS v, min(rank) AS first FROM votes GROUP BY ALL),
coded AS (SELECT pixel, code FROM sums QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY v DESC, first) = 1)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    run, truth, _ = _pixels(spark, sf)
    return bands.classified(run, truth, WIDE, 0.1)


def smoothed(spark: SparkSession, sf: str) -> DataFrame:
    run, truth, height = _pixels(spark, sf)
    return bands.smoothed(bands.classified(run, truth, WIDE, 0.1), WIDE, height, least=3)


SMOOTHED = f"""{_PIXELS}, {_VOTED}, size AS (SELECT ceil(count(*) / {WIDE})::INT AS h FROM embeddings),
cast_ AS (SELECT pixel % {WIDE} + dx AS x, pixel // {WIDE} + dy AS y, code FROM coded, range(-1, 2) a(dx), range(-1, 2) b(dy)),
near_votes AS (SELECT y * {WIDE} + x AS p, code, count(*) AS v FROM cast_, size WHERE x BETWEEN 0 AND {WIDE - 1} AND y >= 0 AND y < h GROUP BY ALL HAVING count(*) >= 3),
only_ AS (SELECT p, min(code) AS new FROM near_votes GROUP BY p HAVING count(*) = 1)
SELECT pixel, coalesce(new, code) AS code FROM coded LEFT JOIN only_ ON p = pixel"""


def error(spark: SparkSession, sf: str) -> DataFrame:
    """Error in the second of four strips of rows, classified without its codes."""
    run, truth, height = _pixels(spark, sf)
    training, validation = bands.folded(truth, WIDE, height, 4, 1)
    return bands.error_rate(bands.classified(run, training, WIDE, 0.1), validation)


ERROR = f"""{_PIXELS}, size AS (SELECT ceil(count(*) / {WIDE})::INT AS h FROM embeddings),
strip AS (SELECT pixel, code, pixel // {WIDE} >= h // 4 AND pixel // {WIDE} < 2 * h // 4 AS inside FROM truth, size),
training AS (SELECT pixel, CASE WHEN inside THEN 0 ELSE code END AS code FROM strip), {_VOTED.replace("JOIN truth t", "JOIN training t")}
SELECT (count(*) FILTER (c.code IS DISTINCT FROM v.code))::BIGINT AS wrong, count(*) AS n, count(*) FILTER (c.code IS DISTINCT FROM v.code) / count(*) AS rate
FROM strip v LEFT JOIN coded c USING (pixel) WHERE inside AND v.code <> 0"""
PLOT = f"""WITH size AS (SELECT ceil(count(*) / {WIDE})::INT AS h FROM embeddings),
grid AS (SELECT unnest(range({WIDE} * h)) AS pixel FROM size),
lines AS (SELECT (pixel // {WIDE})::INT AS y, string_agg(least(greatest(coalesce(label, 0), 0), 255)::VARCHAR, ' ' ORDER BY pixel) AS value FROM grid LEFT JOIN embeddings ON vec_id = pixel GROUP BY 1)
SELECT -1 AS y, 'P2 {WIDE} ' || h || chr(10) || '255' AS value FROM size UNION ALL SELECT y, value FROM lines"""


def contrast(spark: SparkSession, sf: str) -> DataFrame:
    run, truth, _ = _pixels(spark, sf)
    return bands.contrast(run.groupBy("pixel").agg(F.max("hd").alias("hd")), truth, 1).select(*[F.round(c, 9).alias(c) for c in ("coded", "uncoded", "contrast")])


def confident(spark: SparkSession, sf: str) -> DataFrame:
    run, truth, _ = _pixels(spark, sf)
    return bands.confidence(run, truth)


def pictured(spark: SparkSession, sf: str) -> DataFrame:
    _, truth, height = _pixels(spark, sf)
    return bands.plot(truth.select("pixel", F.col("code").alias("value")), WIDE, height)


DOMAIN: dict[str, Entry] = {
    "kmer_stats": (lambda s, d: sequences.kmer_stats(_records(s, d), [4]).select("term", "df", "ctf"), KMERS),
    "genome_signatures": (genome, None),
    "protein_signatures": (protein, None),
    "landsat_norm": (lambda s, d: bands.normalised(table(s, d, "lineitem"), BANDS), NORMALISED),
    "landsat_signatures": (kernels, None),
    "landsat_classify": (classified, f"{_PIXELS}, {_VOTED} SELECT pixel, code FROM coded"),
    "landsat_smooth": (smoothed, SMOOTHED),
    "landsat_error": (error, ERROR),
    "landsat_contrast": (
        contrast,
        f"{_PIXELS}, far AS (SELECT topic_id AS pixel, max(hd) AS hd FROM run GROUP BY ALL), m AS (SELECT avg(hd) FILTER (code = 1) AS coded, avg(hd) FILTER (code <> 1) AS uncoded FROM truth JOIN far USING (pixel)) SELECT round(coded, 9) AS coded, round(uncoded, 9) AS uncoded, round(uncoded - coded, 9) AS contrast FROM m",
    ),
    "landsat_confidence": (
        confident,
        f"{_PIXELS}, met AS (SELECT o.pixel, o.code, avg((t.code = o.code)::INT) AS s FROM truth o LEFT JOIN run r ON r.topic_id = o.pixel LEFT JOIN truth t ON t.pixel = r.doc_id AND t.code <> 0 GROUP BY ALL) SELECT pixel, code, CASE WHEN code = 0 THEN 0 ELSE coalesce(s, 0) END::DOUBLE AS confidence FROM met",
    ),
    "landsat_plot": (pictured, PLOT),
}

QUERIES: dict[str, Entry] = TABLES | RUNS | DOMAIN
