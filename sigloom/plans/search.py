"""Queries on signatures: building, searching, the slice index, histograms, feedback.

SQL has bits as strings of 0s and 1s, which DuckDB compares as its BIT type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.bits import bit_string, hex_string, layout, word_columns
from sigloom.functions.tokenizer import Splitting
from sigloom.operators import feedback, histogram, signatures, slices
from sigloom.operators import search as S
from sigloom.operators.terms import doc_terms, term_stats
from sigloom.operators.vectors import Projection
from sigloom.plans.text import DOCS, Entry, segments_sql, tf_sql, weights_sql
from sigloom.session import cut, new_path, table
from sigloom.sources import results as R

MD5 = Projection(width=64, method="MD5")
SLICE, RADIUS, K = 16, 1, 10
#: Slice, radius and re-ranked signatures of the registered searches; signatures whose number is divisible by EVERY are their queries.
FOUND_BY, EVERY = (8, 2, 200), 20
OVERLAPPED = Splitting("hard", 64, 128)

# ---- tables ----


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of embeddings: doc_num and doc_id are vec_id."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_num"), F.col("vec_id").alias("doc_id"), "label", "embedding")
    found = signatures.from_vectors(rows, "embedding", 64, ["doc_num", "doc_id", "label"])
    return found.withColumn("quality", F.lit(0)).withColumn("offset_begin", F.lit(0))


EMBEDDED = "sig AS (SELECT vec_id AS doc_num, vec_id AS doc_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings)"


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return cut(term_stats(doc_terms(table(spark, sf, "documents"))), "stats")


def documents(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Numbered signatures of the documents, weighted by log-likelihood with known statistics."""
    return cut(signatures.numbered(signatures.build(table(spark, sf, "documents"), MD5, stats(spark, sf) if known is None else known)), "signatures")


def _bits_sql(weights: str, key: str, out: str) -> str:
    """CTE ``out`` (key, bits, mask) of weights (key, term, w), by MD5 vectors."""
    return f"""{out}_terms AS (SELECT term, i, ((instr('0123456789abcdef', substr(md5(term), (i // 4 + 1)::BIGINT, 1)) - 1) >> (3 - i % 4)::INT) & 1 AS b FROM (SELECT DISTINCT term FROM {weights}), range(64) r(i)),
{out}_sums AS (SELECT {key}, i, sum(w * (2 * b - 1)) AS v FROM {weights} JOIN {out}_terms USING (term) GROUP BY ALL),
{out} AS (SELECT {key}, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits, string_agg(CASE WHEN v <> 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS mask FROM {out}_sums GROUP BY {key})"""


DOCUMENTS = f"""{tf_sql(DOCS)}, {weights_sql("loglik")}, {_bits_sql("weights", "doc_id", "bit_rows")},
sig AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_num, doc_id, bits, strlen(text)::INT AS quality FROM bit_rows JOIN documents USING (doc_id))"""
_TOPIC_WEIGHTS = """qtok AS (SELECT topic_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM ({source})),
qtf AS (SELECT topic_id, term, count(*)::BIGINT AS c FROM qtok GROUP BY ALL),
qweights AS (SELECT topic_id, term, c * CASE WHEN ln(1.0::DOUBLE / 3 * n / coalesce(ctf, 1)) > 0 THEN trunc(ln(1.0::DOUBLE / 3 * n / coalesce(ctf, 1)) * 0.5::DOUBLE * 1000)::BIGINT ELSE 1000 END AS w FROM qtf LEFT JOIN stats USING (term), whole)"""
TOPICS = f"""{_TOPIC_WEIGHTS.format(source="SELECT item_id AS topic_id, text FROM benchmark")}, {_bits_sql("qweights", "topic_id", "qsig")}"""
_MASKED = "bit_count(xor(s.bits::BIT, q.bits::BIT) & q.mask::BIT)::INT"


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"), "text")


# ---- building ----


def embedding_signature(spark: SparkSession, sf: str) -> DataFrame:
    return embedded(spark, sf).select("doc_id", bit_string([F.col("w0")]).alias("bits"))


def md5_signature(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_num", "doc_id", "quality", bit_string([F.col("w0")]).alias("bits"))


def query_signature(spark: SparkSession, sf: str) -> DataFrame:
    found = signatures.query_signatures(topics(spark, sf), MD5, stats(spark, sf))
    return found.select("topic_id", bit_string([F.col("w0")]).alias("bits"), bit_string([F.col("m0")]).alias("mask"))


def _random(method: str) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = signatures.build(table(spark, sf, "documents"), Projection(method=method))
        return found.select("doc_id", "seg", "unique_terms", "total_terms", hex_string([F.col(c) for c in word_columns(found.columns)]).alias("bits"))

    return run, None


def overlapping_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that share their terms with the next, weighed by log-likelihood."""
    found = signatures.build(table(spark, sf, "documents"), MD5, stats(spark, sf), splitting=OVERLAPPED, overlap=True)
    return found.select("doc_id", "seg", "unique_terms", "total_terms", "offset_begin", "offset_end", bit_string([F.col("w0")]).alias("bits"))


OVERLAPPING = f"""{segments_sql(OVERLAPPED, True)}, {tf_sql(DOCS)},
weights AS (
  SELECT doc_id * 100000 + seg AS key, o.term, cnt, total, "begin", "end",
    CASE WHEN ln(cnt / total * n / coalesce(ctf, cnt)) > 0 THEN trunc(ln(cnt / total * n / coalesce(ctf, cnt)) * (cnt - 0.5::DOUBLE) * 1000)::BIGINT ELSE cnt * 1000 END AS w
  FROM overlapping o LEFT JOIN stats s ON o.term = s.term, whole), {_bits_sql("weights", "key", "bit_rows")}
SELECT key // 100000 AS doc_id, (key % 100000)::INT AS seg, count(*)::INT AS unique_terms, sum(cnt)::INT AS total_terms, min("begin")::INT AS offset_begin, max("end")::INT AS offset_end, bits
FROM weights JOIN bit_rows USING (key) GROUP BY ALL"""


# ---- search ----


def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.pairs(embedded(spark, sf))


def docsim(spark: SparkSession, sf: str) -> DataFrame:
    return S.docsim(embedded(spark, sf), K)


def _docsim_sql(k: int) -> str:
    return f"""pairs AS (SELECT q.doc_num, s.doc_num AS found_num, bit_count(xor(q.bits::BIT, s.bits::BIT))::INT AS dist FROM sig q, sig s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_num ORDER BY dist, found_num)::INT AS rank FROM pairs WHERE dist < 64),
near AS (SELECT * FROM ranked WHERE rank <= {k})"""


def topic_search(spark: SparkSession, sf: str) -> DataFrame:
    known = stats(spark, sf)
    q = signatures.query_signatures(topics(spark, sf), MD5, known)
    return S.search(documents(spark, sf, known), q, K).select("topic_id", "rank", "score", "dist", "doc_id", "quality")


TOPIC_SEARCH = f"""{DOCUMENTS}, {TOPICS},
found AS (SELECT q.topic_id, s.*, {_MASKED} AS dist FROM qsig q, sig s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY dist, quality DESC, doc_id)::INT AS rank FROM found)"""


def query_search(spark: SparkSession, sf: str) -> DataFrame:
    """One free-text query: the text of the first benchmark item."""
    text = topics(spark, sf).agg(F.min_by("text", "topic_id").alias("text")).withColumn("topic_id", F.lit(0).cast("bigint"))
    known = stats(spark, sf)
    return S.search(documents(spark, sf, known), signatures.query_signatures(text, MD5, known), K).select("rank", "score", "dist", "doc_id")


QUERY_SEARCH = f"""WITH {DOCUMENTS}, {_TOPIC_WEIGHTS.format(source="SELECT 0 AS topic_id, arg_min(text, item_id) AS text FROM benchmark")}, {_bits_sql("qweights", "topic_id", "qsig")},
found AS (SELECT s.*, {_MASKED} AS dist FROM qsig q, sig s),
ranked AS (SELECT *, row_number() OVER (ORDER BY dist, quality DESC, doc_id)::INT AS rank FROM found)
SELECT rank, 1000001 - rank AS score, dist, doc_id FROM ranked WHERE rank <= {K}"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of the turns of conversations, by counts; the turns of one are its segments."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("doc_id"), "text")
    found = signatures.build(rows, MD5)
    return cut(found.withColumn("doc_num", F.col("doc_id")).withColumn("doc_id", F.floor(F.col("doc_id") / 10000)), "turns")


def _turn_search(duplicates: bool) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = signatures.query_signatures(topics(spark, sf), MD5)
        return S.search(turns(spark, sf), q, K, duplicates).select("topic_id", "rank", "dist", "doc_num", "doc_id")

    once = "" if duplicates else "QUALIFY row_number() OVER (PARTITION BY q.topic_id, s.doc_id ORDER BY dist, quality DESC, offset_begin, doc_num) = 1"
    sql = f"""WITH {tf_sql("SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations")}, {weights_sql("count")}, {_bits_sql("weights", "doc_id", "bit_rows")},
sig AS (SELECT b.doc_id AS doc_num, conv_id AS doc_id, bits, strlen(text) AS quality, strlen(regexp_extract(text, '^[^A-Za-z0-9]*')) AS offset_begin
  FROM bit_rows b JOIN conversations c ON b.doc_id = c.conv_id * 10000 + c.turn),
qtok AS (SELECT item_id AS topic_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM benchmark),
qweights AS (SELECT topic_id, term, count(*)::BIGINT * 1000 AS w FROM qtok GROUP BY ALL), {_bits_sql("qweights", "topic_id", "qsig")},
found AS (SELECT q.topic_id, s.*, {_MASKED} AS dist FROM qsig q, sig s {once}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY dist, quality DESC, doc_id, offset_begin, doc_num)::INT AS rank FROM found)
SELECT topic_id, rank, dist, doc_num, doc_id FROM ranked WHERE rank <= {K}"""
    return run, sql


def trec_output(spark: SparkSession, sf: str) -> DataFrame:
    known = stats(spark, sf)
    q = signatures.query_signatures(topics(spark, sf), MD5, known)
    return R.lines(S.search(documents(spark, sf, known), q, K))


# ---- slice index ----


def issl_build(spark: SparkSession, sf: str) -> DataFrame:
    found = slices.build(embedded(spark, sf), SLICE)
    return found.select("slice", "val", "n", F.array_join(F.col("postings").cast("array<string>"), ",").alias("postings"))




def _sliced_sql(width: int) -> str:
    cuts = ", ".join(f"({i}, {a}, {b - a})" for i, (a, b) in enumerate(layout(64, width)))
    return f"""{EMBEDDED},
cuts(slice, a, bits_n) AS (VALUES {cuts}),
sliced AS (SELECT doc_num, slice, bits_n, list_sum(list_transform(range(bits_n), lambda j: CASE WHEN substr(bits, (a + j + 1)::BIGINT, 1) = '1' THEN (1::BIGINT << (bits_n - 1 - j)::INT) ELSE 0 END))::INT AS val FROM sig, cuts)"""


def _votes_sql(width: int, radius: int, every: int = 1) -> str:
    masks = ", ".join(f"({m}, {width - m.bit_count()})" for m in slices.variants(width, radius))
    return f"""{_sliced_sql(width)}, masks(mask, score) AS (VALUES {masks}),
probes AS (SELECT doc_num, slice, xor(val, mask)::INT AS val, score FROM sliced, masks WHERE doc_num % {every} = 0),
votes AS (SELECT p.doc_num AS query, s.doc_num AS found, sum(score)::BIGINT AS votes FROM probes p JOIN sliced s USING (slice, val) GROUP BY ALL)"""


SLICED, VOTES = _sliced_sql(SLICE), _votes_sql(SLICE, RADIUS)


def _indexed(stored: bool) -> Entry:
    """The search of signatures whose number is divisible by EVERY against all, cut into slices on the way or read from a written index."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        slice_width, radius, rerank = FOUND_BY
        sig, index = embedded(spark, sf), None
        if stored:
            path = new_path(spark, "issl")
            slices.write(slices.build(sig, slice_width), path)
            index = spark.read.parquet(path)
        return slices.search(sig, K, rerank, slice_width, radius, queries=sig.where(F.col("doc_num") % EVERY == 0), index=index)

    return run, ISSL_SEARCH


ISSL_SEARCH = f"""WITH {_votes_sql(*FOUND_BY[:2], EVERY)},
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, found) AS place FROM votes),
met AS (SELECT query, found, bit_count(xor(a.bits::BIT, b.bits::BIT))::INT AS dist FROM placed JOIN sig a ON a.doc_num = query JOIN sig b ON b.doc_num = found WHERE place <= {FOUND_BY[2]}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, found)::INT AS rank FROM met)
SELECT query AS doc_num, found AS found_num, dist, rank FROM ranked WHERE rank <= {K}"""


# ---- histograms ----


def _histogram_sql(distances: str) -> str:
    return f"""dists AS ({distances}), counts AS (SELECT dist, count(*) AS c FROM dists GROUP BY dist)
SELECT i::INT AS hd, coalesce(c, 0)::BIGINT AS n, CASE WHEN (SELECT count(*) FROM dists) > 0 THEN coalesce(c, 0) / (SELECT count(*) FROM dists) ELSE 0 END::DOUBLE AS fraction FROM range(65) r(i) LEFT JOIN counts ON dist = i"""


_PAIR = "bit_count(xor(a.bits::BIT, b.bits::BIT))::INT AS dist"


def histogram_doc(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.of_pairs(embedded(spark, sf))


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Each label of embeddings as a topic for which its vectors are relevant."""
    return table(spark, sf, "embeddings").select(F.col("label").alias("topic"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel"))


def histogram_category(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("category"))
    return histogram.of_category(documents(spark, sf), labels, 1)


def _query_histogram(part: int) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        text = topics(spark, sf).agg(F.min_by("text", "topic_id").alias("text")).withColumn("topic_id", F.lit(0).cast("bigint"))
        rel = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("rel"))
        known = stats(spark, sf)
        return histogram.of_query(documents(spark, sf, known), signatures.query_signatures(text, MD5, known), rel if part else None)[part]

    base = QUERY_SEARCH.split("\nfound AS")[0]
    if not part:
        return run, base + "\n" + _histogram_sql(f"SELECT {_MASKED} AS dist FROM qsig q, sig s")
    sql = f"""{base}
dists AS (SELECT doc_id, min({_MASKED}) AS hd FROM qsig q, sig s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality <> 0) GROUP BY doc_id)
SELECT doc_id, hd, count(*) OVER (PARTITION BY hd) / count(*) OVER () AS fraction FROM dists"""
    return run, sql


# ---- feedback ----

FED, SAMPLE, RERANKED = 30, 3, 20


def fed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The FED nearest of each embedding as results, and the signatures."""
    sig = cut(embedded(spark, sf), "embedded")
    found = S.docsim(sig, FED).select(F.col("doc_num").alias("topic_id"), "rank", "dist", F.col("found_num").alias("doc_num"))
    return cut(found.join(sig.select("doc_num", "doc_id", "quality", "offset_begin"), "doc_num"), "results"), sig


RESULTS = f"WITH {EMBEDDED}, {_docsim_sql(FED)}, results AS (SELECT near.doc_num AS topic_id, rank, dist, found_num AS doc_num, s.bits, s.label FROM near JOIN sig s ON s.doc_num = found_num)"
_SCALE = {
    "default": "exp(-(i * i) / ({n} * 8.0::DOUBLE))", "1": "1.0::DOUBLE", "1_i": "1.0::DOUBLE / (i + 1)", "1_sqrt_i": "1.0::DOUBLE / sqrt(i + 1)",
    "1_hamming": "1.0::DOUBLE / greatest(dist, 1)", "1_sqrt_hamming": "1.0::DOUBLE / sqrt(greatest(dist, 1))", "e_-i": "exp(-(i + 1.0::DOUBLE))",
}


def _new_words(sample: str, results: str = "results", out: str = "words") -> str:
    """CTE ``out`` (topic_id, bits) of a weighted sample (topic_id, bits, weight)."""
    return f"""{out}_sums AS (SELECT topic_id, i, round(sum(weight * CASE WHEN substr(bits, (i + 1)::BIGINT, 1) = '1' THEN 1 ELSE -1 END), 9) AS v FROM ({sample}), range(64) r(i) GROUP BY ALL),
{out} AS (SELECT topic_id, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM {out}_sums GROUP BY topic_id)"""


def _reranked(first: int, last: int, results: str = "results") -> str:
    return f"""moved AS (SELECT r.* EXCLUDE (dist), CASE WHEN rank BETWEEN {first} AND {last} AND w.bits IS NOT NULL THEN bit_count(xor(r.bits::BIT, w.bits::BIT))::INT ELSE dist END AS dist, rank BETWEEN {first} AND {last} AND w.bits IS NOT NULL AS moving
  FROM {results} r LEFT JOIN words w USING (topic_id))
SELECT topic_id, doc_num, dist, (CASE WHEN moving THEN {first} - 1 + row_number() OVER (PARTITION BY topic_id, moving ORDER BY dist, doc_num) ELSE rank END)::INT AS rank FROM moved"""


def _blind(scaling: str = "default", method: str = "default", negative: int = 0, ignore: int = 0, iterations: int = 1) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found, sig = fed(spark, sf)
        done = feedback.blind(found, sig, SAMPLE, RERANKED, scaling=scaling, method=method, negative=negative, ignore_first=ignore, iterations=iterations)
        return done.select("topic_id", "doc_num", "dist", "rank")

    sample = f"SELECT topic_id, bits, {_SCALE[scaling].format(n=SAMPLE)} AS weight FROM (SELECT *, rank - 1 - {ignore} AS i FROM results WHERE rank BETWEEN {ignore + 1} AND {ignore + SAMPLE})"
    if negative:
        tail = f"(SELECT *, max(rank) OVER (PARTITION BY topic_id) - rank AS i FROM results)"
        sample += f" UNION ALL SELECT topic_id, bits, -{_SCALE[scaling].format(n=negative)} AS weight FROM {tail} WHERE i < {negative}"
    first = ignore + SAMPLE + 1 if method == "freezing" else 1
    if method == "residual":
        left = f"rest AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY topic_id ORDER BY rank))::INT AS rank) FROM results WHERE rank NOT BETWEEN {ignore + 1} AND {ignore + SAMPLE})"
        sql = f"{RESULTS}, {_new_words(sample)}, {left}, {_reranked(1, RERANKED + ignore - SAMPLE, 'rest')}"
    else:
        sql = f"{RESULTS}, {_new_words(sample)}, {_reranked(first, RERANKED + ignore)}"
    if iterations == 2 and method == "default":
        moved, ranked = _reranked(first, RERANKED + ignore).split("\nSELECT", 1)
        again = f"results2 AS (SELECT x.*, s.bits FROM (SELECT {ranked}) x JOIN sig s ON s.doc_num = x.doc_num)"
        second = _reranked(first, RERANKED + ignore, "results2").replace("words w", "words2 w").replace("moved", "moved2")
        sql = f"{RESULTS}, {_new_words(sample)}, {moved}, {again}, {_new_words(sample.replace('FROM results', 'FROM results2'), out='words2')}, {second}"
    return run, sql


def _scaled(scaling: str) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return feedback.scaled_sample(fed(spark, sf)[0], SAMPLE, scaling)

    return run, f"{RESULTS} SELECT topic_id, doc_num, rank, round({_SCALE[scaling].format(n=SAMPLE)}, 9) AS weight FROM (SELECT *, rank - 1 AS i FROM results WHERE rank <= {SAMPLE})"


def class_feedback(spark: SparkSession, sf: str) -> DataFrame:
    found, sig = fed(spark, sf)
    classes = sig.select("doc_id", F.col("label").alias("class"))
    own = sig.select(F.col("doc_num").alias("topic_id"), F.col("label").alias("class"))
    return feedback.by_class(found, sig, classes, own, RERANKED, most_relevant=5, most_irrelevant=5, scaling="1").select("topic_id", "doc_num", "dist", "rank")


CLASS_FEEDBACK = f"""{RESULTS},
told AS (SELECT r.*, r.label = q.label AS relevant FROM results r JOIN sig q ON q.doc_num = r.topic_id),
sampled AS (SELECT *, row_number() OVER (PARTITION BY topic_id, relevant ORDER BY rank) AS nth FROM told),
{_new_words("SELECT topic_id, bits, CASE WHEN relevant THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM sampled WHERE nth <= 5")}, {_reranked(1, RERANKED)}"""


def text_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Topics searched by their first line, refined by all of their text."""
    s = stats(spark, sf)
    sig = documents(spark, sf, s)
    short = topics(spark, sf).select("topic_id", F.substring_index("text", "\n", 1).alias("text"), F.col("text").alias("refine"))
    query, refine = (signatures.query_signatures(t, MD5, s) for t in feedback.refined(short))
    found = cut(S.search(sig, query, FED).select("topic_id", "rank", "dist", "doc_num", "doc_id", "quality", "offset_begin"), "results")
    return feedback.by_text(found, sig, refine, RERANKED).select("topic_id", "doc_id", "dist", "rank")


_SHORT = _TOPIC_WEIGHTS.format(source="SELECT item_id AS topic_id, string_split(text, chr(10))[1] AS text FROM benchmark")
_SHORT = _SHORT.replace("qtok", "stok").replace("qtf", "stf").replace("qweights", "sweights")
TEXT_FEEDBACK = f"""WITH {DOCUMENTS}, {TOPICS}, {_SHORT}, {_bits_sql("sweights", "topic_id", "ssig")},
found AS (SELECT q.topic_id, s.*, {_MASKED} AS dist FROM ssig q, sig s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY dist, quality DESC, doc_id)::INT AS rank FROM found),
moved AS (SELECT s.topic_id, s.doc_id, s.quality, s.rank, CASE WHEN s.rank <= {RERANKED} THEN {_MASKED} ELSE s.dist END AS dist FROM ranked s JOIN qsig q USING (topic_id) WHERE s.rank <= {FED})
SELECT topic_id, doc_id, dist, (CASE WHEN rank <= {RERANKED} THEN row_number() OVER (PARTITION BY topic_id, rank <= {RERANKED} ORDER BY dist, quality DESC, doc_id) ELSE rank END)::INT AS rank FROM moved"""


QUERIES: dict[str, Entry] = {
    "embedding_signature": (embedding_signature, f"WITH {EMBEDDED} SELECT doc_id, bits FROM sig"),
    "md5_signature": (md5_signature, f"WITH {DOCUMENTS} SELECT doc_num, doc_id, quality, bits FROM sig"),
    "query_signature": (query_signature, f"WITH {tf_sql(DOCS)}, {TOPICS} SELECT topic_id, bits, mask FROM qsig"),
    "signature_traditional": _random("TRADITIONAL"),
    "signature_skip": _random("SKIP"),
    "signature_old": _random("OLD"),
    "signature_overlapping": (overlapping_signature, OVERLAPPING),
    "hamming_pairs": (hamming_pairs, f"WITH {EMBEDDED} SELECT a.doc_num AS a, b.doc_num AS b, {_PAIR} FROM sig a JOIN sig b ON a.doc_num < b.doc_num"),
    "exhaustive_docsim": (docsim, f"WITH {EMBEDDED}, {_docsim_sql(K)} SELECT doc_num, found_num, dist, rank FROM near"),
    "topic_search": (topic_search, f"WITH {TOPIC_SEARCH} SELECT topic_id, rank, 1000001 - rank AS score, dist, doc_id, quality FROM ranked WHERE rank <= {K}"),
    "query_search": (query_search, QUERY_SEARCH),
    "search_dedup": _turn_search(False),
    "search_allow_duplicates": _turn_search(True),
    "trec_output": (trec_output, f"WITH {TOPIC_SEARCH} SELECT topic_id || ' Q0 ' || doc_id || ' ' || rank || ' ' || (1000001 - rank) || ' {R.RUN_NAME} ' || dist AS value FROM ranked WHERE rank <= {K}"),
    "issl_build": (issl_build, f"WITH {SLICED} SELECT slice::INT AS slice, val, count(*)::INT AS n, string_agg(doc_num, ',' ORDER BY doc_num) AS postings FROM sliced GROUP BY ALL"),
    "issl_probe_variants": (lambda s, d: slices.probes(embedded(s, d), SLICE, RADIUS), f"WITH {VOTES} SELECT doc_num, slice::INT AS slice, val, score::INT AS score FROM probes"),
    "issl_votes": (lambda s, d: slices.votes(embedded(s, d), SLICE, RADIUS), f"WITH {VOTES} SELECT query, found, votes FROM votes"),
    "issl_search": _indexed(False),
    "issl_search_stored": _indexed(True),
    "histogram_doc": (histogram_doc, f"WITH {EMBEDDED}, {_histogram_sql(f'SELECT {_PAIR} FROM sig a JOIN sig b ON a.doc_num < b.doc_num')}"),
    "histogram_relevant": (
        lambda s, d: histogram.of_relevant_pairs(embedded(s, d), relevant(s, d)),
        f"WITH {EMBEDDED}, {_histogram_sql(f'SELECT {_PAIR} FROM sig a JOIN sig b ON a.doc_num < b.doc_num AND a.label = b.label')}",
    ),
    "histogram_category": (
        histogram_category,
        f"WITH {DOCUMENTS}, own AS (SELECT * FROM sig WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), {_histogram_sql(f'SELECT {_PAIR} FROM own a JOIN own b ON a.doc_num < b.doc_num')}",
    ),
    "histogram_query": _query_histogram(0),
    "histogram_query_relevant": _query_histogram(1),
    "blind_feedback": _blind(),
    **{f"feedback_scale_{s.replace('-', 'minus')}": _scaled(s) for s in feedback.SCALES},
    "feedback_unit_scale": _blind("1"),
    "feedback_negative": _blind("1", negative=4),
    "feedback_freezing": _blind("1", "freezing"),
    "feedback_residual": _blind("1", "residual"),
    "feedback_ignore_first": _blind("1", ignore=1),
    "feedback_iterations": _blind("1", iterations=2),
    "class_feedback": (class_feedback, CLASS_FEEDBACK),
    "topic_refine": (text_feedback, TEXT_FEEDBACK),
}
