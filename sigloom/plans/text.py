"""Queries on terms: tokens, stems, statistics, weights, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.text import MARKUP, MASKS, basename, mapped_ids, porter_stem, quality, s_stem, stoplist, tokens, without_markup, without_stopwords
from sigloom.functions.tokenizer import Splitting, segments
from sigloom.operators import terms as T
from sigloom.session import table

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]

STOPWORDS = ["the", "and", "of", "to", "in", "is", "it", "der", "die", "und", "le", "la", "et", "el", "los", "de"]


def tokens_sql(text: str, mask: str = "alnum") -> str:
    """The list of tokens of a text, for DuckDB."""
    return f"list_filter(list_transform(regexp_extract_all({text}, '{MASKS[mask]}'), lambda x: lower(x)), lambda x: length(x) <= 127)"


def tf_sql(source: str, mask: str = "alnum") -> str:
    """CTEs tok, tf, totals, stats, whole; source gives doc_id, text."""
    return f"""tok AS (SELECT doc_id, unnest({tokens_sql("text", mask)}) AS term FROM ({source})),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS cnt FROM tok GROUP BY ALL),
totals AS (SELECT doc_id, sum(cnt)::BIGINT AS total, count(*) AS uniq FROM tf GROUP BY doc_id),
stats AS (SELECT term, count(*)::BIGINT AS df, sum(cnt)::BIGINT AS ctf FROM tf GROUP BY term HAVING count(*) > 1),
whole AS (SELECT coalesce(sum(ctf), 0)::BIGINT AS n, (SELECT count(*) FROM totals) AS docs FROM stats)"""


WEIGHTS = {
    "count": "cnt * 1000",
    "loglik": "CASE WHEN ln(cnt / total * n / coalesce(ctf, cnt)) > 0 THEN trunc(ln(cnt / total * n / coalesce(ctf, cnt)) * (cnt - 0.5::DOUBLE) * 1000)::BIGINT ELSE cnt * 1000 END",
    "tfidf": "trunc(cnt * greatest(0.0::DOUBLE, ln(docs / (coalesce(df, 0) + 1))) * 1000)::BIGINT",
    "bm25": "trunc(greatest(0.0::DOUBLE, cnt * 3.0::DOUBLE / (cnt + 2.0::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * total / 333.774137::DOUBLE)) + -0.725::DOUBLE) * greatest(0.0::DOUBLE, ln(greatest((docs - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE), 1e-300))) * 1000)::BIGINT",
    "none": "cnt",
}


def weights_sql(scheme: str) -> str:
    """CTE weights (doc_id, term, cnt, w), behind tf_sql()."""
    return f"weights AS (SELECT doc_id, term, cnt, {WEIGHTS[scheme]} AS w FROM tf JOIN totals USING (doc_id) LEFT JOIN stats USING (term), whole)"


DOCS = "SELECT doc_id, text FROM documents"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _tokenized(name: str, column: str, key: str, mask: str, markup: bool = False) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        text = without_markup(F.col(column)) if markup else F.col(column)
        return table(spark, sf, name).select(key, F.array_join(tokens(text, mask), " ").alias("tokens"))

    text = f"regexp_replace({column}, '{MARKUP}', ' ', 'g')" if markup else column
    return run, f"SELECT {key}, array_to_string({tokens_sql(text, mask)}, ' ') AS tokens FROM {name}"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return T.doc_terms(_docs(spark, sf))


def stems(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_rows(_docs(spark, sf)).select("term").distinct().select("term", s_stem(F.col("term")).alias("stem"))


STEMS_SQL = f"""WITH {tf_sql(DOCS)} SELECT term, CASE
  WHEN length(term) >= 4 AND ends_with(term, 'ies') AND NOT ends_with(term, 'eies') THEN substr(term, 1, length(term) - 3) || 'y'
  WHEN length(term) >= 3 AND ends_with(term, 'es') AND NOT ends_with(term, 'aes') THEN substr(term, 1, length(term) - 1)
  WHEN length(term) >= 2 AND ends_with(term, 's') AND NOT ends_with(term, 'us') AND NOT ends_with(term, 'ss') THEN substr(term, 1, length(term) - 1)
  ELSE term END AS stem FROM (SELECT DISTINCT term FROM tf)"""


def stopped(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in stoplist(STOPWORDS)], "word string")
    return without_stopwords(_terms(spark, sf), words)


def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return T.doc_totals(T.doc_terms(docs)).join(docs.select("doc_id", quality(F.col("text")).alias("quality")), "doc_id")


def _weight(scheme: str) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        terms = _terms(spark, sf)
        return T.weighed(terms, T.term_stats(terms), scheme).select("doc_id", "term", "weight")

    return run, f"WITH {tf_sql(DOCS)}, {weights_sql(scheme)} SELECT doc_id, term, w::BIGINT AS weight FROM weights"


def names(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", basename(url).alias("name"), basename(url, extension=False).alias("stem"))


NAMES_SQL = """SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem FROM pages"""


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of known labels renamed by the label, those of unwanted labels to NULL."""
    labels = table(spark, sf, "labels")
    rows = labels.select(F.col("doc_id").cast("string").alias("from"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("type"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("to"))
    return mapped_ids(_docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "source"), rows, "good")


MAPPING_SQL = """SELECT CASE WHEN l.doc_id IS NULL THEN d.doc_id::VARCHAR WHEN l.quality = 1 THEN 'doc-' || l.doc_id ELSE 'NULL' END AS doc_id, d.source
FROM documents d LEFT JOIN labels l USING (doc_id)"""


def porter(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_rows(_docs(spark, sf)).select("term").distinct().select("term", porter_stem("term").alias("stem"))


def segments_sql(splitting: Splitting, overlap: bool = False) -> str:
    """CTEs to ``segmented`` (doc_id, seg, term, cnt, begin, end), with overlap also to ``overlapping``, which has total too."""
    least, most = splitting.least, splitting.most
    sentence = f"list_filter(stops, lambda q: q >= news[{least}])[1]"
    z = f"least(news[{most}], {sentence})" if splitting.kind == "sentence" else f"news[{most}]"
    step = "list(t.pos ORDER BY t.pos) FILTER (t.prev < %s) AS news, coalesce(list(t.pos ORDER BY t.pos) FILTER (t.stop), []) AS stops"
    over = """,
stotals AS (SELECT doc_id, seg, sum(cnt)::BIGINT AS n FROM segmented GROUP BY ALL),
overlapping AS (
  SELECT doc_id, seg, term, cnt, "begin", "end", (n + coalesce(m, 0))::BIGINT AS total FROM segmented JOIN stotals USING (doc_id, seg) LEFT JOIN (SELECT doc_id, seg + 1 AS seg, n AS m FROM stotals) USING (doc_id, seg)
  UNION ALL
  SELECT s.doc_id, s.seg + 1, term, cnt, "begin", "end", sum(cnt) OVER (PARTITION BY s.doc_id, s.seg ORDER BY first)::BIGINT
  FROM segmented s WHERE (s.doc_id, s.seg + 1) IN (SELECT (doc_id, seg) FROM stotals))"""
    return f"""WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ts, string_split_regex(text, '[A-Za-z0-9]+') AS gs FROM documents),
runs AS (SELECT doc_id, unnest(ts) AS t, unnest(gs[1:len(ts)]) AS g, unnest(gs[2:]) AS after, generate_subscripts(ts, 1) AS k FROM parts),
placed AS (SELECT *, sum(strlen(g) + strlen(t)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS e FROM runs),
kept AS (SELECT doc_id, lower(t) AS term, e - strlen(t) AS b, e, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM placed WHERE strlen(t) <= 127),
stopped AS (SELECT doc_id, k, contains(after, '.') AS dot, sum(contains(after, '.')::INT) OVER (PARTITION BY doc_id ORDER BY k) AS dots FROM placed),
stok AS (
  SELECT k.*, coalesce(lag(pos) OVER (PARTITION BY doc_id, term ORDER BY pos), 0) AS prev,
    coalesce(lead(s.dots - s.dot::INT) OVER (PARTITION BY doc_id ORDER BY pos), 0) > s.dots - s.dot::INT AS stop
  FROM kept k JOIN stopped s USING (doc_id, k)),
seg(doc_id, seg, a, z) AS (
  SELECT doc_id, 0, 1::BIGINT, {z} FROM (SELECT t.doc_id, {step % "1"} FROM stok t GROUP BY t.doc_id)
  UNION ALL
  SELECT doc_id, seg + 1, z0 + 1, {z} FROM (
    SELECT s.doc_id, s.seg, s.z AS z0, {step % "s.z + 1"} FROM seg s JOIN stok t ON t.doc_id = s.doc_id AND t.pos > s.z GROUP BY s.doc_id, s.seg, s.z)),
segmented AS (
  SELECT t.doc_id, s.seg, t.term, count(*)::BIGINT AS cnt, min(t.b)::BIGINT AS "begin", max(t.e)::BIGINT AS "end", min(t.pos) AS first
  FROM stok t JOIN seg s ON t.doc_id = s.doc_id AND t.pos BETWEEN s.a AND coalesce(s.z, 9000000000) GROUP BY ALL){over if overlap else ""}"""


def _split(splitting: Splitting, overlap: bool = False) -> Entry:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return segments(_docs(spark, sf), splitting=splitting, overlap=overlap)

    last = 'SELECT doc_id, seg, term, cnt, "begin", "end", total FROM overlapping' if overlap else 'SELECT doc_id, seg, term, cnt, "begin", "end" FROM segmented'
    return run, f"{segments_sql(splitting, overlap)}\n{last}"


QUERIES: dict[str, Entry] = {
    "tokenize_alpha": _tokenized("documents", "text", "doc_id", "alpha"),
    "tokenize_alnum": _tokenized("documents", "text", "doc_id", "alnum"),
    "tokenize_graph": _tokenized("documents", "text", "doc_id", "all"),
    "xml_filter_terms": _tokenized("pages", "html", "page_id", "alnum", markup=True),
    "s_stem_terms": (stems, STEMS_SQL),
    "porter_terms": (porter, None),
    "stopword_filter": (stopped, f"WITH {tf_sql(DOCS)} SELECT * FROM tf WHERE term NOT IN ({', '.join(repr(w) for w in STOPWORDS)})"),
    "doc_term_freq": (_terms, f"WITH {tf_sql(DOCS)} SELECT * FROM tf"),
    "doc_stats": (doc_stats, f"WITH {tf_sql(DOCS)} SELECT doc_id, uniq AS unique_terms, total AS total_terms, strlen(text)::INT AS quality FROM totals JOIN documents USING (doc_id)"),
    "termstats": (lambda spark, sf: T.term_stats(_terms(spark, sf)), f"WITH {tf_sql(DOCS)} SELECT * FROM stats"),
    **{f"weight_{s}": _weight(s) for s in T.SCHEMES},
    "docid_basename": (names, NAMES_SQL),
    "docid_mapping": (mapping, MAPPING_SQL),
    "split_hard": _split(Splitting("hard", 64, 128)),
    "split_sentence": _split(Splitting("sentence", 64, 128)),
    "split_overlapping": _split(Splitting("hard", 64, 128), overlap=True),
}
