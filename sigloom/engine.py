"""The modes of the engine, driven by settings: index, termstats, query, topic, slice index, similarity, histogram, interactive feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.config import EngineConfig
from sigloom.functions.text import read_stopwords, stoplist
from sigloom.functions.tokenizer import Splitting, segments
from sigloom.operators import feedback, histogram, search, signatures, slices
from sigloom.operators.terms import term_stats
from sigloom.operators.vectors import Projection
from sigloom.session import cut
from sigloom.sources import collections, results, topics


def projection(config: EngineConfig) -> Projection:
    return Projection(
        config.integer("SIGNATURE-WIDTH", 1024), config.integer("SIGNATURE-DENSITY", 21), config.integer("SIGNATURE-SEED", 0),
        config.get("SIGNATURE-METHOD", "TRADITIONAL").upper(), cache=max(config.integer("TERM-CACHE-SIZE", 10_000), 10_000),
    )


def text_options(config: EngineConfig, searching: bool = False) -> dict:
    """Mask, stemmer and stopwords, and for indexing the markup filter."""
    stemmer = config.get("STEMMER", "none").lower()
    path = config.get("STOPLIST", "none")
    words: list[str] = []
    if path.lower() != "none":
        with open(path) as lines:
            words = stoplist(read_stopwords(lines), stemmer, config.get("STOPLIST-MODE", "stemmed"))
    options = {"mask": config.get("CHARMASK", "alnum").lower(), "stemmer": stemmer, "stopwords": words}
    return options if searching else options | {"markup": config.get("TARGET-FORMAT-FILTER", "none").lower() == "xml"}


def splitting(config: EngineConfig) -> Splitting:
    return Splitting(config.get("SPLIT-TYPE", "none").lower(), config.integer("SPLIT-MIN", 256), config.integer("SPLIT-MAX", 512))


def stats(spark: SparkSession, config: EngineConfig) -> DataFrame | None:
    path = config.get("TERMSTATS-PATH")
    return spark.read.parquet(path) if path else None


def run_termstats(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Collection statistics of whole documents, written to TERMSTATS-PATH."""
    terms = segments(collections.read_collection(spark, config), **text_options(config)).select("doc_id", "term", "cnt")
    path = config.required("TERMSTATS-PATH")
    term_stats(terms).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_index(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Signatures of the collection, written to SIGNATURE-PATH with the projection's settings beside them."""
    docs = collections.read_collection(spark, config)
    table = signatures.build(
        docs, projection(config), stats(spark, config), multiplier=config.boolean("TERMWEIGHT-SUFFIXES"), splitting=splitting(config),
        longest_name=config.integer("MAX-DOCNAME-LENGTH", 255), overlap=config.boolean("SPLIT-OVERLAPPING"), **text_options(config),
    )
    path, p = config.required("SIGNATURE-PATH"), projection(config)
    signatures.numbered(table).write.mode("overwrite").parquet(path)
    meta = spark.createDataFrame([(p.width, p.density, p.seed, p.method)], "width int, density int, seed int, method string")
    meta.write.mode("overwrite").parquet(f"{path.rstrip('/')}.meta")
    return spark.read.parquet(path)


def load(spark: SparkSession, config: EngineConfig) -> tuple[DataFrame, Projection]:
    """The signature table, and its own projection, which overrides the settings."""
    path = config.required("SIGNATURE-PATH")
    m = spark.read.parquet(f"{path.rstrip('/')}.meta").first()
    return spark.read.parquet(path), Projection(m["width"], m["density"], m["seed"], m["method"])


def searched(spark: SparkSession, config: EngineConfig, asked: DataFrame) -> DataFrame:
    """Results of topics (topic_num, topic_id, text, refine), with the feedback that the settings ask for."""
    table, p = load(spark, config)
    options, s = text_options(config, searching=True), stats(spark, config)
    sides = (asked, asked.withColumn("text", F.col("refine"))) if "refine" in asked.columns else (asked, None)
    if sides[1] is not None and config.boolean("TOPIC-REFINE-INVERT"):
        sides = sides[::-1]
    query = signatures.query_signatures(sides[0].select("topic_id", "text"), p, s, **options)
    found = search.search(table, query, config.integer("K", 10), config.boolean("ALLOW-DUPLICATES"))
    classes = config.get("FEEDBACK-DOCUMENT-CLASSES")
    sample = config.integer("PSEUDO-FEEDBACK-SAMPLE", 0)
    scaling = config.get("PSEUDO-FEEDBACK-SCALEFACTOR", "default")
    if classes:
        parts = F.split("value", r"\s+")
        known = spark.read.text(classes).select(parts[0].alias("doc_id"), parts[1].alias("class"))
        # a query's own document is the four-digit number of the query in its sequence
        own = asked.select("topic_id", F.format_string("%04d", "topic_num").alias("doc_id")).join(known, "doc_id").select("topic_id", "class")
        most = 2**31 - 1
        found = feedback.by_class(
            cut(found, "results"), table, known, own, config.integer("PSEUDO-FEEDBACK-RERANK", 0), config.boolean("FEEDBACK-ONLY-RELEVANT"),
            config.integer("FEEDBACK-MAX-RELEVANT", most), config.integer("FEEDBACK-MAX-IRRELEVANT", most), scaling,
        )
    elif sample > 0:
        found = feedback.blind(
            cut(found, "results"), table, sample, config.integer("PSEUDO-FEEDBACK-RERANK", 0), config.integer("PSEUDO-FEEDBACK-W", 8), scaling,
            config.get("PSEUDO-FEEDBACK-METHOD", "default"), config.integer("PSEUDO-FEEDBACK-ITERATIONS", 1),
            config.integer("PSEUDO-FEEDBACK-NEGSAMPLE", 0), config.integer("PSEUDO-FEEDBACK-IGNOREFIRST", 0),
        )
    refine_k = config.integer("TOPIC-REFINE-K", 0)
    if sides[1] is not None and refine_k:
        refine = signatures.query_signatures(sides[1].select("topic_id", "text"), p, s, **options)
        found = feedback.by_text(cut(found, "results"), table, refine, refine_k)
    score = (1_000_001 - F.col("rank")).alias("score")
    return found.drop("score").join(asked.select("topic_id", "topic_num"), "topic_id").select("*", score)


def run_query(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """QUERY-TEXT as topic 0."""
    asked = spark.createDataFrame([(0, "0", config.required("QUERY-TEXT"))], "topic_num int, topic_id string, text string")
    return searched(spark, config, asked)


def run_topic(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """All topics of TOPIC-PATH in one job."""
    return searched(spark, config, topics.read(spark, config.required("TOPIC-PATH"), config.get("TOPIC-FORMAT", "wsj")))


def run_create_issl(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Posting lists of the slices, written to ISSL-PATH."""
    path = config.required("ISSL-PATH")
    slices.write(slices.build(load(spark, config)[0], config.integer("ISSL-SLICEWIDTH", 16)), path)
    return spark.read.parquet(path)


def _similar(spark: SparkSession, table: DataFrame, found: DataFrame) -> DataFrame:
    """Results with the names of both documents: a query's own name is the topic."""
    asked = table.select(F.col("doc_num").alias("topic_num"), F.col("doc_id").alias("topic_id"))
    rows = found.select(F.col("doc_num").alias("topic_num"), F.col("found_num").alias("doc_num"), "dist", "rank", (1_000_001 - F.col("rank")).alias("score"))
    return rows.join(asked, "topic_num").join(table.select("doc_num", "doc_id", *signatures.META), "doc_num")


def _range(config: EngineConfig) -> dict:
    return {k: config.integer(f"SEARCH-DOC-{k.upper()}") for k in ("first", "last") if config.get(f"SEARCH-DOC-{k.upper()}") is not None}


def run_search_issl(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Approximate similarity of documents; K are printed, K-OUTPUT re-ranked. With ISSL-PATH its posting lists are searched."""
    table, _ = load(spark, config)
    k = config.integer("K", 10)
    radius = min(config.integer("ISSL-EXPANSION", 3), config.integer("ISSL-CONSIDERATION-RADIUS", 1))
    path = config.get("ISSL-PATH")
    index = spark.read.parquet(path) if path else None
    found = slices.search(table, k, config.integer("K-OUTPUT", k), config.integer("ISSL-SLICEWIDTH", 16), radius, **_range(config), index=index)
    return _similar(spark, table, found)


def run_exhaustive_docsim(spark: SparkSession, config: EngineConfig) -> DataFrame:
    table, _ = load(spark, config)
    return _similar(spark, table, search.docsim(table, config.integer("K", 10), **_range(config)))


def run_histogram(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """HISTOGRAM-TYPE doc or query, over all documents or those that judgements or a category name: bins (hd, n, fraction), and of a query
    with judgements also a row for each relevant document, with doc_id and its own bin's distance and fraction; n is null there."""
    table, p = load(spark, config)
    qrels, category = config.get("HISTOGRAM-QRELS"), config.get("HISTOGRAM-CATEGORY")
    relevant = None
    if qrels:
        part = F.split("value", r"\s+")
        relevant = spark.read.text(qrels).select(part[0].cast("int").alias("topic"), part[2].alias("doc_id"), part[3].cast("int").alias("rel"))
        if config.get("HISTOGRAM-QRELS-TOPIC") is not None:
            relevant = relevant.where(F.col("topic") == config.integer("HISTOGRAM-QRELS-TOPIC"))
    if category:
        part = F.split("value", " ", 2)
        rows = spark.read.text(config.required("HISTOGRAM-CATFILE")).select(part[0].alias("doc_id"), part[1].alias("category"))
        table = table.join(rows.where(F.col("category") == category).select("doc_id").distinct(), "doc_id", "left_semi")
    source = config.get("HISTOGRAM-SOURCE")
    if config.get("HISTOGRAM-TYPE", "doc").lower() == "query":
        asked = spark.createDataFrame([("0", source or config.required("QUERY-TEXT"))], "topic_id string, text string")
        query = signatures.query_signatures(asked, p, stats(spark, config), **text_options(config, searching=True))
        bins, documents = histogram.of_query(table, query, relevant)
        bins = bins.select(F.lit(None).cast("string").alias("doc_id"), "hd", "n", "fraction")
        return bins if relevant is None else bins.unionByName(documents.withColumn("n", F.lit(None).cast("bigint")))
    first = int(source) if source else None
    if relevant is not None:
        bounds = [config.integer(k) if config.get(k) is not None else None for k in ("HISTOGRAM-TOPIC-START", "HISTOGRAM-TOPIC-END")]
        return histogram.of_relevant_pairs(table, relevant, first, *bounds)
    return histogram.of_pairs(table, first)


def feedback_session(spark: SparkSession, config: EngineConfig, asked: Iterable[tuple[str, str]], told: Callable[[str, str], list[str]]) -> Iterator[tuple[str, list]]:
    """For each topic (id, text): its best document goes to ``told``, which answers with lines of feedback; with any, the first 50 results are
    ranked again by the topic and all of its feedback. Yields the topic and its rows of up to 1000 results."""
    table, p = load(spark, config)
    s, options = stats(spark, config), text_options(config, searching=True)
    make = lambda i, text: signatures.query_signatures(spark.createDataFrame([(i, text)], "topic_id string, text string"), p, s, **options)
    for topic, text in asked:
        found = cut(search.search(table, make(topic, text), 1000), "session")
        best = found.orderBy("rank").first()
        lines = told(topic, best["doc_id"]) if best else []
        if lines:
            found = feedback.by_text(found, table, make(topic, " ".join([text, *lines])), 50)
        yield topic, found.orderBy("rank").collect()


MODES: dict[str, Callable[[SparkSession, EngineConfig], DataFrame]] = {
    "index": run_index, "termstats": run_termstats, "query": run_query, "topic": run_topic, "create-issl": run_create_issl, "createisl": run_create_issl,
    "search-issl": run_search_issl, "docsim": run_search_issl, "exhaustive-docsim": run_exhaustive_docsim, "histogram": run_histogram,
}
PRINTED = {"query", "topic", "search-issl", "docsim", "exhaustive-docsim"}


def run(spark: SparkSession, mode: str, config: EngineConfig) -> DataFrame:
    """A mode; results of searches also go to RESULTS-PATH if it is set, in RESULTS-FORMAT."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    found = MODES[mode](spark, config)
    path = config.get("RESULTS-PATH")
    if mode in PRINTED and path:
        results.write(found, path, config.get("RESULTS-FORMAT", results.DEFAULT))
    return found
