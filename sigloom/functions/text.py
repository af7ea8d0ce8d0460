"""Text functions as Spark columns: tokens, markup, stems, stopwords, names."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from sigloom.functions.hashing import super_fast_hash
from sigloom.functions.porter import porter

MASKS = {"alpha": "[A-Za-z]+", "alnum": "[A-Za-z0-9]+", "all": "[!-~]+"}
LONGEST_TERM, LONGEST_RUN = 127, 1023
#: Tags, also unclosed ones, and entities, of which an unclosed one reaches to the next tag.
MARKUP = "<[^>]*>?|&[^;<]*;?"


def without_markup(text: Column) -> Column:
    """Tags and entities become separators."""
    return F.regexp_replace(text, MARKUP, " ")


def tokens(text: Column, mask: str = "alnum", longest: int = LONGEST_TERM) -> Column:
    """Runs of ASCII characters of the mask, in lower case; what is too long is dropped, all other characters separate."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({MASKS[mask]})"), F.lit(1)), F.lower)
    return F.filter(runs, lambda x: F.length(x) <= longest)


def s_stem(word: Column) -> Column:
    """Plural endings: -ies to -y but for -eies, else -es to -e but for -aes, else -s away but for -us and -ss."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n >= 4) & word.endswith("ies") & ~word.endswith("eies"), F.concat(cut(3), F.lit("y")))
        .when((n >= 3) & word.endswith("es") & ~word.endswith("aes"), cut(1))
        .when((n >= 2) & word.endswith("s") & ~word.endswith("us") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")


@F.pandas_udf(LongType())
def term_hash(words: pd.Series) -> pd.Series:
    """The 32-bit hash of terms, as an unsigned number."""
    return words.map(lambda w: super_fast_hash(w.encode()), na_action="ignore").astype("Int64")


def stemmed(terms: DataFrame, stemmer: str = "none", column: str = "term") -> DataFrame:
    """terms with stems in ``column``. Porter's stemmer sees each distinct word once."""
    if stemmer == "none":
        return terms
    if stemmer == "s":
        return terms.withColumn(column, s_stem(F.col(column)))
    if stemmer == "porter":
        stems = terms.select(F.col(column).alias("__word")).distinct().withColumn("__stem", porter_stem("__word"))
        met = terms.join(stems, F.col(column) == F.col("__word"))
        return met.withColumn(column, F.col("__stem")).drop("__word", "__stem")
    raise ValueError(f"no stemmer {stemmer!r}")


def without_stopwords(terms: DataFrame, stopwords: DataFrame, column: str = "term") -> DataFrame:
    """terms that aren't in stopwords (word)."""
    return terms.join(stopwords.select(F.col("word").alias(column)).distinct(), column, "left_anti")


def read_stopwords(lines: Iterable[str]) -> list[str]:
    """Words separated by white space, in lower case."""
    return sorted({w.lower() for line in lines for w in line.split()})


def stoplist(words: list[str], stemmer: str = "none", mode: str = "stemmed") -> list[str]:
    """Stopwords for a stemmer. Modes: raw as they are, stemmed, reference both."""
    one = {"none": lambda w: w, "porter": porter, "s": plain_s_stem}[stemmer]
    stems = {one(w) for w in words}
    return sorted({"raw": set(words), "stemmed": stems, "reference": stems | set(words)}[mode])


def plain_s_stem(w: str) -> str:
    """s_stem() of one word."""
    if len(w) >= 4 and w.endswith("ies") and not w.endswith("eies"):
        return w[:-3] + "y"
    if len(w) >= 3 and w.endswith("es") and not w.endswith("aes"):
        return w[:-1]
    return w[:-1] if len(w) >= 2 and w.endswith("s") and not w.endswith(("us", "ss")) else w


def weight_suffix(token: Column) -> tuple[Column, Column]:
    """(term, multiplier) of tokens like ``term:3.5``; what has no number behind the first colon counts once."""
    parts = F.split(token, ":", 2)
    number = F.get(parts, F.lit(1)).try_cast("double")
    return parts[0], F.coalesce(number, F.lit(1.0))


def quality(text: Column) -> Column:
    """Bytes of a document."""
    return F.octet_length(text).cast("int")


def clipped(name: Column, longest: int = 255) -> Column:
    return F.substring(name, 1, longest)


def basename(path: Column, extension: bool = True) -> Column:
    """Behind the last slash; without the last extension if asked."""
    name = F.element_at(F.split(path, "/"), -1)
    return name if extension else F.regexp_replace(name, r"\.[^.]*$", "")


def field_id(text: Column, field: str, path: Column) -> Column:
    """The text between <field> and </field>, or the path."""
    found = F.regexp_extract(text, f"(?s)<{field}>(.*?)</{field}>", 1)
    return F.when(F.regexp_like(text, F.lit(f"(?s)<{field}>.*?</{field}>")), found).otherwise(path)


def mapped_ids(docs: DataFrame, mapping: DataFrame, kind: str, column: str = "doc_id") -> DataFrame:
    """Ids replaced by mapping (from, type, to); where the wanted ``kind`` doesn't hold the type the id becomes NULL, the word."""
    target = F.when(F.lit(kind).contains(F.col("type")), F.col("to")).otherwise(F.lit("NULL"))
    sides = mapping.select(F.col("from").alias("__from"), target.alias("__to")).dropDuplicates(["__from"])
    met = docs.join(sides, F.col(column) == F.col("__from"), "left")
    return met.withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")
