"""The format language of results, compiled once to a column, and the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_NAME = "sigloom"
DEFAULT = "%T Q0 %D %r %s " + RUN_NAME + r" %h\n"
_META = ["unique_terms", "doc_char_length", "total_terms", "quality", "offset_begin", "offset_end", "unused7", "unused8"]
_FIELDS = {"t": "topic_num", "T": "topic_id", "d": "doc_num", "D": "doc_id", "r": "rank", "s": "score", "h": "dist"} | {str(i + 1): m for i, m in enumerate(_META)}
_ESCAPES = {"a": "\n", "b": "\n", "f": "\n", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "_": " "}


def pieces(text: str) -> list[tuple[str, str]]:
    """("text" or "field", value) of a format: %t topic number, %T its id, %d document number, %D its id, %r rank, %s score, %h distance,
    %1 to %8 metadata, %% a percent sign, and escapes with backslashes, where \\_ is a space."""
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        mark, table = text[at], {"%": _FIELDS, "\\": _ESCAPES}.get(text[at])
        if table is None:
            kind, value, at = "text", mark, at + 1
        else:
            code = text[at + 1 : at + 2]
            if mark == "%" and code == "%":
                kind, value = "text", "%"
            elif code in table:
                kind, value = "field" if mark == "%" else "text", table[code]
            else:
                raise ValueError(f"unknown code {mark + code!r} in a result format")
            at += 2
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        else:
            out.append((kind, value))
    return out


def formatted(fmt: str = DEFAULT) -> Column:
    """The column that a format describes; null fields are empty."""
    parts = [F.lit(v) if k == "text" else F.coalesce(F.col(v).cast("string"), F.lit("")) for k, v in pieces(fmt)]
    return F.concat(*parts) if parts else F.lit("")


def lines(results: DataFrame, fmt: str = DEFAULT) -> DataFrame:
    """(value): a line for each result, without the line break at its end, which the sink adds."""
    return results.select(F.regexp_replace(formatted(fmt), r"\n\z", "").alias("value"))


def write(results: DataFrame, path: str, fmt: str = DEFAULT, order: tuple[str, ...] = ("topic_id", "rank")) -> None:
    """Lines in order as text files."""
    lines(results.orderBy(*order), fmt).write.text(path)
