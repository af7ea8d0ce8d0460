"""The tokenizer with offsets and splits: one scan of each document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.porter import porter
from sigloom.functions.text import LONGEST_RUN, LONGEST_TERM, MARKUP, MASKS, plain_s_stem

_MARKUP = re.compile(MARKUP.encode())
_STEMS: dict[str, Callable[[str], str]] = {"none": lambda w: w, "s": plain_s_stem, "porter": porter}


@dataclass(frozen=True)
class Splitting:
    """How documents are cut into segments.

    kind: none, hard (as soon as ``most`` different terms are there) or sentence (also at a full stop once there are ``least``).
    """

    kind: str = "none"
    least: int = 256
    most: int = 512

    def __post_init__(self) -> None:
        if self.kind not in ("none", "hard", "sentence"):
            raise ValueError(f"no split type {self.kind!r}")


def scan(
    text: str, mask: str = "alnum", markup: bool = False, stemmer: str = "none", stopwords: frozenset[str] = frozenset(), splitting: Splitting = Splitting()
) -> list[list[tuple[str, int, int, int]]]:
    """Segments of (term, count, begin, end), terms in order of first occurrence; offsets are bytes of the raw text.

    A run's characters beyond LONGEST_RUN are ignored; runs of more than LONGEST_TERM bytes are dropped. A term's end is that of its
    unstemmed word. Full stops in markup cut too. Segments without terms are left out.
    """
    raw = text.encode()
    clean = _MARKUP.sub(lambda m: b" " * len(m[0]), raw) if markup else raw
    stops = [i for i, b in enumerate(raw) if b == 46] if splitting.kind == "sentence" else []
    stem = _STEMS[stemmer]
    out: list[list[tuple[str, int, int, int]]] = []
    terms: dict[str, list[int]] = {}
    at = 0

    def close() -> None:
        if terms:
            out.append([(t, *v) for t, v in terms.items()])
            terms.clear()

    for match in re.finditer(MASKS[mask].encode(), clean):
        # a full stop is seen when the scan is there; of the mask "all" it is part of a run, which then still is open
        while at < len(stops) and stops[at] < match.start():
            at += 1
            if len(terms) >= splitting.least:
                close()
        size = match.end() - match.start()
        if min(size, LONGEST_RUN) <= LONGEST_TERM:
            term = stem(match[0].decode().lower())
            if term not in stopwords:
                seen = terms.setdefault(term, [0, match.start(), 0])
                seen[0] += 1
                seen[2] = max(seen[2], match.start() + size)
        if splitting.kind != "none" and len(terms) >= splitting.most:
            close()
    close()
    return out


_OUTSIDE = {mask: bytes(b for b in range(256) if not re.match(f"{pattern}$".encode(), bytes([b]))) for mask, pattern in MASKS.items()}


def whole(text: str, mask: str = "alnum", markup: bool = False, stemmer: str = "none", stopwords: frozenset[str] = frozenset()) -> tuple[dict[str, int], int, int]:
    """Of a document that is one segment: counts of terms in order of first occurrence, and where the first token begins and the last ends; as of scan()."""
    raw = text.encode()
    clean = (_MARKUP.sub(lambda m: b" " * len(m[0]), raw) if markup else raw).lower()
    pattern = re.compile(MASKS[mask].encode())
    runs, stem = Counter(pattern.findall(clean)), _STEMS[stemmer]
    out: dict[str, int] = {}
    lost = set()
    for run, n in runs.items():
        term = stem(run.decode()) if len(run) <= LONGEST_TERM else None
        if term is None or term in stopwords:
            lost.add(run)
        else:
            out[term] = out.get(term, 0) + n
    if not out:
        return out, 0, 0
    if not lost:
        return out, pattern.search(clean).start(), len(clean.rstrip(_OUTSIDE[mask]))
    kept = [m for m in pattern.finditer(clean) if m[0] not in lost]
    return out, kept[0].start(), kept[-1].end()


def segment_rows(
    docs: DataFrame, mask: str = "alnum", markup: bool = False, stemmer: str = "none", stopwords: list[str] | None = None, splitting: Splitting = Splitting(), places: bool = True,
    overlap: bool = False,
) -> DataFrame:
    """A row for each segment of documents (doc_id, text), made where the document stands: nothing is shuffled.

    (doc_id, seg, terms, counts, begins, ends, totals, unique_terms, total_terms, doc_char_length, offset_begin, offset_end). With overlap
    the terms of the segment before come first, as entries of their own; ``totals`` are the tokens that a term is weighed against: of a
    carried entry the running total up to it, of an own one all of both; unique_terms and total_terms count both. Documents without
    terms, null texts among them, have no row. Without places, begins and ends are null, and unsplit documents are counted faster.
    """
    words = frozenset(stopwords or [])
    names = ["doc_id", "seg", "terms", "counts", "begins", "ends", "totals", "unique_terms", "total_terms", "doc_char_length", "offset_begin", "offset_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if splitting.kind == "none" and not places:
                    counts, begin, end = whole(text or "", mask, markup, stemmer, words)
                    if counts:
                        total = sum(counts.values())
                        rows.append((doc, 0, list(counts), list(counts.values()), None, None, [total] * len(counts), len(counts), total, len(text.encode()), begin, end))
                    continue
                carried: list[tuple[str, int, int, int]] = []
                for seg, own in enumerate(scan(text or "", mask, markup, stemmer, words, splitting)):
                    terms, counts, begins, ends = (list(x) for x in zip(*carried, *own, strict=True))
                    total = sum(counts)
                    totals = list(accumulate(counts[: len(carried)])) + [total] * len(own)
                    rows.append((doc, seg, terms, counts, begins, ends, totals, len(terms), total, len(text.encode()), min(begins), max(ends)))
                    carried = own if overlap else []
            yield pd.DataFrame(rows, columns=names)

    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lists = "terms array<string>, counts array<long>, begins array<int>, ends array<int>, totals array<long>"
    return given.mapInPandas(run, f"doc_id {kind}, seg int, {lists}, unique_terms int, total_terms long, doc_char_length int, offset_begin int, offset_end int")


def segments(
    docs: DataFrame, mask: str = "alnum", markup: bool = False, stemmer: str = "none", stopwords: list[str] | None = None, splitting: Splitting = Splitting(),
    overlap: bool = False,
) -> DataFrame:
    """(doc_id, seg, term, cnt, begin, end) of documents (doc_id, text); with overlap also ``total``, as of segment_rows()."""
    rows = segment_rows(docs, mask, markup, stemmer, stopwords, splitting, overlap=overlap)
    each = rows.select("doc_id", "seg", F.inline(F.arrays_zip("terms", "counts", "begins", "ends", "totals")).alias("term", "cnt", "begin", "end", "total"))
    places = [F.col(c).cast("long").alias(c) for c in ("begin", "end")]
    return each.select("doc_id", "seg", "term", "cnt", *places, *(["total"] if overlap else []))
