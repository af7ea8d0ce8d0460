"""Signatures of biological sequences by their k-mers.

Records are (doc_id, residues). A record is covered by windows, each of which is a signature; the last window ends with the record.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.bits import pack, words
from sigloom.functions.hashing import WORDS, Isaac
from sigloom.session import cut

WHOLE = 10_000_000
_KEPT = 50_000
#: Numbers that are added up at once, and variants whose vectors are made at once.
_NUMBERS, _VARIANTS = 4_000_000, 4096


def parse_fasta(text: str) -> list[tuple[str, str]]:
    """(id, residues) of records ``>id ...``; an id ends at its first space or comma, white space in residues goes."""
    out = []
    for record in text.split(">")[1:]:
        head, _, rest = record.partition("\n")
        out.append((head.split(" ")[0].split(",")[0].strip(), "".join(c for c in rest if c.isascii() and c.isprintable() and c != " ")))
    return out


def windows(residues: str, size: int = WHOLE, advance: int = WHOLE) -> list[tuple[int, str]]:
    """(offset, window): of at most the record's length; the last begins where it just fits."""
    size = min(size, len(residues))
    last, at, out = len(residues) - size, 0, []
    while size:
        out.append((at, residues[at : at + size]))
        if at == last:
            break
        at = min(at + advance, last)
    return out


def kmers(window: str, sizes: list[int], exclude: str = "X") -> list[str]:
    """The k-mers of each size without the excluded residue."""
    return [w for k in sizes for i in range(len(window) + 1 - k) if exclude not in (w := window[i : i + k])]


def variants(kmer: str, starred: int = 0, mismatches: dict[str, str] | None = None) -> list[tuple[str, float]]:
    """(k-mer, weight): with up to ``starred`` residues replaced by *, which weighs (k - stars) / k, and with residues replaced by mismatches."""
    out: list[tuple[str, float]] = []

    def replace(term: str, weight: float, start: int) -> None:
        for p in range(start, len(term)):
            for m in (mismatches or {}).get(term[p], ""):
                new = term[:p] + m + term[p + 1 :]
                out.append((new, weight))
                replace(new, weight, p + 1)

    for n in range(starred + 1):
        for places in combinations(range(len(kmer)), n):
            term = "".join("*" if i in places else c for i, c in enumerate(kmer))
            weight = (len(kmer) - n) / len(kmer)
            replace(term, weight, 0)
            out.append((term, weight))
    return out


def uniform_vectors(terms: list[str], width: int, density: float = 1.0, rng: int = 64) -> np.ndarray:
    """Numbers from 0 to 1 for each term, from a generator seeded with the term's bytes; with a density below 1 most are 0."""
    raw = np.zeros((len(terms), WORDS * rng // 8), dtype=np.uint8)
    for i, t in enumerate(terms):
        raw[i, : len(t.encode())] = np.frombuffer(t.encode(), dtype=np.uint8)
    generator = Isaac(raw.view("<u4" if rng == 32 else "<u8"), rng)
    draw = lambda: generator.next().astype(np.uint32).astype(np.float64) / 0xFFFFFFFF
    if density > 0.999999:
        return np.stack([draw() for _ in range(width)], axis=1)
    # a number that is kept takes a second draw, so the terms' streams part: each goes by its own
    stream = np.zeros((len(terms), 0))
    at, rows = np.zeros(len(terms), dtype=np.int64), np.arange(len(terms))

    def next_of(mine: np.ndarray) -> np.ndarray:
        nonlocal stream
        while int(at[mine].max(initial=-1)) >= stream.shape[1]:
            stream = np.concatenate([stream, np.stack([draw() for _ in range(WORDS)], axis=1)], axis=1)
        found = stream[mine, at[mine]]
        at[mine] += 1
        return found

    out = np.zeros((len(terms), width))
    for i in range(width):
        keep = rows[next_of(rows) < density]
        if len(keep):
            out[keep, i] = next_of(keep)
    return out


def _shared(records: DataFrame, *columns: str) -> DataFrame:
    """Columns of records, dealt over all cores: a small file is one task, but a residue takes far longer to work on than to move."""
    spark = records.sparkSession
    return records.select(*columns).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def kmer_stats(records: DataFrame, sizes: list[int], exclude: str = "X", size: int = WHOLE, advance: int = WHOLE) -> DataFrame:
    """(term, df, ctf) of the k-mers of all windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            df: Counter[str] = Counter()
            ctf: Counter[str] = Counter()
            for r in pdf["residues"]:
                for _, w in windows(r or "", size, advance):
                    found = kmers(w, sizes, exclude)
                    df.update(set(found))
                    ctf.update(found)
            if df:
                yield pd.DataFrame({"term": list(df), "d": list(df.values()), "n": [ctf[t] for t in df]})

    found = _shared(records, "residues").mapInPandas(run, "term string, d long, n long")
    return found.groupBy("term").agg(F.sum("d").alias("df"), F.sum("n").alias("ctf"))


def _table(records: DataFrame, width: int, sums) -> DataFrame:  # noqa: ANN001
    names = words(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, seg, 0, at, at + len(w), w) for doc, residues in zip(pdf["doc_id"], pdf["residues"], strict=True) for seg, (at, w) in enumerate(sums.windows(residues or ""))]
            counts, bits = sums.batch([r[-1] for r in rows])
            kept = counts > 0
            out = pd.DataFrame(rows, columns=["doc_id", "seg", "kmers", "offset_begin", "offset_end", "window"]).drop(columns="window").assign(kmers=counts)
            packed = pack(bits) if len(bits) else np.zeros((0, len(names)), dtype=np.int64)
            yield out.assign(**{n: packed[:, i] for i, n in enumerate(names)})[kept]

    kind = dict(records.dtypes)["doc_id"]
    columns = ", ".join(f"{n} long" for n in names)
    return _shared(records, "doc_id", "residues").mapInPandas(run, f"doc_id {kind}, seg int, kmers int, offset_begin int, offset_end int, {columns}")


class _Genome:
    def __init__(self, sizes, width, starred, density, exclude, size, advance, mismatches) -> None:  # noqa: ANN001
        self.sizes, self.width, self.starred, self.density, self.exclude = sizes, width, starred, density, exclude
        self.size, self.advance, self.mismatches = size, advance, mismatches
        self.kept: dict[str, np.ndarray] = {}
        self.sums: dict[str, tuple[np.ndarray, float]] = {}

    def windows(self, residues: str) -> list[tuple[int, str]]:
        return windows(residues, self.size, self.advance)

    def vectors(self, terms: list[str]) -> np.ndarray:
        if len(self.kept) > _KEPT:
            self.kept = {}
        new = list(dict.fromkeys(t for t in terms if t not in self.kept))
        for i in range(0, len(new), 1024):
            part = new[i : i + 1024]
            self.kept.update(zip(part, uniform_vectors(part, self.width, self.density), strict=True))
        return np.stack([self.kept[t] for t in terms])

    def summed(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each k-mer the weighted sum of its variants' vectors, and their weights' sum."""
        if len(self.sums) > _KEPT:
            self.sums = {}
        open_: list[tuple[str, list[tuple[str, float]]]] = []
        size = 0

        def close() -> None:
            if open_:
                w = np.array([x for _, each in open_ for _, x in each])
                first = np.cumsum([0, *(len(each) for _, each in open_[:-1])])
                total = np.add.reduceat(self.vectors([t for _, each in open_ for t, _ in each]) * w[:, None], first, axis=0)
                self.sums.update((t, (v, m)) for (t, _), v, m in zip(open_, total, np.add.reduceat(w, first), strict=True))
                open_.clear()

        for t in dict.fromkeys(t for t in terms if t not in self.sums):
            open_.append((t, variants(t, self.starred, self.mismatches)))
            size += len(open_[-1][1])
            if size > _VARIANTS:
                close()
                size = 0
        close()
        found = [self.sums[t] for t in terms]
        return np.stack([v for v, _ in found]), np.array([m for _, m in found])

    def batch(self, windows: list[str], known: list[dict[str, int] | None] | None = None, all_: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """How many k-mers of each window count, and where the weighted mean of their vectors is 1/2 at least; known: df of a window's k-mers, of ``all_`` in all.

        A k-mer that is known and rarer than expected weighs its log-likelihood each time, less 1/2 the first time.
        """
        n = np.zeros(len(windows), dtype=np.int64)
        total, mass = np.zeros((len(windows), self.width)), np.zeros(len(windows))
        terms: list[str] = []
        at: list[int] = []
        weights: list[float] = []
        most = max(1, _NUMBERS // self.width)

        def add() -> None:
            if not terms:
                return
            distinct = dict.fromkeys(terms)
            distinct.update(zip(distinct, range(len(distinct)), strict=True))
            sums, masses = self.summed(list(distinct))
            which, w, rows = np.array([distinct[t] for t in terms]), np.array(weights), np.array(at)
            first = np.flatnonzero(np.concatenate([[True], np.diff(rows) != 0]))
            total[rows[first]] += np.add.reduceat(sums[which] * w[:, None], first, axis=0)
            mass[rows[first]] += np.add.reduceat(masses[which] * w, first) * self.density
            terms.clear(), at.clear(), weights.clear()

        for i, window in enumerate(windows):
            own = known[i] if known else None
            for kmer, count in Counter(kmers(window, self.sizes, self.exclude)).items():
                weight = float(count)
                if own and (df := own.get(kmer)):
                    ll = math.log(all_ / df / max(1, len(window) - len(kmer)))
                    if ll > 0:
                        weight = ll * count - 0.5
                n[i] += count
                terms.append(kmer), at.append(i), weights.append(weight)
                if len(terms) >= most:
                    add()
        add()
        with np.errstate(invalid="ignore", divide="ignore"):
            return n, (total / mass[:, None] >= 0.5) & (mass != 0)[:, None]

    def bits(self, window: str, known: dict[str, int] | None = None, all_: int = 0) -> tuple[int, np.ndarray]:
        """batch() of one window."""
        n, bits = self.batch([window], [known], all_)
        return int(n[0]), bits[0]


def genome_signatures(
    records: DataFrame, sizes: list[int] | None = None, width: int = 384, starred: int = 0, density: float = 1.0, exclude: str = "X", size: int = WHOLE,
    advance: int = WHOLE, mismatches: dict[str, str] | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, seg, kmers, offset_begin, offset_end, words): bits where the weighted mean of uniform vectors is 1/2 at least.

    With ``stats`` k-mers weigh their log-likelihood, where it is positive; they meet their statistics by a join, whatever their number.
    Windows without k-mers have no row.
    """
    sums = _Genome(sizes or [6], width, starred, density, exclude, size, advance, mismatches)
    if stats is None:
        return _table(records, width, sums)
    stats = cut(stats.select("term", "df", "ctf"), "kmers")
    total = int(stats.agg(F.coalesce(F.sum("ctf"), F.lit(0))).first()[0])
    kind, names = dict(records.dtypes)["doc_id"], words(width)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, seg, at, w, sorted(set(kmers(w, sums.sizes, exclude)))) for d, r in zip(pdf["doc_id"], pdf["residues"], strict=True) for seg, (at, w) in enumerate(sums.windows(r or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seg", "at", "window", "terms"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [dict(zip(t, d, strict=True)) if t is not None else None for t, d in zip(pdf["known"], pdf["dfs"], strict=True)]
            counts, bits = sums.batch(list(pdf["window"]), known, total)
            kept = np.flatnonzero(counts)
            packed = pack(bits[kept]) if len(kept) else np.zeros((0, len(names)), dtype=np.int64)
            out = pdf.iloc[kept].reset_index(drop=True)
            ends = out["at"] + out["window"].str.len() if len(out) else out["at"]
            rows = pd.DataFrame({"doc_id": out["doc_id"], "seg": out["seg"], "kmers": counts[kept], "offset_begin": out["at"], "offset_end": ends})
            yield rows.assign(**{n: packed[:, i] for i, n in enumerate(names)})

    given = _shared(records, "doc_id", "residues").mapInPandas(cover, f"doc_id {kind}, seg int, at int, window string, terms array<string>")
    given = cut(given.withColumn("uid", F.monotonically_increasing_id()), "windows")
    each = given.select("uid", F.explode("terms").alias("term")).join(stats.select("term", "df"), "term")
    known = each.groupBy("uid").agg(F.collect_list(F.struct("term", "df")).alias("known"))
    met = given.join(known, "uid", "left").select("doc_id", "seg", "at", "window", F.col("known.term").alias("known"), F.col("known.df").alias("dfs"))
    columns = ", ".join(f"{n} long" for n in names)
    return met.mapInPandas(weigh, f"doc_id {kind}, seg int, kmers int, offset_begin int, offset_end int, {columns}")


def position_shuffles(k: int, width: int, rng: int = 64) -> np.ndarray:
    """A fixed permutation of the places for each position in a k-mer."""
    generator = Isaac(np.zeros((1, WORDS)), rng)
    out = np.tile(np.arange(width), (k, 1))
    for row in out:
        for j in range(width):
            to = j + int(generator.next()[0]) % (width - j)
            row[j], row[to] = row[to], row[j]
    return out


class _Protein:
    def __init__(self, residues: dict[str, np.ndarray], k: int, exclude: str, size: int, advance: int) -> None:
        self.width = len(next(iter(residues.values())))
        order = position_shuffles(k, self.width)
        self.moved = {c: v[order] for c, v in residues.items()}
        self.k, self.exclude, self.size, self.advance = k, exclude, size, advance

    def windows(self, residues: str) -> list[tuple[int, str]]:
        return windows(residues, self.size, self.advance)

    def bits(self, window: str) -> tuple[int, np.ndarray]:
        """How many k-mers count, and where the sum of their residues' vectors, shuffled by position, is above 0. Unknown residues add nothing."""
        found = kmers(window, [self.k], self.exclude)
        total = np.zeros(self.width)
        for kmer in found:
            for i, c in enumerate(kmer):
                if c in self.moved:
                    total += self.moved[c][i]
        return len(found), total > 0

    def batch(self, windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """bits() of each window."""
        found = [self.bits(w) for w in windows]
        return np.array([n for n, _ in found], dtype=np.int64), np.stack([b for _, b in found]) if found else np.zeros((0, self.width), dtype=bool)


def protein_signatures(records: DataFrame, residues: dict[str, list[int]], k: int = 6, exclude: str = "X", size: int = WHOLE, advance: int = WHOLE) -> DataFrame:
    """As genome_signatures(), from given vectors of single residues; their length is the width."""
    vectors = {c: np.asarray(v, dtype=float) for c, v in residues.items()}
    return _table(records, len(next(iter(vectors.values()))), _Protein(vectors, k, exclude, size, advance))
