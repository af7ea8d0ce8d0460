"""Byte-level BPE encoding and decoding with a public vocabulary, by Spark's higher-order functions.

A text is split into words by the vocabulary's pattern. A word's bytes are folded: in each step the adjacent pair of least rank,
the first of equals, is merged, until no pair has a rank; ranks come from a literal map, laid out as hash buckets so that a look-up
reads about two entries. Words recur, so they are counted over all documents and each word that does is folded once. Folded words
are a table in the shared folder, which each worker process reads once; nothing of it comes to the driver. Workers hold no more than
the ``DICTIONARY`` commonest words; other words are folded by the same expression once for each text they are in. Nothing but distinct
words is shuffled. Decoding looks up the binary pieces and concatenates them.

Splitting is whole-array arithmetic on code points. A fold of n bytes copies arrays of n numbers n times, so words of more than
``LONG`` bytes (a blob without spaces may have a million) are merged by the splitter, with the pairs in a heap: the same ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sigloom.llm.names import fresh
from sigloom.llm.words import mix, stretches
from sigloom.session import cut, read_packed, saved, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a worker holds (about 50 bytes each); bytes of the longest word that is folded; buckets of the rank map.
DICTIONARY, LONG, BUCKETS = 2_000_000, 64, 65536
PLAN_LENGTH = 100_000


@lru_cache(maxsize=4)
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and their ranks, which are the token ids; read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _bucket(key: str) -> int:
    signed = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return (signed - (1 << 64) if signed >= 1 << 63 else signed) % BUCKETS


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    rows: list[dict | None] = [None] * BUCKETS
    for piece, rank in ranks(path).items():
        key = piece.decode("latin1")
        b = _bucket(key)
        row = rows[b] = rows[b] or {}
        row[key] = rank
    return json.dumps(rows, separators=(",", ":"))


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    found = ranks(path)
    pieces: list[str | None] = [None] * (max(found.values()) + 1)
    for piece, rank in found.items():
        pieces[rank] = base64.b64encode(piece).decode()
    return json.dumps(pieces)


def _rank_map(path: str) -> Column:
    """The literal map of pieces to ranks, in hash buckets; a byte is written as the character of its number."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def _find(rank_map: Column, key: Column) -> Column:
    """The rank of key, or null."""
    return F.try_element_at(F.get(rank_map, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), key)


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def fold(word: Column, rank_map: Column) -> Column:
    """Token ids of one word of a byte at least.

    The state is s, where the pieces start, with the end; and r, the ranks of adjacent pairs, behind a null that stands for the pair
    before the first. A step takes the second piece's start of the best pair away and finds the ranks of the two pairs beside it.
    """

    def go(raw: Column) -> Column:
        size = F.length(raw)

        def pair(s: Column, a: Column, b: Column) -> Column:
            return _find(rank_map, F.substring(raw, F.get(s, a), F.get(s, b) - F.get(s, a)))

        def step(state: Column, _: Column) -> Column:
            s, r = state["s"], state["r"]

            def merge(at: Column) -> Column:
                def beside(left: Column) -> Column:
                    both = F.array(pair(left, at - 3, at - 1), pair(left, at - 2, at))
                    return F.struct(left.alias("s"), F.concat(F.slice(r, F.lit(1), at - 2), both, F.slice(r, at + 2, F.lit(LONG))).alias("r"))

                return F.when(at.isNull(), state).otherwise(_let(F.array_remove(s, F.get(s, at - 1)), beside))

            return _let(F.array_position(r, F.array_min(r)).cast("int"), merge)

        pairs = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i < size, _find(rank_map, F.substring(raw, i, F.lit(2)))))
        start = F.struct(F.sequence(F.lit(1), size + 1).alias("s"), F.concat(F.array(F.lit(None).cast("int")), pairs).alias("r"))

        def ids(state: Column) -> Column:
            s = state["s"]
            return F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda a, i: _find(rank_map, F.substring(raw, a, F.get(s, i + 1) - a)))

        return F.aggregate(F.sequence(F.lit(1), size), start, step, ids)

    return _let(F.decode(word.cast("binary"), "ISO-8859-1"), go)


def merge_long(word: bytes, found: dict[bytes, int]) -> list[int]:
    """The same as fold(), in n log n steps."""
    if word in found:
        return [found[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := found.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or (j := after[i]) >= n or end[j] != last:
            continue
        alive[j] = False
        end[i], after[i] = last, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [found[word[i : end[i]]] for i in range(n) if alive[i]]


_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SLICE, _HELD = 250_000, 200_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point whether it is a letter, a number, white space or anything else; one more stands for the end of a text."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kinds = np.array([{"L": _LETTER, "N": _NUMBER}.get(c, _OTHER) for c in first] + [_END], dtype=np.uint8)
    kinds[_SPACES] = _SPACE
    return kinds


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and of each word its text, its first byte and the byte behind it.

    The same words as by the public pattern: a run of letters, of numbers or of other characters takes one space before it; white
    space that precedes something else leaves its last character; 's 't 're 've 'm 'll 'd are words where nothing is in front.
    """
    end = np.array([0x110000], dtype=np.uint32)
    code = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), end)] + [end, end, end])
    kind = _kinds()[code]
    start = np.empty(len(code), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    gap = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    start[gap] = True
    start[gap[code[gap] == 32] + 1] = False
    quote = np.flatnonzero((code == 39) & start)
    one, two = code[quote + 1], code[quote + 2]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    long_ = quote[((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
    start[np.concatenate([short, long_]) + 1] = False
    start[np.concatenate([short + 2, long_ + 3])] = True
    width = 1 + ((code >= 0x80) & (code < 0x110000)) + ((code >= 0x800) & (code < 0x110000)) + ((code >= 0x10000) & (code < 0x110000))
    byte = np.concatenate([[0], np.cumsum(width)])
    edges = np.flatnonzero(start)
    word = np.flatnonzero(kind[edges] != _END)
    at, until = edges[word], edges[word + 1]
    doc = np.searchsorted(np.flatnonzero(kind == _END), at)
    return b"\n".join(t.encode() for t in texts) + b"\n", doc, byte[at], byte[until]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in parts of about _SLICE characters; few rows are Python strings at a time."""
    part: list[str] = []
    size = 0
    for i in range(0, len(texts), 64):
        for t in texts.slice(i, 64).to_pylist():
            part.append(t or "")
            size += len(part[-1])
            if size > _SLICE:
                yield part
                part, size = [], 0
    if part:
        yield part


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return stretches(np.frombuffer(data, dtype=np.uint8), start, end)


def _checks(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Second hashes, of 32 bits: words are told apart by 96 bits."""
    return (stretches(_SPREAD[np.frombuffer(data, dtype=np.uint8)], start, end) >> np.uint64(32)).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), several times over for words that recur after long."""
    words: dict[int, bytes] = {}
    seen: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if seen:
            key, place = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
            total = np.bincount(place, np.concatenate([n for _, n in seen]), len(key)).astype(np.int64)
            found = pa.array([words[k] for k in key.tolist()], type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([found, pa.array(total)], names=["word", "n"])
        words.clear()
        seen.clear()

    for batch in batches:
        for part in _slices(batch.column(0)):
            data, _, start, end = split(part)
            fit = end - start <= LONG
            start, end = start[fit], end[fit]
            key, first, n = np.unique(_hashes(data, start, end), return_index=True, return_counts=True)
            for k, a, b in zip(key.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
                if k not in words:
                    words[k] = data[a:b]
            if len(key):
                seen.append((key, n))
            if len(words) > _HELD:
                yield from flush()
    yield from flush()


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word, n): all words of at most LONG bytes, and how often they occur."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_PACKED = {"key": np.uint64, "check": np.uint32, "sizes": np.uint8, "ids": np.int32}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words as packed numbers: hashes, second hashes, numbers of ids, ids."""
    for batch in batches:
        words = batch.column(0).cast(pa.binary()).to_pylist()
        ids = batch.column(1)
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        data = b"".join(words) + b" "
        found = {"key": _hashes(data, at[:-1], at[1:]), "check": _checks(data, at[:-1], at[1:]), "sizes": np.diff(ids.offsets.to_numpy()), "ids": ids.flatten().to_numpy()}
        yield pa.RecordBatch.from_arrays([pa.array([found[k].astype(kind).tobytes()], type=pa.binary()) for k, kind in _PACKED.items()], names=list(_PACKED))


def dictionary(docs: DataFrame, path: str = VOCABULARY, size: int = DICTIONARY) -> str:
    """The folder of a table (key, check, sizes, ids), packed: of all words that recur, or of those that occur so often that no more than ``size`` do."""
    spark = docs.sparkSession
    words = cut(distinct_words(docs), "words")
    often = words.where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("c")).select("n", F.sum("c").over(Window.orderBy(F.desc("n"))).alias("upto"))
    least = often.where(F.col("upto") <= size).agg(F.min("n")).first()[0]
    words = words.where(F.lit(False) if least is None else F.col("n") >= least).select("word")
    words = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    folded = words.select("word", _let(_rank_map(path), lambda m: fold(F.col("word"), m)).alias("ids"))
    return saved(folded.mapInArrow(_pack, ", ".join(f"{k} binary" for k in _PACKED)), "dictionary")


class Lookup:
    """Finds words of the dictionary by hash, in an open table built once in each worker process."""

    current: Lookup | None = None
    folder: str | None = None

    @classmethod
    def of(cls, folder: str) -> Lookup:
        """The dictionary of a folder; the one before it is let go."""
        if cls.folder != folder:
            cls.current = None
            parts = [{k: np.frombuffer(x, _PACKED[k]) for k, x in row.items()} for row in read_packed(folder, list(_PACKED))]
            cls.current, cls.folder = cls(**{k: np.concatenate([np.zeros(0, kind), *(p.pop(k) for p in parts)]) for k, kind in _PACKED.items()}), folder
        return cls.current

    def __init__(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.key, self.check, self.sizes, self.ids = np.append(key, np.uint64(0)), np.append(check, np.uint32(0)), np.append(sizes, np.uint8(0)), ids
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.bits = np.uint64(64 - max(4, int(len(key) * 2).bit_length()))
        self.table = np.full(1 << (64 - int(self.bits)), len(key), dtype=np.int32)
        left, slot = np.arange(len(key), dtype=np.int32), self._slot(key)
        while len(left):
            free = self.table[slot] == len(key)
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> self.bits).astype(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of words in the dictionary; its length for those that aren't there."""
        slot = self._slot(key)
        place = self.table[slot]
        open_ = np.flatnonzero((self.key[place] != key) & (place < len(self.key) - 1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            place[open_] = self.table[slot[open_]]
            open_ = open_[(self.key[place[open_]] != key[open_]) & (place[open_] < len(self.key) - 1)]
        return np.where(self.check[place] == check, place, len(self.key) - 1)


def _spread(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for lengths[0] numbers, and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _assemble(batches: Iterator[pa.RecordBatch], folder: str, path_ranks, text: int, kept: int, added: list[str]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The first ``kept`` columns of each batch and three more: ids of runs of known words, which word follows each run, and those words."""
    words_ = Lookup.of(folder)
    flat, none = words_.ids, len(words_.key) - 1
    for batch in batches:
        texts, batch, row = batch.column(text), batch.select(range(kept)), 0
        for part in _slices(texts):
            data, doc, start, end = split(part)
            small = end - start <= LONG
            key = _hashes(data, start, end)
            place = np.where(small, words_.find(key, _checks(data, start, end)), none)
            known = place < none
            begins, sizes = words_.begins[place].astype(np.int64), words_.sizes[place].astype(np.int64)
            pool = flat
            far = np.flatnonzero(~small)
            if len(far):
                merged = [merge_long(data[start[i] : end[i]], path_ranks.value) for i in far.tolist()]
                sizes[far] = [len(x) for x in merged]
                begins[far] = len(flat) + np.concatenate([[0], np.cumsum(sizes[far])[:-1]])
                pool = np.concatenate([flat, np.array([i for x in merged for i in x], dtype=np.int32)])
            ids = pool[_spread(sizes, begins)]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            gap = np.flatnonzero(~known & small)
            rows = np.arange(len(part))
            # a text's runs end at its unknown words and at its end
            last = np.searchsorted(doc, rows, side="right")
            ends = np.sort(np.concatenate([gap * 2, last * 2 - 1]), kind="stable")
            part_ends = upto[np.where(ends % 2 == 0, ends // 2, (ends + 1) // 2)]
            unknown = np.searchsorted(gap, last)
            # each unknown word once a text
            order = np.lexsort((key[gap], doc[gap]))
            own, hashes = doc[gap][order], key[gap][order]
            new = np.ones(len(gap), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
            once = gap[order[new]]
            distinct = np.searchsorted(doc[once], rows, side="right")
            which = np.empty(len(gap), dtype=np.int32)
            which[order] = np.cumsum(new) - 1 - np.concatenate([[0], distinct])[own]
            words = pa.array([data[a:b] for a, b in zip(start[once].tolist(), end[once].tolist(), strict=True)], type=pa.binary()).cast(pa.string())
            listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]).astype(np.int32)), values)
            runs = listed(unknown + rows + 1, listed(part_ends, pa.array(ids)))
            same = batch.slice(row, len(part))
            yield pa.RecordBatch.from_arrays([*same.columns, runs, listed(unknown, pa.array(which)), listed(distinct, words)], names=[*same.schema.names, *added])
            row += len(part)


_known: dict[tuple[str, str], object] = {}


def _shared_ranks(context, path: str):  # noqa: ANN001, ANN202
    """The vocabulary as a broadcast, of which there is one for each application and path."""
    key = (context.applicationId, path)
    if key not in _known:
        _known[key] = context.broadcast(ranks(path))
    return _known[key]


def _short_plans(spark: SparkSession) -> None:
    """The driver keeps the texts of plans; those that hold a vocabulary are cut short."""
    key = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(key).rstrip("bB")) > PLAN_LENGTH:
        spark.conf.set(key, str(PLAN_LENGTH))


def encode(docs: DataFrame, path: str = VOCABULARY, size: int = DICTIONARY) -> DataFrame:
    """docs with ``token_ids``, which replaces a column of that name.

    A null text has null ids, an empty one none. Ids follow the vocabulary of ``path``; every byte is in it, so every text can be
    encoded. Repeated rows are encoded each. All other columns stay, whatever their names.
    """
    _short_plans(docs.sparkSession)
    known, folder = _shared_ranks(docs.sparkSession.sparkContext, path), dictionary(docs, path, size)
    rest = [c for c in docs.columns if c != "token_ids"]
    whole, parts, which, words_ = fresh(rest, "whole", "parts", "which", "words")
    plain = dict(docs.dtypes)["text"] == "string"
    given = docs.select(*[F.col(f"`{c}`") for c in rest], *([] if plain else [F.col("text").cast("string").alias(whole)]))
    text, kept = rest.index("text") if plain else len(rest), docs.select(*[F.col(f"`{c}`") for c in rest]).schema.fields
    added = [StructField(parts, ArrayType(ArrayType(IntegerType()))), StructField(which, ArrayType(IntegerType())), StructField(words_, ArrayType(StringType()))]
    found = given.mapInArrow(lambda b: _assemble(b, folder, known, text, len(rest), [parts, which, words_]), StructType([*kept, *added]))

    def joined(rank_map: Column) -> Column:
        folded = F.transform(words_, lambda w: fold(w, rank_map))
        return _let(folded, lambda ids: F.flatten(F.transform(parts, lambda p, k: F.when(k < F.size(which), F.concat(p, F.get(ids, F.get(which, k)))).otherwise(p))))

    ids = F.when(F.size(words_) == 0, F.get(parts, F.lit(0))).otherwise(_let(_rank_map(path), joined))
    return found.select(*[F.col(f"`{c}`") for c in rest], F.when(F.col("text").isNotNull(), ids).alias("token_ids"))


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of token ids. A cast from binary to string keeps the bytes as they are, so joining pieces concatenates bytes; unknown ids give nothing."""
    pieces = F.from_json(F.lit(_piece_json(path)), "array<binary>")
    return F.transform(F.array(pieces), lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i).cast("string")), ""))[0]


def encoded(docs: DataFrame, path: str = VOCABULARY, size: int = DICTIONARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, exact): ``exact`` tells whether decoding gives the text again."""
    found = encode(docs.select("doc_id", "text"), path, size)
    return found.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), (decode(F.col("token_ids"), path) == F.col("text")).alias("exact"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
