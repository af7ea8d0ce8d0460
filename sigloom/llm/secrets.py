"""Secret scan by grammar inference.

For each format of labelled credentials a probabilistic automaton is inferred: the examples are laid out as a prefix tree, and its
states are merged, red by blue, where the frequencies of stopping and going on agree within Hoeffding's bound, also of all states
behind them (ALERGIA; Carrasco and Oncina, 1994). One more automaton is inferred from labelled strings that are no credentials.
Every candidate of every text is then scored: the log-likelihood a character under the best format, against that of the other automaton.
A candidate is a run of characters, or a part of one: from any separator or literal prefix of a format to any separator, as a key behind
its name, in a path or before a full stop.

Automata read symbols: the prefix that all examples of a format share and separators stay as they are, other characters are written
as one of five classes (digits, letters that are hexadecimal digits or not, in either case), and add the even chance of the class. States
of a format are merged if they stand as far behind as many separators: thousands of branches of the tree become a few states for each
place, which keep the lengths and which classes a place has. States of the other automaton are merged wherever they agree.
"""

from __future__ import annotations

import math
import os.path
import random
import re
import string
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import table

#: Confidence of a merge; probability of a symbol that no example has; symbols that smooth a state's shares; share of held-out credentials that may score below the bar.
ALPHA, UNSEEN, SMOOTH, MISSED = 0.05, 1e-4, 1.0, 0.01
#: Labelled strings used at most of each format.
LABELLED = 400
OTHER = "other"

CLASSES = {"d": string.digits, "h": "abcdef", "l": string.ascii_lowercase[6:], "H": "ABCDEF", "U": string.ascii_uppercase[6:]}
#: Of each character of a class its symbol, of two letters, so that no literal is like it.
_SYMBOL = {c: name * 2 for name, members in CLASSES.items() for c in members}
_CHANCE = {name * 2: -math.log(len(members)) for name, members in CLASSES.items()}
_TOKEN = re.compile(r"[A-Za-z0-9]+")


def labelled_examples(seed: int = 5, each: int = LABELLED) -> list[tuple[str, str]]:
    """(format, string): labelled credentials made to public formats, and strings like those in prose and logs that are none."""
    rnd = random.Random(seed)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, string.digits + "abcdef"
    alnum = low + up + dig
    word = lambda: pick(low, rnd.randint(2, 10))
    formats = {
        "hex_160": lambda: pick(hexa, 40),
        "hex_128": lambda: pick(hexa, 32),
        "hex_256": lambda: pick(hexa, 64),
        "hex_160_capitals": lambda: pick(dig + "ABCDEF", 40),
        "access_key_id": lambda: "AKIA" + pick(up + dig, 16),
        "personal_token": lambda: "ghp_" + pick(alnum, 36),
        "live_key": lambda: "sk_live_" + pick(alnum, 24),
        "map_key": lambda: "AIza" + pick(alnum, 35),
        "chat_token": lambda: f"xoxb-{pick(dig, rnd.randint(11, 12))}-{pick(dig, rnd.randint(11, 12))}-{pick(alnum, 24)}",
        "web_token": lambda: f"eyJ{pick(alnum, rnd.randint(17, 33))}.eyJ{pick(alnum, rnd.randint(30, 90))}.{pick(alnum, 43)}",
        OTHER: lambda: rnd.choice(
            [
                lambda: pick(dig, rnd.randint(16, 20)),
                lambda: "-".join(word() for _ in range(rnd.randint(3, 6))) + str(rnd.randint(1, 99)),
                lambda: ".".join([word(), word(), "com"]) + "/" + str(rnd.randint(1, 9999)) + "/" + word(),
                lambda: word() + word() + word() + pick(dig, rnd.randint(1, 4)),
                lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}T{pick(dig, 2)}.{pick(dig, 2)}.{pick(dig, 2)}",
                lambda: "/".join(word() for _ in range(rnd.randint(3, 5))) + f"_{rnd.randint(1, 99)}.html",
                lambda: ".".join(str(rnd.randint(100, 255)) for _ in range(4)) + f".{pick(dig, 4)}",
            ]
        )(),
    }
    return [(name, make()) for name, make in formats.items() for _ in range(each)]


def symbols(text: str, prefix: str = "") -> tuple[list[str], float]:
    """The symbols of a string behind a literal prefix, and the log-chance of its characters given their classes."""
    out = [_SYMBOL.get(c, c) for c in text[len(prefix) :]]
    return [*prefix, *out], sum(_CHANCE.get(s, 0.0) for s in out)


def candidate(shortest: int) -> str:
    """Runs of at least so many characters that credentials are made of; Java's and Python's syntax."""
    return rf"[A-Za-z0-9][A-Za-z0-9_\-+/=.]{{{shortest - 1},}}"


@dataclass
class Automaton:
    """Counts of a deterministic automaton: strings that stop in a state, and that go on, by symbol, and where to."""

    stop: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    go: dict[int, dict[str, int]] = field(default_factory=lambda: defaultdict(dict))
    to: dict[int, dict[str, int]] = field(default_factory=lambda: defaultdict(dict))
    table: dict[int, tuple[dict[str, tuple[float, int]], float]] = field(default_factory=dict)
    most: dict[int, int] = field(default_factory=dict)

    def total(self, q: int) -> int:
        return self.stop[q] + sum(self.go[q].values())

    def compiled(self) -> dict[int, tuple[dict[str, tuple[float, int]], float]]:
        """Of each state the log-chance and the next state of each symbol, and the log-chance of stopping.

        Shares are smoothed by SMOOTH symbols spread as in all examples. What a state has not seen leads where most go on to, or back to the start.
        """
        if not self.table:
            spread: dict[str, int] = defaultdict(int)
            for q in self.go:
                for s, n in self.go[q].items():
                    spread[s] += n
            stops = sum(self.stop.values())
            total = stops + sum(spread.values())
            for q in list(self.go):
                size, go = self.total(q) + SMOOTH, self.go[q]
                most = self.to[q][max(go, key=go.__getitem__)] if go else 0
                log = lambda n, all_: math.log((1 - UNSEEN) * (n + SMOOTH * all_ / total) / size)  # noqa: B023, E731
                self.table[q] = {s: (log(go.get(s, 0), n), self.to[q].get(s, most)) for s, n in spread.items()}, log(self.stop[q], stops)
                self.most[q] = most
        return self.table

    def score(self, word: list[str]) -> float:
        """Log-likelihood; a symbol that no example has has the chance UNSEEN."""
        table = self.compiled()
        q, out = 0, 0.0
        for s in word:
            chance, q = table[q][0].get(s) or (math.log(UNSEEN), self.most[q])
            out += chance
        return out + table[q][1]


def prefix_tree(words: list[list[str]]) -> Automaton:
    tree, states = Automaton(), 1
    for word in words:
        q = 0
        for s in word:
            tree.go[q][s] = tree.go[q].get(s, 0) + 1
            if s not in tree.to[q]:
                tree.to[q][s], states = states, states + 1
            q = tree.to[q][s]
        tree.stop[q] += 1
    return tree


def places(a: Automaton) -> dict[int, tuple[int, int]]:
    """Of each state of a prefix tree how many separators are before it, and how many symbols since the last."""
    found, todo = {0: (0, 0)}, [0]
    while todo:
        q = todo.pop()
        for s, x in a.to[q].items():
            found[x] = (found[q][0] + 1, 0) if len(s) == 1 else (found[q][0], found[q][1] + 1)
            todo.append(x)
    return found


def infer(words: list[list[str]], alpha: float = ALPHA, placed: bool = True) -> Automaton:
    """ALERGIA over the prefix tree of words; if placed, only states of the same place are merged."""
    a = prefix_tree(words)
    place = places(a) if placed else defaultdict(tuple)
    margin = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > margin * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        todo, seen = [(p, q)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            n1, n2 = a.total(x), a.total(y)
            if differ(a.stop[x], n1, a.stop[y], n2):
                return False
            for s in sorted(set(a.go[x]) | set(a.go[y])):
                if differ(a.go[x].get(s, 0), n1, a.go[y].get(s, 0), n2):
                    return False
                if s in a.to[x] and s in a.to[y]:
                    todo.append((a.to[x][s], a.to[y][s]))
        return True

    def fold(p: int, q: int) -> list[int]:
        """Adds the tree at q to p; the states that were added to."""
        todo, met = [(p, q)], []
        while todo:
            x, y = todo.pop()
            met.append(x)
            a.stop[x] += a.stop[y]
            for s, n in a.go[y].items():
                a.go[x][s] = a.go[x].get(s, 0) + n
                if s in a.to[x]:
                    todo.append((a.to[x][s], a.to[y][s]))
                else:
                    a.to[x][s] = a.to[y][s]
        return met

    red, blue = {0: None}, deque((0, s) for s in sorted(a.to[0]))
    peers: dict[tuple, list[int]] = defaultdict(list, {place[0]: [0]})
    while blue:
        parent, s = blue.popleft()
        q = a.to[parent][s]
        if q in red:
            continue
        for p in peers[place[q]]:
            if compatible(p, q):
                a.to[parent][s] = p
                grown = [x for x in fold(p, q) if x in red]
                break
        else:
            red[q] = None
            peers[place[q]].append(q)
            grown = [q]
        waiting = set(blue)
        blue.extend((x, t) for x in dict.fromkeys(grown) for t in sorted(a.to[x]) if a.to[x][t] not in red and (x, t) not in waiting)
    kept = Automaton()
    for q in red:
        kept.stop[q], kept.go[q], kept.to[q] = a.stop[q], a.go[q], a.to[q]
    return kept


@dataclass
class Scanner:
    formats: list[tuple[str, str, Automaton]]
    bars: dict[str, float]
    #: Most tokens between separators that an example of a format has; characters of the shortest example.
    tokens: int = 1
    shortest: int = 16

    def best(self, text: str) -> tuple[str, float, float]:
        """The best format, its log-likelihood a character, and what that is above the other strings' automaton."""
        found = []
        for name, prefix, automaton in self.formats:
            if text.startswith(prefix):
                word, chance = symbols(text, prefix)
                found.append(((automaton.score(word) + chance) / (len(text) + 1), name))
        none = max((s for s, n in found if n == OTHER), default=math.log(UNSEEN))
        score, name = max(((s, n) for s, n in found if n != OTHER), default=(math.log(UNSEEN), OTHER))
        return name, score, score - none

    def is_secret(self, text: str) -> tuple[str, float, bool]:
        name, score, above = self.best(text)
        return name, round(above, 9), name != OTHER and above > 0 and score >= self.bars[name]

    def parts(self, run: str) -> Iterator[tuple[int, int]]:
        """The run, and each part of it from a separator or a format's literal prefix to a separator, of no more tokens than examples have."""
        yield 0, len(run)
        found = [m.span() for m in _TOKEN.finditer(run)]
        inner = {m.start() for _, prefix, _ in self.formats if prefix for m in re.finditer(re.escape(prefix), run)}
        for i, (first, upto) in enumerate(found):
            for start in sorted({first, *(x for x in inner if first < x < upto)}):
                for _, end in found[i : i + self.tokens]:
                    if self.shortest <= end - start < len(run):
                        yield start, end

    def found(self, run: str) -> list[tuple[str, str, float, bool]]:
        """(candidate, format, score, is_secret) of the secrets of a run, of those that overlap the one most above other strings; else of the run."""
        scored = [(start, end, *self.is_secret(run[start:end])) for start, end in self.parts(run)]
        kept: list[tuple[int, int, str, float, bool]] = []
        for x in sorted((x for x in scored if x[4]), key=lambda x: (-x[3] * (x[1] - x[0] + 1), x[0])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        rows = sorted(kept) or scored[:1]
        return [(run[start:end], *rest) for start, end, *rest in rows]


def fit(examples: list[tuple[str, str]]) -> Scanner:
    """Automata from four fifths of the examples of each format; bars from the rest. An example is used once, however often it is given."""
    by: dict[str, list[str]] = defaultdict(list)
    for name, text in sorted(set(examples)):
        by[name].append(text)
    scanner = Scanner([], {})
    scanner.shortest = min((len(t) for name, t in examples if name != OTHER), default=16)
    for name, texts in by.items():
        random.Random(1).shuffle(texts)
        texts = texts[:LABELLED]
        train = texts[: max(1, len(texts) * 4 // 5)]
        prefix = "" if name == OTHER else os.path.commonprefix(texts)
        scanner.formats.append((name, prefix, infer([symbols(t, prefix)[0] for t in train], placed=name != OTHER)))
        if name != OTHER:
            scanner.tokens = max(scanner.tokens, *(len(_TOKEN.findall(t)) for t in texts))
    for name, texts in by.items():
        if name != OTHER:
            held = sorted(scanner_score(scanner, name, t) for t in texts[:LABELLED][max(1, len(texts[:LABELLED]) * 4 // 5) :] or texts)
            scanner.bars[name] = held[int(len(held) * MISSED)] - 0.25  # a little below: held-out examples are few
    return scanner


def scanner_score(scanner: Scanner, name: str, text: str) -> float:
    _, prefix, automaton = next(f for f in scanner.formats if f[0] == name)
    word, chance = symbols(text, prefix)
    return (automaton.score(word) + chance) / (len(text) + 1)


@lru_cache(maxsize=1)
def standard() -> Scanner:
    """The scanner of labelled_examples()."""
    return fit(labelled_examples())


def candidates(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, runs): the runs of each text that could be or hold a credential, in order."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(candidate(shortest)), F.lit(0))
    return docs.select("doc_id", found.alias("runs")).where(F.size("runs") > 0)


def scan(docs: DataFrame, examples: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, nth, candidate, format, score, is_secret) for each candidate of each row of docs, in order, nth from 0.

    Runs are as long as the shortest example at least. Of a run that holds secrets, each of them is a candidate; any other is one as a
    whole. score is the log-likelihood
    a character above that of other strings. Null and empty texts have no candidates; repeated rows have theirs each; long texts are
    scanned whole. Without examples labelled_examples() are used. An empty table gives an empty result.
    """
    scanner = standard() if examples is None else fit(examples)

    @F.pandas_udf("struct<candidate: array<string>, format: array<string>, score: array<double>, is_secret: array<boolean>>")
    def run(lists: pd.Series) -> pd.DataFrame:
        known: dict[str, list[tuple[str, str, float, bool]]] = {}
        out = []
        for runs in lists:
            for t in runs:
                if t not in known:
                    known[t] = scanner.found(t)
            rows = [x for t in runs for x in known[t]]
            out.append([[x[i] for x in rows] for i in range(4)])
        return pd.DataFrame(out, columns=["candidate", "format", "score", "is_secret"])

    rows = candidates(docs, scanner.shortest).select("doc_id", run("runs").alias("x"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("x.candidate", "x.format", "x.score", "x.is_secret")).alias("nth", "x"))
    return rows.select("doc_id", "nth", "x.candidate", "x.format", "x.score", "x.is_secret")


def op4_grammar_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
