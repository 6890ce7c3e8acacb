"""Toxicity scores of texts whose words may be disguised.

Method (noisy channel).  A word seen in a text is taken for the output of a channel that replaces letters by look-alikes, repeats them, and puts
spaces or marks between them.  Each suspicious word spans a lattice of what its characters may stand for; the Viterbi path under a
character trigram model, counted over all documents, restores it.  Words without such signs have one path and stay.  Runs of short tokens span a
lattice of their own, in which every space may be a word's edge or have been put in; words that its path joins are read besides the tokens, from each of
their spaces on, and so is any run of them that makes a word of the evidence.  Spaces that two settled letters on either side show to be edges end a lattice.  The restored text is scored by word evidence learned from labelled rows: log odds of words and word beginnings, of which the strongest count.

Bounds.  At most ``FIT_ROWS`` labelled rows of each class are learned from: half for the evidence, half for the calibration, weighted back to the classes'
shares.  At most ``EVIDENCE`` words and ``TRIGRAMS`` trigrams reach the tasks.  The trigrams are counted over every document.

Cases.  Null or empty text, and text without evidence, has the score of no evidence.  Very long texts and tokens are read whole; a lattice
of more than ``WINDOW`` short tokens is read in windows that share half, so that a word of up to ``WINDOW / 2`` tokens is whole in one.  Without labelled rows of both classes
every score is the share of label 1 (0 without any).  Repeated rows are scored each; an empty table gives an empty result; other columns are ignored and a null
key is not held out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.arrays import mix, text_slices
from inkstream.llm.language_id import _folded
from inkstream.llm.sampling import fit_logistic, labelled_sample, logistic, remainder

FIT_ROWS = 4000
EVIDENCE = 4000
TRIGRAMS = 300_000
#: Weights of tokens remembered by a Python worker, and as many tokens, pairs and groups of them.
MEMORY = 300_000
#: Tokens and pairs remembered by their hashes alone.
HASHES = 600_000
#: Letters and signs of a short token, and how many such tokens a lattice takes.
SHORT, WINDOW = 4, 64
#: Letters of the texts taken at a time, a longer text alone.
SLICE = 1 << 19
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)

# fixed values: what a character may stand for besides itself
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs of the channel, as negative log probabilities.
SUBSTITUTED, DOUBLED = 0.7, 0.5
MARK_DROPPED, MARK_DROPPED_OUTSIDE, LOOKALIKE_DROPPED, DIGIT_DROPPED_OUTSIDE = 0.7, 0.1, 6.0, 2.0
SPACE_DROPPED = 2.0
_EDGES = ".,;:?\"'`~*%&#)]}[{<>/\\=_-…«»“”’"


# ---- the character model ----


class CharacterModel:
    """Costs of a letter after two others; a blank is the edge of a word."""

    def __init__(self, counts: dict[str, int]):
        pairs: Counter[str] = Counter()
        singles: Counter[str] = Counter()
        context: Counter[str] = Counter()
        for gram, n in counts.items():
            context[gram[:2]] += n
            pairs[gram[1:]] += n
            singles[gram[2]] += n
        total = sum(singles.values()) + 1
        first: Counter[str] = Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
        self.rare = float(-np.log(0.01 / 1000))
        self.single = {c: float(-np.log(0.01 * n / total + 1e-5)) for c, n in singles.items()}
        self.pair = {
            p: float(-np.log(0.09 * n / first[p[0]] + np.exp(-self.single[p[1]]))) for p, n in pairs.items()
        }
        self.triple = {
            g: float(-np.log(0.9 * n / context[g[:2]] + np.exp(-self.pair[g[1:]]))) for g, n in counts.items()
        }

    def cost(self, before: str, letter: str) -> float:
        found = self.triple.get(before + letter)
        if found is None:
            found = self.pair.get(before[1] + letter)
            if found is None:
                found = self.single.get(letter, self.rare)
        return found

    def _spell(self, states: dict[str, tuple], token: str) -> dict[str, tuple]:
        """The states behind a token: by their last two letters, the cost and a chain of what was read."""
        if _local(token):  # one reading, so one state is left
            first, second = token[0], token[1]
            cost, text = min(
                ((c + self.cost(last, first) + self.cost(last[1] + first, second), t) for last, (c, t) in states.items()),
                key=lambda state: state[0],
            )
            for at in range(2, len(token)):
                cost += self.cost(token[at - 2 : at], token[at])
            return {token[-2:]: (cost, (text, token))}
        runs = [(c, len(list(g))) for c, g in groupby(token)]
        for at, (c, length) in enumerate(runs):
            outside = at == 0 or at == len(runs) - 1
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, DOUBLED if length > 1 else 0.0))
                if length > 1:
                    options.append((c + c, DOUBLED if length > 2 else 0.0))
            else:
                inside = LOOKALIKE_DROPPED if c in LOOKALIKES else MARK_DROPPED
                options.append(("", (DIGIT_DROPPED_OUTSIDE if c.isdigit() else MARK_DROPPED_OUTSIDE) if outside else inside))
                for letter in LOOKALIKES.get(c, ""):
                    options.append((letter, SUBSTITUTED))
                    if length > 1:
                        options.append((letter + letter, SUBSTITUTED + DOUBLED))
            following: dict[str, tuple] = {}
            for last, (cost, text) in states.items():
                for letters, price in options:
                    total, context = cost + price, last
                    for letter in letters:
                        total += self.cost(context, letter)
                        context = context[1] + letter
                    known = following.get(context)
                    if known is None or total < known[0]:
                        following[context] = (total, (text, letters) if letters else text)
            states = following
        return states

    def _best(self, states: dict[str, tuple]) -> str:
        ends = [(cost + (self.cost(last, " ") if last != "  " else 0.0), text) for last, (cost, text) in states.items()]
        least = min(cost for cost, _ in ends)
        return min(_unchained(text) for cost, text in ends if cost == least)

    def restore(self, token: str) -> str:
        """The most probable letters behind a lower-case token."""
        return self._best(self._spell({"  ": (0.0, None)}, token))

    def joins(self, before: str, behind: str) -> bool:
        """Whether a space between two letters and two letters was rather put in than a word's edge."""
        edge = self.cost(before, " ") + self.cost("  ", behind[0]) + self.cost(" " + behind[0], behind[1])
        return SPACE_DROPPED + self.cost(before, behind[0]) + self.cost(before[1] + behind[0], behind[1]) < edge

    def segment(self, tokens: list[str]) -> list[list[str]]:
        """The most probable words behind lower-case tokens, each as the letters between the spaces put into it."""
        states: dict[str, tuple] = {"  ": (0.0, None)}
        for at, token in enumerate(tokens):
            if at:
                following: dict[str, tuple] = {}
                for last, (cost, text) in states.items():
                    following[last] = (cost + SPACE_DROPPED, (text, "+"))
                edges = [(cost + (self.cost(last, " ") if last != "  " else 0.0), (text, " ")) for last, (cost, text) in states.items()]
                edge = min(edges, key=lambda e: e[0])
                if "  " not in following or edge[0] < following["  "][0]:
                    following["  "] = edge
                states = following
            states = self._spell(states, token)
        return [[part for part in word.split("+") if part] for word in self._best(states).split(" ")]


def _unchained(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        chain, letters = chain
        parts.append(letters)
    return "".join(reversed(parts))


def character_counts(documents: DataFrame, text: str = "text", most: int = TRIGRAMS) -> dict[str, int]:
    """Letter trigrams of all documents, words between blanks; the ``most`` frequent reach the driver."""
    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, _ in text_slices(batch.column(0)):
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
                letters = np.concatenate(([0], _folded()[points], [0])).astype(np.int64)
                keep = np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))
                letters = letters[keep]
                grams = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]
                grams = grams[(letters[1:-1] != 0)]
                first = (letters[:-1] == 0) & (letters[1:] != 0)  # two blanks before a word
                parts.append(np.unique(np.concatenate([grams, letters[1:][first]]), return_counts=True))
            if parts:
                grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total)], names=["gram", "n"])

    counted = rows.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(most).toPandas()
    mask = (1 << 21) - 1
    return {
        "".join(chr(x) if x else " " for x in (g >> 42, g >> 21 & mask, g & mask)): n
        for g, n in zip(top["gram"].tolist(), top["n"].tolist(), strict=True)
    }


# ---- words ----


_TRIPLE = re.compile(r"(.)\1\1")


def _suspicious(core: str) -> bool:
    if core.isalpha():
        return _TRIPLE.search(core) is not None
    return any(c.isalpha() for c in core)


def _evidence_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:n] + "*" for n in range(4, min(len(word), 10)))]


def _local(core: str) -> bool:
    """Whether the letters of a token stand for themselves and settle what its neighbours see."""
    return len(core) > 1 and core.isalpha() and all(a != b for a, b in zip(core, core[1:], strict=False))


def spelled_out(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, joined."""
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    out, at = [], 0
    while at < len(single):
        stop = at + 1
        while stop < len(single) and single[stop] == single[stop - 1] + 1:
            stop += 1
        if stop - at > 2:
            out.append("".join(tokens[single[at] : single[stop - 1] + 1]))
        at = stop
    return out


class Remembered(dict[Any, Any]):
    """What a function gave, by its argument.  Of ``MEMORY`` entries at most, those asked for lately stay."""

    def __init__(self, work: Callable[[Any], Any]):
        super().__init__()
        self.work = work
        self.older: dict[Any, Any] = {}

    def __missing__(self, key: Any) -> Any:
        found = self.older[key] if key in self.older else self.work(key)
        if len(self) >= MEMORY // 2:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def _short(token: str) -> str | None:
    """A token without marks on its edges, None if it is long."""
    core = token.strip(_EDGES)
    return core if len(core) <= SHORT else None


class Restorer:
    """Words of texts, as they stand and restored.

    Neighbouring tokens, and groups of them with unsettled spaces, recur much more than whole runs, so they are what is remembered.
    """

    def __init__(self, counts: dict[str, int], known: Iterable[str] = ()):
        self.model = CharacterModel(counts)
        self.known = {w for w in known if not w.endswith("*")}
        self.beginnings = {w[:n] for w in self.known for n in range(1, len(w) + 1)}
        self.cores = Remembered(_short)
        self.local = Remembered(_local)
        self.pairs = Remembered(self.pair)
        self.groups = Remembered(self._segmented)

    def words(self, token: str) -> list[str]:
        core = token.strip(_EDGES)
        plain = core.strip("!$|+(0123456789@")
        out = [plain] if plain else []
        if _suspicious(core):
            restored = self.model.restore(core)
            if restored and restored != plain:
                out.append(restored)
        return out

    def tokens(self, text: str) -> set[str]:
        """Distinct lower-case tokens of a text, and words joined of short tokens as well."""
        tokens = text.lower().split()
        out = set(tokens)
        line = [core for core in map(self.cores.__getitem__, tokens) if core != ""]
        kinds = list(map(self.pairs.__getitem__, zip(line, line[1:], strict=False)))
        if any(kinds):
            out.update(self._joined(line, kinds))
        return out

    def pair(self, pair: tuple[str | None, str | None]) -> int:
        """What two neighbours may be part of: 1 the beginning of a known word, 2 a group with an unsettled space, 3 both, 0 neither."""
        before, core = pair
        if before is None or core is None:
            return 0
        # a space between letters that stand for themselves is settled by two on either side
        settled = self.local[before] and self.local[core] and not self.model.joins(before[-2:], core[:2])
        return (before in self.beginnings and before + core in self.beginnings) + (0 if settled else 2)

    def _joined(self, line: list[str | None], kinds: list[int]) -> Iterator[str]:
        group: list[str] = []
        for at, kind in enumerate((*kinds, 0)):
            if kind & 2:
                group.append(line[at])
            elif group:
                yield from self.words_of((*group, line[at]))
                group = []
            if kind & 1:
                yield from self.known_from(islice(line, at, None))

    def known_from(self, cores: Iterator[str | None]) -> Iterator[str]:
        """Known words that short tokens make from the first on."""
        word = next(cores)
        for core in cores:
            if core is None:
                return
            word += core
            if word not in self.beginnings:
                return
            if word in self.known:
                yield word

    def words_of(self, group: tuple[str, ...]) -> Iterator[str]:
        if len(group) <= WINDOW:
            yield from self.groups[group]
            return
        yield from spelled_out(list(group))
        for at in range(0, len(group) - WINDOW // 2, WINDOW // 2):
            yield from self.groups[group[at : at + WINDOW]]

    def _segmented(self, group: tuple[str, ...]) -> list[str]:
        """What the lattice of a group of tokens joins, and its single characters in a row."""
        words = self.model.segment(list(group))
        return [*spelled_out(list(group)), *("".join(parts[first:]) for parts in words for first in range(len(parts) - 1))]


# ---- evidence and scores ----


@dataclass
class ToxicityModel:
    counts: dict[str, int]
    evidence: dict[str, float]
    beta: np.ndarray


class Tokens:
    """Lower-case tokens of some texts, their hashes, and those with a core: where it lies and whether it is short."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        self.text = "\n".join(lower)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        spaces, marks = _tables()
        solid = np.concatenate(([False], ~spaces[points], [False]))
        self.starts = np.flatnonzero(solid[1:] & ~solid[:-1])
        self.stops = np.flatnonzero(~solid[1:] & solid[:-1])
        ends = np.cumsum([len(t) + 1 for t in lower])
        self.owner = np.searchsorted(ends, self.starts, side="right")
        # sums of letter hashes times powers of an odd number: a token's is the same wherever it stands
        powers = np.full(len(points) + 1, _ODD, dtype=_U)
        powers[0] = 1
        self._sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(points.astype(_U)) * np.cumprod(powers)[:-1])))
        powers[1:] = pow(int(_ODD), -1, 1 << 64)
        self._back = np.cumprod(powers)
        self.hashes = self._hash(self.starts, self.stops)
        letters = np.flatnonzero(solid[1:-1] & ~marks[points])
        at, to = np.searchsorted(letters, self.starts), np.searchsorted(letters, self.stops)
        cored = np.flatnonzero(at < to)
        self.core_owner = self.owner[cored]
        self.core_starts, self.core_stops = letters[at[cored]], letters[to[cored] - 1] + 1
        self.short = self.core_stops - self.core_starts <= SHORT

    def _hash(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self._sums[stops] - self._sums[starts]) * self._back[starts] + (stops - starts).astype(_U))

    def core(self, at: int) -> str:
        return self.text[self.core_starts[at] : self.core_stops[at]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of short cores that another follows in the same text, and the hashes of the two."""
        two = np.flatnonzero(self.short[:-1] & self.short[1:] & (self.core_owner[:-1] == self.core_owner[1:]))
        before = self._hash(self.core_starts[two], self.core_stops[two])
        core = self._hash(self.core_starts[two + 1], self.core_stops[two + 1])
        return two, mix(before + mix(core))

    def line(self, at: int) -> Iterator[str | None]:
        """Cores from a place on, to the first that is long or of another text."""
        for place in range(at, len(self.short)):
            if not self.short[place] or self.core_owner[place] != self.core_owner[at]:
                break
            yield self.core(place)
        yield None


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a space, and whether it is a mark on the edge of tokens."""
    spaces = np.array([chr(c).isspace() for c in range(0x110000)])
    marks = np.zeros(0x110000, dtype=bool)
    marks[[ord(c) for c in _EDGES]] = True
    return spaces, marks


class Scorer:
    """Strongest evidence of texts.  Tokens and pairs are known by hashes of 64 bits."""

    def __init__(self, counts: dict[str, int], evidence: dict[str, float]):
        self.restorer = Restorer(counts, evidence)
        self.evidence = evidence
        self.starts = {e[:4] for e in evidence if e.endswith("*")}  # beginnings have four letters or more
        self.weights = Remembered(self._weight)
        self.weighty = Remembered(self._weighty)
        self.known: dict[int, float] = {}
        self.kinds: dict[int, int] = {}

    def _weight(self, token: str) -> float:
        best = 0.0
        for word in self.restorer.words(token):
            if word[:4] in self.starts:
                best = max(best, *(self.evidence.get(e, 0.0) for e in _evidence_of(word)))
            else:
                best = max(best, self.evidence.get(word, 0.0))
        return best

    def _weighty(self, group: str) -> list[str]:
        """The joined words of a group, as it stands in a text, that weigh anything."""
        cores = [core for core in map(_short, group.split()) if core]
        return [word for word in self.restorer.words_of(tuple(cores)) if self.weights[word]]

    @staticmethod
    def _looked_up(table: dict[int, Any], hashes: np.ndarray, work: Callable[[int], Any], kind: type) -> np.ndarray:
        """What ``work`` gives for the place of each hash, remembered by the hash; one slice's are held whatever their number."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        names = distinct.tolist()
        if len(table) + len(names) > HASHES:
            table.clear()
        out = list(map(table.get, names))
        for i, found in enumerate(out):
            if found is None:
                out[i] = table[names[i]] = work(int(first[i]))
        return np.array(out, dtype=kind)[back]

    def words(self, texts: list[str]) -> list[set[str]]:
        """The distinct tokens and joined words of each text that weigh anything."""
        tokens = Tokens(texts)
        text, owner = tokens.text, tokens.owner
        out: list[set[str]] = [set() for _ in texts]
        weights = self._looked_up(
            self.known, tokens.hashes, lambda i: self._weight(text[tokens.starts[i] : tokens.stops[i]]), float
        )
        for i in np.flatnonzero(weights).tolist():
            out[owner[i]].add(text[tokens.starts[i] : tokens.stops[i]])
        two, hashes = tokens.pairs()
        kinds = self._looked_up(
            self.kinds, hashes, lambda i: self.restorer.pair((tokens.core(two[i]), tokens.core(two[i] + 1))), int
        )
        for at in two[kinds & 1 == 1].tolist():
            out[tokens.core_owner[at]].update(self.restorer.known_from(tokens.line(at)))
        open_ = two[kinds & 2 == 2]  # groups: places in a row
        new = np.flatnonzero(np.diff(open_, prepend=-2) > 1)
        firsts, lasts = open_[new], open_[np.append(new[1:], len(open_)) - 1] + 1 if len(new) else open_
        begin, end = tokens.core_starts[firsts].tolist(), tokens.core_stops[lasts].tolist()
        for document, a, b in zip(tokens.core_owner[firsts].tolist(), begin, end, strict=True):
            found = self.weighty[text[a:b]]
            if found:
                out[document].update(found)
        return out

    def features(self, words: set[str]) -> tuple[float, float, float]:
        """The largest weight, the sum of the three largest, and how many words have any."""
        weights = sorted(filter(None, map(self.weights.__getitem__, words)), reverse=True)
        return (weights[0], sum(weights[:3]), float(np.log1p(len(weights)))) if weights else (0.0, 0.0, 0.0)

    def matrix(self, texts: pa.Array) -> np.ndarray:
        rows, some, size = [], [], 0
        for value in (*texts, None):
            text = value.as_py() if value is not None else None
            if some and (value is None or size + len(text or "") > SLICE):
                rows += map(self.features, self.words(some))
                some, size = [], 0
            some.append(text or "")
            size += len(text or "")
        return np.array(rows, dtype=float).reshape(-1, 3)


_scorers: dict[str, Scorer] = {}


def scorer_of(name: str, counts: dict[str, int], evidence: dict[str, float]) -> Scorer:
    """The scorer of this Python worker for the model of that name: what it remembers serves later tasks too."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(counts, evidence)
    return _scorers[name]


def fit(
    documents: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic", fit_rows: int = FIT_ROWS,
) -> ToxicityModel:
    """Character model from all documents; evidence and calibration from labelled rows where ``learn`` holds."""
    spark = documents.sparkSession
    counts = character_counts(documents, text)
    known = labels.where(learn).select(F.col(key), F.col(label).cast("int").alias(label))
    shares = {r[label]: r["n"] for r in known.groupBy(label).agg(F.countDistinct(key).alias("n")).collect()}
    shares = {c: shares.get(c, 0) for c in (0, 1)}
    if not (shares[0] and shares[1]):
        share = shares[1] / max(1, shares[0] + shares[1])
        return ToxicityModel(counts, {}, np.array([30 * (2 * share - 1), 0, 0, 0]))
    sample = labelled_sample(known, key, label, fit_rows).select(F.col(key).alias("_k"), F.col(label).alias("_y"))
    sample = sample.withColumn("_part", F.pmod(F.xxhash64(F.lit(9), "_k"), F.lit(2)))
    chosen = documents.join(F.broadcast(sample), F.col(key) == F.col("_k")).select(
        F.col("_y").cast("int").alias("y"), F.col(text).cast("string").alias("t"), "_part"
    )
    shared = spark.sparkContext.broadcast(counts)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            rows = [0, 0]
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for token in restorer.tokens(t or "") for w in restorer.words(token)}
                found[y].update({e for w in words for e in _evidence_of(w)})
                rows[y] += 1
            names = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["", *names], pa.string()), pa.array([rows[0], *(found[0][e] for e in names)], pa.int64()),
                    pa.array([rows[1], *(found[1][e] for e in names)], pa.int64()),
                ],
                names=["e", "clean", "toxic"],
            )

    counted = (
        chosen.where("_part = 0").select("y", "t").mapInArrow(collect, "e string, clean bigint, toxic bigint")
        .groupBy("e").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    n = counted.where("e = ''").first()
    if n is None or not (n["clean"] and n["toxic"]):
        return ToxicityModel(counts, {}, np.array([np.log(shares[1] / shares[0]), 0, 0, 0]))
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(toxic / (n["toxic"] + 1)) - F.log(clean / (n["clean"] + 1))
    sure = odds - 2 * F.sqrt(1 / toxic + 1 / clean)  # what is left of it two deviations down
    strong = counted.where("e <> '' AND toxic >= 4").withColumn("w", sure).where("w > 0.5")
    evidence = {r["e"]: r["w"] for r in strong.orderBy(F.desc("w"), "e").limit(EVIDENCE).collect()}
    told = spark.sparkContext.broadcast((counts, evidence))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*told.value)
        for batch in batches:
            x = scorer.matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], names=["y", "a", "b", "c"])

    points = chosen.where("_part = 1").select("y", "t").mapInArrow(measure, "y int, a double, b double, c double").toPandas()
    y, x = points["y"].to_numpy(dtype=float), points[["a", "b", "c"]].to_numpy()
    if len(set(y)) < 2:
        return ToxicityModel(counts, evidence, np.array([np.log(shares[1] / shares[0]), 0, 0, 0]))
    weights = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    weights *= len(y) / weights.sum()
    return ToxicityModel(counts, evidence, fit_logistic(x, y, weights, ridge=1e-2))


def score(
    documents: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``key``, ``score`` and ``predicted`` (1 from ``threshold`` on) for every row: a map over the rows."""
    rows = documents.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast((model.counts, model.evidence))
    beta, name = model.beta, uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, *shared.value)
        for batch in batches:
            p = logistic(beta, scorer.matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=[key, "score", "predicted"],
            )

    return rows.mapInArrow(work, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double, predicted int")


def toxicity_scores(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = 4, fold: int = 2
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row; labels of the fold are not learned from."""
    learn = F.col(key).isNotNull() & (remainder(F.col(key), divisor) != fold)
    model = fit(documents, labels, learn, key, text)
    held = F.coalesce(remainder(F.col(key), divisor) == fold, F.lit(False))
    return score(documents, model, key, text).withColumn("held_out", held).select(key, "held_out", "score", "predicted")
