"""Toxic documents: Levenshtein automata intersected with a lexicon trie, and context windows around what they catch.

1. The lexicon is learned from labelled rows: stems (word beginnings, whole words included) that mark toxic documents and hardly ever
   others; one that is no more one-sided than some of as many other terms would be by chance is none. Of nested stems the longest that loses no
   documents stays. A stem whose near words stand in clean documents too is
   caught exactly only.
2. One automaton walks the trie of all stems with up to one or two edits at once (its states are sets of trie nodes and edits, made
   deterministic as they are met, and as many held as a bounded memory takes). A word is caught exactly when it begins with a stem, or fuzzily when as a whole it is
   within the allowed edits of one: one from ``FUZZY_LETTERS`` letters on, two from twice as many minus two. A shorter stem allows
   one edit where no clean labelled document holds a word near it.
3. Every catch is scored in a window of words: inside quotation marks it counts as quotation, next to others or beside words of
   address as abuse. A logistic regression on such sums, fitted on labelled rows, gives the score.

The fit reads at most about ``sample_rows`` labelled rows, a documented bound; scoring reads every whole text. Labels,
language, source and id are no input of a score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, slices

SAMPLE_ROWS = 20_000
SHORTEST, LONGEST = 4, 12
FUZZY_LETTERS = 5
WINDOW = 12
CACHE_WORDS = 200_000
#: An automaton's states are forgotten, and made again as they are met, once they take about so many bytes; one takes STATE_BYTES besides its places.
MOST_STATES, STATE_BYTES = 48 << 20, 400
#: Of all terms in so many documents as a stem, fewer than this may be as one-sided by chance.
MOST_NOISE = 0.5
_WORD = re.compile(r"\w+")
#: Marks that open or close a quotation, and words of address in the languages at hand.
_QUOTES = re.compile("[\"“”„«»‹›]")
ADDRESS = frozenset("you your du dein ihr tu toi vous votre tú usted ustedes".split())
N_FEATURES = 6


class Automaton:
    """The trie of the stems under a Levenshtein automaton; ``catch`` tells 2 (begins with a stem), 1 (within the edits of one) or 0."""

    def __init__(self, stems: list[str], exact_only: frozenset[str] = frozenset(), loose: frozenset[str] = frozenset()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [0]  # the most edits of any stem below a node
        self.stem = [0]  # the edits a stem that ends here allows, plus one; 0: none ends here
        self.name = [""]
        for stem in stems:
            edits = 0 if stem in exact_only else (len(stem) >= FUZZY_LETTERS or stem in loose) + (len(stem) >= 2 * FUZZY_LETTERS - 2)
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.stem.append(0)
                    self.name.append("")
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.stem[node], self.name[node] = edits + 1, stem
        self.letters = {c for x in self.children for c in x}
        self._forget()

    def _forget(self) -> None:
        self.held = 0
        self.states: dict[bytes, int] = {}
        self.sets: list[bytes] = []  # four bytes a place: its node and, in the last two bits, the edits
        self.next: list[dict[str, int]] = []
        self.exact: list[bool] = []
        self.fuzzy: list[tuple[str, ...]] = []  # the stems that a whole word ending here is near to
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, cost: dict[int, int]) -> int:
        """The state with these least edits by node, after skipping letters of stems."""
        todo = sorted(cost.items(), key=lambda x: x[1])
        for node, edits in todo:
            if cost.get(node, 9) < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.allowed[child] and edits + 1 < cost.get(child, 9):
                    cost[child] = edits + 1
                    todo.append((child, edits + 1))
        key = array("I", sorted(node << 2 | edits for node, edits in cost.items())).tobytes()
        if key not in self.states:
            self.held += len(key) + STATE_BYTES
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.exact.append(any(e == 0 and self.stem[n] for n, e in cost.items()))
            self.fuzzy.append(tuple(sorted(self.name[n] for n, e in cost.items() if e < self.stem[n])))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        cost: dict[int, int] = {}
        for place in memoryview(self.sets[state]).cast("I"):
            node, edits = place >> 2, place & 3
            if edits + 1 <= self.allowed[node]:
                cost[node] = min(cost.get(node, 9), edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                e = edits + (letter != c)
                if e <= self.allowed[child]:
                    cost[child] = min(cost.get(child, 9), e)
        return self._state(cost)

    def near(self, word: str) -> tuple[str, ...]:
        """The stems that the whole word is within the edits of, if it begins with none."""
        state = self._walk(word)
        return () if state is None else self.fuzzy[state]

    def catch(self, word: str) -> int:
        state = self._walk(word)
        return 2 if state is None else int(bool(self.fuzzy[state]))

    def _walk(self, word: str) -> int | None:
        """The state behind a word; None: it begins with a stem."""
        if self.held > MOST_STATES:
            self._forget()
        state = self.start
        for c in word:
            if c not in self.letters:
                c = ""  # all other letters are alike
            following = self.next[state]
            after = following.get(c)
            if after is None:
                after = following[c] = self._step(state, c)
            state = after
            if state == self.dead:
                break
            if self.exact[state]:
                return None
        return state


class Reader:
    """Texts to features, with the verdicts on recent words kept (their number is bounded)."""

    def __init__(self, stems: list[str], exact_only: frozenset[str] = frozenset(), loose: frozenset[str] = frozenset()) -> None:
        self.automaton = Automaton(stems, exact_only, loose)
        self.caught: dict[str, int] = {}
        self.known: set[str] = set()

    def features(self, text: str) -> tuple[float, ...] | None:
        """None: nothing is caught."""
        low = text.lower()
        words = _WORD.findall(low)
        distinct = set(words)
        new = distinct - self.known
        if new:
            if len(self.known) > CACHE_WORDS:
                self.known, self.caught = set(), {}
                new = distinct
            for w in new:
                if hit := self.automaton.catch(w):
                    self.caught[w] = hit
            self.known |= new
        hits = distinct & self.caught.keys()
        if not hits:
            return None
        quotes = [m.start() for m in _QUOTES.finditer(low)]
        places, i, q = [], 0, 0
        for m in _WORD.finditer(low):
            w = m[0]
            if w in hits:
                while q < len(quotes) and quotes[q] < m.start():
                    q += 1
                # quoted: an odd number of marks stands before it, and the closing one is near
                quoted = q % 2 == 1 and q < len(quotes) and quotes[q] - m.start() < 12 * WINDOW
                addressed = not ADDRESS.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
                places.append((i, self.caught[w], quoted, addressed))
            i += 1
        caught = sum(not z for _, _, z, _ in places)
        fuzzy = sum(k == 1 and not z for _, k, z, _ in places)
        quoted = sum(z for _, _, z, _ in places)
        addressed = sum(a and not z for _, _, z, a in places)
        close = sum(b[0] - a[0] <= WINDOW for a, b in pairwise(x for x in places if not x[2]))
        return tuple(math.log1p(x) for x in (caught, fuzzy, quoted, addressed, close, 100 * caught / len(words)))


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns toxic, text: how many toxic and other documents of a slice have each stem."""
    for batch in slices(batches, 1, 4 << 20):
        counts = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(_WORD.findall((text or "").lower()))
            counts[toxic].update({w[:k] for w in found for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def _lexicon(rows: list, n_toxic: int, n_clean: int) -> list[str]:
    """Stems at least thirty times as frequent in toxic documents, the longest of those with the same documents; the most frequent first."""
    by = {r["term"]: (r["toxic"], r["clean"]) for r in rows}
    odds = lambda t: (by[t][0] / n_toxic) / ((by[t][1] + 0.5) / n_clean)
    pure = {t for t in by if odds(t) >= 30}
    children: dict[str, list[str]] = {}
    for t in pure:
        children.setdefault(t[:-1], []).append(t)
    chosen, todo = [], sorted(t for t in pure if t[:-1] not in pure)
    while todo:
        t = todo.pop()
        whole = next((c for c in children.get(t, ()) if by[c][0] >= 0.97 * by[t][0]), None)
        if whole:
            todo.append(whole)
        else:
            chosen.append(t)
    return sorted(chosen, key=lambda t: (-by[t][0], t))


def chance(toxic: int, clean: int, share: float) -> float:
    """The chance that of ``toxic + clean`` documents, each toxic with ``share``, at least ``toxic`` are."""
    n = toxic + clean
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(toxic, n + 1)]
    return min(1.0, sum(math.exp(x) for x in log))


def _short(stems: list[str]) -> frozenset[str]:
    return frozenset(s for s in stems if len(s) < FUZZY_LETTERS)


def _near(stems):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many toxic and other documents of a slice have a word near each stem."""
        automaton = Automaton(stems.value, loose=_short(stems.value))
        for batch in slices(batches, 1, 4 << 20):
            counts = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({s for w in set(_WORD.findall((text or "").lower())) for s in automaton.near(w)})
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])

    return run


def _read(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*model.value)
        for batch in slices(batches, 1):
            found = [reader.features(t) if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    return run


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's steps, classes weighted alike; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    penalty = np.full(x.shape[1], ridge / 10)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (share * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Stems and weights; no stems: nothing was learned and every score is 0."""

    def __init__(self, stems: list[str], exact_only: frozenset[str], weights: list[float], loose: frozenset[str] = frozenset()) -> None:
        self.stems, self.exact_only, self.weights, self.loose = stems, exact_only, weights, loose

    def reader(self) -> Reader:
        return Reader(self.stems, self.exact_only, self.loose)

    def score(self, features: tuple[float, ...] | None) -> float:
        if not self.stems:
            return 0.0
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, features or (), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns stems and weights from labelled rows that are not held out, about ``sample_rows`` of them at most (chosen by hash)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if n > sample_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(sample_rows / n * (1 << 30))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # labels: at most sample_rows small rows; copies of a text tell nothing more
    rows = texts.join(F.broadcast(labels), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    # a file for each core at most: the sample is bounded, and every file costs processes where Spark has no native code for permissions
    few = spark.sparkContext.defaultParallelism
    rows = scratch.write(rows.coalesce(few), "sample")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model([], frozenset(), [])
    least = max(3, size[1] // 200)
    terms = rows.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    terms = scratch.write(terms.coalesce(few), "terms")
    best = terms.where((F.col("toxic") >= least) & (F.col("toxic") / size[1] >= 30 * (F.col("clean") + 0.5) / size[0]))  # bounded by the sample
    alike = {r["n"]: r["terms"] for r in terms.groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("terms")).collect()}  # a row for each number of documents
    share = size[1] / (size[0] + size[1])
    stems = _lexicon([r for r in best.collect() if chance(r["toxic"], r["clean"], share) * alike[r["toxic"] + r["clean"]] < MOST_NOISE], size[1], size[0])
    if not stems:
        return Model([], frozenset(), [])
    near = rows.mapInArrow(_near(spark.sparkContext.broadcast(stems)), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    exact_only = frozenset(r["term"] for r in near if r["clean"] > max(1, size[0] // 5000) and r["toxic"] / size[1] < 30 * r["clean"] / size[0])
    loose = _short(stems) - {r["term"] for r in near if r["clean"]}
    found = rows.mapInArrow(_read(spark.sparkContext.broadcast((stems, exact_only, loose))), "toxic int, features array<double>").collect()
    x = np.array([r["features"] or [0.0] * N_FEATURES for r in found])
    return Model(stems, exact_only, fit_weights(x, np.array([r["toxic"] for r in found])).tolist(), loose)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.value.reader()
        for batch in slices(batches, 1):
            scores = [model.value.score(reader.features(t) if t else None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != 1), pa.array(scores, pa.float64())], [*(c for i, c in enumerate(batch.schema.names) if i != 1), "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from ``threshold`` on.

    Null and empty texts get the score of a text in which nothing is caught; very long texts are read whole. Null ids are not held out; rows that repeat stand for
    themselves; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they were, whatever their names. Each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in slices(batches, at):
            scores = [shared.value.score(reader.features(t) if t else None) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    at = docs.columns.index("text")
    return map_rows(docs, run, docs.schema)
