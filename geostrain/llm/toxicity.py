"""Operator 10: toxicity by a lexicon, its misspellings and their context.

The lexicon is learned: words that labelled toxic texts have far more often
than clean ones.  It becomes a trie, and the trie's intersection with a
Levenshtein automaton becomes one table-driven automaton, made as far as words
reach it, over which all words of many texts run at once.  A term whose neighbourhood meets ordinary words of
clean training texts takes no misspelling.  A term found counts by its context
window: other terms near it speak for abuse, quotation marks around it for a
mention.  A logistic regression on these counts gives the score.

Training reads about ``TRAIN_ROWS`` labelled texts at most, by a hash of their
ids.  Equal texts count once in it.  Every word that is in ``LEAST_SHARE`` of the
toxic ones and ``LEAST_LIFT`` times likelier there is a term, so the lexicon has
1 / ``LEAST_SHARE`` times the words of a text at most, whatever the corpus.

Defined results: null and empty texts have the score of a text without terms;
without labelled rows, or with one label only, every score is the base rate;
rows with two labels use the larger; of terms at one distance the heavier one
counts, then the first by name; texts of any length are read whole; equal rows
have equal scores; an empty table gives an empty result; further columns are
ignored whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, trimmed

#: Labelled texts that training reads, about, at most.
TRAIN_ROWS = 20_000
#: A term is in this share of toxic texts at least, and so many times likelier there.
LEAST_SHARE, LEAST_LIFT = 0.01, 25.0
#: Share of clean training texts in which misspellings of a term may be found.
LOOSE = 0.001
#: A misspelt term's weight beside that of the term itself.
MISSPELT = 0.8
#: Words on either side that count as context.
WINDOW = 12
#: States of the automaton kept between slices of texts.
MAX_STATES = 50_000
_WORD_SQL = r"[^\p{L}\p{N}]+"
_JOINERS = "*@$!#"


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automata of all terms, merged over their trie.

    A state is a set of (trie node, edits spent).  States and steps are made when
    a word first takes them, so building is linear in the terms' letters and
    memory follows what texts reach; beyond ``MAX_STATES`` all are forgotten and
    made anew, which changes no result.  ``table[state, class]`` is the next
    state, 0 the dead one, -1 not yet made; ``edits`` is the least distance at
    which a state accepts, or -1; ``weight`` is that of the term accepted so and
    ``term`` its number.  They hold for the states that the last ``run`` returned.
    """

    def __init__(self, terms: dict[str, float], rigid: frozenset[str] = frozenset()):
        self.terms = sorted(terms)
        self.weight_of = [terms[t] for t in self.terms]
        self.allowed = [0 if t in rigid else edits_allowed(t) for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.term_at = [-1]
        self.reach = [0]  # edits that some term below allows
        for i, term in enumerate(self.terms):
            node, allowed = 0, self.allowed[i]
            for c in term:
                self.reach[node] = max(self.reach[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
            self.reach[node] = max(self.reach[node], allowed)
            self.term_at[node] = i
        self.alphabet = [None, *sorted({c for term in terms for c in term})]  # class 0: any other character
        self.classes = np.zeros(0x110000, np.uint8 if len(self.alphabet) < 256 else np.uint16)
        for i, c in enumerate(self.alphabet[1:], 1):
            self.classes[ord(c)] = i
        self._forget()

    @classmethod
    def build(cls, terms: dict[str, float], rigid: frozenset[str] = frozenset()) -> Automaton:
        """``rigid`` terms take no edits; ``term`` numbers the sorted terms."""
        return cls(terms, rigid)

    def _forget(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.table = np.full((256, len(self.alphabet)), -1, np.int32)
        self.edits, self.weight, self.term = np.full(256, -1, np.int8), np.zeros(256), np.zeros(256, np.int32)
        self._state(frozenset())
        self.table[0] = 0
        self._state(self._closed({0: 0}))

    def _closed(self, items: dict[int, int]) -> frozenset[tuple[int, int]]:
        todo = list(items.items())
        while todo:
            node, e = todo.pop()
            if items.get(node, 99) < e:
                continue
            for child in self.children[node].values():  # a missing character
                if e + 1 <= self.reach[child] and e + 1 < items.get(child, 99):
                    items[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(items.items())

    def _state(self, state: frozenset) -> int:
        if state in self.number:
            return self.number[state]
        i = self.number[state] = len(self.states)
        self.states.append(state)
        if i == len(self.table):
            self.table = np.vstack([self.table, np.full_like(self.table, -1)])
            self.edits, self.weight, self.term = np.r_[self.edits, np.full_like(self.edits, -1)], np.r_[self.weight, self.weight * 0], np.r_[self.term, self.term * 0]
        found = [(e, -self.weight_of[t], t) for node, e in state if (t := self.term_at[node]) >= 0 and e <= self.allowed[t]]
        if found:
            e, w, t = min(found)
            self.edits[i], self.weight[i], self.term[i] = e, -w, t
        return i

    def _step(self, state: int, k: int) -> None:
        c = self.alphabet[k]
        items: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.reach[node] and e + 1 < items.get(node, 99):  # an extra character
                items[node] = e + 1
            for x, child in self.children[node].items():
                cost = e + (x != c)
                if cost <= self.reach[child] and cost < items.get(child, 99):
                    items[child] = cost
        to = self._state(self._closed(items))  # may give the table a larger array
        self.table[state, k] = to

    def run(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Last state of each word; ``edits`` there is -1 where no term is near."""
        if len(self.states) > MAX_STATES:
            self._forget()
        states = np.zeros(len(start), np.int32)
        alive = np.arange(len(start))
        state, place = np.ones(len(start), np.int32), start.copy()
        while len(alive):
            code = self.classes[points[place]]
            to = self.table[state, code]
            new = np.unique(state[to < 0].astype(np.int64) * len(self.alphabet) + code[to < 0])
            for pair in new.tolist():
                self._step(*divmod(pair, len(self.alphabet)))
            state = self.table[state, code] if len(new) else to
            place += 1
            over = place >= end[alive]
            states[alive[over]] = state[over]
            on = ~over & (state > 0)
            alive, state, place = alive[on], state[on], place[on]
        return states


@dataclass
class Model:
    base: float
    automaton: Automaton | None = None
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.automaton is None:
            return np.full(len(features), self.base)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(features)), features] @ self.beta, -30, 30)))


N_FEATURES = 4


class Hits:
    """The words of some texts that are terms or near one."""

    def __init__(self, automaton: Automaton, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        self.at = np.r_[0, np.cumsum([len(t) + 1 for t in lowered])]
        self.points = points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = _word_points()[points]
        if len(points) > 2:
            joiner = np.isin(points, [ord(c) for c in _JOINERS])
            known[1:-1] |= joiner[1:-1] & known[:-2] & known[2:]
        edge = np.diff(np.r_[False, known, False].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        states = automaton.run(points, start, end)
        self.n_words = np.diff(np.searchsorted(start, self.at))
        self.word = np.flatnonzero(automaton.edits[states] >= 0)
        self.start, self.end, states = start[self.word], end[self.word], states[self.word]
        self.exact, self.weight, self.term = automaton.edits[states] == 0, automaton.weight[states], automaton.term[states]
        self.text = np.searchsorted(self.at, self.start, "right") - 1

    def quoted(self) -> np.ndarray:
        """Hits between quotation marks of their line."""
        points = self.points
        straight = np.r_[0, np.cumsum(points == 0x22)]
        opened = np.r_[0, np.cumsum(np.isin(points, (0xAB, 0x201C, 0x201E)).astype(int) - np.isin(points, (0xBB, 0x201D)))]
        breaks = np.r_[-1, np.flatnonzero(points == 0x0A), len(points)]
        line = np.searchsorted(breaks, self.start) - 1
        first, stop = breaks[line] + 1, breaks[line + 1]
        inside = ((straight[self.start] - straight[first]) % 2 == 1) & (straight[stop] > straight[self.end])
        return inside | (opened[self.start] > opened[first])


def features(automaton: Automaton, texts: list[str | None]) -> np.ndarray:
    """Weights of terms by context for each text."""
    n = len(texts)
    hits = Hits(automaton, texts)
    out = np.zeros((n, N_FEATURES))
    if len(hits.word):
        quoted = hits.quoted()
        weight = hits.weight * np.where(hits.exact, 1.0, MISSPELT)
        near = np.zeros(len(weight), bool)
        close = (np.diff(hits.word) <= WINDOW) & (np.diff(hits.text) == 0)
        near[1:] |= close
        near[:-1] |= close
        for k, chosen in enumerate((~quoted, quoted, near & ~quoted)):
            out[:, k] = np.log1p(np.bincount(hits.text[chosen], weight[chosen], n))
        out[:, 3] = np.minimum(1.0, 20 * np.bincount(hits.text[~quoted], minlength=n) / np.maximum(hits.n_words, 1))
    return out


_KNOWN: list[np.ndarray] = []


def _word_points() -> np.ndarray:
    if not _KNOWN:
        table = np.zeros(0x110000, bool)
        table[: 1 << 16] = [chr(c).isalnum() for c in range(1 << 16)]
        table[1 << 16 :] = True
        _KNOWN.append(table)
    return _KNOWN[0]


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    share = rows / max(n, 1)
    taken = labels.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_003)) / 1_000_003 < share)
    # about ``rows`` rows of two numbers, whatever the size of the input: a proven bound for the broadcast
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(taken), F.col("doc_id") == F.col("id")).where("text is not null")
    words = F.array_distinct(F.split(F.lower("text"), _WORD_SQL))
    once = joined.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    total = once.agg(F.count("*"), F.sum("toxic")).first()
    n_all, n_toxic = total[0], total[1] or 0
    base = n_toxic / n_all if n_all else 0.0
    if not 0 < n_toxic < n_all:
        return Model(base)
    counted = once.select("toxic", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    lift = (F.col("a") / n_toxic) / ((F.col("n") - F.col("a") + 0.5) / (n_all - n_toxic + 1))
    least = max(3.0, LEAST_SHARE * n_toxic)
    terms = counted.where((F.col("a") >= least) & (lift >= LEAST_LIFT)).select("word", F.log(lift).alias("weight")).collect()
    if not terms:
        return Model(base)
    top = max(t["weight"] for t in terms)
    weights = {t["word"]: t["weight"] / top for t in terms}
    wide = docs.sparkSession.sparkContext.broadcast(Automaton.build(weights))

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(weights), np.int64)
        for batch in pieces(batches):
            hits = Hits(wide.value, batch.column(1).to_pylist())
            loose = np.unique(np.stack([hits.text, hits.term], 1)[~hits.exact], axis=0)
            found += np.bincount(loose[:, 1], minlength=len(weights))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "n"])

    loose = once.where("toxic = 0").select("toxic", "text").mapInArrow(trimmed(misspelt), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > max(1.0, LOOSE * (n_all - n_toxic))).collect()
    names = sorted(weights)
    automaton = Automaton.build(weights, frozenset(names[r["term"]] for r in loose))
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(features(sent.value, batch.column(1).to_pylist()).tolist(), pa.list_(pa.float64())), batch.column(0)], ["x", "toxic"])

    seen = once.select("toxic", "text").mapInArrow(trimmed(counts), "x array<double>, toxic int").toPandas()
    x, y = np.array(seen["x"].tolist()), seen["toxic"].to_numpy(float)
    return Model(base, automaton, _regression(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every text; a map without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            x = features(model.automaton, texts) if model.automaton else np.zeros((len(texts), N_FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(scored), "doc_id long, score double, predicted int")
