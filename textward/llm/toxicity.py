"""Toxicity by a fuzzy lexicon and the context of its hits.

Fit (on a bounded sample of labelled rows, ``FIT_TOXIC`` and ``FIT_CLEAN`` at most, taken by a hash of doc_id from
the rows that may be learned from; near copies count once):

* terms: whole words and word beginnings that toxic rows hold far more often than clean ones, the best of each
  chain of beginnings by its likelihood ratio;
* hit weights: log odds by term and edit distance; a distance that clean texts show as well is dropped;
* context: hits inside quotation marks or near a word of reporting weigh as much less as the sample shows;
* a logistic regression over the sums, its intercept moved to the labels' own rate of toxic rows.

Score: the terms form a trie; its product with the Levenshtein automaton of each term's allowed distance is made
deterministic state by state, as words ask for it. A word walks it once a worker, most die after a few letters.

Defined cases: a null or empty text gets the score of a text without hits; without toxic labels to learn from every
score is 0; of several labels for one doc_id the highest counts; rows with a null doc_id or label teach nothing;
repeated rows are scored row by row; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import bound_batches, materialise, texts, trim
from textward.llm.hashing import WordHash, shingles

#: Labelled rows that the fit may take, of each label, and bytes of their texts.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 3_000, 6_000, 128 << 20
#: A row is rejected from this score on.
THRESHOLD = 0.7
#: A term needs this many toxic rows (or share of them), and this ratio of rates.
SUPPORT, SUPPORT_SHARE, RATIO, TERMS = 6, 0.006, 10.0, 400
#: Letters of a word's beginning that can be a term.
SHORTEST, LONGEST = 4, 9
#: Words to either side of a hit that count as its context.
WINDOW = 8
#: Words that a worker remembers before it forgets them all.
REMEMBERED = 200_000

WORD = re.compile(r"[^\W\d_]+")
QUOTES = "\"“”„«»‘’‹›"
#: Words of reporting in the languages at hand.
REPORTING = frozenset("said says wrote writes quote quoted quoting called calling stated sagte schrieb zitat nannte dit écrit cité appelé dijo escribió cita llamó".split())

SCORES = "doc_id long, score double, predicted int, n_terms long, n_quoted long"


def allowed(term: str, whole: bool) -> int:
    """Edit distance at which a word still counts as the term, if the sample agrees."""
    n = len(term)
    return (0 if n < 5 else 1 if n < 9 else 2) if whole else (0 if n < 7 else 1)


class Automaton:
    """The trie of the terms times their Levenshtein automata, determinised lazily.

    A state is a set of (trie node, edits so far); its transitions are made when a letter first asks for them.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.most: list[int] = [0]
        self.whole: list[int] = [-1]
        self.start: list[int] = [-1]
        for t, (term, whole) in enumerate(terms):
            node, d = 0, allowed(term, whole)
            self.most[0] = max(self.most[0], d)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                    self.whole.append(-1)
                    self.start.append(-1)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], d)
            (self.whole if whole else self.start)[node] = t
        self.limit = [allowed(*t) for t in terms]
        self.states: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.now: list[tuple] = []
        self.end: list[tuple] = []
        self.first = self._state({(0, 0)})
        self.memo: dict[str, tuple] = {}

    def _state(self, places: set[tuple[int, int]]) -> int:
        todo = list(places)
        while todo:  # a letter of the term may be missing from the word
            node, e = todo.pop()
            for to in self.child[node].values():
                if e < self.most[to] and (to, e + 1) not in places:
                    places.add((to, e + 1))
                    todo.append((to, e + 1))
        least: dict[int, int] = {}
        for node, e in places:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.next)
            self.next.append({})
            self.sets.append(key)
            self.now.append(tuple((t, e) for node, e in key if (t := self.start[node]) >= 0 and e <= self.limit[t]))
            self.end.append(tuple((t, e) for node, e in key if (t := self.whole[node]) >= 0 and e <= self.limit[t]))
        return found

    def _step(self, state: int, c: str) -> int:
        places = set()
        for node, e in self.sets[state]:
            if e < self.most[node]:
                places.add((node, e + 1))
            for letter, to in self.child[node].items():
                if letter == c:
                    places.add((to, e))
                elif e < self.most[to]:
                    places.add((to, e + 1))
        found = self.next[state][c] = self._state(places) if places else -1
        return found

    def __call__(self, word: str) -> tuple:
        """(term, least distance) of each term that the word, or for beginnings a beginning of it, is near."""
        found = self.memo.get(word)
        if found is not None:
            return found
        state, best = self.first, {}
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            for t, e in self.now[state]:
                best[t] = min(e, best.get(t, e))
        if state >= 0:
            for t, e in self.end[state]:
                best[t] = min(e, best.get(t, e))
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        found = self.memo[word] = tuple(best.items())
        return found


@dataclass
class Model:
    """What the fit learned. ``weight`` is by term and distance."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weight: dict[tuple[int, int], float] = field(default_factory=dict)
    quoted: float = 0.5
    coefficients: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)
    _automaton: Automaton | None = field(default=None, repr=False)

    def fresh(self) -> Model:
        """The same model with an automaton of its own, whose memory goes with the task that made it."""
        return replace(self, _automaton=None)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def hits(self, text: str | None) -> list[tuple[int, int, bool]]:
        """(term, distance, quoted) of each hit of a text."""
        if self._automaton is None:
            self._automaton = Automaton(self.terms)
        find, text = self._automaton, (text or "").lower()
        words = WORD.findall(text)
        get, out = find.memo.get, []
        found = [(k, h) for k, w in enumerate(words) if (h := find(w) if (h := get(w)) is None else h)]
        if not found:
            return out
        spans = None
        marked = any(q in text for q in QUOTES)
        for k, hs in found:
            usable = [(self.weight.get((t, e), 0.0), t, e) for t, e in hs]
            w, t, e = max(usable)
            if w <= 0 and self.weight:
                continue
            near = words[max(0, k - WINDOW) : k + WINDOW + 1]
            quoted = not REPORTING.isdisjoint(near)
            if marked and not quoted:
                if spans is None:
                    spans = [m.span() for m in WORD.finditer(text)]
                begin = spans[max(0, k - WINDOW)][0]
                end = spans[min(len(spans) - 1, k + WINDOW)][1]
                before, after = text[begin : spans[k][0]], text[spans[k][1] : end]
                quoted = sum(map(before.count, QUOTES)) % 2 == 1 and any(q in after for q in QUOTES)
            out.append((t, e, quoted))
        return out

    def features(self, hits: list[tuple[int, int, bool]]) -> tuple[float, float, float]:
        """Weights of the distinct terms; of all hits, damped; hits, damped. Quoted hits weigh less."""
        best: dict[int, float] = {}
        total = count = 0.0
        for t, e, quoted in hits:
            m = self.quoted if quoted else 1.0
            w = self.weight.get((t, e), 0.0) * m
            best[t] = max(w, best.get(t, 0.0))
            total += w
            count += m
        return min(30.0, sum(best.values())), math.log1p(total), min(4.0, count)

    def score(self, text: str | None) -> tuple[float, int, int]:
        hits = self.hits(text) if self.terms else []
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.features(hits), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), len(hits), sum(q for _, _, q in hits)


def _candidates(words: set[str]) -> set[str]:
    out = {w + "$" for w in words}
    for w in words:
        out.update(w[:k] for k in range(SHORTEST, min(len(w) - 1, LONGEST) + 1))
    return out


def _llr(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of a term in a of n toxic and b of m clean rows."""
    x = lambda k, t: k * math.log(k / t) if k else 0.0
    p = (a + b) / (n + m)
    return 2 * (x(a, n) + x(n - a, n) + x(b, m) + x(m - b, m) - (a + b) * math.log(p) - ((n + m - a - b) * math.log(1 - p) if p < 1 else 0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    keep = np.eye(len(b)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p) + 1e-9) @ x + keep, x.T @ (y - p) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_texts(toxic: list[str], clean: list[str], rate: float) -> Model:
    """A model from texts of both labels; ``rate`` is the share of toxic rows among the labels."""
    memo = WordHash()

    def once(rows: list[str]) -> list[str]:
        seen: dict[int, str] = {}
        for k, t in enumerate(rows):
            s = shingles(t, memo)
            seen.setdefault(int(s.min()) if len(s) else -k - 1, t)
        return list(seen.values())

    toxic, clean = once(toxic), once(clean)
    if not toxic or not clean:
        return Model()
    n, m = len(toxic), len(clean)
    has = Counter()
    for t in toxic:
        has.update(_candidates(set(WORD.findall(t.lower()))))
    least = max(min(SUPPORT, max(2, n // 4)), SUPPORT_SHARE * n)
    has = {c: k for c, k in has.items() if k >= least}
    lacks = Counter()
    for t in clean:
        lacks.update(_candidates(set(WORD.findall(t.lower()))) & has.keys())
    ranked = sorted((-round(_llr(k, n, lacks[c], m), 6), -len(c), c) for c, k in has.items() if (k + 0.5) / (n + 1) >= RATIO * (lacks[c] + 0.5) / (m + 1))
    chosen: list[str] = []
    for _, _, c in ranked:  # of equals the longest: a whole word rather than its beginning
        bare = c.rstrip("$")
        if len(chosen) < TERMS and not any(bare.startswith(o.rstrip("$")) and not o.endswith("$") or o.rstrip("$").startswith(bare) and not c.endswith("$") or o == c for o in chosen):
            chosen.append(c)
    model = Model([(c.rstrip("$"), c.endswith("$")) for c in chosen])
    tox_hits, clean_hits = [model.hits(t) for t in toxic], [model.hits(t) for t in clean]
    a, b = Counter(), Counter()
    for count, rows in ((a, tox_hits), (b, clean_hits)):
        for hits in rows:
            count.update({(t, e) for t, e, _ in hits})
    for t, (term, whole) in enumerate(model.terms):
        for e in range(allowed(term, whole) + 1):
            odds = math.log((a[t, e] + 0.5) / (n + 1)) - math.log((b[t, e] + 0.5) / (m + 1))
            if a[t, e] + b[t, e] == 0:  # the sample is silent: a misspelled word counts half, a beginning doesn't
                odds = 0.5 * model.weight.get((t, 0), 0.0) if whole else 0.0
            elif e and (b[t, e] > 0 and odds < math.log(RATIO)):
                odds = 0.0
            model.weight[t, e] = max(0.0, odds)
    quotes = Counter((label, q) for label, rows in ((1, tox_hits), (0, clean_hits)) for hits in rows for _, _, q in hits)
    share = lambda q: (quotes[1, q] + 1) / (quotes[1, q] + quotes[0, q] + 2)
    model.quoted = min(1.0, max(0.1, share(True) / share(False)))
    x = np.array([model.features(h) for rows in ([model.hits(t) for t in toxic], [model.hits(t) for t in clean]) for h in rows])
    y = np.concatenate([np.ones(n), np.zeros(m)])
    beta = _logistic(x, y)
    rate = min(0.99, max(0.001, rate))
    beta[0] += math.log(rate / (1 - rate)) - math.log(n / m)
    model.coefficients = tuple(map(float, beta))
    model._automaton = None
    return model


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 3 isn't 1.

    Only ids are sorted to choose the sample; the texts of at most ``fit_toxic + fit_clean`` rows, and ``fit_bytes`` of
    them in that order, reach the driver.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    sample = rows.where("toxic > 0").orderBy(order, "doc_id").limit(fit_toxic).unionByName(rows.where("toxic <= 0").orderBy(order, "doc_id").limit(fit_clean))
    found = texts(docs).join(F.broadcast(sample), "doc_id").withColumn("order", order)
    # repeated rows of a doc_id could be many: one of each counts
    held = materialise(found.groupBy("doc_id", "order", "toxic").agg(F.min("text").alias("text")), "labelled")
    before = W.orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    sizes = held.select("doc_id", "order", F.octet_length("text").cast("long").alias("size")).coalesce(1)
    ids = sizes.withColumn("sum", F.sum("size").over(before)).where(F.col("sum") <= fit_bytes).select("doc_id")
    got = held.join(F.broadcast(ids), "doc_id", "left_semi").select("toxic", "text").collect()
    total = sum(counts.values())
    return fit_texts([r["text"] for r in got if r["toxic"] > 0], [r["text"] for r in got if r["toxic"] <= 0], counts.get(True, 0) / total if total else 0.0)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_terms (hits), n_quoted of every whole text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.fresh()
        for batch in batches:
            rows = [own.score(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([r[0] for r in rows], pa.float64()), pa.array([int(r[0] >= threshold) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=["doc_id", "score", "predicted", "n_terms", "n_quoted"])
        del own
        trim()

    return texts(docs).mapInArrow(run, SCORES)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay. No join: each row is judged by its own text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.fresh()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t)[0] < threshold for t in batch.column("text").to_pylist()], pa.bool_()))
        del own
        trim()

    return docs.mapInArrow(run, docs.schema)
