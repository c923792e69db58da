"""Toxicity by a learned lexicon that is matched with errors, in context.

1. Lexicon.  Of the labelled training documents each word's toxic and clean documents are counted.  Words whose
   toxic share is too high for chance (binomial tail, false discovery rate ``FALSE_TERMS`` over all words
   counted) are the terms; a term's evidence is its smoothed log ratio of the two shares.
2. Matching.  The terms form a trie.  The Levenshtein automata of all terms, intersected with the trie, run over
   a text's words as one automaton: a state is the set of (trie node, errors so far), made when it is first
   reached.  Most words leave it within a few characters; the others are the terms themselves or
   misspellings (one edit from 5 characters on, two from 9).  A word that is no term but known from clean
   documents is no misspelling, and where clean documents hold many new words near a term, new ones say little.
3. Context.  Around every match a window of ``WINDOW`` words to both sides, and the quotation marks of its
   line, give a score from 0 (quoted or spoken about) to 1 (used on someone).  A match's evidence
   counts by that score.  The scores' constants are set, not learned.
4. Score.  Logistic regression over the sums of evidence, in all, by share of words and by term.  Training
   documents are seen without their own count in the lexicon, as any new document is.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the smallest digests of their ids; this bound
is a parameter.  Rows whose id's crc32 leaves 0 by ``FOLDS`` are never trained on.  Scoring covers whole texts of
all documents.

Defined results: null and empty texts and texts without a match get the score of a text without evidence; without
labels of both kinds the lexicon is empty and every score is the share of toxic labels, smoothed towards a quarter;
labels other than 0 and 1, and ids labelled both ways, are not used; a null id is never held out; very long texts are
read whole and very long words match nothing; repeated rows and rows that share an id are scored one by one; an empty
table gives an empty result; columns other than doc_id, text and toxic are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidycell.llm.common import stage

SAMPLE = 20_000
FOLDS = 5
FALSE_TERMS = 0.01
WINDOW = 8
#: Automaton states and words that a task remembers; beyond it forgets them and starts anew.
REMEMBERED = 200_000

_INNER = r"\s\"“”„«»,;:.!?()\[\]|/"
WORD = re.compile(rf"[^\W_](?:[^{_INNER}]*[^\W_])?")
QUOTES = re.compile(r"[\"“”„«»\n]")
# Words that report speech, and words that address someone, in the languages of the documents.
REPORTING = frozenset("said says say called calls wrote writes quoted quote quoting word words term terms termed insult slur sagte sagt schrieb nannte zitierte wort wörter"
                      " zitat dijo dice llamó escribió palabra palabras cita dit disait appelé écrit écrivit mot mots citation".split())
ADDRESS = frozenset("you your yours yourself ur u du dich dir dein deine deinen ihr euch tú tu ti te eres vosotros ustedes usted vous toi ton ta tes votre es".split())


def allowed(length: int) -> int:
    """Edits that a word may be away from a term of so many characters."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie and made deterministic on the way."""

    def __init__(self, terms: list[str]):
        self.terms, self.longest = terms, max((len(t) + allowed(len(t)) for t in terms), default=0)
        self.children: list[dict[str, int]] = [{}]
        self.term = [-1]
        self.limit = [0]  # the most edits that a term below the node allows
        for k, t in enumerate(terms):
            node = 0
            for c in t:
                self.limit[node] = max(self.limit[node], allowed(len(t)))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.limit.append(0)
                node = self.children[node][c]
            self.limit[node] = max(self.limit[node], allowed(len(t)))
            self.term[node] = k
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.known: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state; its nodes are closed under leaving out characters of a term."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            if e <= self.limit[node]:
                for child in self.children[node].values():
                    if e <= self.limit[child] and e < nodes.get(child, 99):
                        nodes[child] = e
                        todo.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= allowed(len(self.terms[self.term[n]]))]
            self.accepts.append(min(ends) if ends else None)
        return self.number[key]

    def _step(self, state: int, char: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.limit[node] and e < nodes.get(node, 99):
                nodes[node] = e

        for node, e in self.states[state]:
            for c, child in self.children[node].items():
                put(child, e + (c != char))
            put(node, e + 1)
        to = self.steps[state][char] = self._state(nodes) if nodes else -1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term within its limit; of equally near ones the first."""
        if len(word) > self.longest:
            return None
        if word in self.known:
            return self.known[word]
        if len(self.states) > REMEMBERED or len(self.known) > REMEMBERED:
            self._forget()
        at = self.start
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                break
        found = self.known[word] = self.accepts[at] if at >= 0 else None
        return found


def abuse(text: str, words: list[re.Match], k: int) -> float:
    """How far the k-th word is used on someone, rather than quoted or spoken about: 0 to 1."""
    m = words[k]
    before = after = None
    for q in QUOTES.finditer(text, max(0, m.start() - 400), m.start()):
        before = q.group()
    q = QUOTES.search(text, m.end(), m.end() + 400)
    after = q.group() if q else None
    quoted = before not in (None, "\n", "”", "»") and after not in (None, "\n", "“", "„", "«")
    near = [w.group() for w in words[max(0, k - WINDOW) : k + WINDOW + 1]]
    reported = any(w in REPORTING for w in near[: WINDOW + 1])
    addressed = any(w in ADDRESS for w in near)
    return 1 / (1 + math.exp(-(2.0 - 3.0 * quoted - 2.0 * reported + 1.0 * addressed)))


#: Evidence in all, by share of words, and that of different terms.
FEATURES = 3


@dataclass
class Model:
    """Terms with their toxic and clean documents; words near a term with their clean documents; by term the documents
    whose near word no (other) clean document has; and the regression."""

    terms: list[str]
    toxic: list[int]
    clean: list[int]
    n_toxic: int
    n_clean: int
    near: dict[str, int] = field(default_factory=dict)
    near_toxic: list[int] = field(default_factory=list)
    near_clean: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0
    _automaton: Automaton | None = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}  # tasks build their own

    @property
    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = Automaton(self.terms)
        return self._automaton

    def evidence(self, term: int, edits: int, own: int | None = None) -> float:
        """Of a term: log ratio of the shares of toxic and clean documents with it.  Of a misspelling: the log odds of new
        words near the term, to which the term itself adds one document of its kind, against those of all documents.
        ``own`` is the label of a training document whose count is left out."""
        t, c = self.toxic[term], self.clean[term]
        if not edits:
            return max(0.0, math.log((t - (own == 1) + 0.5) / (self.n_toxic + 1)) - math.log((c - (own == 0) + 0.5) / (self.n_clean + 1)))
        share = (t + 0.5) / (t + c + 1)
        near_t, near_c = self.near_toxic[term] - (own == 1), self.near_clean[term] - (own == 0)
        odds = (max(0, near_t) + share) / (max(0, near_c) + 1 - share)
        return max(0.0, math.log(odds) - math.log((self.n_toxic + 0.5) / (self.n_clean + 0.5)))

    def features(self, text: str | None, own: int | None = None) -> list[float]:
        text = (text or "").lower()
        find = self.automaton.match
        hits = {}
        for w in set(WORD.findall(text)):
            found = find(w)
            if found and (not found[0] or self.near.get(w, 0) - (own == 0) <= 0):
                hits[w] = found
        if not hits:
            return [0.0] * FEATURES
        words = list(WORD.finditer(text))
        total, most = 0.0, {}
        for k, m in enumerate(words):
            found = hits.get(m.group())
            if not found:
                continue
            edits, term = found
            e = self.evidence(term, edits, own)
            used = abuse(text, words, k)
            total += e * used
            most[term] = max(e * used, most.get(term, 0.0))
        return [math.log1p(total), math.log1p(100 * total / len(words)), math.log1p(sum(most.values()))]

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _tail(t: int, n: int, p: float) -> float:
    """Probability of t or more hits of n at rate p."""
    if p <= 0 or p >= 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(t, n + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def choose(counted: list[tuple[str, int, int]], n_toxic: int, n_clean: int, tested: int) -> list[tuple[str, int, int]]:
    """The terms among (word, toxic, clean) at the false discovery rate, ``tested`` words having been counted."""
    rate = n_toxic / max(1, n_toxic + n_clean)
    ranked = sorted((_tail(t, t + c, rate), w, t, c) for w, t, c in counted)
    last = max((k for k, (p, *_) in enumerate(ranked, 1) if p <= FALSE_TERMS * k / max(1, tested)), default=0)
    return sorted((w, t, c) for _, w, t, c in ranked[:last])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression, by Newton steps.  Weights are drawn to 0 and the bias to a quarter of
    toxic ones; abuse never speaks against toxicity: a feature with a negative weight is left out, the most negative first."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0) if len(x) else np.ones(x.shape[1])
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([x[:, used] / scale[used], np.ones(len(x))])
        prior = np.zeros(z.shape[1])
        prior[-1] = -math.log(3)
        w = prior.copy()
        pull = np.full(z.shape[1], ridge)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * (w - prior))
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        if not used.any() or w[:-1].min() >= 0:
            weights = np.zeros(x.shape[1])
            weights[used] = w[:-1] / scale[used]
            return weights.tolist(), float(w[-1])
        used[np.flatnonzero(used)[w[:-1].argmin()]] = False


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            seen[label].update(set(WORD.findall((text or "").lower())))
        words = [*(seen[0] | seen[1])]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([s[w] for w in words], pa.int64()) for s in (seen[1], seen[0]))], names=["word", "toxic", "clean"])


def _near(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model.automaton.match
        for batch in batches:
            found = [find(w) for w in batch.column(0).to_pylist()]
            near = pa.array([bool(f and f[0]) for f in found], pa.bool_())
            term = pa.array([f[1] if f else -1 for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, term], names=[*batch.schema.names, "term"]).filter(near)

    return run


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(text, label) for text, label in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit a model to the labelled documents outside the held-out fold."""
    rows = labels.where("toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most"))
    rows = rows.where("toxic = __most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # At most ``sample`` rows of an id and a label are broadcast.
    seen = stage(docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(rows), "doc_id").select("text", "toxic"), "toxicity-sample")
    size = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    counts = stage(seen.mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-words")
    tested = counts.where("toxic + clean >= 3").count()
    likely = counts.where((F.col("toxic") >= 3) & (F.col("toxic") * F.lit(n_clean + 1) >= 3 * F.col("clean") * F.lit(n_toxic + 1)))
    terms = choose([(r.word, r.toxic, r.clean) for r in likely.collect()], n_toxic, n_clean, tested)
    model = Model([w for w, _, _ in terms], [t for _, t, _ in terms], [c for _, _, c in terms], n_toxic, n_clean)
    model.near_toxic, model.near_clean = [0] * len(terms), [0] * len(terms)
    # Words like a term: at most as many as the sample's texts hold.
    for r in counts.mapInArrow(_near(model), "word string, toxic long, clean long, term long").collect():
        if r.clean:
            model.near[r.word] = r.clean
        model.near_toxic[r.term] += r.toxic * (r.clean == 0)
        model.near_clean[r.term] += r.clean == 1
    found = seen.mapInArrow(_features(model), "toxic int, x array<double>").collect()
    x = np.array([r.x for r in found], float).reshape(-1, FEATURES)
    order = np.lexsort([*x.T, [r.toxic for r in found]])  # sums do not depend on the order of arrival
    model.weights, model.bias = fit(x[order], np.array([r.toxic for r in found], float)[order])
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, from its text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(_scores(model), f"doc_id {kind}, score double")
