"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, takes off marks, maps look-alike letters and digit substitutions to one form
and turns everything but letters into one space. The lexicon holds beginnings of words: candidates
are counted in labelled documents, a beginning is lengthened while nearly all its toxic documents
agree on the next letters, and its weight is the smoothed log-odds of toxic against clean documents.
Exception phrases (a match with its next word) that clean documents use are not counted. The sum of
weights, plain and per word, gives the score by a logistic curve fitted to the same documents.

Labels are read from a bounded sample of labelled rows outside the held-out fold. The score uses
the text alone.

Defined cases: null and empty texts score as texts without a match; without toxic training rows the
lexicon is empty and every text gets the share of toxic labels, or 0; repeated labels of a document
count as toxic if one is; repeated rows are scored one by one; empty tables give no rows; only
``doc_id``, ``text`` and the label columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import map_rows, texts_of, tidy

#: Bounded sample of labelled documents, bounds of the lexicon, least share of toxic documents of a term.
MAX_LABELLED, MAX_TERMS, LEAST_SHARE = 20_000, 3000, 0.003
SHORTEST, LONGEST = 4, 12
_FOLDED = "abcdefghijkmnopqrstuvwxyzß"
THRESHOLD = 0.7

#: Look-alike letters after lower-casing, and digits and signs used as letters; fixed values.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b",
    "н": "h", "г": "r", "и": "u", "п": "n", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ɡ": "g", "ı": "i", "ø": "o",
    "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    # i, l, 1, ! and | share one form
    "l": "i", "1": "i", "!": "i", "|": "i",
}
_TABLE = {ord(a): b for a, b in LOOK_ALIKE.items()}
#: The same with a space for everything but letters, for texts of ASCII alone.
_ASCII = b"".join((LOOK_ALIKE.get(c) or (c if c.isalpha() else " ")).encode() for c in map(chr, range(128))) + b" " * 128
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MARKS = re.compile(r"[̀-ͯ]+")


def fold(text: str) -> str:
    """Folded words of a text, a space before and after each."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    if low.isascii():
        return f" {b' '.join(low.encode().translate(_ASCII).split()).decode()} "
    return f" {_NOT_LETTERS.sub(' ', low.translate(_TABLE)).strip()} "


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base_rate: float = 0.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (term, weight))
        if self.weights:
            found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[int, str, float]]:
    """(end, term, weight), one match a word: the heaviest."""
    best: dict[int, tuple[int, str, float]] = {}
    if len(automaton):
        for end, (term, weight) in automaton.iter(folded):
            start = end - len(term)
            if start not in best or best[start][2] < weight:
                best[start] = (end, term, weight)
    return list(best.values())


def phrase(folded: str, end: int, term: str) -> str:
    """The matched word and the next one."""
    start = end - len(term) + 1
    stop = folded.find(" ", end + 1)
    following = folded.find(" ", stop + 1)
    return folded[start : following if following > 0 else stop]


def features(text: str, lexicon: Lexicon, automaton) -> tuple[float, float]:
    """Sum of weights, and the same by length."""
    folded = fold(text)
    total = sum(w for end, term, w in matches(folded, automaton) if phrase(folded, end, term) not in lexicon.exceptions)
    words = folded.count(" ")
    return float(np.log1p(total)), float(np.log1p(100 * total / (words + 20)))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled documents outside the held-out fold."""
    once = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    few = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")


def _counted(sample: DataFrame, of_text) -> DataFrame:
    """(term, toxic, clean): documents per term; counted within each task, then summed."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        of = of_text()
        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                (toxic if label else clean).update(of(text))
        terms = list(toxic)  # a term without a toxic document can't enter; its clean counts don't matter
        others = [t for t in clean if t not in toxic]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms + others, pa.string()),
                pa.array([toxic[t] for t in terms] + [0] * len(others), pa.int64()),
                pa.array([clean[t] for t in terms + others], pa.int64()),
            ],
            names=["term", "toxic", "clean"],
        )

    counted = sample.mapInArrow(tidy(run), "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beginnings(text: str) -> set[str]:
    return {w[:n] for w in set(fold(text).split()) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def choose_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Beginnings of words with clear log-odds; each lengthened while its toxic documents agree."""

    def weight(term: str) -> float:
        t, c = counts[term]
        return float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))

    least = max(2, LEAST_SHARE * n_toxic)
    # rare in clean text as a whole, and far more frequent in toxic text
    strong = {t for t, (a, c) in counts.items() if a >= least and a >= 8 * c * n_toxic / max(1, n_clean) and c <= a}
    chosen = {}
    for term in strong:
        if term[:-1] in strong:  # a shorter one says it, unless all its documents go on this way
            continue
        while True:
            longer = [u for u in (term + c for c in _FOLDED) if u in strong]
            top = max(longer, key=lambda u: counts[u][0], default=None)
            if top is None or counts[top][0] < 0.95 * counts[term][0]:
                break
            term = top
        chosen[term] = weight(term)
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:MAX_TERMS])


def _logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Ridge-penalised logistic curve by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), rows])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - 0.1 * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(3)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Lexicon:
    sample = labelled_sample(docs, labels, limit).cache()
    try:
        totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
        n_toxic, n = int(totals[0] or 0), int(totals[1])
        if not n_toxic or n_toxic == n:
            return Lexicon(base_rate=n_toxic / n if n else 0.0)
        least = max(2, int(LEAST_SHARE * n_toxic))
        counted = _counted(sample, lambda: _beginnings).where(f"toxic >= {least} AND clean <= toxic")
        rows = counted.orderBy(F.col("clean") - F.col("toxic"), "term").limit(20 * MAX_TERMS).collect()  # bounded
        terms = choose_terms({r.term: (r.toxic, r.clean) for r in rows}, n_toxic, n - n_toxic)
        lexicon = Lexicon(terms, set(), (0.0, 0.0, 0.0), n_toxic / n)

        def phrases():
            automaton = lexicon.automaton()

            def of(text: str) -> set[str]:
                folded = fold(text)
                return {phrase(folded, end, term) for end, term, _ in matches(folded, automaton)}

            return of

        mild = _counted(sample, phrases).where("clean >= 2 AND clean > 2 * toxic")
        lexicon.exceptions = {r.term for r in mild.orderBy(F.desc("clean"), "term").limit(MAX_TERMS).collect()}

        def build():
            automaton = lexicon.automaton()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                pairs = [features(t, lexicon, automaton) for t in texts_of(batch.column(0))]
                columns = [pa.array([p[i] for p in pairs]) for i in (0, 1)]
                return pa.RecordBatch.from_arrays([*columns, batch.column(1).cast(pa.float64())], names=["a", "b", "y"])

            return step

        fitted = np.array(map_rows(sample, "a double, b double, y double", build).collect(), float)  # <= limit rows
        lexicon.curve = _logistic(fitted[:, :2], fitted[:, 2])
        return lexicon
    finally:
        sample.unpersist()


def score_of(text: str, lexicon: Lexicon, automaton) -> float:
    if not lexicon.weights:
        return lexicon.base_rate
    a, b = features(text, lexicon, automaton)
    z = lexicon.curve[0] + lexicon.curve[1] * a + lexicon.curve[2] * b
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def build():
        lexicon = shared.value
        automaton = lexicon.automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [score_of(t, lexicon, automaton) for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double", build)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([score_of(t, lexicon, automaton) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
