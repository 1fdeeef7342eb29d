"""Secret scan: fixed patterns, plus spans tagged by a linear-chain conditional random field.

The field tags tokens as begin, inside or outside of a secret. A token's score is the sum of
weights of its shape, of the words and shapes beside it, and of features of its line and its whole
text. It is trained by gradient ascent on the likelihood of tags that the fixed patterns give on a
bounded sample of documents, and decoded by Viterbi. Plain tokens (words without digits or mixed
case, single signs) can only be outside; so the chain falls apart at plain tokens, and only the
runs of other tokens need decoding, which gives the same tags as decoding whole texts.

Pattern spans always stay; a tagged span is added (kind ``crf``) unless it overlaps one.
Positions are code points, ends exclusive.

Defined cases: a null text is empty; an empty text has no span and the digest of an empty string;
very long texts are scanned whole; repeated rows are scanned one by one; an empty table gives an
empty sample, hence a model without weights that tags nothing; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import map_rows, texts_of, tidy

#: Fixed patterns, in the order of their kinds.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
#: Hints without which a pattern cannot match: part of a key in small letters; of 32 signs, eight are every fourth one.
_KEYS = ("passw", "secret", "token", "api")
_HEX_HINT = re.compile(r"[0-9a-f]{8}")

#: Documents of the training sample, and the weight decay, steps and rate of the fit.
SAMPLE_DOCS, DECAY, STEPS, RATE = 6000, 1e-3, 150, 0.1
#: Tokens of the sample's decodable runs at most; the fit's memory bound.
SAMPLE_RUNS = 40_000
#: Log-odds that a begin tag must win by, against marking clean text.
MARGIN = 2.0

_TOKEN = re.compile(r"[\w+/.\-]+|=+|[^\w\s]")
#: What makes a token other than plain; a text without any needs no tokens at all. Seen from the capital, and long
#: words from their first letter: most places of a text then fail at once.
_TRIGGER = re.compile(r"[0-9_+/]|[A-Z](?:(?<=[a-z][A-Z])|[A-Z]{3})|(?<![A-Za-z])[A-Za-z]{24}")
#: Shapes of tokens that a worker remembers.
SHAPES = 1 << 16

Span = tuple[int, int, str]


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    spans = []
    small = text.lower()
    if any(key in small for key in _KEYS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_HINT.search(text[::4]):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """What the training tags mark: the value of an assignment, other matches whole."""
    parts = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    return parts + [s[:2] for s in pattern_spans(text) if s[2] != "assign"]


@lru_cache(SHAPES)
def shape(token: str) -> str:
    """Shape class of a token: kinds of characters, length and changes between kinds; '' if plain."""
    if not _TRIGGER.search(token):
        return ""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    size = len(token)
    length = "1" if size < 4 else "2" if size < 8 else "3" if size < 12 else "4" if size < 16 else "5" if size < 24 else "6"
    mixing = "0" if changes == 0 else "1" if changes * 4 < size else "2"
    script = "" if token.isascii() else "x"
    return "".join(sorted(set(kinds))) + length + mixing + script


def _neighbour(token: str | None) -> str:
    if token is None:
        return "^"
    if not token[0].isalnum():
        return token[0]
    return shape(token) or token.lower()[:12]


def _text_features(text: str) -> str:
    """File feature: share of signs that source code and settings are full of."""
    signs = sum(map(text.count, "=:{}[];\"'"))
    return "f" + str(min(3, signs * 60 // (len(text) + 1)))


def runs(text: str) -> list[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Decodable runs of a text: token positions and feature names of each token."""
    out = []
    end = 0
    whole = ""
    while trigger := _TRIGGER.search(text, end):  # one for each line that has any
        begin = text.rfind("\n", 0, trigger.start()) + 1
        end = text.find("\n", trigger.start())
        end = len(text) if end < 0 else end
        whole = whole or _text_features(text)
        tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
        names = _TOKEN.findall(text, begin, end)
        shapes = [shape(n) for n in names]
        line = "L=" if "=" in names or ":" in names else "L"
        k = 0
        while k < len(tokens):
            if not shapes[k]:
                k += 1
                continue
            stop = k
            while stop < len(tokens) and (shapes[stop] or names[stop][0] == "="):
                stop += 1
            features = []
            for i in range(k, stop):
                before = _neighbour(names[i - 1] if i else None)
                earlier = _neighbour(names[i - 2] if i > 1 else None)
                further = _neighbour(names[i - 3] if i > 2 else None)
                after = _neighbour(names[i + 1] if i + 1 < len(names) else None)
                own = shapes[i] or "="
                features.append(
                    ["s" + own, "p" + before, "q" + earlier, "r" + further, "n" + after, "sl" + own + line, "sp" + own + before[:1], whole]
                )
            out.append((tokens[k:stop], features))
            k = stop
    return out


# --- the field: tags 0 outside, 1 begin, 2 inside ------------------------------------------------

FORBIDDEN = -1e9


@dataclass
class Field:
    """Weights per feature name (three tags each) and transitions."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    trained: bool = False

    def scores(self, features: list[list[str]]) -> np.ndarray:
        none = np.zeros(3)
        return np.array([sum((self.weights.get(f, none) for f in token), none) for token in features])

    @cached_property
    def numbers(self) -> tuple[dict[str, list[float]], list[list[float]]]:
        """Weights and allowed transitions as plain numbers: most runs are of one token, too short for arrays."""
        return {name: w.tolist() for name, w in self.weights.items()}, (self.transitions + _allowed()).tolist()

    def tags(self, features: list[list[str]]) -> list[int]:
        """Best tags of one run by Viterbi; outside before and after it."""
        if not self.trained:
            return [0] * len(features)
        weights, step = self.numbers
        best: list[float] = []
        back = []
        for token in features:
            outside = begin = inside = 0.0
            for name in token:
                if name in weights:
                    w = weights[name]
                    outside, begin, inside = outside + w[0], begin + w[1], inside + w[2]
            row = (outside, begin - MARGIN, inside)
            if not best:
                best = [row[j] + step[0][j] for j in range(3)]
                continue
            paths = [[best[i] + step[i][j] for i in range(3)] for j in range(3)]
            tops = [max(into) for into in paths]
            back.append([into.index(top) for into, top in zip(paths, tops)])
            best = [tops[j] + row[j] for j in range(3)]
        best = [best[i] + step[i][0] for i in range(3)]
        tags = [best.index(max(best))]
        for pointers in reversed(back):
            tags.append(pointers[tags[-1]])
        return tags[::-1]


def _allowed() -> np.ndarray:
    step = np.zeros((3, 3))
    step[0, 2] = FORBIDDEN  # inside follows begin or inside only
    return step


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    """Over an axis of the three tags: whole slices are added, many times faster than a sum along three numbers."""
    first, second, third = np.moveaxis(x, axis, 0)
    top = np.maximum(np.maximum(first, second), third)
    return top + np.log(np.exp(first - top) + np.exp(second - top) + np.exp(third - top))


def fit(examples: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = RATE) -> Field:
    """Maximum likelihood with decay, by Adam on forward-backward expectations of all runs at once."""
    if not any(any(tags) for _, tags in examples):
        return Field()
    names = sorted({f for features, _ in examples for token in features for f in token})
    number = {n: i for i, n in enumerate(names)}
    width = len(examples[0][0][0])
    longest = max(len(t) for _, t in examples)
    n = len(examples)
    ids = np.full((n, longest, width), len(names))
    gold = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for k, (features, tags) in enumerate(examples):
        for i, token in enumerate(features):
            ids[k, i] = [number[f] for f in token]
        gold[k, : len(tags)] = tags
        mask[k, : len(tags)] = True
    used = np.concatenate([ids[:, :, j][mask] for j in range(width)])  # features of all tokens
    weights = np.zeros((len(names) + 1, 3))
    moves = np.zeros((3, 3))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    one_hot = np.eye(3)[gold] * mask[:, :, None]
    gold_moves = np.zeros((3, 3))
    previous = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], 1)
    np.add.at(gold_moves, (previous[mask], gold[mask]), 1)
    lengths = mask.sum(1)
    last = gold[np.arange(n), lengths - 1]
    np.add.at(gold_moves, (last, np.zeros_like(last)), 1)
    for t in range(1, steps + 1):
        emit = weights[ids[:, :, 0]]
        for j in range(1, width):
            emit += weights[ids[:, :, j]]
        step = moves + _allowed()
        forward = np.zeros((n, longest, 3))
        forward[:, 0] = emit[:, 0] + step[0]
        for i in range(1, longest):
            forward[:, i] = _logsum(forward[:, i - 1, :, None] + step[None], 1) + emit[:, i]
        backward = np.zeros((n, longest, 3))
        for i in range(longest - 1, -1, -1):
            ends = lengths - 1 == i
            if i + 1 < longest:
                backward[:, i] = _logsum(step[None] + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[ends, i] = step[:, 0]
        total = _logsum(forward[np.arange(n), lengths - 1] + step[None, :, 0], 1)
        chance = np.exp(np.minimum(0, forward + backward - total[:, None, None])) * mask[:, :, None]
        difference = np.tile((one_hot - chance)[mask], (width, 1))
        gradient = np.stack([np.bincount(used, difference[:, tag], len(weights)) for tag in range(3)], 1)
        expected = np.zeros((3, 3))
        expected[0] += chance[:, 0].sum(0)
        for i in range(1, longest):
            inside = mask[:, i]
            pair = forward[inside, i - 1, :, None] + step[None] + (emit[inside, i] + backward[inside, i])[:, None, :]
            expected += np.exp(np.minimum(0, pair - total[inside, None, None])).sum(0)
        expected[:, 0] += chance[np.arange(n), lengths - 1].sum(0)
        updates = ((weights, gradient - DECAY * n * weights, 0), (moves, gold_moves - expected - DECAY * n * moves, 2))
        for value, slope, at in updates:
            state[at] = 0.9 * state[at] + 0.1 * slope / n
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * (slope / n) ** 2
            value += rate * (state[at] / (1 - 0.9**t)) / (np.sqrt(state[at + 1] / (1 - 0.99**t)) + 1e-6)
    return Field({name: weights[i] for name, i in number.items()}, moves, True)


def examples_of(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Runs of a text with the tags that the fixed patterns give."""
    parts = sorted(_secret_parts(text))
    out = []
    for positions, features in runs(text):
        tags, open_part = [], None
        for a, b in positions:
            inside = next((p for p in parts if p[0] < b and a < p[1]), None)
            tags.append(0 if inside is None else 2 if inside == open_part else 1)
            open_part = inside
        out.append((features, tags))
    return out


def sample_documents(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """The ``limit`` documents with the smallest hash of their id: a bounded sample for the fit."""
    order = F.xxhash64("doc_id")
    few = docs.select("doc_id", order.alias("_h")).orderBy("_h", "doc_id").limit(limit).select("doc_id").distinct()
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi")


def train(docs: DataFrame, limit: int = SAMPLE_DOCS) -> Field:
    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(features, tags) for text in texts_of(batch.column(1)) for features, tags in examples_of(text)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in found], pa.list_(pa.list_(pa.string()))),
                    pa.array([t for _, t in found], pa.list_(pa.int64())),
                ],
                names=["features", "tags"],
            )

        return step

    found = map_rows(sample_documents(docs, limit), "features array<array<string>>, tags array<long>", build)
    by_hash = found.where(F.size("tags") <= 64).orderBy(F.xxhash64("features"), "tags").limit(SAMPLE_RUNS)
    rows = by_hash.toArrow()  # bounded by SAMPLE_RUNS
    return fit(list(zip(rows.column("features").to_pylist(), rows.column("tags").to_pylist())))


def spans(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans), both by start, then kind."""
    base = pattern_spans(text)
    added = []
    for positions, features in runs(text) if model.trained else []:
        begin = None
        tags = [*model.tags(features), 0]
        for (a, b), tag, following in zip(positions, tags, tags[1:]):
            begin = a if tag == 1 else begin
            if tag and following != 2 and not any(a0 < b and begin < b0 for a0, b0, _ in base):
                added.append((begin, b, "crf"))
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, model: Field) -> DataFrame:
    """One row per document row: counts, digest of the pattern spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"

    def build():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch.column(1)):
                base, every = spans(text, model)
                kinds = [kind for _, _, kind in every]
                counts = [kinds.count(kind) for kind in KINDS]
                rows.append((*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), counts[3]))
            columns = [pa.array(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.split()[0] for f in schema.split(", ")])

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, build)


def redact(docs: DataFrame, model: Field, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced; all rows and columns stay, ``n_chars`` follows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            clean = []
            for text in texts:
                parts, end = [], 0
                for a, b, _ in spans(text, model)[1] if text else []:
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                clean.append(text if not parts else "".join([*parts, text[end:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            sized = batch.schema.get_field_index("n_chars")
            if sized >= 0:
                sizes = zip(batch.column(sized).to_pylist(), texts, clean)
                kept = [n if new == old or n is None else len(new) for n, old, new in sizes]
                columns[sized] = pa.array(kept, batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
