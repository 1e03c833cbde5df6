"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words and their beginnings, hashed. The machine adds a weight for each
term and, for each pair of terms, the product of their vectors, so it learns what terms mean together
and not only by themselves.

It is fitted on at most `SAMPLE` labelled rows: of their terms the `TERMS` ones whose document shares
differ most between the classes have parameters, others have none. All documents are scored in place,
over their whole texts, without a shuffle.

Null text counts as empty; a text without known terms gets the score of the bias alone. Repeated rows
have a result each; without any labels, or with one class only, every score is the share of label 1
(0 without labels). Other columns are left out by `score_texts` and kept by `keep_clean`.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from trialyst.llm.common import map_texts, texts
from trialyst.llm.labelled import THRESHOLD, training_rows, verdicts

PARTS, HELD = 3, 1
SAMPLE = 20_000
TERMS = 4096
SPACE = 1 << 22
FACTORS = 8
BEGINNINGS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Standard errors by which the shares of a term must differ.
LEAST_ERRORS = 3.0
#: Weight of a row with label 1 in the loss; such rows are few.
WEIGHT = 3.0
REMEMBERED = 200_000


def hashed(word: str) -> list[int]:
    """The places of a lower-case word and of its beginnings."""
    cut = [word + "$"] + [word[:n] for n in BEGINNINGS if len(word) >= n]
    return [crc32(x.encode("utf-8", "surrogatepass")) % SPACE for x in cut]


@dataclass
class Machine:
    """Parameters of the chosen terms; `bias` alone scores a text without any."""

    places: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    memo: dict = field(default_factory=dict)
    index: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}, "index": {}}

    def terms(self, text: str) -> list[int]:
        if not self.index:
            self.index = {p: i for i, p in enumerate(self.places.tolist())}
        out: set[int] = set()
        memo, index = self.memo, self.index
        for word in set(WORD.findall(text.lower())):
            known = memo.get(word)
            if known is None:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                known = tuple(index[p] for p in hashed(word) if p in index)
                if len(word) <= 64:
                    memo[word] = known
            out.update(known)
        return sorted(out)

    def score(self, text: str) -> float:
        own = self.terms(text)
        v = self.vectors[own]
        z = self.bias + self.weights[own].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def choose(rows: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """The places whose shares differ most between the classes, in standard errors."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    count = [np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)]
    for own, label in zip(rows, y, strict=True):
        count[int(label)][own] += 1
    both = count[0] + count[1]
    share = both / (n0 + n1)
    far = np.abs(count[1] / n1 - count[0] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1))
    far[both < (2 if len(y) < 2000 else 3)] = 0
    order = np.argsort(-far, kind="stable")[:terms]
    return np.sort(order[far[order] > LEAST_ERRORS])


def fit(rows: list[np.ndarray], y: np.ndarray, terms: int = TERMS, factors: int = FACTORS, rounds: int = 8, rate: float = 0.05, seed: int = 5) -> Machine:
    """Adaptive-moment descent on the logistic loss, in a fixed order."""
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return Machine(np.zeros(0, np.int64), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, factors)))
    places = choose(rows, y, terms)
    rng = np.random.default_rng(seed)
    k = len(places)
    own = [np.searchsorted(places, r[np.isin(r, places)]) for r in rows]
    p = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.05, (k, factors))]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    decay, step = (0.0, 1e-4, 1e-3), 0
    for _ in range(max(rounds, min(300, 10_000 * rounds // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            part = order[at : at + 256]
            idx = np.concatenate([own[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(own[i]) for i in part])
            v = p[2][idx]
            total = np.zeros((len(part), factors))
            np.add.at(total, row, v)
            square = np.bincount(row, (v**2).sum(1), len(part))
            z = p[0][0] + np.bincount(row, p[1][idx], len(part)) + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * (1 + (WEIGHT - 1) * y[part]) / len(part)
            grad = [np.array([g.sum()]), np.bincount(idx, g[row], k), np.zeros((k, factors))]
            np.add.at(grad[2], idx, g[row, None] * (total[row] - v))
            step += 1
            for x, d, mx, sx, l2 in zip(p, grad, m, s, decay, strict=True):
                d = d + l2 * x
                mx += 0.1 * (d - mx)
                sx += 0.001 * (d * d - sx)
                x -= rate * (mx / (1 - 0.9**step)) / (np.sqrt(sx / (1 - 0.999**step)) + 1e-8)
    return Machine(places, float(p[0][0]), p[1], p[2])


def _term_lists(batch: list[str]) -> tuple:
    seen = functools.cache(hashed)
    return ([sorted({p for w in set(WORD.findall(t.lower())) for p in seen(w)}) for t in batch],)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on a bounded sample; only its hashed terms come to the driver."""
    rows = training_rows(docs, labels, "toxic", PARTS, HELD, sample, id_col, text_col)
    got = map_texts(rows, _term_lists, "terms array<int>").toArrow().sort_by(id_col)
    return fit([np.asarray(t.values) for t in got.column("terms")], got.column("y").to_numpy().astype(float))


def score_texts(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # at most TERMS parameters
    return map_texts(texts(docs, id_col, text_col), lambda batch: ([sent.value.score(t) for t in batch],), "score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return verdicts(score_texts(docs, train(docs, labels)), PARTS, HELD)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score `threshold` or more, all columns kept, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col))
    at = docs.columns.index(text_col)
    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            keep = []
            for t in batch.column(at):
                keep.append(sent.value.score(t.as_py() or "") < threshold)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)
