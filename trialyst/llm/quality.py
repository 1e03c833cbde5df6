"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded: rates of word forms, how
often words repeat within it and were seen before it, and a hashed histogram of word shapes. A layer
turns each encoding into a hidden vector; a gated attention (tanh times sigmoid) gives each passage a
weight, weights sum to one over the document, and the weighted sum of hidden vectors is scored. Only
documents have labels; the attention learns which passages tell.

It is fitted on at most `SAMPLE` labelled rows, all passages of each; scoring reads every whole text in
place, without a shuffle. Null text counts as empty; an empty text is one passage of zeros. Repeated rows
have a result each; without any labels, or with one class only, every score is the share of label 1
(0 without labels). Other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialyst.llm.common import map_texts, texts
from trialyst.llm.labelled import training_rows, verdicts

PARTS, HELD = 4, 2
SAMPLE = 6000
PASSAGE = 48
SHAPES = 64
#: Words that a Python worker remembers; beyond this it starts anew.
REMEMBERED = 400_000
RUNS = re.compile(r"(.)\1+")
FORMS = 14
SEQUENCE = 5
WIDTH = FORMS + SEQUENCE + SHAPES


class Kinds(dict):
    """a and A for letters, 0 for digits, other marks as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[code]


KINDS = Kinds()


def forms(word: str) -> tuple[float, ...]:
    """Rates of one word, and its shape's place in the histogram last; a shape names repeated kinds once."""
    n = len(word)
    kinds = word.translate(KINDS)
    upper, digits = kinds.count("A"), kinds.count("0")
    letters = upper + kinds.count("a")
    marks = n - letters - digits
    tail = 0
    while tail < n and kinds[-1 - tail] not in "aA0":
        tail += 1
    end = word[-1]
    return (
        min(n, 40) / 10,
        n == 1,
        letters == n,
        digits > 0,
        n > 1 and upper > 0 and upper == letters,
        kinds[0] == "A" and upper == 1 and letters == n,
        end in ".!?",
        end in ",;:",
        marks / n,
        letters == 0,
        marks == n,
        tail >= 2,
        tail >= 3,
        "/" in word or "@" in word,
        crc32(RUNS.sub(r"\1", kinds[:64]).encode("utf-8", "surrogatepass")) % SHAPES,
    )


class Encoder:
    """Turns texts into passage rows; remembers words."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, FORMS + 1), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        first = len(known)
        made: list[tuple[float, ...]] = []
        out = []
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
                made.append(forms(w))
            out.append(i)
        if made:
            while len(known) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : len(known)] = made
        return np.array(out, np.int64)

    def encode(self, text: str) -> np.ndarray:
        """(passages, WIDTH)"""
        words = text.split()
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        ids = self.ids(words)
        n = len(ids)
        starts = np.arange(0, n, PASSAGE)
        sizes = np.diff(np.append(starts, n)).astype(np.float32)
        of = np.arange(n) // PASSAGE
        rows = self.table[ids]
        out = np.zeros((len(starts), WIDTH), np.float32)
        out[:, :FORMS] = np.add.reduceat(rows[:, :FORMS], starts, axis=0) / sizes[:, None]
        again = np.zeros((n, 2), np.float32)
        for lag in (1, 2):
            again[lag:, lag - 1] = ids[lag:] == ids[:-lag]
        out[:, FORMS : FORMS + 2] = np.add.reduceat(again, starts, axis=0) / sizes[:, None]
        pairs = np.unique(of * (int(ids.max()) + 1) + ids)
        out[:, FORMS + 2] = np.bincount(pairs // (int(ids.max()) + 1), minlength=len(starts)) / sizes
        new = np.zeros(n, np.float32)
        new[np.unique(ids, return_index=True)[1]] = 1
        out[:, FORMS + 3] = np.add.reduceat(new, starts) / sizes
        out[:, FORMS + 4] = np.minimum(n, 4 * PASSAGE) / (4 * PASSAGE)
        shapes = np.bincount(of * SHAPES + rows[:, FORMS].astype(np.int64), minlength=len(starts) * SHAPES)
        out[:, FORMS + SEQUENCE :] = shapes.reshape(len(starts), SHAPES) / sizes[:, None]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Parameters: mean and spread of encodings; hidden, gate and score layers."""

    mean: np.ndarray
    spread: np.ndarray
    layers: dict = field(default_factory=dict)
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict:
        """All steps for bags that lie one after another; `of` is each passage's bag."""
        p = self.layers
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        weight = e / np.add.reduceat(e, starts)[of]
        bag = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "score": _sigmoid(bag @ p["c"] + p["d"][0])}

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(self.forward(x, np.array([0]), np.zeros(len(x), np.int64))["score"][0])


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 15, rate: float = 0.01, seed: int = 3) -> Attention:
    """Adaptive-moment descent on the logistic loss of bags, in a fixed order."""
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return Attention(np.zeros(WIDTH), np.ones(WIDTH), {}, share)
    flat = np.concatenate(bags)
    rng = np.random.default_rng(seed)
    net = Attention(flat.mean(0), flat.std(0) + 0.02)
    del flat
    net.layers = p = {
        "w": rng.normal(0, 0.2, (WIDTH, hidden)),
        "b": np.zeros(hidden),
        "v": rng.normal(0, 0.3, (hidden, gate)),
        "u": rng.normal(0, 0.3, (hidden, gate)),
        "a": rng.normal(0, 0.3, gate),
        "c": rng.normal(0, 0.3, hidden),
        "d": np.array([np.log(share / (1 - share))]),
    }
    m, s, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(max(rounds, min(200, 1500 * rounds // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            part = order[at : at + 64]
            sizes = np.array([len(bags[i]) for i in part])
            starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
            f = net.forward(np.concatenate([bags[i] for i in part]), starts, of)
            dz = (f["score"] - y[part]) / len(part)
            dbag = dz[:, None] * p["c"]
            dh = f["weight"][:, None] * dbag[of]
            dw = (f["h"] * dbag[of]).sum(1)
            de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, starts)[of])
            dtg = de[:, None] * p["a"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh += dt @ p["v"].T + dg @ p["u"].T
            dpre = dh * (1 - f["h"] ** 2)
            grad = {"w": f["x"].T @ dpre, "b": dpre.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["bag"].T @ dz, "d": np.array([dz.sum()])}
            step += 1
            for k, x in p.items():
                d = grad[k] + 1e-4 * x
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.001 * (d * d - s[k])
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


ENCODERS: list[Encoder] = []


def encoder() -> Encoder:
    """One for each Python worker."""
    if not ENCODERS:
        ENCODERS.append(Encoder())
    return ENCODERS[0]


def _encoded(batch: list[str]) -> tuple:
    bags = [encoder().encode(t) for t in batch]
    ends = np.cumsum([0, *(b.size for b in bags)], dtype=np.int32)
    return (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([b.ravel() for b in bags]))),)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention:
    """Fits on a bounded sample; its encodings come to the driver, not its texts."""
    rows = training_rows(docs, labels, "quality", PARTS, HELD, sample)
    got = map_texts(rows, _encoded, "bag array<float>").toArrow().sort_by("doc_id")
    return fit([np.asarray(b.values).reshape(-1, WIDTH) for b in got.column("bag")], got.column("y").to_numpy().astype(float))


def score_texts(docs: DataFrame, net: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters
    return map_texts(texts(docs, id_col, text_col), lambda batch: ([sent.value.score(encoder().encode(t)) for t in batch],), "score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return verdicts(score_texts(docs, train(docs, labels)), PARTS, HELD)
