"""Operator 3: a linear-chain CRF over a document's lines, and document quality from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import by_bytes, doc_fold

#: Labelled documents that the model is fitted on at most (those with the smallest id hashes).
FIT_DOCS = 3000
#: Characters counted by class, and the number of measures of a line.
CLASSES = (b"#*$%&<>", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")
N_LINE = len(CLASSES) + 9
#: Words of a window in which repeated words are counted, so that a line's length doesn't move their share.
REPEAT_WORDS = 200
STEPS, RATE, DECAY = 120, 0.1, 1e-3


def repeated_shares(words: list[bytes]) -> tuple[float, float]:
    """Mean (by words) and largest share of repeated words over consecutive windows; the last REPEAT_WORDS end the line."""
    n = len(words)
    if n <= REPEAT_WORDS:
        share = 1 - len(set(words)) / n
        return share, share
    starts = [*range(0, n - REPEAT_WORDS, REPEAT_WORDS), n - REPEAT_WORDS]
    shares = [1 - len(set(words[a : a + REPEAT_WORDS])) / REPEAT_WORDS for a in starts]
    last = (n - 1) % REPEAT_WORDS + 1  # words that only the last window holds
    return (sum(shares[:-1]) * REPEAT_WORDS + shares[-1] * last) / n, max(shares)


def line_measures(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Measures and length of every line that holds a word."""
    rows, sizes, seen, last = [], [], set(), None
    for line in (text or "").split("\n"):
        raw = line.encode("utf-8", "replace")
        words = raw.split()
        if not words:
            continue
        n, size = len(words), len(raw)
        row = [(size - len(raw.translate(None, c))) / size for c in CLASSES]
        repeats = sum(map(eq, words, words[1:]))
        row += [*repeated_shares(words), repeats / n, min(size / n, 40) / 10, 1.0 if n <= 3 else 0.0, 1.0 if n >= 400 else 0.0, 1.0 if line in seen else 0.0, 1.0 if line == last else 0.0, 1.0]
        seen.add(line)
        last = line
        rows.append(row)
        sizes.append(len(line))
    return rows, sizes


def with_neighbours(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each line's measures, beside those of the line before and after it in its document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(lengths[lengths > 0])
    before[ends[:-1]] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after])


@dataclass
class Model:
    """Emission weights for "good", log transition scores [from, to], and document calibration."""

    weights: np.ndarray
    trans: np.ndarray
    scale: float = 4.0
    shift: float = -2.0

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of "good" for every line, by forward-backward over each document."""
        z = np.clip(x @ self.weights, -30, 30).tolist() if len(x) else []
        good = np.exp(z).tolist()
        (t00, t01), (t10, t11) = np.exp(self.trans).tolist()
        out, at = [], 0
        for n in lengths.tolist():
            forward, p = [], None
            for e in good[at : at + n]:
                a, b = (1.0, e) if p is None else ((1 - p) * t00 + p * t10, ((1 - p) * t01 + p * t11) * e)
                p = b / (a + b)
                forward.append(p)
            part, q = [0.0] * n, 0.5
            for i in range(n - 1, -1, -1):
                p = forward[i]
                a, b = (1 - p) * (1 - q), p * q
                part[i] = b / (a + b) if a + b > 0 else p
                e = good[at + i]
                a, b = t00 * (1 - q) + t01 * e * q, t10 * (1 - q) + t11 * e * q
                q = b / (a + b)
            out += part
            at += n
        return np.array(out)

    def scores(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * means + self.shift, -40, 40)))


def weighted_means(marginals: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each document; 0.0 for one without a line."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(owner, sizes, len(lengths))
    return np.bincount(owner, sizes * marginals, len(lengths)) / np.maximum(total, 1)


def _gradient(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, starts: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood; documents are sorted by descending number of lines."""
    z = np.stack([np.zeros(len(x)), np.clip(x @ w, -30, 30)], 1)
    longest = int(lengths[0])
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]
    T, expz = np.exp(trans), np.exp(z - z.max(1, keepdims=True))
    forward, backward, pair = np.zeros_like(z), np.ones_like(z), np.zeros((2, 2))
    for t in range(longest):
        i = starts[: alive[t]] + t
        v = expz[i] * (1 if t == 0 else forward[i - 1] @ T)
        forward[i] = v / v.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        i = starts[: alive[t + 1]] + t
        v = (backward[i + 1] * expz[i + 1]) @ T.T
        backward[i] = v / v.sum(1, keepdims=True)
        both = forward[i][:, :, None] * T[None] * (expz[i + 1] * backward[i + 1])[:, None, :]
        pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
    p = forward * backward
    p = p[:, 1] / p.sum(1)
    seen = np.zeros((2, 2))
    same = np.ones(len(x), bool)
    same[starts] = False
    np.add.at(seen, (y[np.flatnonzero(same) - 1].astype(int), y[same].astype(int)), 1)
    return x.T @ (y - p), seen - pair


def _ascend(x, y, lengths, starts, w, trans, steps):
    theta = np.concatenate([w, trans.ravel()])
    m, v, k = np.zeros_like(theta), np.zeros_like(theta), len(w)
    for step in range(1, steps + 1):
        gw, gt = _gradient(x, y, lengths, starts, theta[:k], theta[k:].reshape(2, 2))
        g = np.concatenate([gw, gt.ravel()]) / len(x) - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:k], theta[k:].reshape(2, 2)


def fit(docs: list[tuple[list[list[float]], list[int], int]]) -> Model:
    """Fit on (line measures, line sizes, label 0 or 1) of documents.

    Lines start with their document's label. As a bad document may hold good lines, its lines are
    relabelled once by the first fit's marginals (its worst line stays bad), and the model is
    fitted again. Document scores are then calibrated by a logistic fit on the weighted means.
    """
    docs = sorted((d for d in docs if d[0]), key=lambda d: -len(d[0]))
    model = Model(np.zeros(3 * N_LINE), np.zeros((2, 2)))
    if not docs:
        return model
    lengths = np.array([len(d[0]) for d in docs])
    x = with_neighbours(np.array([r for d in docs for r in d[0]], float), lengths)
    sizes = np.array([s for d in docs for s in d[1]], float)
    label = np.array([d[2] for d in docs], float)
    owner, starts = np.repeat(np.arange(len(docs)), lengths), np.cumsum(lengths) - lengths
    y = label[owner]
    for _ in range(2):
        model.weights, model.trans = _ascend(x, y, lengths, starts, model.weights, model.trans, STEPS)
        p = model.marginals(x, lengths)
        worst = np.minimum.reduceat(p, starts)
        y = np.where(label[owner] == 1, 1.0, (p > np.maximum(0.5, worst[owner])).astype(float))
    means = weighted_means(p, sizes, lengths)
    a, b = 4.0, -2.0
    for _ in range(60):  # Newton steps of a ridge logistic regression
        s = 1 / (1 + np.exp(-np.clip(a * means + b, -40, 40)))
        h = s * (1 - s)
        g = np.array([((label - s) * means).sum() - 0.05 * a, (label - s).sum() - 0.05 * b])
        H = np.array([[(h * means * means).sum() + 0.05, (h * means).sum()], [(h * means).sum(), h.sum() + 0.05]])
        step = np.linalg.solve(H, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    model.scale, model.shift = a, b
    return model


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = FIT_DOCS, held_out_fold: int = 0) -> Model:
    """The model of at most max_docs labelled documents outside the held-out fold."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (doc_fold(F.col(id_col)) != held_out_fold))
    usable = usable.select(id_col, F.col(label_col).cast("int").alias("_label")).dropDuplicates([id_col])
    chosen = usable.orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)  # max_docs rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [line_measures(t) for t in b.column(0).to_pylist()]
            flat = [np.array(r, np.float32).tobytes() for r, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary()), pa.array([s for _, s in got], pa.list_(pa.int32())), b.column(1)], names=["x", "sizes", "label"])

    rows = texts.select("_text", "_label").mapInArrow(measure, "x binary, sizes array<int>, label int").collect()
    return fit([(np.frombuffer(r.x, np.float32).reshape(-1, N_LINE).tolist(), list(r.sizes), r.label) for r in rows])


def text_scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of lines and expected number of good characters of each text."""
    got = [line_measures(t) for t in texts]
    lengths = np.array([len(s) for _, s in got], int)
    sizes = np.array([s for _, ss in got for s in ss], float)
    x = np.array([r for rows, _ in got for r in rows], float).reshape(-1, N_LINE)
    p = model.marginals(with_neighbours(x, lengths), lengths) if len(x) else np.zeros(0)
    chars = np.bincount(np.repeat(np.arange(len(lengths)), lengths), sizes * p, len(lengths))
    return model.scores(weighted_means(p, sizes, lengths)), lengths, chars


def filter_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores threshold or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(iter([b]), at):
                yield part.filter(pa.array(text_scores(part.column(at).to_pylist(), model)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, score (0 to 1), predicted (1 if score >= threshold), n_lines, good_chars for every row.

    A null text, or one without a word, has no lines and scores as one whose every line is bad.
    Null ids, repeated rows and very long texts are scored like others, an empty table gives no
    row, and columns besides the id and the text are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(iter([b]), 1, 1 << 22):
                scores, lengths, chars = text_scores(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(lengths, pa.int64()), pa.array(chars, pa.float64())], names=["id", "score", "n_lines", "good_chars"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double, n_lines bigint, good_chars double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "good_chars")


def quality_scores(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """score_documents with a model of fit_model, and held_out for each row."""
    scored = score_documents(docs, fit_model(docs, labels, **names))
    return scored.select("doc_id", (doc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "n_lines", "good_chars")
