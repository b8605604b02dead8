"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 is cut into chunks that overlap by a filter's width less one, so every window of
bytes is in one chunk. A filter is a table of weights for each byte at each of its places, so a
convolution is a sum of table rows. Each chunk keeps the largest response of each filter; a
document's pooled responses (their mean, least and largest over its chunks) give one probability.
Filters are learned on chunks by Adam, the last layer on whole documents by Newton's method. Tasks cut
the chunks and pool the responses, so no text reaches the driver: it gets ``DRAWN`` chunks at most of
each labelled document to learn filters from, and each one's pooled responses for the last layer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import staged
from cadenza.llm.toxicity import labelled

#: At most so many labelled rows are learned from, and so many chunks of each by filters (12 MB in all).
SAMPLE, DRAWN = 3_000, 8
FILTERS, WIDTH, CHUNK = 16, 5, 512
STEPS, BATCH = 600, 64


@dataclass
class Network:
    """tables[k, b]: what byte b at place k adds to each filter; the last layer is over standardised pooled responses."""

    tables: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float


def chunks(text: str | None) -> np.ndarray:
    """A row of CHUNK bytes for each chunk, which together cover the whole text; one of zeros for an empty text. Ends are filled with the last chunk's own bytes, repeated."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= CHUNK:
        return np.resize(raw, (1, CHUNK)) if len(raw) else np.zeros((1, CHUNK), np.uint8)
    step = CHUNK - WIDTH + 1
    starts = np.append(np.arange(0, len(raw) - CHUNK, step), len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


def responses(tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Filters' responses at each place of each row."""
    n = rows.shape[1] - WIDTH + 1
    out = tables[0][rows[:, :n]]
    for k in range(1, WIDTH):
        out += tables[k][rows[:, k : k + n]]
    return out


def pooled(tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each chunk, a few chunks at a time."""
    return np.concatenate([responses(tables, rows[i : i + 32]).max(1) for i in range(0, len(rows), 32)])


def document(tables: np.ndarray, text: str | None) -> np.ndarray:
    p = pooled(tables, chunks(text))
    return np.concatenate([p.mean(0), p.min(0), p.max(0)])


def learn_filters(texts: list[np.ndarray], label: np.ndarray, seed: int = 5) -> np.ndarray:
    """Filters from chunks (a matrix for each document) drawn at random, as many of either label, each with its document's label."""
    draw = np.random.default_rng(seed)
    tables = draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    out = draw.normal(0, 0.3, FILTERS).astype(np.float32)
    params = [tables, out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sides = [np.flatnonzero(label == v) for v in (0, 1)]
    for t in range(1, STEPS + 1):
        chosen = np.concatenate([draw.choice(s, BATCH // 2) for s in sides])
        rows = np.stack([texts[i][draw.integers(len(texts[i]))] for i in chosen])
        y = label[chosen].astype(np.float32)
        r = responses(tables, rows)
        at = r.argmax(1)
        top = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
        act = np.tanh(top)
        error = 1 / (1 + np.exp(-(act @ out + params[2][0]))) - y
        back = error[:, None] * out[None, :] * (1 - act**2) / len(y)
        grads = [np.zeros_like(tables), act.T @ error / len(y), np.array([error.mean()], np.float32)]
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            np.add.at(grads[0][k], (rows[np.arange(len(rows))[:, None], at + k], f), back)
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return tables


def last_layer(tables: np.ndarray, x: np.ndarray, label: np.ndarray) -> Network:
    """The network of these filters with a logistic layer over documents' pooled responses."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 2.0), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - label) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Network(tables, mean, spread, w[:-1], float(w[-1]))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a text by DRAWN of its chunks at most, drawn by a seed from the text."""
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            rows = chunks(text)
            if len(rows) > DRAWN:
                rows = rows[np.sort(np.random.default_rng(zlib.crc32(rows.tobytes())).choice(len(rows), DRAWN, replace=False))]
            out.append(rows.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])


def learn(rows: DataFrame) -> Network | float:
    """A network from rows (doc_id, label, text), or the rate of label 1 if only one label is there."""
    rows = staged(rows.select("doc_id", F.col("label").cast("int").alias("label"), "text"), "quality-sample")
    drawn = rows.mapInArrow(_drawn, "doc_id bigint, label int, chunks binary").toPandas().sort_values(["doc_id", "chunks"])
    label = drawn["label"].to_numpy(np.int64)
    if not len(label) or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.5
    tables = learn_filters([np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x in drawn["chunks"]], label)

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [document(tables, t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    pooled_ = rows.mapInArrow(respond, "doc_id bigint, label int, x array<double>").toPandas()
    order = sorted(range(len(pooled_)), key=lambda i: (pooled_["doc_id"][i], list(pooled_["x"][i])))
    return last_layer(tables, np.stack(pooled_["x"].to_numpy())[order], pooled_["label"].to_numpy(np.int64)[order])


def probability(net: Network | float, text: str | None) -> float:
    if isinstance(net, float):
        return net
    z = (document(net.tables, text) - net.mean) / net.spread @ net.weights + net.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def classify(docs: DataFrame, labels: DataFrame, learning, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted: one row for each row of ``docs``.

    Labels are learned from rows for which the condition ``learning`` on doc_id holds. Null and empty
    texts are one chunk of zero bytes. Rows with equal texts score alike, whatever their other
    columns, which are ignored. An empty table gives an empty result.
    """
    net = learn(labelled(docs, labels, "quality", learning, sample))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by FILTERS and WIDTH

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([probability(shared.value, t) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id bigint, score double, predicted int")
