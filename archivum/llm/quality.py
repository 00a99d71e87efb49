"""Quality classification by a byte-level convolutional network in numpy.

The bytes of a whole text are cut into segments; every two neighbouring
segments are a chunk, so chunks overlap by half and cover everything. Learned
filters slide over embedded bytes and are pooled (largest and mean) in each
chunk. A hidden layer over that is max-pooled and averaged over the chunks of
the document and combined into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivum.llm._shared import bounded_sample, release_memory, with_outputs

SEGMENT = 128
STRIDE = 4
WIDTH = 2 * STRIDE
EMBED, FILTERS, HIDDEN = 8, 24, 32
#: Labelled texts of each class that the network is fitted on, at most.
SAMPLE_PER_CLASS = 1000
EPOCHS = 12
#: Documents of a step of fitting; fewer where they have BLOCK segments.
BATCH = 32
#: Segments that are embedded at a time.
BLOCK = 1024
POSITIONS = SEGMENT // STRIDE


def segments(text: str | None) -> np.ndarray:
    """The text's bytes, SEGMENT and the first of the next in a row, zeros
    where there are none. An empty text is one segment of zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(data) // SEGMENT))
    padded = np.zeros(n * SEGMENT + WIDTH, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, SEGMENT + WIDTH - STRIDE), (SEGMENT, 1))


class Network:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        if weights is None:
            rng = np.random.default_rng(seed)
            inputs = 2 * FILTERS
            normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
            weights = {
                "embed": normal(256, EMBED, scale=0.5),
                "filters": normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
                "filter_bias": np.zeros(FILTERS, np.float32),
                "hidden": normal(inputs, HIDDEN, scale=(2 / inputs) ** 0.5),
                "hidden_bias": np.zeros(HIDDEN, np.float32),
                "out": normal(2 * HIDDEN, scale=(1 / HIDDEN) ** 0.5),
                "out_bias": np.zeros(1, np.float32),
            }
        self.weights = weights

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """For segments: largest and mean filter outputs, and what the backward
        pass needs."""
        w, n = self.weights, len(rows)
        body = np.ascontiguousarray(rows)
        embedded = w["embed"][body]
        span = WIDTH * EMBED
        step = embedded.strides[1] * STRIDE
        windows = np.lib.stride_tricks.as_strided(embedded, (n, POSITIONS, span), (embedded.strides[0], step, embedded.itemsize))
        flat = np.ascontiguousarray(windows).reshape(n * POSITIONS, span)
        made = np.maximum(flat @ w["filters"] + w["filter_bias"], 0).reshape(n, POSITIONS, FILTERS)
        return made.max(axis=1), made.mean(axis=1), (body, flat, made)

    def blocks(self, rows: np.ndarray, cached: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pooled outputs of any number of segments, BLOCK at a time. What the
        backward pass needs is kept in ``cached`` where it is one block."""
        parts = []
        for at in range(0, len(rows), BLOCK):
            *part, cache = self.pooled(rows[at : at + BLOCK])
            parts.append(part)
            if cached is not None and len(rows) <= BLOCK:
                cached.append(cache)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def document_inputs(self, largest, mean, counts):
        """Chunks out of neighbouring segments, and where documents start."""
        ends = np.cumsum(counts)
        starts = ends - counts
        nxt = np.arange(len(largest)) + 1
        nxt[ends - 1] = ends - 1  # the last segment stands alone
        return np.concatenate((np.maximum(largest, largest[nxt]), (mean + mean[nxt]) / 2), axis=1), starts, nxt

    def score(self, texts: list[str | None]) -> np.ndarray:
        w = self.weights
        out = np.empty(len(texts))
        group, held, first = [], 0, 0

        def flush(stop: int) -> None:
            nonlocal group, held, first
            counts = np.array([len(x) for x in group])
            inputs, starts, _ = self.document_inputs(*self.blocks(np.concatenate(group)), counts)
            hidden = np.maximum(inputs @ w["hidden"] + w["hidden_bias"], 0)
            pooled = np.concatenate((np.maximum.reduceat(hidden, starts), np.add.reduceat(hidden, starts) / counts[:, None]), axis=1)
            out[first:stop] = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["out_bias"][0], -30, 30).astype(float)))
            group, held, first = [], 0, stop

        for i, text in enumerate(texts):
            group.append(segments(text))
            held += len(group[-1])
            if held >= BLOCK:
                flush(i + 1)
        if group:
            flush(len(texts))
        return out

    def gradients(self, documents: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of the weighted log losses of these documents, each given
        by all of its segments. Memory is bounded by a block of segments, which
        is embedded again on the way back where there are several."""
        w, cached = self.weights, []
        counts = np.array([len(x) for x in documents])
        rows = np.concatenate(documents)
        largest, mean = self.blocks(rows, cached)
        inputs, starts, nxt = self.document_inputs(largest, mean, counts)
        hidden = np.maximum(inputs @ w["hidden"] + w["hidden_bias"], 0)
        owner = np.repeat(np.arange(len(documents)), counts)
        top = np.maximum.reduceat(hidden, starts)
        pooled = np.concatenate((top, np.add.reduceat(hidden, starts) / counts[:, None]), axis=1)
        probability = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["out_bias"][0], -30, 30)))
        slope = ((probability - target) * weight).astype(np.float32)
        grads = {"out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True)}
        back = slope[:, None] * w["out"][None]
        is_top = (hidden == top[owner]) & (hidden > 0)
        d_hidden = back[owner, :HIDDEN] * is_top + back[owner, HIDDEN:] / counts[owner, None]
        d_hidden *= hidden > 0
        grads["hidden"], grads["hidden_bias"] = inputs.T @ d_hidden, d_hidden.sum(axis=0)
        d_inputs = d_hidden @ w["hidden"].T
        d_largest, d_mean = np.zeros_like(largest), np.zeros_like(mean)
        own = largest >= largest[nxt]
        part = d_inputs[:, :FILTERS]
        d_largest += part * own
        np.add.at(d_largest, nxt, part * ~own)
        part = d_inputs[:, FILTERS : 2 * FILTERS] / 2
        d_mean += part
        np.add.at(d_mean, nxt, part)
        for k in ("filters", "filter_bias", "embed"):
            grads[k] = np.zeros_like(w[k])
        for at in range(0, len(rows), BLOCK):
            block = slice(at, at + BLOCK)
            self.add_filter_gradients(grads, cached[0] if cached else self.pooled(rows[block])[2], d_largest[block], d_mean[block])
        return grads

    def add_filter_gradients(self, grads: dict[str, np.ndarray], cache: tuple, d_largest: np.ndarray, d_mean: np.ndarray) -> None:
        """What a block of segments adds to the gradients of filters and bytes."""
        body, flat, made = cache
        d_made = np.broadcast_to(d_mean[:, None] / POSITIONS, made.shape).copy()
        where = made.argmax(axis=1)
        n = np.arange(len(made))[:, None]
        d_made[n, where, np.arange(FILTERS)[None]] += d_largest
        d_made *= made > 0
        d_flat = d_made.reshape(-1, FILTERS)
        grads["filters"] += flat.T @ d_flat
        grads["filter_bias"] += d_flat.sum(axis=0)
        # A window is two strides wide: its halves fall on whole strides.
        halves = (d_flat @ self.weights["filters"].T).reshape(len(body), POSITIONS, 2, STRIDE * EMBED)
        d_body = np.zeros((len(body), POSITIONS + 1, STRIDE * EMBED), np.float32)
        d_body[:, :-1] += halves[:, :, 0]
        d_body[:, 1:] += halves[:, :, 1]
        d_body = d_body.reshape(len(body), -1, EMBED)
        by_byte = body.ravel()
        grads["embed"] += np.stack([np.bincount(by_byte, d_body[:, :, e].ravel(), 256) for e in range(EMBED)], axis=1).astype(np.float32)


def fit(samples: list[tuple[int, str]], class_weight: dict[int, float], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over the whole texts of the sample in a fixed order; without two
    classes the network stays untrained but for the bias."""
    network = Network(seed=seed)
    w = network.weights
    classes = {label for label, _ in samples}
    if len(classes) < 2:
        w["out"][:] = 0
        w["out_bias"][:] = 0 if not classes else (4 if classes == {1} else -4)
        return network
    rows = [segments(text) for _, text in samples]
    sizes = np.array([len(x) for x in rows])
    target = np.array([float(label) for label, _ in samples], np.float32)
    weight = np.array([class_weight[label] for label, _ in samples], np.float32)
    weight /= BATCH * weight.mean()
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order, at = rng.permutation(len(rows)), 0
        while at < len(order):
            held = np.cumsum(sizes[order[at : at + BATCH]])
            pick = order[at : at + max(1, int(np.searchsorted(held, BLOCK, side="right")))]
            at += len(pick)
            grads = network.gradients([rows[i] for i in pick], target[pick], weight[pick])
            step += 1
            rate = 4e-3 * (1 - (epoch + at / (len(order) + 1)) / epochs)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def learn(labels: DataFrame, docs: DataFrame, key: str, text: str, label: str, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Fit on the texts of a bounded sample of each class; weights restore the
    share that the classes have among all labelled rows. Labels other than 0
    and 1, and those without a document, don't take part."""
    known = labels.where(F.col(label).isin(0, 1)).select(key, label)
    shares = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    samples = bounded_sample(known, docs, key, label, text, per_class)
    seen = {c: sum(1 for x, _ in samples if x == c) for c in shares}
    network = fit(samples, {c: shares[c] / max(1, seen[c]) for c in shares})
    del samples
    release_memory()
    return network


def predict(df: DataFrame, network: Network, threshold: float, text: str = "text", keep: list[str] = ["doc_id"], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:  # noqa: B006
    """The columns ``keep``, score (0 to 1) and predicted (score >= threshold),
    the last two under ``names``.

    A null text counts as empty, and empty texts have a score too. Repeated
    rows stay; other columns of ``df`` don't matter, and a kept one that is
    named like an output gives way to it.
    """
    weights = network.weights

    def task():
        own = Network(weights)

        def made(texts: list[str]) -> list[pa.Array]:
            score = own.score(texts)
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

        return made

    return with_outputs(df, text, keep, dict(zip(names, (T.DoubleType(), T.IntegerType()))), task)
