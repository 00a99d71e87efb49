"""Language-model scores of whole documents.

Word counts come from all training texts. The model is a gated recurrent
network in numpy over the most frequent words, more of them the more distinct
words there are: started by truncated backpropagation on a bounded sample, then
trained on every training text by a copy in each task, whose weights are
averaged; its output softmax factored into classes of words, its state carried
from window to window through a whole document.
A word outside its vocabulary has the probability that the network gives to
"another word", times the word's share of the counts of such words.

Counts of the frequent words (HOT, bounded) are looked up in each task; rarer
words of the documents are joined with the counts table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm._shared import HASHES, bounded_sample, for_python, release_memory, stored

#: Words whose counts every task has, at most.
HOT = 131_072
#: Words that are looked up at once, about; a table of HOT is made for each time.
LOOKED = 800_000
#: A task hands on its counts when it holds so many words.
HELD = 400_000
#: Classes, and words of a class, at least (see ``side_for``).
CLASSES = 32
HIDDEN = 16
WINDOW, LANES = 24, 48
SAMPLE_TEXTS, EPOCHS = 1200, 2
#: Streams side by side and rate of the pass over all texts, and parts in which
#: the tasks' weights are averaged.
WIDE, RATE, PARTS = 512, 0.002, 64
#: Tokens of a step of fitting, about.
TOKENS = 400_000
#: Steps of a window of scoring, or as many as have so many tokens, and tokens
#: scored together: the more, the fewer steps of few documents.
STEPS, TOGETHER, SCORED = 16, 32_768, 1_600_000
#: Rows of class logits made at a time: they stay in a core's cache.
ROWS = 2_048
#: Documents scored together, at most.
SIDE_BY_SIDE = 8_000


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of texts end to end, and where those of each begin and the
    last end, without an object for each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves an empty text
    if not full.all():
        flat, ends = flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[ends]
    return flat.cast(pa.binary()), ends


class Places:
    """Where words are in a list; its length for others. An array is looked up
    as a whole in a table made for it, a short one in a dictionary."""

    def __init__(self, listed: list[bytes]):
        self.listed, self.place = pa.array(listed, pa.binary()), None

    def of(self, found: pa.Array) -> np.ndarray:
        cold = len(self.listed)
        if len(found) * 8 >= cold:
            return pc.index_in(found, value_set=self.listed).fill_null(cold).to_numpy()
        if self.place is None:
            self.place = {x: k for k, x in enumerate(self.listed.to_pylist())}
        return np.array([self.place.get(x, cold) for x in found.to_pylist()], np.int32)


def placed(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Batches with what ``split`` gives of their first column, and the places
    of its words. Batches of LOOKED words are looked up as one array."""
    held, size = [], 0

    def out():
        at, start = places.of(pa.concat_arrays([found for _, found, _ in held])), 0
        for batch, found, ends in held:
            yield batch, found, ends, at[start : start + len(found)]
            start += len(found)

    for batch in batches:
        held.append((batch, *split(batch.column(0))))
        size += len(held[-1][1])
        if size >= LOOKED:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and n of a task's texts; a word comes again after HELD others."""
    held: list[pa.Table] = []

    def grouped() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        values, counts = pc.value_counts(split(batch.column(0))[0]).flatten()
        held.append(pa.table({"word": values, "n": counts}))
        if sum(map(len, held)) > 2 * HELD:
            held = [grouped()]
            if len(held[0]) > HELD:
                yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from grouped().combine_chunks().to_batches()
    held.clear()
    release_memory()


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (binary) and n over all rows, pre-aggregated in each task."""
    for_python(docs.sparkSession)
    parts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(counted, "word binary, n long")
    return stored(parts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def hot_words(counts: DataFrame, most: int = HOT) -> dict[bytes, int]:
    """The most frequent words, about ``most``: all those above a count that a
    histogram (eighths of powers of two) shows to be rare enough, and of the
    next step those with the smallest hashes, as many as there is room for."""
    step = F.floor(F.log2("n") * 8)
    room, least, share = most, 1 << 20, 1.0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        least, share = row.step, min(1.0, room / row["count"])
        room -= row["count"]
        if room <= 0:
            break
    last = (step == least) & (F.pmod(F.xxhash64("word"), F.lit(HASHES)) < int(HASHES * share))
    return {bytes(r.word): r.n for r in counts.where((step > least) | last).collect()}


def side_for(distinct: int) -> int:
    """Classes of the network, and words of each: their product grows as twice
    the square root of the distinct words."""
    return max(CLASSES, int(np.ceil(np.sqrt(2 * np.sqrt(distinct)))))


def order_of(values: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of numbers below ``limit``; small types are sorted by radix."""
    return np.argsort(values.astype(np.uint16) if limit <= 1 << 16 else values, kind="stable")


def with_one(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in this order, each with a 1 behind it, that a bias is
    multiplied by: a product adds it without another pass."""
    out = np.ones((len(states), HIDDEN + 1), states.dtype)
    out[:, :HIDDEN] = states
    return out.take(order, axis=0)


def advance(to_gates: np.ndarray, to_new: np.ndarray, state: np.ndarray, by_gates: np.ndarray, by_new: np.ndarray):
    """The next state of a cell, its gates (reset, keep), its new state and that
    before the reset, from what tokens add and weights that lie apart as those
    of ``Network.apart``. Work is done in place: most of the time goes into
    passing over these arrays."""
    gates = state @ by_gates
    gates += to_gates
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    inner = state @ by_new
    new = gates[0] * inner
    new += to_new
    np.tanh(new, out=new)
    out = state - new
    out *= gates[1]
    out += new
    return out, gates, new, inner


def parts(ends: list[int]) -> Iterator[tuple[slice, list[tuple[int, slice]]]]:
    """Parts of at most ROWS rows, which lie in order of their classes; and the
    classes of each part with their rows in it."""
    at, kind = 0, 0
    while at < ends[-1]:
        stop, start, found = min(at + ROWS, ends[-1]), at, []
        while start < stop:
            if ends[kind] <= start:
                kind += 1
                continue
            end = min(ends[kind], stop)
            found.append((kind, slice(start - at, end - at)))
            start = end
        yield slice(at, stop), found
        at = stop


class Network:
    """Tokens are numbered by falling frequency: 0 the end, 1 another word,
    then words; token // side is a token's class."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 11, side: int = CLASSES):
        if weights is None:
            rng = np.random.default_rng(seed)
            normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
            tokens, h = side * side, HIDDEN
            weights = {
                "input": normal(tokens, 3 * h, scale=0.1),
                "state": normal(h, 3 * h, scale=h**-0.5),
                "class": normal(h, side, scale=0.1),
                "class_bias": np.zeros(side, np.float32),
                "word": normal(side, h, side, scale=0.1),
                "word_bias": np.zeros((side, side), np.float32),
            }
        self.weights, self.side = weights, len(weights["class_bias"])

    def start(self, counts: np.ndarray) -> None:
        """Biases that make the untrained network a unigram model."""
        share = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts))).reshape(self.side, self.side)
        top = share.max(axis=1, keepdims=True)
        self.weights["class_bias"] = (top[:, 0] + np.log(np.exp(share - top).sum(axis=1))).astype(np.float32)
        self.weights["word_bias"] = share.astype(np.float32)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes, and of the words of each, with their biases as a
        last row."""
        w = self.weights
        return np.vstack((w["class"], w["class_bias"][None])), np.concatenate((w["word"], w["word_bias"][:, None]), axis=1)

    def apart(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the two gates, negated, and of the new state. All three
        lie apart, as NumPy is slow on parts of short rows."""
        reset, keep, new = np.hsplit(self.weights[name], 3)
        return np.negative((reset, keep)), new.copy()

    def step(self, tokens: np.ndarray, state: np.ndarray):
        """The next state, both gates, and what the backward pass needs."""
        gates, new = self.apart("input")
        return advance(gates.take(tokens, axis=1), new.take(tokens, axis=0), state, *self.apart("state"))

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs of the targets' probabilities after these states."""
        by_class, by_word = self.heads()
        kinds, words = np.divmod(targets, self.side)
        order = order_of(kinds, self.side)
        ends = np.cumsum(np.bincount(kinds, minlength=self.side)).tolist()
        states, kinds, words = with_one(states, order), kinds[order], words[order]
        logs, ones, cells = np.empty(len(kinds), states.dtype), np.ones(self.side, states.dtype), np.arange(ROWS) * self.side
        made = np.empty((min(ROWS, len(kinds)), self.side), states.dtype)

        def shares(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
            own = logits.ravel().take(cells[: len(right)] + right)
            own -= np.log(np.exp(logits, out=logits) @ ones)
            return own

        for part, found in parts(ends):
            rows = states[part]
            logits = np.matmul(rows, by_class, out=made[: len(rows)])
            logs[part] = shares(logits, kinds[part])
            for kind, its in found:
                np.matmul(rows[its], by_word[kind], out=logits[its])
            logs[part] += shares(logits, words[part])
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole documents (token arrays without the
        end). Documents run side by side, longest first; states carry over
        from window to window."""
        if not documents:
            return np.zeros(0)
        lengths = np.array([len(d) + 1 for d in documents])
        order = np.argsort(-lengths, kind="stable")
        # Before each document there is an end: that of another, or one added.
        flat, begins = np.append(np.int32(0), streamed(documents)[0]), (np.cumsum(lengths) - lengths)[order]
        longer = np.searchsorted(lengths[order[::-1]], np.arange(lengths.max()), side="right")
        beside = (len(documents) - longer).astype(np.int32)  # step t takes the first beside[t] documents
        total = np.zeros(len(documents))
        state = np.zeros((len(documents), HIDDEN), np.float32)
        (gates, new), weights, begin = self.apart("input"), self.apart("state"), 0
        while begin < len(beside):
            n = beside[begin : begin + TOGETHER]
            ends = np.cumsum(n, dtype=np.int64)
            steps = max(STEPS, int(np.searchsorted(ends, TOGETHER, side="right")))
            n, ends = n[:steps], ends[:steps]
            owners = np.arange(ends[-1]) - np.repeat(ends - n, n)
            places = begins.take(owners) + np.repeat(np.arange(begin, begin + len(n)), n)
            before = flat.take(places)
            to_gates, to_new = gates.take(before, axis=1), new.take(before, axis=0)
            states = np.empty(to_new.shape, np.float32)
            for start, end in zip((ends - n).tolist(), ends.tolist()):
                state = advance(to_gates[:, start:end], to_new[start:end], state[: end - start], *weights)[0]
                states[start:end] = state
            total[: n[0]] += np.bincount(owners, self.log_probabilities(states, flat.take(places + 1)), n[0])
            begin += len(n)
        out = np.empty(len(documents))
        out[order] = total
        return out

    def gradients(self, tokens: np.ndarray, targets: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """Of the mean loss over a window (steps, lanes), and the last state.
        ``fresh`` marks where a document begins and the state is zero."""
        w, h = self.weights, HIDDEN
        steps, lanes = tokens.shape
        (gates, new), recurrent, trace = self.apart("input"), self.apart("state"), []
        to_gates, to_new = gates.take(tokens, axis=1), new.take(tokens, axis=0)
        for t in range(steps):
            begun = np.flatnonzero(fresh[t])
            if len(begun):
                state = state.copy()
                state[begun] = 0
            made = advance(to_gates[:, t], to_new[t], state, *recurrent)
            trace.append((begun, state, *made[1:], made[0]))
            state = made[0]
        flat = targets.ravel()
        kinds, words = np.divmod(flat, self.side)
        order = order_of(kinds, self.side)
        ends = np.cumsum(np.bincount(kinds, minlength=self.side)).tolist()
        kinds, words, scale = kinds[order], words[order], 1.0 / len(flat)
        states = with_one(np.concatenate([x[-1] for x in trace]), order)
        by_class, by_word = self.heads()
        ones, cells = np.ones(self.side, states.dtype), np.arange(ROWS) * self.side

        def slopes(logits: np.ndarray, right: np.ndarray) -> None:
            """Of the scaled loss by the logits, in their place."""
            np.exp(logits, out=logits)
            logits *= (scale / (logits @ ones))[:, None]
            logits.ravel()[cells[: len(right)] + right] -= scale

        d_class, d_word = np.zeros_like(by_class), np.zeros_like(by_word)
        by_kind, made = np.empty((len(flat), h), states.dtype), np.empty((min(ROWS, len(flat)), self.side), states.dtype)
        for part, found in parts(ends):
            own, back = states[part], by_kind[part]
            p = np.matmul(own, by_class, out=made[: len(own)])
            slopes(p, kinds[part])
            d_class += own.T @ p
            np.matmul(p, w["class"].T, out=back)
            for kind, its in found:
                np.matmul(own[its], by_word[kind], out=p[its])
            slopes(p, words[part])
            for kind, its in found:
                d_word[kind] += own[its].T @ p[its]
                back[its] += p[its] @ w["word"][kind].T
        grads = {"class": d_class[:h], "class_bias": d_class[h], "word": d_word[:, :h], "word_bias": d_word[:, h]}
        d_states = np.empty_like(by_kind)
        d_states[order] = by_kind
        d_states = d_states.reshape(steps, lanes, h)
        back = np.zeros((lanes, h), d_states.dtype)
        # By the new state, the gates, and the new state before the reset.
        d_sums, d_state = np.empty((4, steps, lanes, h), d_states.dtype), np.zeros((3, h, h), d_states.dtype)
        by_reset, by_keep, by_new = (np.ascontiguousarray(x.T) for x in np.hsplit(w["state"], 3))
        for t in range(steps - 1, -1, -1):
            begun, before, (reset, keep), new, inner, _ = trace[t]
            d_new, d_reset, d_keep, d_inner = d_sums[:, t]
            back += d_states[t]
            np.subtract(1, keep, out=d_new)
            d_new *= back
            np.multiply(new, new, out=d_inner)
            np.subtract(1, d_inner, out=d_inner)
            d_new *= d_inner
            np.multiply(d_new, reset, out=d_inner)
            np.subtract(1, reset, out=d_reset)
            d_reset *= d_inner
            d_reset *= inner
            back *= keep
            np.subtract(1, keep, out=d_keep)
            d_keep *= back
            np.subtract(before, new, out=new)
            d_keep *= new
            d_state += before.T @ d_sums[1:, t]
            back += d_reset @ by_reset
            back += d_keep @ by_keep
            back += d_inner @ by_new
            back[begun] = 0
        grads["state"] = np.hstack(d_state)
        order = order_of(tokens.ravel(), self.side**2)
        found = tokens.ravel()[order]
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        new, reset, keep = np.add.reduceat(d_sums[:3].reshape(3, -1, h).take(order, axis=1), starts, axis=1)
        grads["input"] = np.zeros_like(w["input"])
        grads["input"][found[starts]] = np.hstack((reset, keep, new))
        return grads, state


class Adam:
    """Steps of a network over windows of streams side by side."""

    def __init__(self, network: Network):
        self.network, self.steps = network, 0
        self.first = {k: np.zeros_like(v) for k, v in network.weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in network.weights.items()}

    def fit(self, stream: np.ndarray, begins: np.ndarray, lanes: int, length: int, window: int, rate) -> None:
        """``rate`` is a function of the number of the step."""
        w, first, second = self.network.weights, self.first, self.second
        targets = stream[: lanes * length].reshape(lanes, length).T
        fresh = begins[: lanes * length].reshape(lanes, length).T.copy()
        fresh[0] = True
        tokens = np.vstack((np.zeros((1, lanes), targets.dtype), targets[:-1]))
        tokens = np.where(fresh, 0, tokens)
        state = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, length, window):
            part = slice(at, at + window)
            grads, state = self.network.gradients(tokens[part], targets[part], fresh[part], state)
            self.steps += 1
            step = self.steps
            # Both corrections of the means, as numbers and not as arrays.
            root = (1 - 0.99**step) ** 0.5
            size = rate(step) * root / (1 - 0.9**step)
            for k, g in grads.items():
                change = g - first[k]
                change *= 0.1
                first[k] += change
                np.multiply(g, g, out=g)
                g -= second[k]
                g *= 0.01
                second[k] += g
                np.sqrt(second[k], out=change)
                change += 1e-8 * root
                np.divide(first[k], change, out=change)
                change *= size
                w[k] = w[k] - change


    def fit_stream(self, stream: np.ndarray, begins: np.ndarray, lanes: int, least: int, rate) -> tuple[np.ndarray, np.ndarray]:
        """Whole windows of ``lanes`` parts of the stream side by side, then the
        rest in fewer, until ``least`` tokens or fewer are left; those."""
        while len(stream) > least:
            wide = max(1, min(lanes, len(stream) // (4 * WINDOW)))
            window = min(WINDOW, len(stream))
            length = len(stream) // wide // window * window
            self.fit(stream, begins, wide, length, window, rate)
            stream, begins = stream[wide * length :], begins[wide * length :]
        return stream, begins


def streamed(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end, each with its end, and where each begins."""
    lengths = np.array([len(d) + 1 for d in documents], np.int64)
    stream, begins = np.zeros(lengths.sum(), np.int32), np.zeros(lengths.sum(), bool)
    for at, tokens in zip((np.cumsum(lengths) - lengths).tolist(), documents):
        stream[at : at + len(tokens)] = tokens
        begins[at] = True
    return stream, begins


def train(documents: list[np.ndarray], counts: np.ndarray, epochs: int = EPOCHS, seed: int = 11, side: int = CLASSES) -> Network:
    """Adam over windows of streams of whole documents, in a fixed order; all
    tokens are fitted in every epoch."""
    network = Network(seed=seed, side=side)
    network.start(counts)
    adam = Adam(network)
    rng = np.random.default_rng(seed)
    planned = epochs * (sum(len(d) + 1 for d in documents) // (LANES * WINDOW) + 1)
    for _ in range(epochs):
        if documents:
            stream, begins = streamed([documents[k] for k in rng.permutation(len(documents))])
            adam.fit_stream(stream, begins, LANES, 0, lambda step: 0.01 * max(0.02, 1 - step / (planned + 1)))
    return network


def fit_all(network: Network, documents: Iterator[np.ndarray]) -> int:
    """One pass over all documents, some TOKENS tokens at a time; tokens that
    fill no window of all streams wait for the next ones, and the last ones are
    taken in fewer streams. The number of tokens, all of them fitted."""
    adam = Adam(network)
    rest, fresh = np.zeros(0, np.int32), np.zeros(0, bool)
    held, size, done = [], 0, 0

    def fit(least: int) -> None:
        nonlocal rest, fresh, held, size
        stream, begins = streamed(held)
        held, size = [], 0
        rest, fresh = adam.fit_stream(np.concatenate((rest, stream)), np.concatenate((fresh, begins)), WIDE, least, lambda _: RATE)

    for tokens in documents:
        held.append(tokens)
        size += len(tokens) + 1
        done += len(tokens) + 1
        if size > TOKENS:
            fit(WIDE * 4 * WINDOW)
    if held or len(rest):
        fit(0)
    return done


def train_everywhere(training: DataFrame, text: str, network: Network, numbers: dict[bytes, int]) -> tuple[Network, int]:
    """``network`` after a pass of each task over its rows, their weights
    averaged by tokens; and the number of tokens, those of all rows. The
    average is taken in parts, so no task holds all weights of all tasks."""
    from pyspark import TaskContext

    shared = training.sparkSession.sparkContext.broadcast((numbers, network.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights = shared.value
        net, places, tokens = Network(dict(weights)), Places([*numbers]), np.array([*numbers.values(), 1], np.int32)

        def documents() -> Iterator[np.ndarray]:
            for _, _, ends, at in placed(batches, places):
                made = tokens[at]
                for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    yield made[start:end]

        n = fit_all(net, documents())
        flat = np.concatenate([net.weights[k].ravel() for k in sorted(net.weights)])
        release_memory()
        if n:
            for k, part in enumerate(np.array_split(flat, PARTS)):
                arrays = [pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "task", "n", "weights"])

    def mean(rows):
        rows = rows.sort_values("task")
        total = sum(np.frombuffer(w, np.float32).astype(float) * n for w, n in zip(rows["weights"], rows["n"]))
        rows, n = rows.iloc[:1].copy(), int(rows["n"].sum())
        rows["weights"], rows["n"] = [(total / n).astype(np.float32).tobytes()], [n]
        return rows[["part", "n", "weights"]]

    made = training.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "part int, task int, n long, weights binary")
    found = sorted(made.groupBy("part").applyInPandas(mean, "part int, n long, weights binary").collect())
    if not found:
        return network, 0
    flat, at, weights = np.concatenate([np.frombuffer(r.weights, np.float32) for r in found]), 0, {}
    for k in sorted(network.weights):
        old = network.weights[k]
        weights[k] = flat[at : at + old.size].reshape(old.shape)
        at += old.size
    return Network(weights), found[0].n


def score_documents(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``keep`` and n_tokens, n_known, train_tokens, base_score
    (add-half unigram) and score (the network), log10 of the whole text.

    Null texts are empty: the end alone. Repeated rows stay. Without training
    rows every token is unknown and the network untrained. Other columns of
    either table don't matter; a kept one that is named like an output gives
    way to it.
    """
    spark = docs.sparkSession
    for_python(spark)
    counts = word_counts(training, text)
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = training.count()
    total, distinct = row.n + ends, row.v + (1 if ends else 0)
    hot = hot_words(counts)
    ordered = sorted(hot, key=lambda x: (-hot[x], x))
    side = side_for(row.v)
    vocabulary = side * side - 2  # all but "another word" and the end
    numbers = {x: 2 + k for k, x in enumerate(ordered[:vocabulary])}
    inside = sum(hot[x] for x in numbers)
    other, other_distinct = row.n - inside, row.v - len(numbers)

    token_counts = np.zeros(side * side)
    token_counts[:2] = ends, other
    token_counts[2 : 2 + len(numbers)] = [hot[x] for x in numbers]
    sampled = bounded_sample(training.select(F.col(key).alias("k"), F.lit(0).alias("g"), F.col(text).alias("text")), training.select(F.col(key).alias("k"), F.col(text).alias("text")), "k", "g", "text", SAMPLE_TEXTS)
    lookup = lambda found: np.array([numbers.get(x, 1) for x in found], np.int32)
    network = train([lookup(words(t)) for _, t in sampled], token_counts, side=side)
    del sampled
    network, _ = train_everywhere(training, text, network, numbers)
    release_memory()

    base_floor, other_floor = np.log10(total + 0.5 * (distinct + 1)), np.log10(other + 0.5 * (other_distinct + 1))
    hot_counts = np.array([hot[x] for x in ordered], float)
    # Last: a word that isn't hot, whose terms are added after the join.
    base_terms = np.append(np.log10(hot_counts + 0.5) - base_floor, 0.0)
    other_terms = np.append(np.log10(hot_counts + 0.5) - other_floor, 0.0)
    other_terms[: len(numbers)] = 0.0
    end_term, end_known = float(np.log10(ends + 0.5) - base_floor), int(ends > 0)
    shared = spark.sparkContext.broadcast((ordered, network.weights, base_terms, other_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, weights, base_terms, other_terms = shared.value
        places, net, cold = Places(ordered), Network(weights), len(ordered)
        known_words = min(vocabulary, cold)
        item = pa.struct([("word", pa.binary()), ("n", pa.int64())])

        def out(rows: list[pa.RecordBatch], documents, sums) -> pa.RecordBatch:
            logs = net.score(documents) / np.log(10)
            n, known, base, extra, rare = zip(*sums)
            arrays = [c.combine_chunks() for c in pa.Table.from_batches(rows).columns]
            arrays += [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(logs + np.array(extra), pa.float64())]
            offsets = np.cumsum([0, *map(len, rare)])
            pairs = pa.StructArray.from_arrays([pa.array([w for c in rare for w in c], pa.binary()), pa.array([m for c in rare for m in c.values()], pa.int64())], fields=list(item))
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs))
            return pa.RecordBatch.from_arrays(arrays, names=inner)

        # Documents of several batches run side by side, so that a long one
        # isn't alone for most of its steps.
        rows, documents, sums, held = [], [], [], 0
        for batch, found, ends, at in placed(batches, places):
            done = 0
            tokens = np.where(at < known_words, at + 2, 1).astype(np.int32)
            rare_at = np.flatnonzero(at == cold)
            rare, rare_ends = found.take(pa.array(rare_at)).to_pylist(), np.searchsorted(rare_at, ends).tolist()
            bases, others = base_terms[at], other_terms[at]
            for i, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                unknown = rare[rare_ends[i] : rare_ends[i + 1]]
                documents.append(tokens[start:end])
                sums.append((end - start + 1, end - start - len(unknown) + end_known, float(bases[start:end].sum()) + end_term, float(others[start:end].sum()), Counter(unknown)))
                held += end - start
                if held > SCORED or len(sums) >= SIDE_BY_SIDE:
                    rows.append(batch.slice(done, i + 1 - done).select(range(1, batch.num_columns)))
                    yield out(rows, documents, sums)
                    rows, documents, sums, held, done = [], [], [], 0, i + 1
            if done < batch.num_rows:
                rows.append(batch.slice(done).select(range(1, batch.num_columns)))
        if sums:
            yield out(rows, documents, sums)
        release_memory()

    outputs = "n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,n:bigint>>"
    keep = [c for c in keep if c.lower() not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    inner = [*(f"k{i}" for i in range(len(keep))), "__row", "n_tokens", "n_known", "base_score", "score", "rare"]
    ready = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("__row"))
    names = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    made = ready.mapInArrow(run, f"{names}__row long, {outputs}")
    made = stored(made, "lm")  # the row numbers hold from here on

    rare = made.select("__row", F.explode("rare").alias("r")).select("__row", "r.word", F.col("r.n").alias("m")).join(counts, "word", "left")
    share = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    summed = rare.groupBy("__row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("known"),
        F.sum(F.col("m") * (share - F.lit(float(base_floor)))).alias("base"),
        F.sum(F.col("m") * (share - F.lit(float(other_floor)))).alias("other"),
    )
    joined = made.drop("rare").join(summed, "__row", "left")
    zero = F.lit(0.0)
    return joined.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("other", zero)).alias("score"),
    )
