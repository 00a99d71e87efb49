"""Toxicity by weak supervision.

Voters (words of a lexicon, words and word beginnings that the labels single
out, and patterns) vote toxic or abstain on a text. A generative label model has, for
either class, the probability of each vote, estimated by expectation and
maximisation from all sampled texts, the labelled classes serving as a start
and as soft evidence. It also estimates which voters agree beyond what the
class explains (correlation of what is left of their votes given the class);
those share one vote's weight. A linear classifier over voters, words and word
beginnings is then trained on the posteriors, and scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivum.llm._shared import bounded_sample, release_memory, with_outputs

#: Insults, in alphabetical order.
LEXICON = [
    "bastard", "clown", "coward", "creep", "cretin", "degenerate", "despicable", "dimwit", "disgusting", "dumb",
    "fool", "freak", "garbage", "hate", "idiot", "idiotic", "imbecile", "jerk", "kill", "liar", "loser", "lowlife",
    "maggot", "moron", "moronic", "nasty", "parasite", "pathetic", "pervert", "pig", "rat", "retard", "scum", "shut",
    "slime", "sucker", "stupid", "trash", "ugly", "vermin", "vile", "worthless",
]
#: Patterns over lower-case text.
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are) (?:an? |such an? |all |so )?\w+"),
    "shut_up": re.compile(r"\bshut up\b|\bgo away\b|\bget lost\b"),
    "hate_you": re.compile(r"\bi hate\b|\bhate you\b|\bdespise\b"),
    "masked": re.compile(r"\b\w+[*@#$]{2,}\w+\b"),
}
#: Labelled texts of each class that the voters and the models are fitted on.
SAMPLE_PER_CLASS = 1500
#: Words and beginnings that the labels single out become voters: so many at
#: most, each in so many toxic texts at least, and so many times as frequent.
MINED, MINED_TEXTS, MINED_LIFT = 400, 4, 12.0
#: Lengths of word beginnings, which stand for a word with any ending.
BEGINNINGS = (4, 5, 6, 7)
#: The classifier knows the most frequent words and beginnings: so many at
#: most, each in so many sampled texts at least.
KNOWN, KNOWN_TEXTS = 20_000, 5
#: Voters whose votes correlate more than this given the class share their
#: weight; who they are is estimated anew after so many rounds.
CORRELATED, ROUNDS_APART = 0.3, 5
ROUNDS = 25
WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    """The text's words, and their beginnings (with ``*``)."""
    own = set(WORD.findall((text or "").lower()))
    found = set(own)
    for n in BEGINNINGS:
        found.update([w[:n] + "*" for w in own if len(w) >= n])
    return found


class Voters:
    def __init__(self, mined: list[str]):
        self.names = [*LEXICON, *(w for w in mined if w not in LEXICON), *PATTERNS]
        self.place = {w: k for k, w in enumerate(self.names) if w not in PATTERNS}
        self.patterns = [(len(self.place) + k, p) for k, p in enumerate(PATTERNS.values())]

    def votes(self, text: str | None, own: set[str] | None = None) -> list[int]:
        """The voters that vote toxic; the others abstain."""
        own = words(text) if own is None else own
        found = [self.place[w] for w in own & self.place.keys()]
        low = (text or "").lower()
        return found + [k for k, p in self.patterns if p.search(low)]


def mined_words(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """The words by which the labels tell toxic texts, best first."""
    one, other = Counter(w for x in toxic for w in x), Counter(w for x in clean for w in x)
    scored = []
    for word, n in one.items():
        lift = (n / max(1, len(toxic))) / ((other[word] + 0.5) / max(1, len(clean)))
        if n >= MINED_TEXTS and lift >= MINED_LIFT:
            scored.append((-n * np.log(lift), word))
    return [w for _, w in sorted(scored)[:MINED]]


def shared_weight(votes: np.ndarray, posterior: np.ndarray, p1: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """Each voter's weight: one over the number of voters, itself included,
    whose votes go with its own when the class is known. Voters that agree
    because the class makes them vote keep their weight."""
    rest = votes - (posterior[:, None] * p1 + (1 - posterior)[:, None] * p0)
    scale = np.sqrt((rest**2).sum(axis=0)) + 1e-9
    alike = (np.abs((rest.T @ rest) / np.outer(scale, scale)) > CORRELATED) & (votes.sum(axis=0) > 0)[:, None]
    return 1.0 / np.maximum(1, alike.sum(axis=0))


def label_model(votes: np.ndarray, weak: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of toxic, the log ratio that each voter's vote adds, and the
    voters' weights.

    ``votes`` is (texts, voters) of 0 and 1, ``weak`` the labelled class, right
    with the accuracy that the model itself estimates.
    """
    n, k = votes.shape
    posterior = np.where(weak == 1, 0.9, 0.1 * prior)
    weight, ratio = np.ones(k), np.zeros(k)
    for step in range(ROUNDS):
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        p1 = (posterior @ votes + 0.5) / (toxic + 1)
        p0 = ((1 - posterior) @ votes + 0.5) / (clean + 1)
        if step % ROUNDS_APART == 0:
            weight = shared_weight(votes, posterior, p1, p0)
        ratio = np.clip(np.log(p1 / p0), -4, 6) * weight
        silent = np.clip(np.log((1 - p1) / (1 - p0)), -2, 2) * weight
        right1 = (posterior @ weak + 1) / (toxic + 2)
        right0 = ((1 - posterior) @ weak + 1) / (clean + 2)
        rate = np.clip(toxic / n, 0.01, 0.99)
        score = np.log(rate / (1 - rate)) + votes @ ratio + (1 - votes) @ silent
        score += np.where(weak == 1, np.log(right1 / right0), np.log((1 - right1) / (1 - right0)))
        posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return posterior, ratio, weight


class Classifier:
    """Logistic regression over voters, words and word beginnings."""

    def __init__(self, voters: Voters, known: list[str], weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias
        self.known = {w: len(voters.names) + k for k, w in enumerate(known)}

    def inputs(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        own = words(text)
        marks = self.voters.votes(text, own)
        common = [self.known[w] for w in own & self.known.keys()]
        size = np.concatenate((np.ones(len(marks)), np.full(len(common), 1 / np.sqrt(1 + len(common)))))
        return np.array([*marks, *common], np.int64), size

    def __call__(self, text: str | None) -> float:
        where, size = self.inputs(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[where] @ size + self.bias, -30, 30))))


def fit(samples: list[tuple[int, str]], shares: dict[int, float]) -> Classifier:
    """On a bounded sample of (label, text); ``shares`` are the labels' counts
    among all. Without a toxic text only the lexicon speaks."""
    sets = [words(t) for _, t in samples]
    weak = np.array([label for label, _ in samples], float)
    mined = mined_words([s for s, y in zip(sets, weak) if y], [s for s, y in zip(sets, weak) if not y])
    voters = Voters(mined)
    k = len(voters.names)
    texts_with = Counter(w for own in sets for w in own)
    known = sorted((w for w, n in texts_with.items() if n >= KNOWN_TEXTS), key=lambda w: (-texts_with[w], w))[:KNOWN]
    model = Classifier(voters, known, np.concatenate((np.full(k, 2.0), np.zeros(len(known)))), -3.0)
    if not weak.any() or weak.all():
        return model
    votes = np.zeros((len(samples), k))
    for i, ((_, text), own) in enumerate(zip(samples, sets)):
        votes[i, voters.votes(text, own)] = 1
    posterior, ratio, _ = label_model(votes, weak, shares[1] / (shares[0] + shares[1]))
    inputs = [model.inputs(t) for _, t in samples]
    lengths = np.array([len(w) for w, _ in inputs])
    where, size = np.concatenate([w for w, _ in inputs]), np.concatenate([s for _, s in inputs])
    row = np.repeat(np.arange(len(samples)), lengths)
    seen = np.bincount(weak.astype(int), minlength=2)
    importance = np.where(weak == 1, shares[1] / seen[1], shares[0] / seen[0])
    importance /= importance.sum()
    w, bias = np.concatenate((np.maximum(ratio, 0) / 2, np.zeros(len(known)))), float(np.log(shares[1] / shares[0]))
    speed = np.full(len(w), 1e-8)
    bias_speed = 1e-8
    penalty = np.concatenate((np.full(k, 1e-5), np.full(len(known), 2e-4)))
    for _ in range(300):  # Adagrad over the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[where] * size, len(samples)) + bias, -30, 30)))
        slope = (p - posterior) * importance
        grad = np.bincount(where, slope[row] * size, len(w)) + penalty * w
        speed += grad**2
        w = w - 0.5 * grad / np.sqrt(speed)
        bias_speed += slope.sum() ** 2
        bias -= 0.5 * slope.sum() / np.sqrt(bias_speed)
    return Classifier(voters, known, w, bias)


def learn(labels: DataFrame, docs: DataFrame, key: str, text: str, label: str, per_class: int = SAMPLE_PER_CLASS) -> Classifier:
    """Fit on the texts of a bounded sample of each class. Labels other than 0
    and 1, and those without a document, don't take part."""
    known = labels.where(F.col(label).isin(0, 1)).select(key, label)
    shares = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    model = fit(bounded_sample(known, docs, key, label, text, per_class), shares)
    release_memory()
    return model


def predict(df: DataFrame, model: Classifier, threshold: float = 0.5, text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``keep``, score (0 to 1) and predicted (score >= threshold).

    A null text counts as empty, and empty texts have a score too. Repeated
    rows stay; other columns of ``df`` don't matter, and a kept one that is
    named like an output gives way to it.
    """

    def task():
        def made(texts: list[str]) -> list[pa.Array]:
            score = np.array([model(x) for x in texts], float)
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

        return made

    return with_outputs(df, text, keep, {"score": T.DoubleType(), "predicted": T.IntegerType()}, task)
