"""Language identification by compression.

Every language has a zstandard raw-content dictionary made of training texts.
A text is encoded whole with each dictionary; the smallest size wins, and the
prediction is marked as rejected where the runner-up is too near.

Texts are folded first: lower case, and every run of other characters than
letters becomes one blank, so that layout and capitals say nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivum.llm._shared import bounded_sample, with_outputs

#: Bytes of folded training text in a language's dictionary.
DICTIONARY_BYTES = 65_536
#: At most so many whole training texts are fetched for a language, those with
#: the smallest hash of the key (and SAMPLE_BYTES of them).
SAMPLE_TEXTS = 300
#: Words of the pieces that a dictionary is drawn from.
PIECE_WORDS = 24
LEVEL = 9
#: Rejected where the runner-up is less than this share larger.
MARGIN = 0.01
#: Predicted for texts without a letter.
UNDETERMINED = "und"

_not_letters = regex.compile(r"\P{L}+")
_letter = regex.compile(r"\p{L}")


def fold(text: str) -> str:
    return _not_letters.sub(" ", text.lower())


def pieces(text: str) -> list[str]:
    """The folded lines of the whole text, PIECE_WORDS words at a time."""
    found = []
    for line in text.split("\n"):
        words = fold(line).split()
        found += [" ".join(words[at : at + PIECE_WORDS]) for at in range(0, len(words), PIECE_WORDS)]
    return found


def dictionaries(samples: list[tuple[str, str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, of pieces drawn by hash from all over
    its texts until ``size`` is reached. Pieces that several languages share
    (licences, boilerplate) and repeats of a piece are left out."""
    own_pieces: dict[str, set[str]] = {}
    for lang, text in samples:
        own_pieces.setdefault(lang, set()).update(pieces(text))
    users = Counter(x for own in own_pieces.values() for x in own)
    made = {}
    for lang, own in own_pieces.items():
        unique = [x for x in own if users[x] == 1] or own
        drawn, room = [], size
        for data in sorted((x.encode("utf-8", "replace") for x in unique), key=lambda x: (zlib.crc32(x), x)):
            drawn.append(data[:room])
            room -= len(data) + 1
            if room <= 0:
                break
        made[lang] = b" ".join(drawn)
    return {lang: data for lang, data in made.items() if len(data) >= 8}


class Classifier:
    def __init__(self, by_language: dict[str, bytes], margin: float = MARGIN):
        self.languages = sorted(by_language)
        self.margin = margin
        self.encoders, self.fine = [], []
        shortest = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False)
        for lang in self.languages:
            shared = zstandard.ZstdCompressionDict(by_language[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False))
            shared = zstandard.ZstdCompressionDict(by_language[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=shortest)
            self.fine.append(zstandard.ZstdCompressor(compression_params=shortest, dict_data=shared))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence and whether it is rejected. Ties are encoded
        anew with matches of three bytes; those still tied go to the language
        first in the alphabet, and are rejected."""
        if not text or not _letter.search(text) or not self.encoders:
            return UNDETERMINED, 0.0, True
        data = fold(text).encode("utf-8", "replace")
        sizes = np.array([len(x.compress(data)) for x in self.encoders], float)
        if len(sizes) > 1 and (sizes == sizes.min()).sum() > 1:
            sizes = np.array([len(x.compress(data)) for x in self.fine], float)
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        gap = (others.min() / sizes[best] - 1) if len(others) else 1.0
        weights = np.exp(-50 * (sizes / sizes[best] - 1))
        return self.languages[best], float(weights[best] / weights.sum()), bool(gap < self.margin)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries from the rows of ``df`` with a language and a text.

    An empty table gives none, and then every text is undetermined.
    """
    return dictionaries(bounded_sample(df.where(F.col(text).isNotNull()), df, key, lang, text, SAMPLE_TEXTS))


def predict(df: DataFrame, by_language: dict[str, bytes], text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``keep`` and lang_pred, score, rejected.

    Null texts and texts without a letter are ``und`` with score 0, rejected.
    Repeated rows stay; other columns of ``df`` don't matter, and a kept one
    that is named like an output gives way to it.
    """

    def task():
        classify = Classifier(by_language)

        def made(texts: list[str]) -> list[pa.Array]:
            return [pa.array(column, kind) for column, kind in zip(zip(*map(classify, texts)), (pa.string(), pa.float64(), pa.bool_()))] if texts else [pa.array([], kind) for kind in (pa.string(), pa.float64(), pa.bool_())]

        return made

    return with_outputs(df, text, keep, {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}, task)
