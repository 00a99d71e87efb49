"""Words of whole arrays of texts are those of the texts one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from archivum.llm import lm

TEXTS = ["", None, " ", "a", " A\tb\n\nC\r\x0b\x0c ", "".join(map(chr, range(128))), "".join(f"x{chr(c)}Y" for c in range(128)), "É ß Ж İK é", "ends ", " begins", "a" * 70_000, "😀 \u0085 \x1c\x1d\x1e\x1f z"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_split_gives_the_words_of_each_text(kind):
    for texts in (TEXTS, TEXTS[::-1], ["", None], []):
        found, ends = lm.split(pa.array(texts, kind))
        flat = found.to_pylist()
        assert len(ends) == len(texts) + 1
        assert [flat[a:b] for a, b in zip(ends[:-1], ends[1:])] == [lm.words(t) for t in texts]
    found, ends = lm.split(pa.array(["gone x", *TEXTS], kind).slice(1))
    assert [found.to_pylist()[a:b] for a, b in zip(ends[:-1], ends[1:])] == [lm.words(t) for t in TEXTS]


@pytest.mark.parametrize("listed", [[], [b"b", b"a", b""], [b"%d" % k for k in range(5000)]])
def test_places_are_those_of_the_list_in_short_and_long_arrays(listed):
    places, right = lm.Places(listed), {x: k for k, x in enumerate(listed)}
    for found in ([], [b"a", b"7", b"zz", b"b"], [b"%d" % (k * 3) for k in range(8000)]):
        at = places.of(pa.array(found, pa.binary()))
        assert at.tolist() == [right.get(x, len(listed)) for x in found] and at.dtype == np.int32


def test_counts_of_a_task_that_holds_few_words_add_up(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 10)
    texts = [f"w{k % 40} W{k % 7} é{k}" for k in range(300)] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 5], pa.string())], names=["text"]) for k in range(0, len(texts), 5)]
    made = [x for batch in lm.counted(iter(batches)) for x in batch.to_pylist()]
    found = Counter()
    for x in made:
        found[x["word"]] += x["n"]
    assert found == Counter(w for t in texts for w in lm.words(t)) and len(made) > len(found)
    assert [*lm.counted(iter([]))] == []


@pytest.mark.parametrize("looked", [0, 9, 1 << 20])
def test_batches_that_are_looked_up_together_keep_their_own_words(monkeypatch, looked):
    monkeypatch.setattr(lm, "LOOKED", looked)
    texts = [["a b", None, "c"], [], ["", "b b b"], ["d a"] * 5, [" "]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in texts]
    for listed in ([b"a", b"b", b"c"], [b"%d" % k for k in range(999)] + [b"b"]):
        made = list(lm.placed(iter(batches), lm.Places(listed)))
        assert [b for b, *_ in made] == batches
        assert [[found.to_pylist()[i:j] for i, j in zip(ends[:-1], ends[1:])] for _, found, ends, _ in made] == [[lm.words(t) for t in x] for x in texts]
        assert [at.tolist() for *_, at in made] == [[listed.index(w) if w in listed else len(listed) for t in x for w in lm.words(t)] for x in texts]
