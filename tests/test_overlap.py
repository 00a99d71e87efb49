"""Candidate pairs of the contradiction check against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivum.functions import text as T
from archivum.operators import overlap, similarity


def made(rng, rows):
    """Sets of very uneven words, of 1 to 400, with near copies and copies."""
    p = 1 / np.arange(1, 5001)
    sets = [set(rng.choice(5000, int(rng.choice([1, 3, 12, 60, 400])), p=p / p.sum()).tolist()) for _ in range(rows)]
    for k in range(rows // 4):
        near = set(list(sets[k])[: max(1, int(len(sets[k]) * rng.uniform(0.5, 1.0)))])
        sets.append(near | set(rng.integers(0, 5000, int(len(near) * rng.uniform(0, 0.3))).tolist()))
    return sets


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.8, 1.0])
def test_no_similar_pair_is_lost_and_few_others_are_kept(monkeypatch, threshold):
    monkeypatch.setattr(overlap, "CELLS", 3000)
    monkeypatch.setattr(overlap, "COMMON", 5000)
    monkeypatch.setattr(overlap, "CHECKED", 10)
    rng = np.random.default_rng(1)
    sets, scatter = made(rng, 300), rng.integers(-(2**63), 2**63 - 1, 5000)
    frequent = [int(scatter[k]) for k in range(199, -1, -1)]
    rows = pa.table({"tenant_id": ["a"] * len(sets), "category": ["b"] * len(sets), "node": list(range(len(sets))), "tokens": pa.array([[int(scatter[w]) for w in s] for s in sets], pa.list_(pa.int64()))})
    halves = [pa.Table.from_batches(list(overlap._prefixes(frequent, threshold, left)(rows.to_batches()))) for left in (True, False)]
    both = pa.concat_tables(halves)
    found = []
    for band in set(both["band"].to_pylist()):
        block = overlap._pairs(threshold)(both.filter(pa.compute.equal(both["band"], band)))
        found += zip(block["left_node"].to_pylist(), block["right_node"].to_pylist())
    wanted = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(a & b) >= threshold * len(a | b) - 1e-9 and a & b}
    assert len(found) == len(set(found)) and wanted and wanted <= set(found)
    assert len(found) <= 3 * len(wanted)


def test_whole_sets_are_dealt_once_and_not_once_a_pair(spark, monkeypatch):
    """Near copies and copies of them: far more pairs than sets."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[: 60 - k % 20] + [f"own{k}"]) for k in range(40)]
    rows = spark.createDataFrame([(3 * k + n, "t", "c", "active", text, str(k)) for k, text in enumerate(texts) for n in range(3)], "id long, tenant_id string, category string, lifecycle string, content string, content_hash string")
    dealt, scored = [], overlap.scored
    monkeypatch.setattr(overlap, "scored", lambda sets, pairs, threshold: dealt.append((sets, pairs)) or scored(sets, pairs, threshold))
    found = similarity.similar_texts(rows, rows, T.content_tokens(F.col("content")), F.col("content_hash"), 0.6).collect()
    sets = {str(k): set(text.split()) for k, text in enumerate(texts)}
    wanted = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) >= 0.6 * len(x | y)}
    assert {(r.left, r.right): r.similarity for r in found} == wanted and len(found) == len(wanted) > 1000
    ((whole, pairs),) = dealt
    assert pairs.count() >= len(wanted) and whole.count() <= 4 * len(texts)


def test_parts_of_a_block_lose_no_pair(spark, monkeypatch):
    """Blocks cut to parts of few tokens, and classes of one node."""
    monkeypatch.setattr(overlap, "PART", 100)
    rng = np.random.default_rng(2)
    sets = made(rng, 200)
    rows = pa.table({"tenant_id": ["a"] * len(sets), "category": ["b"] * len(sets), "node": list(range(len(sets))), "tokens": pa.array([sorted(map(int, s)) for s in sets], pa.list_(pa.int64()))})
    both = pa.concat_tables([pa.Table.from_batches(list(overlap._prefixes([], 0.6, left)(rows.to_batches()))) for left in (True, False)])
    parts, found = set(), {}
    for band in set(both["band"].to_pylist()):
        block = overlap._pairs(0.6)(both.filter(pa.compute.equal(both["band"], band)))
        for part in set(block["part"].to_pylist()):
            pairs = block.filter(pa.compute.equal(block["part"], part))
            sides = [(left, node) for left, c in ((True, "left_node"), (False, "right_node")) for node in set(pairs[c].to_pylist()) for _ in range(2)]
            whole = pa.table({"on_left": [left for left, _ in sides], "node": [node for _, node in sides], "class": [str(node) for _, node in sides], "tokens": pa.array([sorted(map(int, sets[node])) for _, node in sides], pa.list_(pa.int64()))})
            parts.add((band, part))
            for r in overlap._scored(0.6)(whole, pairs).to_pylist():
                assert (r["left"], r["right"]) not in found and (r["tenant_id"], r["category"]) == ("a", "b")
                found[r["left"], r["right"]] = r["similarity"]
    wanted = {(str(i), str(j)): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a & b and len(a & b) >= 0.6 * len(a | b)}
    assert found == wanted and len(wanted) > 10 and len(parts) > len({band for band, _ in parts})


def test_a_block_gives_no_more_than_the_closest(spark, monkeypatch):
    """Near copies, many of them alike near: what is made of the pairs grows as
    the sets, and the best ids are those of all pairs."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[: 60 - k % 20] + [f"own{k}"]) for k in range(60)]
    rows = spark.createDataFrame([(7 * k % 60 + 60 * n, "t", "c", "active", text, str(k)) for k, text in enumerate(texts) for n in range(3)], "id long, tenant_id string, category string, lifecycle string, content string, content_hash string")
    made, closest = [], overlap.closest
    monkeypatch.setattr(overlap, "closest", lambda *a: made.append((a[1], closest(*a))) or made[-1][1])
    found = {(r.left_id, r["rank"]): (r.right_id, r.similarity) for r in similarity.contradictions(rows, rows, 0.6, 4).collect()}
    sets = [set(text.split()) for text in texts]
    wanted = {}
    for a, x in enumerate(sets):
        near = sorted((-len(x & y) / len(x | y), 7 * b % 60 + 60 * n) for b, y in enumerate(sets) if a != b and len(x & y) >= 0.6 * len(x | y) for n in range(3))
        wanted |= {(7 * a % 60 + 60 * n, k + 1): (right, -s) for n in range(3) for k, (s, right) in enumerate(near[:4])}
    assert found == wanted
    ((lists, pairs),) = made
    assert lists.count() <= 4 * len(texts) and pairs.count() <= 3 * 4 * len(texts)


def test_ids_that_are_no_integers_leave_no_pair_out(spark):
    rows = spark.createDataFrame([(f"m{k}", "t", "c", "active", " ".join(f"w{j}" for j in range(20)) + f" own{k}", str(k)) for k in range(12)], "id string, tenant_id string, category string, lifecycle string, content string, content_hash string")
    found = [(r.left_id, r["rank"], r.right_id) for r in similarity.contradictions(rows, rows, 0.6, 2).collect()]
    names = sorted(f"m{k}" for k in range(12))
    assert sorted(found) == sorted((a, k + 1, b) for a in names for k, b in enumerate([x for x in names if x != a][:2]))
