"""Pairs of token sets that may be similar, counted block by block.

What is dealt out are the prefixes of sets under an order that has rare tokens
first, to blocks of sets of like size. A block counts common prefix tokens by
posting lists, in place, so no row is made for a common token. No pair at or
above the threshold is lost; most others are ruled out by the count. Whole sets
of the pairs that remain are then dealt to the block where a pair was found, once
each and not once a pair: pairs may grow as the square of the input. Where only the
closest sets are asked for (``listed`` and ``closest``), pairs are lists beside the
sets, not rows, and a block gives no more of a set's pairs than are asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.shipping import ship

#: Rows that frequencies are taken from, and tokens known as frequent. They set
#: the order of tokens alone: the pairs found are right under any order.
SAMPLE_ROWS, FREQUENT = 10_000, 50_000
CELLS, COMMON, CHECKED = 4_000_000, 8_000_000, 200_000
#: Tokens of left sets that are compared whole by one task.
PART = 4_000_000
#: Bits of a token as known here, and of a set's map.
BITS, MAP = 62, 1024
PREFIXES = "tenant_id string, category string, band int, on_left boolean, node long, row long, n int, last long, map binary, prefix array<int>"


def _first(n, threshold: float):
    """How many tokens of a set of ``n`` are its prefix."""
    return np.clip(n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1, 1, n)


def frequent_tokens(rows: DataFrame, total: int) -> list[int]:
    """The most frequent tokens of some rows, rarest first."""
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    some = rows.where(F.pmod("node", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # explode() would have all rows' tokens made for a filter of its own.
    counts = some.select(F.explode_outer("tokens").alias("t")).groupBy("t").agg(F.count("t").alias("f")).where("f > 1")
    found = counts.orderBy(F.desc("f"), "t").limit(FREQUENT).collect()
    return [r.t for r in reversed(found)]


def _prefixes(frequent: list[int], threshold: float, on_left: bool):
    step = math.log(1 / max(threshold, 1e-9))
    step = max(step, 0.1) * 1.000001
    known = np.array(frequent, np.int64) & ((1 << BITS) - 1)
    by_token = np.argsort(known)
    known = known[by_token]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pa.compute.greater(pa.compute.list_value_length(table["tokens"]), 0)).combine_chunks()
            if not table.num_rows:
                continue
            # A class of copies is one row of a batch, the smallest.
            order = np.argsort(table["row" if "row" in table.column_names else "node"].to_numpy(), kind="stable").tolist()
            names = list(zip(*(table[c].to_pylist() for c in ("tenant_id", "category", "node"))))
            seen, keep = set(), []
            for k in order:
                if names[k] not in seen:
                    seen.add(names[k])
                    keep.append(k)
            table = table.take(pa.array(sorted(keep))).combine_chunks()
            row = table["row" if "row" in table.column_names else "node"].combine_chunks()
            lists = table["tokens"].combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << BITS) - 1)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                flat = np.where(known[place] == flat, (1 << BITS) + by_token[place], flat)
            owner = np.repeat(np.arange(len(n)), n)
            flat = flat[np.lexsort((flat, owner))]
            starts, p = np.cumsum(n) - n, _first(n, threshold)
            last = flat[starts + p - 1]
            within = np.arange(len(flat)) - np.repeat(starts, n) < np.repeat(p, n)
            # Two tokens of one remainder only add to a count.
            short = (flat[within] % 2147483647).astype(np.int32)
            bits = np.zeros((len(n), MAP), bool)
            bits[owner, flat % MAP] = True
            maps = pa.array([m.tobytes() for m in np.packbits(bits, axis=1)], pa.binary())
            bands = np.floor(np.log(n) / step).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(short))
            for shift in (-1, 0, 1) if on_left else (0,):
                yield pa.RecordBatch.from_arrays(
                    [*(table[c].combine_chunks() for c in ("tenant_id", "category")), pa.array(bands + np.int32(shift)), pa.array(np.full(len(n), on_left)), table["node"].combine_chunks(), row, pa.array(n.astype(np.int32)), pa.array(last), maps, prefix],
                    names=["tenant_id", "category", "band", "on_left", "node", "row", "n", "last", "map", "prefix"],
                )

    return run


def _side(table: pa.Table, on_left: bool):
    """node, row, n, last, maps, tokens and their owners, of each set once; of
    copies, the smallest row."""
    mine = table.filter(pa.compute.equal(table["on_left"], on_left)).sort_by([("node", "ascending"), ("row", "ascending")])
    _, once = np.unique(mine["node"].to_numpy(), return_index=True)
    mine = mine.take(pa.array(once)).combine_chunks()
    if not mine.num_rows:
        return None
    lists = mine["prefix"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    tokens = lists.flatten().to_numpy(zero_copy_only=False)
    maps = np.frombuffer(b"".join(mine["map"].to_pylist()), np.uint64).reshape(-1, MAP // 64)
    return mine["node"].to_numpy(), mine["row"].to_numpy(), mine["n"].to_numpy().astype(np.int64), mine["last"].to_numpy(), maps, tokens, np.repeat(np.arange(len(sizes)), sizes)


def _matched(threshold: float):
    """Of a block: node and row of each left set and of each right set, and of
    each pair the part and the places of its sets, by part and left set."""

    def run(table: pa.Table):
        left, right = _side(table, True), _side(table, False)
        found_left, found_right = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        node_l = row_l = n_l = node_r = row_r = np.empty(0, np.int64)
        if left and right:
            node_l, row_l, n_l, last_l, map_l, tokens_l, owner_l = left
            node_r, row_r, n_r, last_r, map_r, tokens_r, owner_r = right
            order = np.argsort(tokens_r, kind="stable")
            tokens_r, owner_r = tokens_r[order], owner_r[order]
            low = np.searchsorted(tokens_r, tokens_l, "left")
            times = np.searchsorted(tokens_r, tokens_l, "right") - low
            rows, size = len(node_l), len(node_r)
            upto = np.concatenate([[0], np.cumsum(np.bincount(owner_l, times, rows).astype(np.int64))])
            edges = np.searchsorted(owner_l, np.arange(rows + 1))
            begin = 0
            while begin < rows:
                end = min(int(np.searchsorted(upto, upto[begin] + COMMON, "right")) - 1, begin + max(1, CELLS // size), rows)
                end = max(end, begin + 1)
                part = slice(edges[begin], edges[end])
                many, total = times[part], int(upto[end] - upto[begin])
                if total:
                    at = np.repeat(low[part] - (np.cumsum(many) - many), many) + np.arange(total)
                    cell = np.repeat((owner_l[part] - begin) * size, many) + owner_r[at]
                    common = np.bincount(cell, minlength=(end - begin) * size)
                    cells = np.flatnonzero(common)
                    c, i, j = common[cells], begin + cells // size, cells % size
                    a, b = n_l[i], n_r[j]
                    # Of the set whose prefix ends first, all tokens up to there
                    # are counted; of the rest, at most all are common.
                    rest_a, rest_b = a - _first(a, threshold), b - _first(b, threshold)
                    rest = np.where(last_l[i] < last_r[j], rest_a, np.where(last_l[i] > last_r[j], rest_b, np.minimum(rest_a, rest_b)))
                    near = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
                    need = threshold / (1 + threshold) * (a + b) - 1e-6
                    ok = np.flatnonzero(near & (c + rest >= need) & (node_l[i] != node_r[j]))
                    # A bit that one map has alone is a token that the other set lacks.
                    for k in range(0, len(ok), CHECKED):
                        some = ok[k : k + CHECKED]
                        x, y = i[some], j[some]
                        alone_a = np.bitwise_count(map_l[x] & ~map_r[y]).sum(1, np.int64)
                        alone_b = np.bitwise_count(map_r[y] & ~map_l[x]).sum(1, np.int64)
                        may = np.minimum(a[some] - alone_a, b[some] - alone_b) >= need[some]
                        found_left.append(x[may].astype(np.int32))
                        found_right.append(y[may].astype(np.int32))
                begin = end
        x, y = np.concatenate(found_left), np.concatenate(found_right)
        # Left sets with right ones in common are compared by one task, if they fit.
        least = np.full(len(node_l), len(node_r))
        np.minimum.at(least, x, y)
        order = np.lexsort((y, x, least[x]))
        x, y = x[order], y[order]
        part = (np.cumsum(n_l[x] * (np.diff(x, prepend=-1) != 0)) // PART).astype(np.int32)
        return (node_l, row_l), (node_r, row_r), part, x, y

    return run


def _pairs(threshold: float):
    matched = _matched(threshold)

    def run(table: pa.Table) -> pa.Table:
        (node_l, row_l), (node_r, row_r), part, x, y = matched(table)
        key = {c: table[c].slice(0, 1).to_pylist() * len(x) for c in ("tenant_id", "category", "band")}
        return pa.table({**key, "part": part, "left_node": node_l[x], "left_row": row_l[x], "right_node": node_r[y], "right_row": row_r[y]}, FOUND)

    return run


FOUND = pa.schema([("tenant_id", pa.string()), ("category", pa.string()), ("band", pa.int32()), ("part", pa.int32()), *((f"{side}_{x}", pa.int64()) for side in ("left", "right") for x in ("node", "row"))])
PAIRS = "tenant_id string, category string, band int, part int, left_node long, left_row long, right_node long, right_row long"


def _lists(threshold: float):
    matched = _matched(threshold)

    def run(table: pa.Table) -> pa.Table:
        left, right, part, x, y = matched(table)
        out = [LISTED.empty_table()]
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            mine, starts, many = np.unique(x[begin:end], return_index=True, return_counts=True)
            order = np.argsort(starts)
            mine, many = mine[order], many[order]
            others, places = np.unique(y[begin:end], return_inverse=True)
            at = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            rights = pa.ListArray.from_arrays(pa.array(at), pa.array(places.astype(np.int32)))
            for on_left, (node, row), some, lists in ((True, left, mine, rights), (False, right, others, pa.nulls(len(others), rights.type))):
                key = {c: table[c].slice(0, 1).to_pylist() * len(some) for c in ("tenant_id", "category", "band")}
                out.append(pa.table({**key, "part": pa.repeat(part[begin], len(some)), "on_left": pa.repeat(on_left, len(some)), "node": node[some], "row": row[some], "place": np.arange(len(some), dtype=np.int32), "rights": lists}, LISTED))
        return pa.concat_tables(out)

    return run


LISTED = pa.schema([("tenant_id", pa.string()), ("category", pa.string()), ("band", pa.int32()), ("part", pa.int32()), ("on_left", pa.bool_()), ("node", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("rights", pa.list_(pa.int32()))])
LISTS = "tenant_id string, category string, band int, part int, on_left boolean, node long, row long, place int, rights array<int>"


def _blocks(left: DataFrame, right: DataFrame, threshold: float, total: int):
    ship(left.sparkSession)
    frequent = frequent_tokens(right, total)
    columns = ["tenant_id", "category", "node", "row", "tokens"]
    one = left.select(*columns).mapInArrow(_prefixes(frequent, threshold, True), PREFIXES)
    two = right.select(*columns).mapInArrow(_prefixes(frequent, threshold, False), PREFIXES)
    return one.unionAll(two).groupBy("tenant_id", "category", "band")


def candidates(left: DataFrame, right: DataFrame, threshold: float, total: int) -> DataFrame:
    """The pairs of sets (tenant_id, category, node, row, tokens as hashes) of a
    tenant and category whose Jaccard may be at least ``threshold``, but those of
    one node; empty sets take no part. Sets of one node are copies; a pair has
    the row of one of them on each side, and the block where it was found (band
    and part). ``total`` is about the rows of ``right``."""
    return _blocks(left, right, threshold, total).applyInArrow(_pairs(threshold), PAIRS)


def listed(left: DataFrame, right: DataFrame, threshold: float, total: int) -> DataFrame:
    """As ``candidates``, but a row for each set of a block's part that has a
    pair: node, the smallest row of its copies, its place on its side, and of
    left sets the places of the right ones."""
    return _blocks(left, right, threshold, total).applyInArrow(_lists(threshold), LISTS)


def _whole(table: pa.Table, on_left: bool):
    """class, node, tokens and their offsets, of each set once, by node."""
    mine = table.filter(pa.compute.equal(table["on_left"], on_left))
    names = list(zip(mine["node"].to_pylist(), mine["class"].to_pylist()))
    once = {name: k for k, name in enumerate(names)}
    mine = mine.take(pa.array([once[name] for name in sorted(once)], pa.int64())).combine_chunks()
    if not mine.num_rows:
        return [], np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
    lists = mine["tokens"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return mine["class"].to_pylist(), mine["node"].to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _compared(sets: pa.Table, wanted):
    """Of each left set that has any: the left class, the right classes, nodes
    and similarities. ``wanted`` gives the right nodes of a left one."""
    class_l, node_l, tokens_l, at_l = _whole(sets, True)
    class_r, node_r, tokens_r, at_r = _whole(sets, False)
    known, codes = np.unique(np.concatenate([tokens_l, tokens_r]), return_inverse=True)
    codes_l, codes_r = codes[: len(tokens_l)], codes[len(tokens_l) :]
    marked = np.zeros(len(known), bool)
    for i, node in enumerate(node_l.tolist()):
        nodes = wanted(node)
        low, high = np.searchsorted(node_r, nodes, "left"), np.searchsorted(node_r, nodes, "right")
        js = np.concatenate([low[low < high], *(np.arange(x + 1, y) for x, y in zip(low, high) if y > x + 1)])
        if not len(js):
            continue
        own = codes_l[at_l[i] : at_l[i + 1]]
        marked[own] = True
        common = np.array([np.count_nonzero(marked[codes_r[at_r[j] : at_r[j + 1]]]) for j in js])
        marked[own] = False
        yield class_l[i], class_r, node_r, js, common / (len(own) + (at_r[js + 1] - at_r[js]) - common)


def _scores(pairs: pa.Table, out: list) -> pa.Table:
    key = {c: pairs[c].slice(0, 1).to_pylist() * len(out) for c in ("tenant_id", "category")}
    one, two, three = zip(*out) if out else ((), (), ())
    return pa.table({**key, "left": pa.array(one, pa.string()), "right": pa.array(two, pa.string()), "similarity": pa.array(three, pa.float64())}, SCORED)


def _scored(threshold: float):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        rights: dict[int, set[int]] = {}
        for a, b in zip(pairs["left_node"].to_pylist(), pairs["right_node"].to_pylist()):
            rights.setdefault(a, set()).add(b)
        out = []
        for left, class_r, _, js, similarity in _compared(sets, lambda node: np.fromiter(rights.get(node, ()), np.int64)):
            out += [(left, class_r[j], x) for j, x in zip(js.tolist(), similarity.tolist()) if x >= threshold]
        return _scores(pairs, out)

    return run


def _closest(threshold: float, most: int):
    def run(sets: pa.Table, lists: pa.Table) -> pa.Table:
        right = lists.filter(pa.compute.invert(lists["on_left"])).sort_by("place")
        nodes, rows = right["node"].to_numpy(), right["row"].to_numpy()
        by_node = np.argsort(nodes)
        mine = lists.filter(lists["on_left"]).combine_chunks()
        place = {node: k for k, node in enumerate(mine["node"].to_pylist())}
        rights = mine["rights"].combine_chunks() if mine.num_rows else None
        out, none = [], np.empty(0, np.int64)
        for left, class_r, node_r, js, similarity in _compared(sets, lambda node: nodes[rights[place[node]].values.to_numpy()] if node in place else none):
            js, similarity = js[similarity >= threshold], similarity[similarity >= threshold]
            js, similarity = js[(other := np.array([class_r[j] != left for j in js], bool))], similarity[other]
            first = rows[by_node[np.searchsorted(nodes, node_r[js], sorter=by_node)]]
            best = np.lexsort((first, -similarity))[:most]
            out += [(left, class_r[j], x) for j, x in zip(js[best].tolist(), similarity[best].tolist())]
        return _scores(lists, out)

    return run


SCORED = pa.schema([*((c, pa.string()) for c in ("tenant_id", "category", "left", "right")), ("similarity", pa.float64())])


def scored(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """tenant_id, category, left and right class and Jaccard similarity of
    ``candidates`` that are at or above the threshold. ``sets`` (tenant_id,
    category, band, part, on_left, node, class, tokens) has the whole sets of
    each block's pairs; each is dealt out once a block."""
    block = ["tenant_id", "category", "band", "part"]
    own = sets.select(*block, "on_left", "node", "class", "tokens").groupBy(*block)
    return own.cogroup(pairs.select(*block, "left_node", "right_node").groupBy(*block)).applyInArrow(_scored(threshold), "tenant_id string, category string, left string, right string, similarity double")


def closest(sets: DataFrame, lists: DataFrame, threshold: float, most: int) -> DataFrame:
    """As ``scored``, of ``listed``, but of each left class and block only the
    ``most`` pairs of largest similarity, ties to the smaller row. Where rows
    are ids, those have the ``most`` best ids: of any other class, the smallest
    id comes after the smallest of each of these."""
    block = ["tenant_id", "category", "band", "part"]
    own = sets.select(*block, "on_left", "node", "class", "tokens").groupBy(*block)
    return own.cogroup(lists.select(*block, "on_left", "node", "row", "place", "rights").groupBy(*block)).applyInArrow(_closest(threshold, most), "tenant_id string, category string, left string, right string, similarity double")
