"""Match incoming masters to existing ones: exact names, blocked fuzzy candidates, decisions.

The work is done on distinct (name, parent) keys, not on rows, so copies of a
name cost nothing. Candidates share a block (name prefix or sound code). A block
may hold nearly all names, so the existing keys of a block are dealt to tiles by
their letters (names with the same letters stand together). An incoming key first
meets the tile with the most alike letters; the third score found there is a
floor. It then meets only the tiles in which some set of letters can still reach
the floor: what two names share is bounded by their letters. The best three are
those of scoring every pair in the block. No pair list is ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.similarity import code_points, jaro_winkler_codes, metaphone
from ledgerweave.functions.text import norm_or_empty
from ledgerweave.operators.joins import hot_safe_join
from ledgerweave.sources.shared_folder import stored

# Weights and thresholds of the match score.
W_EXACT, W_SIMILAR, W_PARENT = 0.60, 0.30, 0.10
MATCH, CONFLICT, NAME_CONFLICT, AMBIGUOUS_GAP = 0.95, 0.85, 0.90, 0.05
TOP = 3
PREFIX = 4

_TILE = 2048  # existing keys of one tile; a tile with more incoming keys than that is copied for each so many
_SETS = 4096  # sets of letters that are compared with so many others at once
_LARGE = 50_000  # a tile with more pairs goes by sets of letters first
_PAIRS = 200_000  # pairs scored in one array operation
_PROBES = 8  # pairs per incoming key that set the score to beat
_LETTERS = 64  # classes of letters in the bound
_DIGITS = 10  # scores are compared to this many digits, so float noise cannot order them

_KEY = ["in_name", "in_parent"]
_PAIR_SCHEMA = "in_name string, in_parent string, ex_name string, ex_parent string, jw double, score double, ex_first long"


def block_keys(name: Column, kinds=("prefix", "sound")) -> Column:
    """Array of block keys of a normalized name."""
    keys = []
    if "prefix" in kinds:
        keys.append(F.concat(F.lit("p:"), F.substring(name, 1, PREFIX)))
    if "sound" in kinds:
        code = metaphone(name)
        keys.append(F.when(code != "", F.concat(F.lit("m:"), code)))
    return F.array_compact(F.array(*keys))


def _incoming_keys(incoming: DataFrame) -> DataFrame:
    return (
        incoming.select(norm_or_empty("name").alias("name"), norm_or_empty("parent").alias("parent"))
        .filter(F.col("name") != "")
        .distinct()
    )


def _existing_keys(existing: DataFrame) -> DataFrame:
    """Distinct (name, parent) of the existing masters with their lowest row id and up to three row ids.

    Rows with the same key score alike and ties go to the lowest id, so three ids
    per key are all that any top-three list can use.
    """
    rows = existing.select(
        norm_or_empty("name").alias("name"), norm_or_empty("parent").alias("parent"), F.col("ex_id").cast("long")
    ).filter(F.col("name") != "")
    order = Window.partitionBy("name", "parent").orderBy("ex_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.groupBy("name", "parent").agg(
        F.min("ex_id").alias("ex_first"), F.sort_array(F.collect_list("ex_id")).alias("ex_ids")
    )


def _letters_of(name: Column) -> Column:
    """The characters of a name in order: equal for names with the same letters."""
    return F.array_join(F.array_sort(F.split(name, "")), "")


def _in_blocks(keys: DataFrame, kinds, *more: str) -> DataFrame:
    placed = keys.select("name", "parent", *more, F.explode(block_keys(F.col("name"), kinds)).alias("block"))
    return placed.withColumns({"letters": _letters_of(F.col("name")), "size": F.length("name")})


def _dealt(right: DataFrame) -> DataFrame:
    """Existing keys with their tile `c`, and whether their block has `several`.

    Names with the same letters go to one tile; if they exceed it, to several.
    """
    sets = right.groupBy("block", "letters", "size").agg(F.count("*").alias("alike"))
    big = sets.groupBy("block").agg(F.sum("alike").alias("e")).filter(F.col("e") > _TILE)
    # a big block is rare but holds many keys: the broadcast or the skew split of adaptive execution serves both
    sized = hot_safe_join(right, big, ["block"], "left")
    sized = hot_safe_join(sized, sets.filter(F.col("alike") > _TILE), ["block", "letters", "size"], "left")
    deal = F.pmod(F.xxhash64("letters", "size"), F.ceil(F.col("e") / _TILE))
    part = F.pmod(F.xxhash64("name", "parent"), F.coalesce(F.ceil(F.col("alike") / _TILE), F.lit(1)))
    tile = F.when(F.col("e").isNull(), F.lit(0)).otherwise(F.shiftleft(deal, 24).bitwiseOR(part)).cast("long")
    return sized.select("block", "letters", "size", tile.alias("c"), F.col("e").isNotNull().alias("several"), "name", "parent", "ex_first")


def _routed(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """block, letters, size, c, bound: tiles for each set of letters of incoming names, and the best score but for the parent in them.

    wanted: block, letters, size, floor. Without a floor it is the tile with the highest bound; else all tiles that reach it.
    """
    counts = [side.groupBy("block").agg(F.ceil(F.count("*") / _SETS).alias(name)) for side, name in ((wanted, "rows"), (sets, "cols"))]
    shape = hot_safe_join(counts[0], counts[1], ["block"])
    cell = F.xxhash64("letters", "size")
    left = hot_safe_join(wanted, shape, ["block"]).withColumns(
        {"r": F.pmod(cell, F.col("rows")), "g": F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))})
    right = hot_safe_join(sets, shape, ["block"]).withColumns(
        {"g": F.pmod(cell, F.col("cols")), "r": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))})
    cut = ["block", "r", "g"]
    left, right = left.select(*cut, "letters", "size", "floor"), right.select(*cut, "letters", "size", "c")
    schema = "block string, letters string, size int, c long, bound double"
    return left.groupBy(*cut).cogroup(right.groupBy(*cut)).applyInPandas(_route, schema=schema)


def _route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Bounds of all sets of letters of one side with those of the other."""
    names = ["block", "letters", "size", "c", "bound"]
    if not len(left) or not len(right):
        return pd.DataFrame({n: [] for n in names})
    right = right.sort_values("c", kind="stable")
    codes, lengths = code_points([*left["letters"], *right["letters"]])
    counts, n = _letter_counts(codes, lengths), len(left)
    size = np.concatenate([left["size"].to_numpy(), right["size"].to_numpy()]).astype(np.int64)
    same = pd.factorize(np.concatenate([left["letters"].to_numpy(), right["letters"].to_numpy()]))[0]
    tiles, first = np.unique(right["c"].to_numpy(), return_index=True)
    floor = left["floor"].to_numpy(dtype=np.float64)
    out = []
    for low in range(0, n, 256):
        some = slice(low, min(low + 256, n))
        bound = W_SIMILAR * _set_bounds(counts[some], size[some], counts[n:], size[n:])
        bound += W_EXACT * (same[some][:, None] == same[None, n:])
        best = np.maximum.reduceat(bound, first, axis=1)
        ask = floor[some]
        take = best + W_PARENT >= ask[:, None]
        top = best.argmax(axis=1)
        new = np.isnan(ask)
        take[new] = False
        take[new, top[new]] = True
        a, b = np.nonzero(take)
        out.append((a + low, tiles[b], best[a, b]))
    a, c, bound = (np.concatenate(part) for part in zip(*out))
    return pd.DataFrame({**{name: left[name].to_numpy()[a] for name in names[:3]}, "c": c, "bound": bound})


def _set_bounds(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro-Winkler from above for every row of a with every row of b: names share no more than their letters."""
    shared = np.zeros((len(a), len(b)), dtype=np.int32)
    for letter in range(a.shape[1]):
        if a[:, letter].any() and b[:, letter].any():
            shared += np.minimum(a[:, letter, None], b[None, :, letter])
    la, lb = la[:, None].astype(np.float64), lb[None, :].astype(np.float64)
    shared = np.minimum(shared, np.minimum(la, lb))
    jaro = np.where(shared > 0, (shared / la + shared / lb + 1.0) / 3.0, 0.0)
    return np.where(jaro > 0.7, jaro + 0.1 * PREFIX * (1.0 - jaro), jaro) + 1e-9


def _scored(keys: DataFrame, members: DataFrame) -> DataFrame:
    """The best three of each tile for each of its incoming keys.

    keys: block, c, name, parent, floor. members: block, c, name, parent, ex_first.
    """
    crowds = keys.groupBy("block", "c").agg(F.ceil(F.count("*") / _TILE).alias("rows")).filter(F.col("rows") > 1)
    rows = F.coalesce("rows", F.lit(1).cast("long"))
    cut = ["block", "c"]
    left = hot_safe_join(keys, crowds, cut, "left").select(
        *cut, F.pmod(F.xxhash64("name", "parent"), rows).alias("r"), F.lit(1).alias("side"), "name", "parent",
        F.lit(None).cast("long").alias("ex_first"), "floor")
    met = hot_safe_join(members, keys.select(*cut).distinct(), cut)
    right = hot_safe_join(met, crowds, cut, "left").select(
        *cut, F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("r"), F.lit(0).alias("side"), "name", "parent",
        "ex_first", F.lit(None).cast("double").alias("floor"))
    # a fixed number keeps adaptive execution from merging tasks by their bytes: tiles are small but costly
    spark = keys.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ordered = left.unionByName(right).repartition(tasks, "block", "r", "c").sortWithinPartitions("block", "r", "c", "side")
    return ordered.mapInPandas(_score_tiles, schema=_PAIR_SCHEMA)


def _score_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream a partition sorted by (block, r, c, side): score complete tiles, carry the last one over."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        data = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = data[["block", "r", "c"]].iloc[-1]
        last = (data["block"] == key["block"]) & (data["r"] == key["r"]) & (data["c"] == key["c"])
        rest = data[last]
        if not last.all():
            yield from _score(data[~last].reset_index(drop=True))
    if rest is not None:
        yield from _score(rest.reset_index(drop=True))


def _letter_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each letter occurs, with all letters folded into `_LETTERS` classes."""
    counts = np.zeros((codes.shape[0], _LETTERS), dtype=np.uint16)
    inside = np.arange(codes.shape[1])[None, :] < lengths[:, None]
    rows, columns = np.nonzero(inside)
    np.add.at(counts, (rows, codes[rows, columns] % _LETTERS), 1)
    used = counts[:, counts.any(axis=0)]
    return used.astype(np.uint8) if used.size and used.max() < 256 else used


def _worth_scoring(left, right, fixed, codes, lengths, letters) -> np.ndarray:
    """Mask of the pairs that can still be among the best three of their incoming key.

    Two names cannot share more characters than their letter counts allow, which
    bounds Jaro and, with the common prefix, Jaro-Winkler from above. The most
    promising pairs of a key are scored; a pair whose bound is below their third
    score cannot enter the list. Nothing that could win is left out.
    """
    la, lb = lengths[left], lengths[right]
    shared = np.minimum(letters[left], letters[right]).sum(axis=1, dtype=np.int32).astype(np.float64)
    jaro = np.where(shared > 0, (shared / la + shared / lb + 1.0) / 3.0, 0.0)
    start = codes[:, :PREFIX]
    alike, prefix = np.ones(len(left), dtype=bool), np.zeros(len(left))
    for i in range(start.shape[1]):
        alike &= (start[left, i] == start[right, i]) & (start[left, i] != 0)  # zero pads short names
        prefix += alike
    bound = fixed + W_SIMILAR * np.where(jaro > 0.7, jaro + 0.1 * prefix * (1.0 - jaro), jaro) + 1e-9
    order = np.lexsort((-bound, left))
    rank = np.empty(len(left), dtype=np.int64)
    rank[order] = _rank_in_runs(left[order])
    probe = np.flatnonzero(rank < _PROBES)
    jw = jaro_winkler_codes(codes[left[probe]], la[probe], codes[right[probe]], lb[probe])
    score = fixed[probe] + W_SIMILAR * jw
    by_score = np.lexsort((-score, left[probe]))
    third = by_score[_rank_in_runs(left[probe][by_score]) == TOP - 1]
    floor = np.full(int(left.max()) + 1, -1.0)
    floor[left[probe][third]] = score[third]
    return bound >= floor[left]


def _rank_in_runs(values: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each run of equal values."""
    begin = np.r_[True, values[1:] != values[:-1]]
    return np.arange(len(values)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]


def _score(data: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Score all tiles in `data`: existing keys (side 0) come before incoming keys (side 1) in each tile."""
    tile = data.groupby(["block", "r", "c"], sort=False).ngroup().to_numpy()
    side = data["side"].to_numpy()
    most = np.bincount(tile[side == 0], minlength=tile.max() + 1) * np.bincount(tile[side == 1], minlength=tile.max() + 1)
    if (most > _LARGE).any():
        for large in np.flatnonzero(most > _LARGE):
            low, high = np.searchsorted(tile, [large, large + 1])
            yield from _score_large(data.iloc[low:high])
        data = data[most[tile] <= _LARGE].reset_index(drop=True)
        if len(data):
            yield from _score(data)
        return
    names, parents = data["name"].to_numpy(), data["parent"].to_numpy()
    firsts = data["ex_first"].to_numpy()
    sound = data["block"].str.startswith("m:").to_numpy()
    count = int(tile.max()) + 1
    ex_count = np.bincount(tile[side == 0], minlength=count)
    ex_start = np.searchsorted(tile, np.arange(count))
    incoming = np.flatnonzero(side == 1)
    incoming = incoming[ex_count[tile[incoming]] > 0]
    codes, lengths = code_points(names)
    letters = _letter_counts(codes, lengths)
    name_ids, parent_ids = pd.factorize(names)[0], pd.factorize(parents)[0]
    has_parent = parents != ""
    start = 0
    while start < len(incoming):
        sizes = ex_count[tile[incoming[start:]]]
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes), _PAIRS, side="right")))
        part = incoming[start:stop]
        start = stop
        n = ex_count[tile[part]]
        left = np.repeat(part, n)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        right = np.repeat(ex_start[tile[part]], n) + offset
        # a pair that shares its prefix was already scored in the prefix block
        k = min(PREFIX, codes.shape[1])
        if sound[part].any():
            fresh = ~(sound[left] & (codes[left, :k] == codes[right, :k]).all(axis=1))
            left, right = left[fresh], right[fresh]
        if not len(left):
            continue
        same = name_ids[left] == name_ids[right]
        parent = (parent_ids[left] == parent_ids[right]) & has_parent[left]
        fixed = W_EXACT * same + W_PARENT * parent
        need = _worth_scoring(left, right, fixed, codes, lengths, letters)
        left, right, fixed = left[need], right[need], fixed[need]
        jw = jaro_winkler_codes(codes[left], lengths[left], codes[right], lengths[right])
        score = np.round(fixed + W_SIMILAR * jw, _DIGITS)
        yield _best(left, right, jw, score, names, parents, firsts)


def _best(left, right, jw, score, names, parents, firsts) -> pd.DataFrame:
    """The best three pairs of each incoming key."""
    order = np.lexsort((firsts[right], -score, left))
    left, right, jw, score = left[order], right[order], jw[order], score[order]
    keep = _rank_in_runs(left) < TOP
    left, right = left[keep], right[keep]
    return pd.DataFrame(
        {
            "in_name": names[left], "in_parent": parents[left], "ex_name": names[right], "ex_parent": parents[right],
            "jw": jw[keep], "score": score[keep], "ex_first": firsts[right].astype(np.int64),
        }
    )


def _score_large(data: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Score one tile: keys meet the sets of letters that can reach their floor, and in those the names that can.

    A key without a floor takes the third score among a few names with the most alike letters.
    """
    names, parents = data["name"].to_numpy(), data["parent"].to_numpy()
    firsts, floors = data["ex_first"].to_numpy(), data["floor"].to_numpy(dtype=np.float64)
    sound = bool(data["block"].iloc[0].startswith("m:"))
    side = data["side"].to_numpy()
    codes, lengths = code_points(names)
    counts = _letter_counts(codes, lengths)
    k = min(PREFIX, codes.shape[1])
    name_ids, parent_ids = (pd.factorize(v)[0].astype(np.int64) for v in (names, parents))
    has_parent = parents != ""
    rows = np.ascontiguousarray(np.column_stack([lengths.astype(np.uint16), counts.astype(np.uint16)]))
    _, first, sets = np.unique(rows.view(f"V{rows.shape[1] * 2}").ravel(), return_index=True, return_inverse=True)
    ex, inc = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    ex_sets, in_sets = np.unique(sets[ex]), np.unique(sets[inc])
    # existing keys by set, then parent: a set, and a parent in a set, is a range; so is a name in the order by name
    span = int(parent_ids.max()) + 1
    place = np.searchsorted(ex_sets, sets[ex]) * span + parent_ids[ex]
    by_set = ex[np.argsort(place, kind="stable")]
    place = np.sort(place)
    by_name = ex[np.argsort(name_ids[ex], kind="stable")]

    def ranges(order: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray):
        """(key, existing) pairs of the ranges [low, high) of sorted values, in pieces of bounded size."""
        begin, end = np.searchsorted(values, low), np.searchsorted(values, high)
        n = end - begin
        done = 0
        total = np.cumsum(n)
        while done < len(keys):
            spent = total[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(total, spent + _PAIRS, side="right")))
            m = n[done:stop]
            left = np.repeat(keys[done:stop], m)
            right = order[np.repeat(begin[done:stop] - np.cumsum(m) + m, m) + np.arange(len(left))]
            done = stop
            if sound:  # a pair that shares its prefix is scored in the prefix block
                fresh = ~(codes[left, :k] == codes[right, :k]).all(axis=1)
                left, right = left[fresh], right[fresh]
            if len(left):
                yield left, right

    def fixed(left, right):
        same = name_ids[left] == name_ids[right]
        return W_EXACT * same + W_PARENT * ((parent_ids[left] == parent_ids[right]) & has_parent[left])

    def scores(left, right):
        jw = jaro_winkler_codes(codes[left], lengths[left], codes[right], lengths[right])
        return jw, np.round(fixed(left, right) + W_SIMILAR * jw, _DIGITS)

    best_of: list[pd.DataFrame] = []
    step = max(1, 2_000_000 // max(1, len(ex_sets)))
    at = np.searchsorted(in_sets, sets[inc])
    inc, at = inc[np.argsort(at, kind="stable")], np.sort(at)
    for low in range(0, len(in_sets), step):
        some = in_sets[low : low + step]
        bound = W_SIMILAR * _set_bounds(counts[first[some]], lengths[first[some]], counts[first[ex_sets]], lengths[first[ex_sets]])
        begin, end = np.searchsorted(at, [low, low + len(some)])
        keys, own = inc[begin:end], at[begin:end] - low
        floor = floors[keys]
        ask = np.flatnonzero(np.isnan(floor))
        floor[ask] = -1.0
        if len(ask):
            top = bound.argmax(axis=1)[own[ask]]
            spot = top * span + parent_ids[keys[ask]]
            enough = has_parent[keys[ask]] & (np.searchsorted(place, spot + 1) - np.searchsorted(place, spot) > TOP)
            few = min(_PROBES, len(ex_sets))
            nearest = np.argpartition(-bound, few - 1, axis=1)[:, :few]
            wide = ask[~enough]
            spots = nearest[own[wide]].ravel()
            probes = (
                ranges(by_set, place, spot[enough], spot[enough] + 1, keys[ask[enough]]),
                ranges(by_set, place, spots * span, (spots + 1) * span, np.repeat(keys[wide], few)),
            )
            found = np.full(len(names), -1.0)
            for pieces in probes:
                for left, right in pieces:
                    bounds = _pair_bounds(left, right, fixed(left, right), codes, lengths, counts)
                    best, third = _probe(left, right, bounds, scores)
                    found[best] = np.maximum(found[best], third)
            floor[ask] = found[keys[ask]]
        # the parent counts for what has it, the name for what has it; all else needs the letters alone
        wide_a, wide_b = np.nonzero(bound[own] >= floor[:, None])
        near_a, near_b = np.nonzero((bound[own] + W_PARENT >= floor[:, None]) & has_parent[keys][:, None])
        floor_of = np.full(len(names), -1.0)
        floor_of[keys] = floor
        spots = near_b * span + parent_ids[keys[near_a]]
        parts = (
            ("name", ranges(by_name, name_ids[by_name], name_ids[keys], name_ids[keys] + 1, keys)),
            ("parent", ranges(by_set, place, spots, spots + 1, keys[near_a])),
            ("letters", ranges(by_set, place, wide_b * span, (wide_b + 1) * span, keys[wide_a])),
        )
        for part, pieces in parts:
            for left, right in pieces:
                if part != "name":
                    new = name_ids[left] != name_ids[right]
                    if part == "letters":
                        new &= (parent_ids[left] != parent_ids[right]) | ~has_parent[left]
                    left, right = left[new], right[new]
                need = _pair_bounds(left, right, fixed(left, right), codes, lengths, counts) >= floor_of[left]
                left, right = left[need], right[need]
                if len(left):
                    jw, score = scores(left, right)
                    best_of.append(_best(left, right, jw, score, names, parents, firsts))
                    if len(best_of) > 64:
                        best_of = [pd.concat(best_of, ignore_index=True)]
    if best_of:
        made = pd.concat(best_of, ignore_index=True).sort_values(["score", "ex_first"], ascending=[False, True], kind="stable")
        yield made[made.groupby(_KEY, sort=False).cumcount() < TOP].reset_index(drop=True)


def _pair_bounds(left, right, fixed, codes, lengths, letters) -> np.ndarray:
    """Scores from above. With the same letters, either all characters match in their order, or one at least does not match."""
    la, lb = lengths[left].astype(np.float64), lengths[right].astype(np.float64)
    shared = np.minimum(letters[left], letters[right]).sum(axis=1, dtype=np.int32).astype(np.float64)
    shared = np.minimum(shared, np.minimum(la, lb))
    whole = (la == lb) & (shared == la)
    moved = (codes[left] != codes[right]).sum(axis=1) // 2
    jaro = np.where(shared > 0, (shared / la + shared / lb + 1.0) / 3.0, 0.0)
    jaro = np.where(whole, (2.0 + np.maximum((la - moved) / la, 1.0 - 2.0 / la)) / 3.0, jaro)
    return fixed + W_SIMILAR * np.where(jaro > 0.7, jaro + 0.1 * PREFIX * (1.0 - jaro), jaro) + 1e-9


def _probe(left, right, bound, scores) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the third score among the pairs of a key with the highest bounds."""
    order = np.lexsort((-bound, left))
    order = order[_rank_in_runs(left[order]) < _PROBES]
    left, right = left[order], right[order]
    score = scores(left, right)[1]
    order = np.lexsort((-score, left))
    third = order[_rank_in_runs(left[order]) == TOP - 1]
    return left[third], score[third]


def _top_rows(inc: DataFrame, ex: DataFrame, kinds) -> DataFrame:
    """Best three existing rows per incoming key, ranked by (score desc, row id)."""
    if set(kinds) == {"sound"}:
        raise ValueError("The sound block extends the prefix block; ask for both or for the prefix alone.")
    left = stored(_in_blocks(inc, kinds))
    right = stored(_dealt(_in_blocks(ex, kinds, "ex_first")))
    # only blocks of several tiles need to know which; all keys of another block have one
    several = right.filter("several").select("block").distinct()
    sets = right.filter("several").select("block", "letters", "size", "c").distinct()
    by_set = ["block", "letters", "size"]
    placed = hot_safe_join(left, several.withColumn("several", F.lit(True)), ["block"], "left")
    wanted = placed.filter("several").select(*by_set, F.lit(None).cast("double").alias("floor")).distinct()
    best = F.max(F.struct("bound", -F.col("c")))
    nearest = _routed(wanted, sets).groupBy(*by_set).agg((-best["col2"]).alias("c"))
    unknown = F.lit(None).cast("double").alias("floor")
    one = placed.filter("several is null").select("block", F.lit(0).cast("long").alias("c"), "name", "parent", unknown)
    first = stored(hot_safe_join(placed.filter("several"), nearest, by_set).select("block", "letters", "size", "c", "name", "parent"))
    members = right.select("block", "c", "name", "parent", "ex_first")
    pairs = stored(_scored(one.unionByName(first.select("block", "c", "name", "parent", unknown)), members))
    # the third score of a key over all its blocks; then the other tiles of its blocks that can reach it
    order = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "ex_first")
    floors = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == TOP).select(
        F.col("in_name").alias("name"), F.col("in_parent").alias("parent"), F.col("score").alias("floor"))
    open_keys = stored(hot_safe_join(first, floors, ["name", "parent"], "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))))
    more = _routed(open_keys.groupBy(*by_set).agg(F.min("floor").alias("floor")), sets)
    more = more.groupBy(*by_set, "c").agg(F.max("bound").alias("bound"))
    again = hot_safe_join(open_keys.withColumnRenamed("c", "done"), more, by_set).filter(
        (F.col("c") != F.col("done")) & (F.col("bound") + W_PARENT >= F.col("floor")))
    rest = _scored(stored(again.select("block", "c", "name", "parent", "floor")), members)
    pairs = pairs.unionByName(rest)
    by_key = Window.partitionBy("in_name", "in_parent").orderBy(F.desc("score"), "ex_first")
    keys = pairs.withColumn("key_rank", F.row_number().over(by_key)).filter(F.col("key_rank") <= TOP)
    ids = ex.select(F.col("name").alias("ex_name"), F.col("parent").alias("ex_parent"), "ex_ids")
    rows = hot_safe_join(keys, ids, ["ex_name", "ex_parent"]).withColumn("ex_id", F.explode("ex_ids"))
    by_row = Window.partitionBy("in_name", "in_parent").orderBy(F.desc("score"), "ex_id")
    return rows.withColumn("rank", F.row_number().over(by_row)).filter(F.col("rank") <= TOP)


def resolve(incoming: DataFrame, existing: DataFrame, kinds=("prefix", "sound")) -> DataFrame:
    """A verdict per incoming row.

    incoming: source_row, name, parent. existing: ex_id, name, parent, guid.
    Rows with a blank name have no candidates and are created.
    """
    inc, ex = _incoming_keys(incoming), _existing_keys(existing)
    top = _top_rows(inc, ex, kinds)
    details = existing.select(
        F.col("ex_id").cast("long"), F.col("name").alias("ex_label"), F.col("parent").alias("ex_parent_label"), "guid"
    )
    top = top.join(details, "ex_id")
    candidate = F.struct(
        "rank", F.col("ex_label").alias("name"), F.col("ex_parent_label").alias("parent"), "guid",
        F.col("score").alias("raw"), "jw", (F.col("ex_name") == F.col("in_name")).alias("exact"), "ex_id",
    )
    # at most three rows per key
    verdicts = top.groupBy("in_name", "in_parent").agg(F.sort_array(F.collect_list(candidate)).alias("found"))
    best, second = F.col("found")[0], F.try_element_at("found", F.lit(2))
    ambiguous = F.coalesce(
        (second["raw"] >= CONFLICT) & (F.round(best["raw"] - second["raw"], _DIGITS) < AMBIGUOUS_GAP), F.lit(False)
    )
    verdicts = verdicts.withColumns({"ambiguous": ambiguous, "best": best}).withColumn(
        "decision",
        F.when((F.col("best.exact") | (F.col("best.raw") >= MATCH)) & ~F.col("ambiguous"), F.lit("update"))
        .when(
            F.col("ambiguous") | (F.col("best.raw") >= CONFLICT)
            | (F.round("best.jw", _DIGITS) >= NAME_CONFLICT),
            F.lit("conflict"),
        )
        .otherwise(F.lit("create")),
    )
    rows = incoming.select(
        "source_row", F.col("name").alias("incoming_name"), norm_or_empty("name").alias("in_name"),
        norm_or_empty("parent").alias("in_parent"), F.xxhash64(norm_or_empty("name")).alias("_twin"),
    )
    joined = rows.join(
        verdicts.withColumn("_twin", F.xxhash64("in_name")), ["in_name", "in_parent", "_twin"], "left"
    )
    decision = F.coalesce("decision", F.lit("create"))
    return joined.select(
        "source_row",
        "incoming_name",
        decision.alias("decision"),
        F.when(decision == "update", F.lit("Alter")).when(decision == "create", F.lit("Create")).alias("action"),
        F.col("best.name").alias("matched_name"),
        F.col("best.guid").alias("matched_guid"),
        F.coalesce(F.round("best.raw", 4), F.lit(0.0)).alias("score"),
        F.transform(
            "found",
            lambda x: F.struct(x["name"].alias("name"), x["parent"].alias("parent"), x["guid"].alias("guid"),
                               F.round(x["raw"], 4).alias("score")),
        ).alias("candidates"),
    )


def resolve_summary(verdicts: DataFrame) -> DataFrame:
    """Rows per decision."""
    return verdicts.groupBy("decision").agg(F.count("*").alias("n"))


def apply_verdicts(rows: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to convert, rows held back). Conflicts are held; updates carry action, guid and old name.

    Rows without a verdict pass as they are.
    """
    marks = verdicts.select("source_row", "decision", F.col("action").alias("_action"), "matched_name", "matched_guid")
    joined = rows.join(marks, "source_row", "left")
    held = joined.filter(F.coalesce("decision", F.lit("")) == "conflict").select(*rows.columns)
    update = F.coalesce(F.col("decision") == "update", F.lit(False))

    def own(column: str) -> Column:
        return F.col(column) if column in rows.columns else F.lit(None).cast("string")

    renamed = update & (norm_or_empty("matched_name") != "") & (norm_or_empty("matched_name") != norm_or_empty("name"))
    kept = joined.filter(F.coalesce("decision", F.lit("")) != "conflict").select(
        *[c for c in rows.columns if c not in ("guid", "old_name", "_action")],
        "_action",
        F.when(update & (F.coalesce("matched_guid", F.lit("")) != ""), F.col("matched_guid")).otherwise(own("guid")).alias("guid"),
        F.when(renamed, F.col("matched_name")).otherwise(own("old_name")).alias("old_name"),
    )
    return kept, held
