"""Stops and trips from location pings.

The method: runs of pings that hardly move become *segments* of at most an hour, each with the median of its points;
the medians of an entity, snapped to small cells, are the nodes of a proximity graph (nodes within the stop radius are
linked); its communities are the recurring places; segments of one place that follow each other without a break are one
visit, and what lies between two stops is a trip.

An exact check follows on the visits. Visits that go on from each other are a *chain*, and a stop lies in one chain. A
chain whose bounding box shows that all its pings are within the radius of each other is a stop as it is. Any other is
searched for its longest runs, in parts: where one place gives way to the next, and the box of the two visits is longer
than the radius along an axis, they hold two pings that no stop can hold both, so the search may be cut there if both
parts get both visits. In a part, a segment whose box is within the radius of every corner of the part's box can end no
run, and stands there with its first and last ping only; of the others the pings are fetched. The runs of the parts are
put together by their times.

Nothing is held per entity: series are cut in slices (`slices.sliced`), a segment is one row, communities are found by
pointer jumping over distinct (entity, cell) nodes, of which each has a bounded number of neighbours.

Defined results: pings without key, time or coordinates on the globe don't count; of several in one whole second the
one with the lowest tie value counts (the tie value must be unique but for repeated rows). An empty input gives an empty
output. Columns beyond the five named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, arc_of_chord, chord_km, chord_of_arc, on_globe, sphere_km
from ..functions.identity import entity_key
from ..session import materialise
from .groups import whole_groups
from .slices import sliced


@dataclass(frozen=True)
class StopRule:
    radius_km: float = 1.0
    least_s: int = 600
    silence_s: int = 2700
    outlier_km: float = 100.0
    slice_s: int = 86_400
    segment_s: int = 3_600
    cell_km: float = 0.25
    strides: tuple[int, ...] = (8, 64)


def clean_pings(df: DataFrame, key: str, lat: str, lon: str, second: Column, tie: str) -> DataFrame:
    """(k, s, lat, lon, tie) of the pings that can count."""
    out = df.select(
        entity_key(key).alias("k"), second.cast("bigint").alias("s"),
        F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(tie).alias("tie"),
    )
    return out.where(F.col("k").isNotNull() & F.col("s").isNotNull() & on_globe("lat", "lon"))


def _xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.c_[np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)] * EARTH_KM


def _away(p: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Chord in km from each point to the one n before it in its group; NaN where there is none."""
    out = np.full(len(p), np.nan)
    if len(p) > n:
        d = np.sqrt(((p[n:] - p[:-n]) ** 2).sum(axis=1))
        out[n:] = np.where(group[n:] == group[:-n], d, np.nan)
    return out


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """What was measured from the point n further on."""
    out = np.full(len(x), np.nan)
    out[:-n] = x[n:]
    return out


SEGMENT = (
    "k string, _slice bigint, seg bigint, still boolean, joined boolean, first_s bigint, last_s bigint, n bigint, gap bigint, path_km double, "
    + ", ".join(f"{c}_{e} double" for c in "xyz" for e in ("lo", "hi", "med"))
)


def _segments(rule: StopRule):
    near, far = chord_of_arc(rule.radius_km), chord_of_arc(rule.outlier_km)

    def one(b: pd.DataFrame) -> pd.DataFrame:
        k, cut, s, own = b["k"].to_numpy(), b["_slice"].to_numpy(), b["s"].to_numpy(), b["_own"].to_numpy()
        p = _xyz(b["lat"].to_numpy(float), b["lon"].to_numpy(float))
        group = np.cumsum(np.r_[True, (cut[1:] != cut[:-1]) | (k[1:] != k[:-1])])
        # lone outliers go before anything else is looked at
        one, two = _away(p, group, 1), _away(p, group, 2)
        lone = (one > far) & (_ahead(one, 1) > far) & (_ahead(two, 1) <= far) if len(p) > 2 else np.zeros(len(p), bool)
        keep = np.flatnonzero(~lone)
        k, cut, s, own, p, group = (x[keep] for x in (k, cut, s, own, p, group))
        n = len(s)
        step = _away(p, group, 1)
        begins = np.r_[True, group[1:] != group[:-1]]
        gap = np.where(begins, 0, np.r_[0, np.diff(s)])
        # A ping further than the radius from one at most half the least duration before it, and from one as long after
        # it, is in no stop: whichever side of it holds half of the stop holds one of the two. Looking a few strides
        # back and ahead finds such pings where they are dense, so that a flight doesn't become one segment.
        back, on = np.zeros(n, bool), np.zeros(n, bool)
        for m in rule.strides:
            if n > m:
                off = np.zeros(n, bool)
                off[m:] = (s[m:] - s[:-m] <= rule.least_s // 2) & (_away(p, group, m)[m:] > near)
                back |= off
                on[:-m] |= off[m:]
        moving = back & on
        brk = ~(step <= near) | (gap > rule.silence_s) | moving
        brk[1:] |= moving[:-1] & ~begins[1:]
        ends = np.r_[begins[1:], True]
        still = ~brk | (~np.r_[brk[1:], True] & ~ends)
        turn = np.where(still, brk, begins | np.r_[True, still[:-1]] | (gap > rule.silence_s))
        hour = s // rule.segment_s
        turn |= still & np.r_[True, hour[1:] != hour[:-1]]  # goes on from the segment before it
        i = np.flatnonzero(own)
        if not len(i):
            return pd.DataFrame(columns=names)
        at = np.flatnonzero(turn[i] | np.r_[True, group[i][1:] != group[i][:-1]])
        first, size = i[at], np.diff(np.r_[at, len(i)])
        seg = np.repeat(np.arange(len(at)), size)
        q, calm = p[i], still[i]
        out = {
            "k": k[first], "_slice": cut[first], "seg": np.arange(len(at)), "still": still[first], "joined": ~brk[first] & still[first],
            "first_s": s[first], "last_s": s[i[at + size - 1]], "n": size, "gap": gap[first],
            "path_km": np.add.reduceat(np.where(~calm | brk[i], 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.nan_to_num(step[i]) / (2 * EARTH_KM))), 0.0), at),
        }
        where = np.flatnonzero(calm)
        middle = np.r_[0, np.cumsum(np.bincount(seg[where], minlength=len(at)))]
        for j, c in enumerate("xyz"):
            out[f"{c}_lo"], out[f"{c}_hi"] = np.minimum.reduceat(q[:, j], at), np.maximum.reduceat(q[:, j], at)
            x = q[where, j][np.lexsort((q[where, j], seg[where]))]
            med = np.full(len(at), np.nan)
            full = middle[1:] > middle[:-1]
            med[full] = x[(middle[:-1] + middle[1:] - 1)[full] // 2]
            out[f"{c}_med"] = med
        return pd.DataFrame(out)[names]

    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches):
        for b in whole_groups(batches, ["k", "_slice"]):
            r = one(b)
            if len(r):
                yield r

    return run


def segments(pings: DataFrame, rule: StopRule) -> DataFrame:
    """SEGMENT of (k, s, lat, lon, tie): one row per entity, slice and segment, in the order (_slice, seg). A new segment
    begins where the aircraft goes over from resting to moving, rests at another place, was silent, or where an hour is
    over. joined: it goes on from the segment before it without a break; gap: the seconds since the ping before it."""
    most = max(rule.strides) + 4
    cut = sliced(pings.select("k", "s", "lat", "lon", "tie"), "k", "s", 4, 4, rule.slice_s, most, min(rule.slice_s, rule.silence_s + rule.least_s), "tie", keep_tie=False)
    cut = cut.select("k", "_slice", "s", "lat", "lon", "_own").sortWithinPartitions("k", "_slice", "s")
    return cut.mapInPandas(_segments(rule), SEGMENT)


def place_communities(still: DataFrame, rule: StopRule) -> DataFrame:
    """(k, cx, cy, cz, place): the community of every occupied cell of an entity. Nodes are the distinct cells with
    the number of pings as weight; nodes within the radius are linked; every node points to the heaviest node among
    itself and its neighbours, and following the pointers to their end gives the communities (mode seeking on the
    proximity graph, deterministic). Pointer jumping halves the way left in each round."""
    size = rule.cell_km
    nodes = still.groupBy("k", *[F.floor(F.col(f"{c}_med") / size).cast("int").alias(f"c{c}") for c in "xyz"]).agg(
        F.sum("n").alias("weight")
    )
    reach = int(np.ceil(rule.radius_km / size))
    me = ["k", "cx", "cy", "cz"]
    # a cell's neighbours are found through coarse cells of the radius: 27 copies of a node at most
    coarse = [F.floor(F.col(f"c{c}") / reach).cast("int").alias(f"g{c}") for c in "xyz"]
    around = F.sequence(F.lit(-1), F.lit(1))
    left = nodes.select("*", *coarse)
    right = left.select("k", "weight", *[F.col(f"c{c}").alias(f"d{c}") for c in "xyz"], *[f"g{c}" for c in "xyz"])
    for c in "xyz":
        right = right.withColumn("_o", F.explode(around)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("_o")).drop("_o")
    d2 = sum(((F.col(f"c{c}") - F.col(f"d{c}")) * (F.col(f"c{c}") - F.col(f"d{c}")) for c in "xyz"), F.lit(0))
    best = (
        left.select(*me, "gx", "gy", "gz").join(right, ["k", "gx", "gy", "gz"]).where(d2 <= reach * reach)
        .groupBy(*me).agg(F.max(F.struct("weight", "dx", "dy", "dz")).alias("b"))
    )
    to = lambda c: F.struct(*[F.col(f"{c}.d{a}").alias(f"d{a}") for a in "xyz"])
    links = materialise(best.select(*me, to("b").alias("to")))
    for _ in range(40):
        nxt = links.select("k", *[F.col(f"c{a}").alias(f"e{a}") for a in "xyz"], F.col("to").alias("further"))
        cond = [F.col(f"l.to.d{a}") == F.col(f"r.e{a}") for a in "xyz"]
        jumped = links.alias("l").join(nxt.alias("r"), [F.col("l.k") == F.col("r.k"), *cond]).select(
            *[F.col(f"l.{c}").alias(c) for c in me], F.col("r.further").alias("to"), (F.col("r.further") != F.col("l.to")).alias("moved")
        )
        jumped = materialise(jumped)
        moved = jumped.where("moved").limit(1).count()
        links = jumped.drop("moved")
        if not moved:
            break
    return links.select(*me, F.concat_ws(":", *[F.col(f"to.d{a}").cast("string") for a in "xyz"]).alias("place"))


#: Directions in the plane, and how much of a distance at least one of them sees.
ANGLES = np.arange(32) * (2 * np.pi / 32)
SEEN = np.cos(np.pi / 32)


def maximal_windows(p: np.ndarray, near: float) -> np.ndarray:
    """lo[j]: the earliest point from which all points up to j, of points (n, 3) in km, are within `near` of each other.

    The points of the window are known by how far they reach in 32 directions of the plane (two stacks: one grows, of
    the other all suffixes are known), which settles all but distances within half a percent of `near`, and pairs that
    are too far; then points are looked at, the latest first."""
    n = len(p)
    lo = np.zeros(n, np.int64)
    if n < 2:
        return lo
    middle = np.median(p, axis=0)
    up = middle / max(np.linalg.norm(middle), 1e-9)
    east = np.cross([0.0, 0.0, 1.0] if abs(up[2]) < 0.9 else [1.0, 0.0, 0.0], up)
    east /= np.linalg.norm(east)
    plane = (p - middle) @ np.c_[east, np.cross(up, east)]
    flat = np.abs(plane).max() < 50  # the plane shortens no distance by more than a thousandth
    reach = plane @ np.r_[[np.cos(ANGLES)], [np.sin(ANGLES)]]
    sure = near * SEEN - 1e-3 if flat else -1.0
    first = mid = at = 0
    front, back = reach[:0], np.full(len(ANGLES), -np.inf)
    for j in range(n):
        here = reach[j]
        known = np.maximum(back, front[first - at]) if first < mid else back
        if j > first and (known - here).max() > sure:
            stop = j
            while stop > first:
                start = max(first, stop - 512)
                d = p[start:stop] - p[j]
                off = np.flatnonzero(np.einsum("ij,ij->i", d, d) > near * near)
                if off.size:
                    first = start + int(off[-1]) + 1
                    break
                stop = start
            if first >= mid:
                front, at, mid = np.maximum.accumulate(reach[first : j + 1][::-1], axis=0)[::-1], first, j + 1
                back = np.full(len(ANGLES), -np.inf)
                lo[j] = first
                continue
        back = np.maximum(back, here)
        lo[j] = first
    return lo


WINDOW = ["start_s", "end_s", "before_s", "after_s", "start_i", "end_i", "x_med", "y_med", "z_med"]


def windows_of(s: np.ndarray, index: np.ndarray, p: np.ndarray, near: float, least_s: int) -> list[tuple]:
    """WINDOW of the longest runs to either side of which a point is too far off. before and after: the neighbours'
    times. Shorter ones than least_s can't become stops."""
    lo = maximal_windows(p, near)
    ends = np.flatnonzero(np.r_[lo[1:] != lo[:-1], True]) if len(lo) else lo
    out = []
    for j in ends.tolist():
        i = int(lo[j])
        if s[j] - s[i] >= least_s:
            before, after = s[i - 1] if i else s[i], s[j + 1] if j + 1 < len(s) else s[j]
            out.append((int(s[i]), int(s[j]), int(before), int(after), int(index[i]), int(index[j]), *np.median(p[i : j + 1], axis=0)))
    return out


def longest_first(windows: list[tuple], least_s: int) -> list[tuple]:
    """The stops among WINDOW rows of a chain: the longest first (of equals the earlier), then what is left on either
    side of it. Windows inside others, which come from the edges of parts, don't count."""
    windows = sorted(set(windows), key=lambda w: (w[0], -w[1]))
    kept: list[tuple] = []
    for w in windows:
        if not kept or w[1] > kept[-1][1]:
            kept.append(w)
    found, todo = [], [(0, len(kept), None, None)]
    while todo:
        a, b, left, right = todo.pop()
        best, which = least_s - 1, None
        for m in range(a, b):
            w = kept[m]
            start, end = (w[0] if left is None or w[0] >= left[0] else left[0]), (w[1] if right is None or w[1] <= right[0] else right[0])
            if end - start > best:
                best, which = end - start, (m, start, end)
        if which is None:
            continue
        m, start, end = which
        w = kept[m]
        i = w[4] if start == w[0] else left[1]
        j = w[5] if end == w[1] else right[1]
        found.append((start, end, j - i + 1, *w[6:9]))
        # windows that reach over the edge of the one taken are cut at it
        before = (w[2], w[4] - 1) if start == w[0] else None
        after = (w[3], w[5] + 1) if end == w[1] else None
        if before is not None and before[0] < start:
            todo.append((a, m, left, before))
        if after is not None and after[0] > end:
            todo.append((m + 1, b, after, right))
    return sorted(found)


def _searched(rule: StopRule):
    """Windows of parts, from their pings sorted by (k, chain, part, s, tie); holds one part at a time."""
    near, least, lone_off = chord_of_arc(rule.radius_km), rule.least_s, chord_of_arc(rule.outlier_km)
    far = lambda a, b: ((a - b) ** 2).sum(axis=1) > lone_off**2

    def run(batches):
        for b in whole_groups(batches, ["k", "chain", "part"], 20_000):
            new = b["k"].ne(b["k"].shift()) | b["chain"].ne(b["chain"].shift()) | b["part"].ne(b["part"].shift())
            out = []
            for _, v in b.groupby(new.cumsum(), sort=False):
                v = v[v["s"].ne(v["s"].shift())]  # one ping in a second
                s, p, base = v["s"].to_numpy(), v[["x", "y", "z"]].to_numpy(), v["base"].to_numpy()
                lone = np.zeros(len(s), bool)  # a chain begins and ends with pings that count
                lone[1:-1] = far(p[1:-1], p[:-2]) & far(p[1:-1], p[2:]) & ~far(p[:-2], p[2:])
                s, p, base, last = s[~lone], p[~lone], base[~lone], v["last"].to_numpy()[~lone]
                # the number of a ping in its chain: pings before its segment, and before it in the segment
                begin = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
                size = np.diff(np.r_[begin, len(base)])
                index = np.where(last >= 0, last, base + np.arange(len(base)) - np.repeat(begin, size))
                out += [(v["k"].iloc[0], v["chain"].iloc[0], *w) for w in windows_of(s, index, p, near, least)]
            if out:
                yield pd.DataFrame(out, columns=["k", "chain", *WINDOW])

    return run


def _chosen(rule: StopRule):
    """Stops from the windows of chains, sorted by (k, chain)."""

    def run(batches):
        for b in whole_groups(batches, ["k", "chain"], 20_000):
            out = []
            for (k, chain), v in b.groupby(["k", "chain"], sort=False):
                out += [(k, *w) for w in longest_first([tuple(r) for r in v[WINDOW].itertuples(index=False)], rule.least_s)]
            if out:
                yield pd.DataFrame(out, columns=["k", "start_s", "end_s", "n", "x_med", "y_med", "z_med"])

    return run


def _box(p: str = "", of=lambda low, high: (F.min(low), F.max(high))) -> list[Column]:
    return [c.alias(f"{p}{a}_{e}") for a in "xyz" for c, e in zip(of(f"{a}_lo", f"{a}_hi"), ("lo", "hi"))]


def visits(segs: DataFrame, places: DataFrame, rule: StopRule) -> DataFrame:
    """The still segments with their place, and the chain and visit they belong to: a chain goes on from segment to
    segment without a break, a visit is a part of it with one place. base: the pings of the chain before the segment."""
    size = rule.cell_km
    cells = [F.floor(F.col(f"{c}_med") / size).cast("int").alias(f"c{c}") for c in "xyz"]
    labelled = segs.where("still").select("*", *cells).join(places, ["k", "cx", "cy", "cz"], "left")
    w = W.partitionBy("k").orderBy("_slice", "seg")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    goes_on = F.coalesce(F.col("joined") & F.lag(F.lit(True)).over(w), F.lit(False))
    labelled = labelled.withColumn("_on", goes_on).withColumn("_same", goes_on & F.coalesce(F.col("place") == F.lag("place").over(w), F.lit(False)))
    labelled = labelled.withColumns({"chain": F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(run), "visit": F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(run)})
    inner = W.partitionBy("k", "chain").orderBy("_slice", "seg").rowsBetween(W.unboundedPreceding, -1)
    return labelled.withColumn("base", F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("_on", "_same", "cx", "cy", "cz")


def parts_of(visited: DataFrame, chains: DataFrame, rule: StopRule) -> DataFrame:
    """(k, chain, part, first_visit, last_visit, box) of the chains to be searched: the parts of the search. A part goes
    from one cut to the next, and one visit over each."""
    near = chord_of_arc(rule.radius_km)
    v = visited.join(chains.select("k", "chain"), ["k", "chain"], "left_semi").groupBy("k", "chain", "visit").agg(*_box())
    w = W.partitionBy("k", "chain").orderBy("visit")
    nxt = F.lead(F.struct(*[f"{c}_{e}" for c in "xyz" for e in ("lo", "hi")], "visit")).over(w)
    v = v.withColumn("_x", nxt)
    wide = [F.greatest(f"{c}_hi", f"_x.{c}_hi") - F.least(f"{c}_lo", f"_x.{c}_lo") > near for c in "xyz"]
    v = v.withColumn("_cut", F.coalesce(F.col("_x").isNotNull() & (wide[0] | wide[1] | wide[2]), F.lit(False)))
    cuts = F.coalesce(F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("_part", cuts).withColumn("_was", F.coalesce(F.lag("_cut").over(w), F.lit(False)))
    mine = F.array_compact(F.array(F.col("_part"), F.when(F.col("_cut"), F.col("_part") + 1), F.when(F.col("_was"), F.col("_part") - 1)))
    v = v.select("k", "chain", "visit", *[f"{c}_{e}" for c in "xyz" for e in ("lo", "hi")], F.explode(mine).alias("part"))
    return v.groupBy("k", "chain", "part").agg(F.min("visit").alias("first_visit"), F.max("visit").alias("last_visit"), *_box("p"))


def stops_and_trips(pings: DataFrame, rule: StopRule = StopRule()) -> DataFrame:
    """(icao24, kind, start_s, end_s, n, distance_km, path_km, place, to_place) from (k, s, lat, lon, tie).

    distance_km is 0 for a stop and the great-circle distance between the places for a trip; path_km is the length of
    the track. place is the community: of the stop, or of the start of the trip; to_place of its end."""
    segs = materialise(segments(pings, rule))
    places = place_communities(segs.where("still"), rule)
    visited = materialise(visits(segs, places, rule))
    near = chord_of_arc(rule.radius_km)
    chains = visited.groupBy("k", "chain").agg(
        F.min("first_s").alias("start_s"), F.max("last_s").alias("end_s"), F.sum("n").alias("n"), *_box(),
        *[F.max_by(f"{c}_med", "n").alias(f"{c}_med") for c in "xyz"], F.max_by("place", "n").alias("place"),
    ).where(F.col("end_s") - F.col("start_s") >= rule.least_s)
    diag = F.sqrt(sum(((F.col(f"{c}_hi") - F.col(f"{c}_lo")) * (F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c in "xyz"), F.lit(0.0)))
    cols = ["k", "start_s", "end_s", "n", "x_med", "y_med", "z_med"]
    sure = chains.where(diag <= near).select(*cols, "place")

    # the exact search of the other chains
    parts = parts_of(visited, chains.where(diag > near), rule)
    inside = visited.join(parts, ["k", "chain"]).where(F.col("visit").between(F.col("first_visit"), F.col("last_visit")))
    corner = [F.greatest(F.col(f"p{c}_hi") - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"p{c}_lo")) for c in "xyz"]
    inside = inside.withColumn("opened", F.sqrt(corner[0] * corner[0] + corner[1] * corner[1] + corner[2] * corner[2]) > near)
    inside = materialise(inside.select("k", "chain", "part", "first_s", "last_s", "n", "base", "opened", *[f"{c}_med" for c in "xyz"]))
    end = lambda at, i: F.struct(F.col(at).alias("s"), i.cast("bigint").alias("last"))
    ends = F.array_distinct(F.array(end("first_s", F.col("base")), end("last_s", F.col("base") + F.col("n") - 1)))
    closed = inside.where("NOT opened").select(
        "k", "chain", "part", "base", F.lit(None).cast("bigint").alias("tie"), *[F.col(f"{c}_med").alias(c) for c in "xyz"], F.inline(ends)
    )
    hours = inside.where("opened").select("k", "chain", "part", "base", "first_s", "last_s", F.floor(F.col("first_s") / rule.segment_s).alias("_h"))
    fetched = pings.withColumn("_h", F.floor(F.col("s") / rule.segment_s)).join(hours, ["k", "_h"]).where(F.col("s").between(F.col("first_s"), F.col("last_s")))
    fetched = fetched.select("k", "chain", "part", "base", "s", "tie", *[c.alias(n) for c, n in zip(sphere_km("lat", "lon"), "xyz")], F.lit(-1).cast("bigint").alias("last"))
    loose = fetched.unionByName(closed.withColumn("tie", F.col("tie").cast(dict(fetched.dtypes)["tie"])))
    loose = loose.repartition("k", "chain", "part").sortWithinPartitions("k", "chain", "part", "s", "tie")
    windows = loose.mapInPandas(
        _searched(rule), "k string, chain bigint, start_s bigint, end_s bigint, before_s bigint, after_s bigint, start_i bigint, end_i bigint, x_med double, y_med double, z_med double"
    )
    found = windows.repartition("k", "chain").sortWithinPartitions("k", "chain", "start_s").mapInPandas(
        _chosen(rule), "k string, start_s bigint, end_s bigint, n bigint, x_med double, y_med double, z_med double"
    )
    cells = [F.floor(F.col(f"{c}_med") / rule.cell_km).cast("int").alias(f"c{c}") for c in "xyz"]
    found = found.select("*", *cells).join(places, ["k", "cx", "cy", "cz"], "left").select(*cols, "place")
    stops = sure.unionByName(found)

    # trips: neighbours among stops, silences and stretches of movement, in order of time
    silent = segs.where(F.col("gap") > rule.silence_s).select("k", F.col("first_s").alias("start_s"))
    none = {c: F.lit(None).cast("double") for c in ("x_med", "y_med", "z_med", "path_km")}
    moves = segs.select("k", F.col("first_s").alias("start_s"), F.lit(None).cast("bigint").alias("end_s"), F.col("path_km"), F.lit(-1).alias("rank"))
    events = (
        stops.withColumns({"path_km": none["path_km"], "rank": F.lit(1)})
        .unionByName(silent.withColumn("rank", F.lit(0)), allowMissingColumns=True)
        .unionByName(moves, allowMissingColumns=True)
    )
    t = W.partitionBy("k").orderBy("start_s", "rank")
    events = events.withColumn("_way", F.sum(F.coalesce("path_km", F.lit(0.0))).over(t.rowsBetween(W.unboundedPreceding, 0)))
    events = events.where("rank >= 0")
    prior = F.lag(F.struct("rank", "end_s", "x_med", "y_med", "z_med", "place", "_way")).over(t)
    events = events.withColumn("_p", prior).where("rank = 1")
    flown = chord_km([F.col(f"{c}_med") for c in "xyz"], [F.col(f"_p.{c}_med") for c in "xyz"])
    arc = arc_of_chord(flown)
    stop = F.struct(
        F.lit("stop").alias("kind"), F.col("start_s"), F.col("end_s"), F.col("n"), F.lit(0.0).alias("distance_km"),
        F.lit(None).cast("double").alias("path_km"), F.col("place"), F.lit(None).cast("string").alias("to_place"),
    )
    trip = F.struct(
        F.lit("trip").alias("kind"), F.col("_p.end_s").alias("start_s"), F.col("start_s").alias("end_s"),
        F.lit(None).cast("bigint").alias("n"), arc.alias("distance_km"), (F.col("_way") - F.col("_p._way")).alias("path_km"),
        F.col("_p.place").alias("place"), F.col("place").alias("to_place"),
    )
    both = F.when(F.col("_p.rank") == 1, F.array(stop, trip)).otherwise(F.array(stop))
    return events.select(F.col("k").alias("icao24"), F.inline(both))
