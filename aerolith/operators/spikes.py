"""Implausible readings, judged by how their source usually behaves.

Readings of a source are taken in order of time; a break starts a new stretch; null readings are skipped. One pass
over slices of bounded length (`slices.sliced`) gives three things: readings that are impossible in themselves, with
no regard to the source; candidates for spikes (at most three readings in a row off the course that the readings
before and after them give, and back again) and runs of equal values; and quantile sketches of the scatter around the
course, by source, field and hour of the day. A sketch is a histogram over logarithmic bins: quantiles have a relative
error of at most 2 %, sketches merge by adding counts, and the result depends on neither the partitioning nor chance.
The merged sketches of a source give its interquartile range, over all hours and in each hour of the day, and with it
the expanded fence that a candidate must leave: that of its hour, as far as the hour has readings of its own (few are
drawn towards the source's overall range), but never less than the fence over all hours, which is what the source
usually does. A rate of change is implausible as a deviation from the course: a jump that stays is a new level.

A candidate block must also be one: its deviation is more than twice what the readings on both sides disagree by
(so a course that itself breaks off is no spike), and each of its readings is off both courses by more than half of it.
A run of equal values is stuck unless the aircraft rests: its usual speed in the run is under rest_speed or unknown, and
its position, where there is any, moves by less than rest_spread degrees between the 10th and 90th percentile.

Defined results: rows without key or time aren't judged; of several in one second the one with the lowest order value
is. Null and NaN readings are skipped. A reading with nothing before or after it in its stretch is no spike. A source
that was never seen moving has no scatter, so the least deviation alone decides. Empty input, empty output.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import entity_key
from ..session import materialise
from .groups import whole_groups
from .slices import sliced


@dataclass(frozen=True)
class Field:
    name: str
    low: float
    high: float
    least: float  # a spike deviates by at least so much
    wrap: float = 0.0  # period, of an angle


@dataclass(frozen=True)
class ReadingRule:
    fields: tuple[Field, ...] = (
        Field("alt_baro", -1500.0, 60000.0, 2000.0),
        Field("gs", 0.0, 1200.0, 40.0),
        Field("lat", -90.0, 90.0, 0.1),
        Field("lon", -180.0, 180.0, 0.1, 360.0),
    )
    speed: str = "gs"
    position: tuple[str, str] = ("lat", "lon")
    break_s: int = 600
    spike_readings: int = 3
    scatter_times: float = 10.0
    stuck_readings: int = 12
    rest_speed: float = 5.0
    rest_spread: float = 0.005
    neighbours: int = 5
    slice_s: int = 86_400
    guests: int = 16  # rows a slice sees on either side at least, and up to `more` within `reach_s`
    more: int = 1_000
    reach_s: int = 7_200
    growth: float = dc_field(default=1.04)  # of the sketch's bins
    hour_prior: float = 300.0  # readings that the overall range counts for in the range of an hour


ZERO_BIN = -100_000
SCHEMA = "k string, field string, kind string, log_seq bigint, d double, hour int, bin int, cnt bigint"


def _wrapped(d: np.ndarray, period: float) -> np.ndarray:
    return d - period * np.round(d / period) if period else d


def _median(a: np.ndarray) -> np.ndarray:
    """Row medians without NaN; NaN for rows of nothing but NaN."""
    s = np.sort(a, axis=1)
    n = (~np.isnan(a)).sum(axis=1)
    r = np.arange(len(a))
    lo, hi = s[r, np.maximum(n - 1, 0) // 2], s[r, np.minimum(n // 2, a.shape[1] - 1)]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def _side(x, t, st, edge, step, count, period):
    """Readings from `edge` on in direction `step`: values relative to the edge, times, slope."""
    idx = edge[:, None] + step * np.arange(count)[None, :]
    ok = (idx >= 0) & (idx < len(x))
    idx = np.clip(idx, 0, len(x) - 1)
    ok &= st[idx] == st[edge][:, None]
    y = np.where(ok, _wrapped(x[idx] - x[edge][:, None], period), np.nan)
    tt = np.where(ok, t[idx], np.nan)
    slope = _median(np.diff(y, axis=1) / np.diff(tt, axis=1))
    return y, tt, slope


def spike_candidates(x, t, st, rule: ReadingRule, f: Field):
    """(index, d): readings of blocks that leave the course and come back, and by how much at least; d is to be held
    against the fence."""
    n, best = len(x), np.zeros(len(x))
    if n < 3:
        return best
    for m in range(1, rule.spike_readings + 1):
        i = np.arange(1, n - m)
        a = i + m
        i, a = (v[st[i - 1] == st[a]] for v in (i, a))
        if not len(i):
            continue
        b = i - 1
        base = x[b]
        ya = _wrapped(x[a] - base, f.wrap)
        away = np.ones(len(i), bool)
        for j in range(m):  # the block must be off the line between its neighbours by half of the least
            line = ya * (t[i + j] - t[b]) / np.maximum(t[a] - t[b], 1e-9)
            away &= np.abs(_wrapped(x[i + j] - base - line, f.wrap)) >= f.least / 2
        i, a, b = i[away], a[away], b[away]
        if not len(i):
            continue
        base = x[b]
        yl, tl, sl = _side(x, t, st, b, -1, rule.neighbours, f.wrap)
        yr, tr, sr = _side(x, t, st, a, 1, rule.neighbours, f.wrap)
        yr = yr + _wrapped(x[a] - base, f.wrap)[:, None]
        sl, sr = np.where(np.isnan(sl), sr, sl), np.where(np.isnan(sr), sl, sr)
        sl, sr = np.nan_to_num(sl), np.nan_to_num(sr)
        left = lambda at: _median(yl + sl[:, None] * (at[:, None] - tl))
        right = lambda at: _median(yr + sr[:, None] * (at[:, None] - tr))
        d, both = np.full(len(i), np.inf), np.full(len(i), np.inf)
        for j in range(m):
            at, v = t[i + j], _wrapped(x[i + j] - base, f.wrap)
            before, after = left(at), right(at)
            d = np.minimum(d, np.abs(v - (before + after) / 2))
            both = np.minimum(both, np.minimum(np.abs(v - before), np.abs(v - after)))
        mid = (t[i] + t[i + m - 1]) / 2
        off = np.maximum(np.abs(left(t[b])), np.abs(_wrapped(x[a] - base, f.wrap) - right(t[a])))
        off = np.maximum(off, np.abs(left(mid) - right(mid)))
        d = np.where((off < d / 2) & (both > d / 2), d, 0)
        for j in range(m):
            np.maximum.at(best, i + j, d)
    return best


def _judge(rule: ReadingRule):
    def one(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        k, t, seq, own = b["k"].to_numpy(), b["s"].to_numpy(float), b["seq"].to_numpy(), b["_own"].to_numpy()
        group = np.r_[True, (k[1:] != k[:-1]) | (b["_slice"].to_numpy()[1:] != b["_slice"].to_numpy()[:-1])]
        st = np.cumsum(group | np.r_[True, np.diff(t) > rule.break_s])
        hour = (b["s"].to_numpy() // 3600 % 24).astype(np.int32)
        speed = b[rule.speed].to_numpy(float)
        flying = ~(np.nan_to_num(speed, nan=np.inf) < rule.rest_speed)
        place = [b[c].to_numpy(float) for c in rule.position]

        def emit(kind, f, at, d):
            if len(at):
                out.append(pd.DataFrame({"k": k[at], "field": f, "kind": kind, "log_seq": seq[at], "d": d, "hour": hour[at], "bin": 0, "cnt": 0}))

        for f in rule.fields:
            v = b[f.name].to_numpy(float)
            there = ~np.isnan(v)
            bad = there & ((v < f.low) | (v > f.high))
            at = np.flatnonzero(bad & own)
            emit("impossible", f.name, at, np.abs(v[at]))
            at = np.flatnonzero(there & ~bad)
            if len(at) < 2:
                continue
            x, tt, s = v[at], t[at], st[at]
            d = spike_candidates(x, tt, s, rule, f)
            hit = (d >= f.least) & own[at]
            emit("spike", f.name, at[hit], d[hit])
            # runs of equal values
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (s[1:] != s[:-1])])
            length = np.diff(np.r_[first, len(x)])
            for i, n in zip(first[length >= rule.stuck_readings], length[length >= rule.stuck_readings]):
                rows = at[i : i + n]
                span = slice(rows[0], rows[-1] + 1)
                known = speed[span][~np.isnan(speed[span])]
                slow = not len(known) or np.median(known) < rule.rest_speed
                still = True
                for p in place:
                    q = p[span][~np.isnan(p[span])]
                    still &= not len(q) or np.subtract(*np.percentile(q, [90, 10])) < rule.rest_spread
                if not (slow and still):
                    emit("stuck", f.name, rows[own[rows]], np.full(int(own[rows].sum()), float(n)))
            # scatter around the course, in flight: off the line between the neighbours, brought to one reading
            if len(x) > 2:
                span = np.maximum(tt[2:] - tt[:-2], 1e-9)
                u = (tt[1:-1] - tt[:-2]) / span
                r = _wrapped(x[1:-1] - x[:-2], f.wrap) - u * _wrapped(x[2:] - x[:-2], f.wrap)
                r /= np.sqrt(1 + u * u + (1 - u) ** 2)
                mid = at[1:-1]
                use = (s[2:] == s[:-2]) & own[mid] & flying[mid]
                r, mid = np.abs(r[use]), mid[use]
                if len(r):
                    bins = np.where(r > 1e-9, np.floor(np.log(np.maximum(r, 1e-9)) / np.log(rule.growth)), ZERO_BIN).astype(np.int32)
                    h = pd.DataFrame({"k": k[mid], "hour": hour[mid], "bin": bins}).value_counts(sort=False).rename("cnt").reset_index()
                    out.append(h.assign(field=f.name, kind="sketch", log_seq=-1, d=0.0))
        cols = ["k", "field", "kind", "log_seq", "d", "hour", "bin", "cnt"]
        return pd.concat(out)[cols] if out else pd.DataFrame({c: [] for c in cols})

    def run(batches):
        for b in whole_groups(batches, ["k", "_slice"]):
            r = one(b)
            if len(r):
                yield r

    return run


def judged(df: DataFrame, key: str, second: Column, order: str, rule: ReadingRule = ReadingRule()) -> DataFrame:
    """The pass over all readings: candidates and sketches (SCHEMA), written to the checkpoint folder because both
    sides of the last step read them."""
    names = [f.name for f in rule.fields]
    rows = df.select(
        entity_key(key).alias("k"), second.cast("bigint").alias("s"), F.col(order).alias("seq"),
        *[F.col(c).cast("double").alias(c) for c in names],
    ).where(F.col("k").isNotNull() & F.col("s").isNotNull())
    cut = sliced(rows, "k", "s", rule.guests, rule.guests, rule.slice_s, rule.more, rule.reach_s, tie="seq")
    cut = cut.select("k", "s", "seq", *names, "_slice", "_own").sortWithinPartitions("k", "_slice", "s")
    return materialise(cut.mapInPandas(_judge(rule), SCHEMA))


def scatter(passed: DataFrame, by: list[str], rule: ReadingRule = ReadingRule()) -> DataFrame:
    """Merged sketches: (by..., readings, q1, q2, q3) of the absolute scatter; with by = (k, field) of the source over
    all hours."""
    b = passed.where("kind = 'sketch'").groupBy(*by, "bin").agg(F.sum("cnt").alias("c"))
    w = W.partitionBy(*by).orderBy("bin")
    b = b.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(W.partitionBy(*by)))
    value = F.when(F.col("bin") == ZERO_BIN, F.lit(0.0)).otherwise(F.pow(F.lit(rule.growth), F.col("bin") + 0.5))
    q = [F.min(F.when(F.col("upto") >= p * F.col("all"), value)).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return b.groupBy(*by).agg(F.max("all").alias("readings"), *q)


#: The interquartile range of a normal distribution in standard deviations; |scatter| has its median at half of it.
IQR_SIGMAS = 1.3489795


def implausible(df: DataFrame, key: str, second: Column, order: str, rule: ReadingRule = ReadingRule()) -> DataFrame:
    """(log_seq, k, field, kind, d, fence): every reading that is impossible, a spike or stuck, once for each kind."""
    passed = judged(df, key, second, order, rule)
    # scatter is symmetric about the course: its interquartile range is twice the median of its absolute value
    hours = scatter(passed, ["k", "field", "hour"], rule).groupBy("k", "field").agg(  # 24 at most
        F.map_from_entries(F.collect_list(F.struct("hour", F.struct("readings", "q2")))).alias("hours")
    )
    usual = scatter(passed, ["k", "field"], rule).select("k", "field", "q2").join(hours, ["k", "field"])
    salts = 16
    usual = usual.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cases = passed.where("kind <> 'sketch'").withColumn("salt", F.pmod(F.hash("log_seq"), F.lit(salts)))
    held = cases.join(usual, ["k", "field", "salt"], "left").withColumn("_h", F.try_element_at("hours", F.col("hour")))
    n, prior = F.coalesce(F.col("_h.readings"), F.lit(0)), F.lit(rule.hour_prior)
    own = (n * F.coalesce(F.col("_h.q2"), F.lit(0.0)) + prior * F.col("q2")) / (n + prior)
    fence = F.lit(rule.scatter_times * 2 / IQR_SIGMAS) * F.greatest(F.col("q2"), own)
    held = held.withColumn("fence", F.coalesce(fence, F.lit(0.0)))
    held = held.where((F.col("kind") != "spike") | (F.col("d") > F.col("fence")))
    return held.select("log_seq", "k", "field", "kind", "d", "fence")
