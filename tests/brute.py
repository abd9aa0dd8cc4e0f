"""Plain versions of operators that SQL can't express, for small inputs. Written from the definitions, not from the
operators."""

from __future__ import annotations

import math

WS = "\t\n\x0b\x0c\r \x85\xa0"


def key_of(x):
    if x is None or x != x:
        return None
    return x.strip().lower() or None


def hav(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def stops_and_trips(rows, radius=1.0, least=600, silence=2700, far=100.0):
    """rows: (tie, icao24, lat, lon, second). -> {(icao24, kind, start, end)}"""
    by = {}
    for tie, icao, lat, lon, s in rows:
        k = key_of(icao)
        if k is None or s is None or lat is None or lon is None or not (abs(lat) <= 90 and abs(lon) <= 180):
            continue
        old = by.setdefault(k, {}).get(s)
        if old is None or tie < old[0]:
            by[k][s] = (tie, lat, lon)
    out = set()
    for k, pings in by.items():
        q = [(s, *pings[s][1:]) for s in sorted(pings)]
        keep = []
        for i, (s, a, o) in enumerate(q):
            if 0 < i < len(q) - 1:
                p, n = q[i - 1], q[i + 1]
                if hav(a, o, *p[1:]) > far and hav(a, o, *n[1:]) > far and hav(*p[1:], *n[1:]) <= far:
                    continue
            keep.append((s, a, o))

        def longest(lo, hi):
            best, i = None, lo
            for j in range(lo, hi + 1):
                if j > lo and keep[j][0] - keep[j - 1][0] > silence:
                    i = j
                for m in range(j - 1, i - 1, -1):
                    if hav(*keep[m][1:], *keep[j][1:]) > radius:
                        i = m + 1
                        break
                d = keep[j][0] - keep[i][0]
                if d >= least and (best is None or d > best[0]):
                    best = (d, i, j)
            if best is None:
                return []
            _, i, j = best
            return longest(lo, i - 1) + [(i, j)] + longest(j + 1, hi) if True else []

        stops = longest(0, len(keep) - 1) if keep else []
        for i, j in stops:
            out.add((k, "stop", keep[i][0], keep[j][0]))
        for (_, j), (i, _) in zip(stops, stops[1:]):
            if all(keep[m + 1][0] - keep[m][0] <= silence for m in range(j, i)):
                out.add((k, "trip", keep[j][0], keep[i][0]))
    return out
