"""Helpers for mapInPandas over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 50_000) -> Iterator[pd.DataFrame]:
    """Frames in which no group (consecutive rows that agree in `keys`) is cut. Holds `least` rows and one group."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows < least:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame[keys].iloc[-1]
        same = pd.Series(True, index=frame.index)
        for k in keys:
            same &= frame[k] == last[k]
        cut = len(frame) - int(same.to_numpy()[::-1].argmin()) if not same.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held, rows = [frame.iloc[cut:]], len(frame) - cut
        least = max(least, 2 * rows)
    if held:
        frame = pd.concat(held, ignore_index=True)
        if len(frame):
            yield frame
