"""Offset algebra: what becomes of positions when a text is edited.

An edit is a sorted list of non-overlapping changes (start, end, new text). An :class:`OffsetMap` keeps the segments between and in them as arrays,
so any number of spans are mapped by one binary search each. Maps of successive edits are applied one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

Change = tuple[int, int, str]


class OffsetMap:
    """Segments of a source and where they are in the result.

    A start inside a replaced segment moves to the replacement's start, an end to its end; a span of which nothing is left maps to (-1, -1).
    """

    def __init__(self, source_length: int, changes: list[Change]):
        cuts, at, result = [], 0, 0
        for start, end, new in changes:
            if start < at:
                raise ValueError(f"the change at {start} overlaps the one before it, which ends at {at}")
            if end < start:
                raise ValueError(f"the change at {start} ends before it starts")
            if start > at:
                cuts.append((at, result, result + start - at, True))
                result += start - at
            cuts.append((start, result, result + len(new), False))
            result, at = result + len(new), end
        if at < source_length or not cuts:
            cuts.append((at, result, result + source_length - at, True))
            result += source_length - at
        self.length = result
        self.source, self.begin, self.end = (np.array([c[k] for c in cuts], np.int64) for k in range(3))
        self.kept = np.array([c[3] for c in cuts], bool)

    def _segment(self, offsets: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.source, offsets, side="right") - 1, 0)

    def map(self, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        first, last = self._segment(starts), self._segment(np.maximum(ends - 1, 0))
        new_start = np.where(self.kept[first], self.begin[first] + starts - self.source[first], self.begin[first])
        new_end = np.where(self.kept[last], np.minimum(self.begin[last] + ends - self.source[last], self.end[last]), self.end[last])
        new_start, new_end = np.clip(new_start, 0, self.length), np.clip(new_end, 0, self.length)
        gone = (ends <= starts) | (new_end <= new_start)
        return np.where(gone, -1, new_start), np.where(gone, -1, new_end)


def apply_changes(source: str, changes: Iterable[Change]) -> tuple[str, OffsetMap]:
    """The edited text and its offset map."""
    ordered = sorted(changes, key=lambda c: c[:2])
    offsets = OffsetMap(len(source), ordered)
    out, at = [], 0
    for start, end, new in ordered:
        out += [source[at:start], new]
        at = end
    return "".join([*out, source[at:]]), offsets


def map_through(maps: Iterable[OffsetMap], starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Spans through successive edits; what one edit removes stays removed."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    for each in maps:
        new_starts, new_ends = each.map(np.maximum(starts, 0), np.maximum(ends, 0))
        gone = starts < 0
        starts, ends = np.where(gone, -1, new_starts), np.where(gone, -1, new_ends)
    return starts, ends
