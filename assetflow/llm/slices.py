"""Texts of an Arrow batch as byte arrays of bounded size; a very long text comes in several parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from assetflow.llm.common import CHUNK_BYTES, chunks


@dataclass
class Slice:
    """``data`` is the UTF-8 of some whole texts, or of a part of one long text; text i is row ``first + i`` of the
    batch and lies at ``offsets[i]:offsets[i + 1]``.  ``last`` is False while parts of the same text follow."""

    data: np.ndarray
    offsets: np.ndarray
    first: int
    last: bool = True


def slices(batch: pa.RecordBatch, text: str, cuts: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[Slice]:
    """The batch's texts in slices of about ``limit`` bytes; nulls are empty.  A longer text is divided after bytes of
    ``cuts`` (256 flags); a stretch without such a byte stays in one part."""
    at = 0
    for chunk in chunks(batch, text, limit):
        column = chunk.column(text).cast(pa.large_binary()).fill_null(b"")
        _, offs, data = column.buffers()
        off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        if len(chunk) > 1 or len(raw) <= limit:
            yield Slice(raw, off - off[0], at)
        else:
            start = 0
            while start < len(raw):
                end = min(start + limit, len(raw))
                while end < len(raw):
                    found = np.flatnonzero(cuts[raw[end : end + limit]])
                    end = min(end + (int(found[0]) + 1 if len(found) else limit), len(raw))
                    if len(found):
                        break
                yield Slice(raw[start:end], np.array([0, end - start]), at, end == len(raw))
                start = end
        at += len(chunk)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs of flagged bytes; a run never goes over from one text to the next."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def strings(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The flagged runs as an Arrow array of strings."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
