"""Vectorised views of whole texts: UTF-8 bytes of an Arrow batch, their words and word hashes.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Nulls read as empty texts.  Everything works on slices of a
batch of bounded size (`slices`), so memory follows the slice, not the batch; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_2 = mix64(_BYTE + np.uint64(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"] = _powers(_BASE, n)
        _POWERS["down"] = _powers(pow(_BASE, -1, 1 << 64), n)
    return _POWERS["up"], _POWERS["down"]


def flatten(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of a single longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a text's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offs[:-1][offs[:-1] < n]
    first[begin] |= inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = offs[1:][offs[1:] > 0] - 1
    last[end] |= inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text."""
    starts, ends = runs(~SPACE[buf], offs)
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each span, or a second one; the spans ascend and don't overlap."""
    out, byte = np.zeros(len(starts), np.uint64), _BYTE_2 if second else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _tables(max(_SPAN, hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(byte[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix64(out + mix64((ends - starts).astype(np.uint64)))


def counts_before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True flags in each text (or in each range of `offs`)."""
    total = counts_before(flags)
    return total[offs[1:]] - total[offs[:-1]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
