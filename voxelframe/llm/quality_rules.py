"""Quality rules: word and line statistics, and compression bands.

A text is rejected when its zstandard ratio (bytes / compressed bytes), over the whole text or over more than
`chunk_share` of its fixed chunks, leaves the limits for its length: above them the text is repetitive, below them
incompressible.  Longer texts compress better, so the limits follow the length: they are given at some lengths
(`LIMITS`) and drawn as straight lines over the logarithm of the length between them.  Chunks have the limits of
their own length.  Chunks cover the whole text: where its length is no multiple of theirs, the last chunk is its last
bytes and overlaps the one before.  Texts under `chunk_bytes` have chunks of `small_chunk_bytes`; texts shorter still
are their own only chunk, so they have the whole text's limits and count none.

Defined cases: null and empty texts have zero counts and fail the base rules; texts shorter than the first length of
`LIMITS` have none; beyond its last length the limits stay; repeated rows get equal results; other columns pass
through, whatever their names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bytetext as bt
from .columns import kept, spare

#: At a length in bytes, the least and the largest ratio.  Measured: prose in Latin script lies up to 0.1 below
#: the largest; texts with a mark between all words lie above it.  Keys, ciphers and base64 (1.0 to 1.35) lie below the least.
LIMITS = (
    (128, 0.90, 1.85),
    (256, 1.05, 1.90),
    (512, 1.20, 1.95),
    (1024, 1.30, 2.04),
    (2048, 1.40, 2.18),
    (4096, 1.45, 2.31),
    (8192, 1.50, 2.43),
    (16384, 1.50, 2.53),
    (32768, 1.50, 2.62),
    (65536, 1.50, 2.72),
    (262144, 1.50, 3.00),
    (1048576, 1.50, 3.30),
)
SYMBOLS = b"#*$%&|<>"
FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "ratio": "double", "n_chunks": "bigint", "n_bad_chunks": "bigint", "base_failed": "boolean", "kept": "boolean"}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk_bytes: int = 4096
    small_chunk_bytes: int = 1024
    chunk_share: float = 1 / 3
    limits: tuple = LIMITS


def limits_of(sizes: np.ndarray, limits: tuple = LIMITS) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest ratio of texts of these many bytes."""
    at, low, high = (np.array([x[k] for x in limits], float) for k in range(3))
    place = np.log2(np.maximum(sizes, 1))
    short = np.asarray(sizes) < at[0]
    return np.where(short, 0.0, np.interp(place, np.log2(at), low)), np.where(short, np.inf, np.interp(place, np.log2(at), high))


def _repeat_words(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each text in a 3-word window that the text holds twice or more."""
    n = len(hashes)
    repeated = np.zeros(n, bool)
    if n > 2:
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        w = bt.mix64(hashes[:-2] * np.uint64(3) + bt.mix64(hashes[1:-1] * np.uint64(5) + bt.mix64(hashes[2:] + text[:-2].astype(np.uint64))))
        whole = np.flatnonzero(text[:-2] == text[2:])
        w = w[whole]
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        twice = np.zeros(len(w), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        first = whole[twice]
        for k in range(3):
            repeated[first + k] = True
    return bt.per_text(repeated, at)


def _dup_lines(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends = bt.runs(buf != 10, offs)
    if not len(starts):
        return np.zeros(len(offs) - 1, np.int64)
    wordy = bt.counts_before(~bt.SPACE[buf])
    has = wordy[ends] > wordy[starts]
    starts, ends = starts[has], ends[has]
    text = np.searchsorted(offs, starts, "right") - 1
    h = bt.mix64(bt.span_hashes(buf, starts, ends) + bt.mix64(text.astype(np.uint64)))
    _, first = np.unique(h, return_index=True)
    return np.bincount(text, minlength=len(offs) - 1) - np.bincount(text[first], minlength=len(offs) - 1)


def _bands(buf: np.ndarray, offs: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ratio (NaN: empty), chunks, chunks outside their limits, and whether the text stays within its limits."""
    pack = zstandard.ZstdCompressor(level=rules.level).compress
    n = len(offs) - 1
    ratio, chunks, bad, ok = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    view = memoryview(buf)
    low, high = (x.tolist() for x in limits_of(np.diff(offs), rules.limits))
    sizes = (rules.small_chunk_bytes, rules.chunk_bytes)
    of_chunk = dict(zip(sizes, zip(*(x.tolist() for x in limits_of(np.array(sizes), rules.limits)), strict=True), strict=True))
    for i in range(n):
        a, b = int(offs[i]), int(offs[i + 1])
        if a == b:
            continue
        ratio[i] = r = (b - a) / len(pack(view[a:b]))
        size = rules.chunk_bytes if b - a >= rules.chunk_bytes else rules.small_chunk_bytes
        least, most = of_chunk[size]
        if b - a >= size:
            last = [b - size] if (b - a) % size else []
            for k in (*range(a, b - size + 1, size), *last):
                chunks[i] += 1
                bad[i] += not least <= size / len(pack(view[k : k + size])) <= most
        ok[i] = low[i] <= r <= high[i] and bad[i] <= rules.chunk_share * chunks[i]
    return ratio, chunks, bad, ok


def measure(col: pa.Array, rules: Rules = Rules()) -> pa.StructArray:
    """The statistics and the verdict for an Arrow batch of texts."""
    buf, offs = bt.flatten(col)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    parts: list[tuple] = []
    for i, j in bt.slices(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, at = bt.words(b, o)
        n_words = np.diff(at)
        chars = bt.per_text(((b & 0xC0) != 0x80) & ~bt.SPACE[b], o)
        repeat = _repeat_words(bt.span_hashes(b, starts, ends), at)
        ratio, chunks, bad, ok = _bands(b, o, rules)
        failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
        parts.append((n_words, chars, bt.per_text(is_symbol[b], o), _dup_lines(b, o), repeat, ratio, chunks, bad, failed, ~failed & ok))
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    cols = []
    for k, (name, kind) in enumerate(FIELDS.items()):
        v = np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)
        cols.append(pa.array(v, kinds[kind], mask=np.isnan(v) if name == "ratio" and len(v) else None))
    return pa.StructArray.from_arrays(cols, list(FIELDS))


def rules_of(text: Column, rules: Rules = Rules()) -> Column:
    """A struct of `FIELDS` for a text column."""

    def f(col: pa.Array) -> pa.Array:
        return measure(col, rules)

    return arrow_udf(f, ", ".join(f"{k} {v}" for k, v in FIELDS.items())).asNondeterministic()(text)  # so that no filter evaluates it twice


def apply_rules(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """`docs` with the columns of `FIELDS`."""
    mark, own = spare(docs, "rules"), kept(docs, tuple(FIELDS))
    return docs.select(*own, rules_of(F.col(f"`{text_col}`"), rules).alias(mark)).select(*own, f"{mark}.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` whose text the rules keep, with the columns of `docs`."""
    mark = spare(docs, "rules")
    return docs.select("*", rules_of(F.col(f"`{text_col}`"), rules).alias(mark)).where(F.col(f"{mark}.kept")).drop(mark)
