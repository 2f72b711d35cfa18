"""Byte-level BPE: a backtracking encoder that gives the exact merges in linear time, and decoding by an offset table.

Encoding a piece: an Aho-Corasick automaton over the vocabulary reports every token occurrence, which gives the
longest token at each position.  The encoder appends the longest token that is *compatible* with the token before
it (the two would not have merged differently; checked against a memoised pair table derived from the merges),
else tries the next shorter prefix token, else drops the last token and marks the position dead.  Each position
dies at most once, so the work is linear in the piece.

Texts are cut into pieces as the vocabulary's pre-tokeniser does, vectorised over code points; each distinct piece
of a slice is encoded once, and a bounded cache keeps pieces between batches.

Defined cases: null texts encode as empty texts; special tokens found in a text become their ids; null id lists
decode to null; ids outside the vocabulary decode to nothing, and invalid UTF-8 to U+FFFD; repeated rows get equal
results; other columns pass through, whatever their
names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

import json
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import bytetext as bt
from .columns import spare

DEFAULT_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
CACHED_PIECES = 100_000
CACHED_PAIRS = 100_000
SLICE_BYTES = 1 << 20

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Contractions are pieces of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = [(kind, regex.compile(pattern)) for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+"))]
    for page in range(0, 0x110000, 0x800):  # a page at a time: all characters at once are 80 MB of objects
        if 0xD800 <= page < 0xE000:
            continue
        every = "".join(map(chr, range(page, page + 0x800)))
        for kind, pattern in kinds:
            for m in pattern.finditer(every):
                out[page + m.start() : page + m.end()] = kind
    return out


class Vocab:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        ids: dict[bytes, int] = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        # inner numbers: the 256 bytes, then the merges by rank
        tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(tokens)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = map(to_bytes, m.split(" ") if isinstance(m, str) else m)
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            pair = (number[a], number[b])
            self.merged[pair] = number[a + b] = len(tokens)
            tokens.append(a + b)
            self.halves.append(pair)
        self.tokens, self.number = tokens, number
        del model, spec["model"]  # large, and read
        self.outer = [ids[t] for t in tokens]
        self.shorter = [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for k in range(len(t) - 1, 0, -1):
                if (j := number.get(t[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache: dict[bytes, list[int]] = {}
        # decoding: all tokens' bytes in one array, and where each id's begin
        by_id = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        lens = np.zeros(max(by_id) + 2, np.int64)
        for i, t in by_id.items():
            lens[i + 1] = len(t)
        self.offsets = np.cumsum(lens)
        self.flat = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)
        self.classes = _char_classes()
        self.special_pattern = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether `a` then `b` stand in the encoding of their joined bytes.

        Walks back the merges on both sides of the border from the latest to the earliest: if two border parts
        would merge before either grew into what it is, the pair can't occur.
        """
        key = a * len(self.tokens) + b
        known = self.pairs.get(key)
        if known is not None:
            return known
        x, y, before, good = a, b, 1 << 60, True
        while True:
            made = self.merged.get((x, y))
            if made is not None and made < before:
                good = False
                break
            if x > y:  # the left part was made later: undo it, keeping the part at the border
                before, part = x, self.halves[x][1]
                if part == x:
                    before, part_y = y + 1, self.halves[y][0]
                    if part_y == y:
                        break
                    y = part_y
                else:
                    x = part
            else:
                before, part = y + 1, self.halves[y][0]
                if part == y:
                    before, part_x = x, self.halves[x][1]
                    if part_x == x:
                        break
                    x = part_x
                else:
                    y = part
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, without cutting it further."""
        whole = self.number.get(piece)
        if whole is not None:
            return [self.outer[whole]]
        n = len(piece)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i  # later ends are longer
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter, pairs, width = self.length, self.shorter, self.pairs, len(self.tokens)
        while True:
            end = at + length[token]
            fits = alive[end]
            if fits and out:
                fits = pairs.get(out[-1] * width + token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
            if fits:
                out.append(token)
                at = end
                if at == n:
                    break
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        outer = self.outer
        return [outer[i] for i in out]

    def piece_starts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first byte of each piece, and the texts' borders with those of special tokens added."""
        data = buf.tobytes()
        if self.special_pattern and any(s in data for s in self.special):
            cuts = [m.span() for i in range(len(offs) - 1) for m in self.special_pattern.finditer(data, int(offs[i]), int(offs[i + 1]))]
            inside = np.zeros(len(buf), bool)
            for a, b in cuts:
                inside[a + 1 : b] = True
            offs = np.unique(np.concatenate([offs, np.array(cuts, np.int64).ravel()]))
        else:
            inside = None
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        n = len(cp)
        kind = self.classes[cp]
        first = np.zeros(n + 1, bool)  # of a text
        first[np.searchsorted(lead, offs[offs < len(buf)])] = True
        first[n] = True
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        blank = cp == 32
        start[1:] &= ~(blank[:-1] & (kind[1:] != SPACE))
        space = kind == SPACE
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
        start |= first[:-1]
        # a blank that ends its text starts no joined piece; the rule above has set nothing for it
        quote = np.flatnonzero((cp == 39) & start)
        if len(quote):
            ends = np.searchsorted(offs, lead[quote], "right")
            for i, e in zip(quote.tolist(), ends.tolist(), strict=True):
                for c in CONTRACTIONS:
                    if all(i + k < n and cp[i + k] == ord(ch) for k, ch in enumerate(c)):
                        stop = i + len(c)
                        limit = offs[e] if e < len(offs) else len(buf)
                        if lead[stop - 1] < limit:
                            start[i + 1 : stop] = False
                            if stop < n:
                                start[stop] = True
                            break
        starts = lead[start]
        if inside is not None:
            starts = starts[~inside[starts]]
        return starts, offs

    def encode_slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        starts, _ = self.piece_starts(buf, offs)
        ends = np.append(starts[1:], len(buf))
        h, check = bt.span_hashes(buf, starts, ends), bt.span_hashes(buf, starts, ends, second=True)
        codes, _ = pd.factorize(h)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
        if (check != check[first][codes]).any():  # two pieces share a hash: take each as it is
            codes = first = np.arange(len(starts))
        data, cache, found = buf.tobytes(), self.cache, []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = data[a:b]
            got = cache.get(piece)
            if got is None:
                got = [self.special[piece]] if piece in self.special else self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[piece] = got
            found.append(got)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        return flat[bt.ragged(begin[codes], size[codes])], bt.counts_before(size[codes])[np.searchsorted(starts, offs)]

    def encode(self, col: pa.Array) -> pa.ListArray:
        """Lists of ids for an Arrow batch of texts."""
        buf, offs = bt.flatten(col)
        ids, at, base = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for i, j in bt.slices(offs, SLICE_BYTES):
            got, begin = self.encode_slice(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ids.append(got)
            at.append(begin[1:] + base)
            base += len(got)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(ids)))

    def decode(self, col: pa.Array) -> pa.Array:
        """Texts for an Arrow batch of id lists."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        n = len(col)
        null = np.asarray(col.is_null())
        lens = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        ids = np.asarray(col.flatten().fill_null(-1)).astype(np.int64)
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        ids = np.where(known, ids, 0)
        size = np.where(known, self.offsets[ids + 1] - self.offsets[ids], 0)
        token_at, byte_at = bt.counts_before(lens), bt.counts_before(size)
        out = []
        i = 0
        while i < n:  # as many texts at a time as fill a slice
            j = max(i + 1, int(np.searchsorted(byte_at[token_at], byte_at[token_at[i]] + SLICE_BYTES, "right")) - 1)
            j = min(j, n)
            a, b = token_at[i], token_at[j]
            data = self.flat[bt.ragged(self.offsets[ids[a:b]], size[a:b])].tobytes()
            cut = (byte_at[token_at[i : j + 1]] - byte_at[a]).tolist()
            out += [data[x:y].decode("utf-8", "replace") for x, y in zip(cut, cut[1:], strict=False)]
            i = j
        return pa.array(out, pa.string(), mask=null) if n else pa.array([], pa.string())


_LOADED: dict[str, Vocab] = {}


def vocab(path: str = DEFAULT_VOCAB) -> Vocab:
    """The vocabulary at a path, loaded once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocab(path)
    return _LOADED[path]


def ids_of(text: Column, path: str = DEFAULT_VOCAB) -> Column:
    """array<int> of token ids for a text column."""

    def f(col: pa.Array) -> pa.Array:
        return vocab(path).encode(col)

    return arrow_udf(f, "array<int>").asNondeterministic()(text)  # so that it runs once, whatever reads it


def text_of(ids: Column, path: str = DEFAULT_VOCAB) -> Column:
    """The text for a column of id lists."""

    def f(col: pa.Array) -> pa.Array:
        return vocab(path).decode(col)

    return arrow_udf(f, "string").asNondeterministic()(ids)


def _in_slices(docs: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make, path: str) -> DataFrame:
    """`keep` and new columns that `make` gives for a vocabulary and texts, a slice of each Arrow batch at a time.

    So neither side holds more than a slice of ids and texts besides the batch that was read.
    """
    names = [*keep, *[f.name for f in fields]]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *fields])

    def run(batches):
        v = vocab(path)
        for batch in batches:
            for i, j in bt.slices(bt.flatten(batch.column(len(keep)))[1], SLICE_BYTES):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *make(v, part.column(len(keep)))], names)

    mark = spare(docs, "bpe_text", *names)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(mark)).mapInArrow(run, schema)


def _kept(docs: DataFrame, keep: list[str] | None, new: tuple[str, ...]) -> list[str]:
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new}]


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = DEFAULT_VOCAB, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with its texts' token ids in `ids_col`."""
    field = T.StructField(ids_col, T.ArrayType(T.IntegerType()))
    return _in_slices(docs, text_col, _kept(docs, keep, (ids_col,)), [field], lambda v, col: [v.encode(col)], path)


def round_trip_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", path: str = DEFAULT_VOCAB, keep: list[str] | None = None) -> DataFrame:
    """`encode_documents`, then `decode_documents`, with one pass through Python."""

    def both(v: Vocab, col: pa.Array) -> list[pa.Array]:
        ids = v.encode(col)
        return [ids, v.decode(ids)]

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    return _in_slices(docs, text_col, _kept(docs, keep, (ids_col, decoded_col)), fields, both, path)


def decode_documents(docs: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", path: str = DEFAULT_VOCAB) -> DataFrame:
    """`docs` with the texts of its token ids in `decoded_col`."""
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != decoded_col.lower()]
    return docs.select(*own, text_of(F.col(f"`{ids_col}`"), path).alias(decoded_col))
