"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

A text's n-grams are its runs of `n` words (one n-gram of all words if it has fewer), as 64-bit hashes.  Texts that
are equal word for word form a copy class; one row stands for each class.  `bands_for` chooses rows a band and bands
so that a pair at the threshold shares a band with the target probability.

1. One pass over the texts gives each row its class key, the size of its set and its band hashes.
2. Classes that share a band hash are linked to the bucket's least class, never to each other, and connected
   components of these links are the candidate groups: every pair that shares a band lies in one of them.
3. The n-gram sets of the candidates, and of no other texts, are shuffled.  A small or dense group is verified as a
   whole, so each of its sets travels once.  A large group that hangs together by chains (it has more pairs than all
   its buckets together) is verified bucket by bucket: a set travels at most once for each band, and only pairs that
   share a bucket are compared, each in the first bucket they share.  Groups and buckets of more than `block_bytes`
   of sets or `block_rows` classes are dealt into blocks, and each pair of blocks is a task of its own.  Inside a
   task, tiles of classes sorted by set size are compared on the full sets; tiles whose sizes differ too much for
   the threshold are not.  A task returns a row for each class: its number of links and a representative of what it
   is linked with.
4. Representatives of classes that met in several tasks are joined by connected components once more.

Work that remains quadratic: n texts that all share a bucket and differ are compared in n * n / 2 pairs, and their
sets travel once for each `block_bytes` of such sets, for the number of links of each is exact.

Rows of the result: `copy_id`, the least id with an equal text; `class_id`, the least id of the documents connected
by links; `n_links`, the number of other documents within the threshold, copies included.

Defined cases: null texts count as empty; texts without words have no n-gram and link only to each other, as copies;
repeated rows are copies; null ids take part, and an id is null only if all ids it stands for are; other columns are
ignored (`near_duplicates`) or kept (`keep_one`), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.components import connected_components
from ..plans.tables import Tables
from . import bytetext as bt
from .columns import spare


@dataclass(frozen=True)
class Join:
    n: int = 5
    similarity: float = 0.8
    recall: float = 0.99999
    most_hashes: int = 240
    block_rows: int = 4096  # classes of a block
    block_bytes: int = 4 << 20  # of their sets
    whole: int = 512  # groups of no more classes are verified as a whole
    tile: int = 256
    seed: int = 11


def bands_for(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest chance candidates, that reach `recall` within `most_hashes`."""
    best = None
    for rows in range(1, most_hashes + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams in text order, and where each text's begin."""
    starts, ends, at = bt.words(buf, offs)
    h = bt.span_hashes(buf, starts, ends)
    count = np.diff(at)
    size = np.minimum(n, count)
    grams = np.where(count > 0, count - size + 1, 0)
    first = bt.ragged(at[:-1], grams)
    width = np.repeat(size, grams)
    out = bt.mix64(width.astype(np.uint64))
    for k in range(n):
        live = width > k
        out[live] = bt.mix64(out[live] * np.uint64(0x9E3779B97F4A7C15) + h[first[live] + k])
    return out, np.concatenate([[0], np.cumsum(grams)])


def _band_hashes(grams: np.ndarray, at: np.ndarray, join: Join) -> np.ndarray:
    """(texts with n-grams, bands) band hashes: of the least values of `rows` permutations of 32-bit hashes each."""
    bands, rows = bands_for(join.similarity, join.recall, join.most_hashes)
    rng = np.random.default_rng(join.seed)
    begin = at[:-1][np.diff(at) > 0]
    short = (grams >> np.uint64(32)).astype(np.uint32)
    turned, out = np.empty_like(short), np.empty((len(begin), bands), np.uint64)
    for b in range(bands):
        mixed = np.full(len(begin), b + 1, np.uint64)
        for _ in range(rows):
            odd, plus = rng.integers(0, 1 << 31, 2, dtype=np.uint32)
            np.multiply(short, odd * np.uint32(2) + np.uint32(1), out=turned)
            turned += plus * np.uint32(2) + np.uint32(b & 1)
            mixed = bt.mix64(mixed * np.uint64(31) + np.minimum.reduceat(turned, begin))
        out[:, b] = mixed
    return out


SIGNED = "key binary, size bigint, bands array<bigint>"


def signatures(col: pa.Array, join: Join) -> pa.StructArray:
    """Class key, number of n-grams and band hashes (none for texts without words) of an Arrow batch of texts."""
    buf, offs = bt.flatten(col)
    keys: list[bytes] = []
    sizes, lens, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in bt.slices(offs):
        o = offs[i : j + 1] - offs[i]
        b = buf[offs[i] : offs[j]]
        data = b.tobytes()
        cut = o.tolist()
        keys += [hashlib.blake2b(b" ".join(data[x:y].split()), digest_size=16).digest() for x, y in zip(cut, cut[1:], strict=False)]
        grams, at = shingles(b, o, join.n)
        sizes.append(np.diff(at))
        if len(grams):
            h = _band_hashes(grams, at, join)
            flat.append(h.ravel())
            lens.append(np.where(np.diff(at) > 0, h.shape[1], 0))
        else:
            lens.append(np.zeros(j - i, np.int64))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes), pa.int64()), bands], ["key", "size", "bands"])


def _sets(col: pa.Array, join: Join) -> pa.ListArray:
    """The sorted n-gram set of each text."""
    buf, offs = bt.flatten(col)
    sets: list[np.ndarray] = []
    for i, j in bt.slices(offs):
        grams, at = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], join.n)
        sets += [np.unique(grams[a:b]) for a, b in zip(at, at[1:], strict=False)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


@dataclass
class Sets:
    """Sets of n-grams that lie in `flat` one after the other, each sorted."""

    flat: np.ndarray
    begin: np.ndarray
    lens: np.ndarray

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some sets and the place in `at` of each one's set."""
        return self.flat[bt.ragged(self.begin[at], self.lens[at])], np.repeat(np.arange(len(at)), self.lens[at])


def overlaps(sets: Sets, a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """(a, b) sizes of the intersections of sets."""
    x, x_row = sets.of(a)
    same = a is b
    y, y_row = (x, x_row) if same else sets.of(b)
    if same:
        values, count = np.unique(x, return_counts=True)
        shared = values[count > 1]
    else:
        shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32 if sets.lens[a].max(initial=0) < 1 << 24 else np.float64)

    def placed(v: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(shared, v), max(0, len(shared) - 1))
        has = shared[k] == v if len(shared) else np.zeros(len(v), bool)
        order = np.argsort(k[has], kind="stable")
        return k[has][order], row[has][order]

    (xk, xr), (yk, yr) = placed(x, x_row), placed(y, y_row)
    for i in range(0, len(shared), columns):
        part = []
        for k, r, n in ((xk, xr, len(a)), (yk, yr, len(b))):
            lo, hi = np.searchsorted(k, [i, i + columns])
            m = np.zeros((n, min(columns, len(shared) - i)), out.dtype)
            m[r[lo:hi], k[lo:hi] - i] = 1
            part.append(m)
        out += part[0] @ part[1].T
    if same:
        out[np.arange(len(a)), np.arange(len(a))] = sets.lens[a]
    return out


def linked(sets: Sets, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """(a, b) whether two sets reach the similarity."""
    both = overlaps(sets, a, b).astype(np.float64)
    return (both > 0) & (both >= similarity * (sets.lens[a][:, None] + sets.lens[b][None, :] - both) - 1e-9)


class _Roots:
    """Connected components of rows by rank: the least rank is the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def join(self, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> None:
        """Joins rows a[i] and b[j] where links[i, j]: the components of the tile first, an edge for each row."""
        n = len(a)
        at = np.arange(n + len(b))
        while True:
            by_row = np.where(links, at[None, n:], len(at)).min(1, initial=len(at))
            new = np.concatenate([np.minimum(at[:n], by_row), at[n:]])
            by_col = np.where(links, new[:n, None], len(at)).min(0, initial=len(at))
            new[n:] = np.minimum(new[n:], by_col)
            if (new == at).all():
                break
            at = new
        rows = np.concatenate([a, b])
        for x in np.flatnonzero(at != np.arange(len(at))).tolist():
            p, q = self.find(int(rows[x])), self.find(int(rows[at[x]]))
            self.up[max(p, q)] = min(p, q)


def verify(sets: Sets, copies: np.ndarray, side: np.ndarray | None, bands: np.ndarray | None, band: int, similarity: float, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number of rows linked with it and the least place of what it is connected with.

    With `side`, only pairs of different sides count; with `bands`, only pairs whose first equal band is `band`.
    """
    n = len(sets.lens)
    links, roots = np.zeros(n, np.int64), _Roots(n)
    order = np.argsort(sets.lens, kind="stable")
    for i in range(0, n, tile):
        a = order[i : i + tile]
        for j in range(i, n, tile):
            b = a if i == j else order[j : j + tile]
            if sets.lens[a[-1]] < similarity * sets.lens[b[0]] - 1e-9:
                break  # the sets only grow from here
            if side is not None and (side[a] == side[a[0]]).all() and (side[b] == side[a[0]]).all():
                continue
            found = linked(sets, a, b, similarity)
            if i == j:
                np.fill_diagonal(found, False)
            if side is not None:
                found &= side[a][:, None] != side[b][None, :]
            if bands is not None and found.any():
                for k in range(band):
                    found &= bands[a, k][:, None] != bands[b, k][None, :]
            links[a] += found @ copies[b]
            if i != j:
                links[b] += found.T @ copies[a]
            roots.join(a, b, found)
    return links, np.array([roots.find(x) for x in range(n)], np.int64)


FILTER_WORDS = 1 << 20
MAYBE = "maybe"


def _maybe(rows: DataFrame, name: str, keys: DataFrame, tables: Tables, mark: str = MAYBE) -> DataFrame:
    """`rows` marked in the column `mark`: false only if their hash, the column `name`, is surely not among `keys` (row).

    A bit table of at most FILTER_WORDS rows of 64 bits, whatever the size of `keys`, so it may be broadcast.  When
    it fills up (beyond some 10**8 keys), more rows pass as "maybe"; the exact join behind it decides.
    """
    word = lambda c: F.shiftright(c, 6).bitwiseAND(FILTER_WORDS - 1)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(63).cast("int"))
    k, r = F.col("row"), F.col(f"`{name}`")
    of_word, of_bits = spare(rows, "word", mark), spare(rows, "bits", mark)
    bits = tables.cut(keys.select(word(k).alias(of_word), bit(k).alias("b")).groupBy(of_word).agg(F.bit_or("b").alias(of_bits)))
    hit = F.coalesce(F.col(of_bits).bitwiseAND(bit(r)) != 0, F.lit(False))
    return rows.withColumn(of_word, word(r)).join(F.broadcast(bits), of_word, "left").withColumn(mark, hit).drop(of_word, of_bits)


VERIFIED = "key binary, root binary, links bigint, split boolean"


def _verify(join: Join):
    """Verifies the groups dealt to a task: rows (group, left, right, part, band, split, key, copies, bands, grams)."""

    def f(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, copies = table["key"].to_pylist(), np.asarray(table["copies"])
        part, left, band, split = (np.asarray(table[c]) for c in ("part", "left", "band", "split"))
        right = np.asarray(table["right"])
        grams = table["grams"].combine_chunks()
        lens = np.asarray(grams.value_lengths()).astype(np.int64)
        flat, begin = np.asarray(grams.flatten()), np.cumsum(lens) - lens
        rows: dict[tuple, dict[bytes, int]] = {}
        for i, g in enumerate(zip(table["group"].to_pylist(), band.tolist(), left.tolist(), right.tolist(), strict=True)):
            rows.setdefault(g, {})[keys[i]] = i  # repeated rows have one key
        out_key: list[bytes] = []
        out_root: list[bytes] = []
        out_links, out_split = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for (_, b, low, high), members in rows.items():
            names = sorted(members)  # so that the least place is the least key
            at = np.array([members[k] for k in names])
            with_bands = np.array(table["bands"].take(pa.array(at)).to_pylist(), np.int64) if b >= 0 else None
            links, root = verify(Sets(flat, begin[at], lens[at]), copies[at], part[at] if low != high else None, with_bands, b, join.similarity, join.tile)
            out_key += names
            out_root += [names[r] for r in root.tolist()]
            out_links.append(links)
            out_split.append(split[at])
        return pa.table([pa.array(out_key, pa.binary()), pa.array(out_root, pa.binary()), pa.array(np.concatenate(out_links)), pa.array(np.concatenate(out_split))], ["key", "root", "links", "split"])

    return f


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two independent hashes of a row's id and text, 128 bits together."""
    row = (F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return [F.xxhash64(*row), F.xxhash64(F.lit(7), *row)]


def _classes(docs: DataFrame, id_col: str, text_col: str, join: Join, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows (id, row, row2, key) as written, and classes (key, root, copy_id, row, row2, copies, n_links); row and row2 are those of one row of the class."""
    text = F.col(f"`{text_col}`")
    row, row2 = row_keys(id_col, text_col)
    sign = arrow_udf(lambda col: signatures(col, join), SIGNED).asNondeterministic()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), row2.alias("row2"), sign(text).alias("s")).select("id", "row", "row2", "s.*")
    rows = tables.cut(rows)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "row2"))
    classes = rows.groupBy("key", "size", "bands").agg(first.alias("first"), F.count("*").alias("copies"))
    classes = tables.cut(classes.select("key", "size", "bands", F.col("first.id").alias("copy_id"), F.col("first.row").alias("row"), F.col("first.row2").alias("row2"), "copies"))
    # candidate groups
    spread = classes.select("key", F.explode("bands").alias("bucket"))
    buckets = tables.cut(spread.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub"))
    shared = _maybe(spread, "bucket", buckets.select(F.col("bucket").alias("row")), tables).where(F.col(MAYBE)).drop(MAYBE)
    edges = tables.cut(shared.join(buckets, "bucket").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct())
    groups = tables.cut(connected_components(edges, tables).select(F.col("node").alias("key"), F.col("root").alias("group")))
    tables.drop(edges)
    dealt = tables.cut(_dealt(classes, groups, buckets, join, tables))
    tables.drop(buckets)
    sent = max(1, math.ceil((dealt.where("parts = 1").agg(F.sum("size")).first()[0] or 0) * 8 / join.block_bytes))
    # the n-gram sets: only texts that may be wanted are shuffled
    light = tables.cut(classes.join(groups, "key", "left_semi").select("key", "row", "copies", "bands"))
    grams = arrow_udf(lambda keys, col: _sets_if(keys, col, join), "array<bigint>").asNondeterministic()
    wanted = _maybe(docs.select(row.alias("row"), text.alias("text")), "row", light.select("row"), tables).where(F.col(MAYBE)).drop(MAYBE)
    sets = wanted.join(light, "row").select("key", "copies", "bands", grams(F.col("key"), F.col("text")).alias("grams")).where(F.col("grams").isNotNull())
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    sets = sets.join(dealt.drop("size"), "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
    lot = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("group", "band"), F.lit(sent))).otherwise(F.xxhash64("group", "band", "left", "right"))
    bands = F.when(F.col("band") >= 0, F.col("bands"))
    checked = sets.select(lot.alias("lot"), "group", "left", "right", "part", "band", "split", "key", "copies", bands.alias("bands"), "grams")
    checked = tables.cut(checked.groupBy("lot").applyInArrow(_verify(join), VERIFIED))
    for read in (groups, dealt, light):
        tables.drop(read)
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    whole = checked.where("not split").select("key", "root")
    apart = checked.where("split").select(F.col("key").alias("a"), F.col("root").alias("b"))
    if apart.limit(1).count():
        whole = whole.unionByName(connected_components(apart, tables).select(F.col("node").alias("key"), "root"))
    known = tables.cut(whole.join(links, "key"))
    done = classes.select("key", "copy_id", "row", "row2", "copies").join(known, "key", "left")
    done = done.select("key", F.coalesce("root", "key").alias("root"), "copy_id", "copies", "row", "row2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = tables.cut(done)
    for read in (classes, checked, known):
        tables.drop(read)
    return rows, done


def _dealt(classes: DataFrame, groups: DataFrame, buckets: DataFrame, join: Join, tables: Tables) -> DataFrame:
    """(key, size, group, band, parts, split): where the set of each candidate class goes.  Band -1 is a group as a whole."""
    bytes_of = F.sum(F.col("size") * 8)
    parts = F.greatest(F.ceil(F.col("bytes") / join.block_bytes), F.ceil(F.col("n") / join.block_rows)).cast("int")
    sized = tables.cut(groups.join(classes.select("key", "size"), "key"))
    of_group = tables.cut(sized.groupBy("group").agg(F.count("*").alias("n"), bytes_of.alias("bytes")))
    large = of_group.where(F.col("n") > join.whole)
    by_bucket = None
    if large.limit(1).count():
        # a large group's buckets, and how many pairs they have together
        members = sized.join(large.select("group"), "group", "left_semi").join(classes.select("key", "bands"), "key")
        members = members.select("key", "size", "group", F.posexplode("bands").alias("band", "bucket")).join(buckets.select("bucket"), "bucket", "left_semi")
        members = tables.cut(members)
        of_bucket = tables.cut(members.groupBy("group", "band", "bucket").agg(F.count("*").alias("n"), bytes_of.alias("bytes")))
        chained = of_bucket.groupBy("group").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("met")).join(large.select("group", F.col("n").alias("all")), "group")
        chained = tables.cut(chained.where(F.col("met") < F.col("all").cast("double") * F.col("all")).select("group"))
        named = F.concat("group", F.encode(F.col("bucket").cast("string"), "utf-8"))
        small = of_bucket.join(chained, "group", "left_semi").select("bucket", "band", parts.alias("parts"))
        by_bucket = members.join(small, ["bucket", "band"]).join(chained, "group", "left_semi").select("key", "size", named.alias("group"), "band", "parts", F.lit(True).alias("split"))
        of_group = of_group.join(chained, "group", "left_anti")
    out = sized.join(of_group.select("group", parts.alias("parts")), "group").select("key", "size", "group", F.lit(-1).alias("band"), "parts", (F.col("parts") > 1).alias("split"))
    return out if by_bucket is None else out.unionByName(by_bucket)


def _sets_if(keys: pa.Array, col: pa.Array, join: Join) -> pa.Array:
    """The n-gram sets of the texts that have the given class keys, else null: two rows may share a row hash."""
    got = _sets(col, join)
    wrong = [k != hashlib.blake2b(b" ".join((t or "").encode().split()), digest_size=16).digest() for k, t in zip(keys.to_pylist(), col.to_pylist(), strict=True)]
    if not any(wrong):
        return got
    return pa.array([None if w else g for w, g in zip(wrong, got.to_pylist(), strict=True)], pa.list_(pa.int64()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """(<id_col>, class_id, copy_id, n_links), a row for each row of `docs`."""
    tables = Tables(docs.sparkSession)
    rows, classes = _classes(docs, id_col, text_col, join, tables)
    linked = classes.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = tables.cut(classes.join(linked, "root").select("key", "class_id", "copy_id", "n_links"))
    return rows.select("id", "key").join(named, "key").select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """The rows of `docs` but for near duplicates: of each connected group the row with the least id stays, one if it is repeated."""
    tables = Tables(docs.sparkSession)
    rows, classes = _classes(docs, id_col, text_col, join, tables)
    first = F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "row", "row2"))
    groups = tables.cut(classes.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("n")))
    a, b, mark = spare(docs, "row"), spare(docs, "row2"), spare(docs, MAYBE, "row2")
    winners = groups.select(F.col("first.row").alias(a), F.col("first.row2").alias(b))
    # rows of groups of one stay where they are; only the others' texts meet the winners' hashes
    shared = classes.join(groups.where("n > 1").select("root"), "root").select("key")
    row, row2 = row_keys(id_col, text_col)
    marked = _maybe(docs.withColumns({a: row, b: row2}), a, rows.select("row", "key").join(shared, "key"), tables, mark)
    for read in (rows, classes):
        tables.drop(read)
    kept = marked.where(F.col(mark)).join(winners, [a, b], "left_semi").dropDuplicates([a, b])
    return marked.where(~F.col(mark)).unionByName(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(table: str = "documents") -> str:
    """`near_duplicates` with five words and a similarity of 0.8 for DuckDB."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
 copies AS (SELECT w, min(doc_id) AS copy_id, count(*) AS n FROM d GROUP BY w),
 grams AS (SELECT DISTINCT copy_id, unnest(CASE WHEN len(w)=0 THEN []::varchar[] WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) END) AS g FROM copies),
 sizes AS (SELECT copy_id, count(*) AS n FROM grams GROUP BY copy_id),
 pairs AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.copy_id<>b.copy_id GROUP BY ALL),
 links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.copy_id=a JOIN sizes y ON y.copy_id=b WHERE 5*p.n>=4*(x.n+y.n-p.n)),
 walk AS (SELECT copy_id AS root, copy_id AS node FROM copies UNION SELECT root, b FROM walk JOIN links ON a=node),
 classes AS (SELECT node, min(root) AS class_id FROM walk GROUP BY node),
 others AS (SELECT a, sum(c.n) AS n FROM links JOIN copies c ON c.copy_id=b GROUP BY a)
SELECT d.doc_id, class_id, copy_id, (c.n-1+coalesce(o.n,0))::bigint AS n_links FROM d JOIN copies c ON c.w=d.w JOIN classes ON node=copy_id LEFT JOIN others o ON o.a=copy_id"""
