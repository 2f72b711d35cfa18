"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line gets features of its own and of both neighbours; the field labels it good or bad.  Forward-backward
marginals, weighted by line length, average to the text's quality.  Lines take their document's label in training.

Training uses a bounded sample of labelled documents: about `Fit.per_label` of each label and `Fit.most_rows` in all.
Executors read their whole texts and hand back the features of at most `Fit.lines` lines of each, in `Fit.stretches`
runs of consecutive lines spread evenly from the first line to the last; no text reaches the driver.

Defined cases: a text without any line that holds a word (null, empty or white space) scores `Model.prior`, the share
of label 1 in the sample; without training rows of both labels every text scores 1 if only label 1 is known, 0 if
only label 0, 0.5 if none; a text may have any number of lines and a line any length (time grows in proportion to
both); repeated rows get equal scores; other columns pass through, whatever their names, except that an input column
with the name of a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bytetext as bt
from .columns import kept, spare

SYMBOLS = b"#*$%&|<>@^~=+_\\/{}[]"
FEATURES = ("bias", "symbols", "upper", "digits", "marks", "repeats", "pairs", "bars", "short words", "long words", "short line", "long line")
N_OWN = len(FEATURES)


@dataclass(frozen=True)
class Fit:
    per_label: int = 1500
    most_rows: int = 6000
    lines: int = 40
    stretches: int = 4
    steps: int = 150
    rate: float = 0.3
    l2: float = 1e-3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (3 * N_OWN, 2): own, previous, next
    move: np.ndarray  # (2, 2)
    prior: float


def _classes() -> np.ndarray:
    out = np.zeros((5, 256), np.float32)
    out[0, list(SYMBOLS)] = 1
    out[1, ord("A") : ord("Z") + 1] = 1
    out[2, ord("0") : ord("9") + 1] = 1
    out[3, list(b"!?")] = 1
    out[4, ord("|")] = 1
    return out


_CLASS = _classes()


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of each line that holds a word, the lines before each text, and each line's letters (non-space bytes)."""
    starts, ends = bt.runs(buf != 10, offs)
    ws, we, _ = bt.words(buf, offs)
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    has = last > first
    starts, ends, first, last = starts[has], ends[has], first[has], last[has]
    at = np.searchsorted(starts, offs)
    n = len(starts)
    x = np.zeros((n, N_OWN), np.float32)
    if not n:
        return x, at, np.zeros(0)

    def total(flags):
        c = bt.counts_before(flags)
        return c[ends] - c[starts]

    chars = total(~bt.SPACE[buf]).astype(np.float64)
    counts = [total(_CLASS[k][buf] > 0) for k in range(5)]
    h = bt.span_hashes(buf, ws, we)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first] = False
    # word pairs that the line has had before
    line = np.repeat(np.arange(n), last - first)
    pair = bt.mix64(h[1:] + bt.mix64(h[:-1] + line[1:].astype(np.uint64)))
    inner = np.flatnonzero(line[1:] == line[:-1])
    _, fresh = np.unique(pair[inner], return_index=True)
    words = (last - first).astype(np.float64)
    old = np.bincount(line[inner], minlength=n) - np.bincount(line[inner[fresh]], minlength=n)
    sizes = (we - ws).astype(np.float64)
    total_words = bt.counts_before(same)
    little, big = bt.counts_before(sizes <= 2), bt.counts_before(sizes >= 20)
    x[:, 0] = 1
    x[:, 1] = np.minimum(1, 8 * counts[0] / chars)
    x[:, 2] = np.minimum(1, 2 * counts[1] / chars)
    x[:, 3] = np.minimum(1, 2 * counts[2] / chars)
    x[:, 4] = np.minimum(1, 8 * counts[3] / chars)
    x[:, 5] = (total_words[last] - total_words[first]) / words
    x[:, 6] = old / words
    x[:, 7] = np.minimum(1, 4 * counts[4] / words)
    x[:, 8] = (little[last] - little[first]) / words
    x[:, 9] = (big[last] - big[first]) / words
    x[:, 10] = words < 4
    x[:, 11] = words > 60
    return x, at, chars


def _with_neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 3 * N_OWN), np.float32)
    out[:, :N_OWN] = x
    if len(x) > 1:
        out[1:, N_OWN : 2 * N_OWN] = x[:-1]
        out[:-1, 2 * N_OWN :] = x[1:]
        starts = at[:-1][np.diff(at) > 0]
        ends = at[1:][np.diff(at) > 0] - 1
        out[starts, N_OWN : 2 * N_OWN] = 0
        out[ends, 2 * N_OWN :] = 0
    return out


def _smooth(score: np.ndarray, move: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (lines, 2) and, for each line but a text's first, the pair marginals (lines, 2, 2) with the line before.

    Texts advance together, one line a step; texts that ended leave the batch.
    """
    n = len(score)
    lens = np.diff(at)
    order = np.argsort(-lens, kind="stable")
    starts, lens = at[:-1][order], lens[order]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    most = int(lens[0]) if len(lens) else 0
    live = np.searchsorted(-lens, -np.arange(1, most + 1), "right")  # texts with more than t lines
    log = lambda a, b: np.logaddexp(a, b)
    for t in range(most):
        k = starts[: live[t]] + t
        a = score[k].astype(np.float64)
        if t:
            p = alpha[k - 1]
            a = a + np.stack([log(p[:, 0] + move[0, y], p[:, 1] + move[1, y]) for y in (0, 1)], 1)
        alpha[k] = a - a.max(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        k = starts[: live[t + 1]] + t
        q = beta[k + 1] + score[k + 1]
        b = np.stack([log(q[:, 0] + move[y, 0], q[:, 1] + move[y, 1]) for y in (0, 1)], 1)
        beta[k] = b - b.max(1, keepdims=True)
    one = alpha + beta
    one = np.exp(one - log(one[:, 0], one[:, 1])[:, None])
    pair = np.zeros((n, 2, 2))
    if n > 1:
        p = alpha[:-1, :, None] + move[None] + (score[1:] + beta[1:])[:, None, :]
        p = np.exp(p - p.max((1, 2), keepdims=True))
        pair[1:] = p / p.sum((1, 2), keepdims=True)
        pair[at[:-1][np.diff(at) > 0]] = 0
    return one, pair


@dataclass(frozen=True)
class Sample:
    """Chains of training lines: a document's stretches, one after the other."""

    x: np.ndarray  # (lines, 3 * N_OWN)
    chains: np.ndarray  # where each chain begins, and the number of lines
    document: np.ndarray  # of each chain
    labels: np.ndarray  # of each document


def _stretches(n: int, how: Fit) -> list[tuple[int, int]]:
    """Ranges of the lines that training sees of a text of `n`: all, or `stretches` runs spread over the whole text."""
    if n <= how.lines:
        return [(0, n)] if n else []
    runs = max(1, min(how.stretches, how.lines))
    size = how.lines // runs
    return [(a, a + size) for a in ((n - size) * k // max(1, runs - 1) for k in range(runs))]


def sample_lines(col: pa.Array, how: Fit = Fit()) -> pa.StructArray:
    """For each text the features of its sampled lines, one line after the other, and the lengths of the stretches."""
    buf, offs = bt.flatten(col)
    features: list[np.ndarray] = []
    sizes: list[list[int]] = []
    for i, j in bt.slices(offs):
        x, at, _ = line_features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        x = _with_neighbours(x, at)
        for a, b in zip(at.tolist(), at.tolist()[1:], strict=False):
            ranges = _stretches(b - a, how)
            features.append(np.concatenate([x[a + s : a + e] for s, e in ranges] or [x[:0]]).ravel())
            sizes.append([e - s for s, e in ranges])
    ends = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.float32), *features]).astype(np.float32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sizes, pa.list_(pa.int32()))], ["features", "sizes"])


def sample_of(texts: list[str | None], labels: list[int], how: Fit = Fit()) -> Sample:
    """The training lines of texts at hand."""
    rows = sample_lines(pa.array(texts, pa.string()), how).to_pylist()
    return _sample([r["features"] for r in rows], [r["sizes"] for r in rows], labels)


def _sample(features: list, sizes: list[list[int]], labels: list[int]) -> Sample:
    x = np.concatenate([np.zeros(0), *[np.asarray(f, np.float64) for f in features]]).reshape(-1, 3 * N_OWN)
    lens = np.array([n for s in sizes for n in s], np.int64)
    return Sample(x, np.concatenate([[0], np.cumsum(lens)]), np.repeat(np.arange(len(sizes)), [len(s) for s in sizes]), np.asarray(labels, np.int64))


def fit(sample: Sample, how: Fit = Fit()) -> Model:
    """Gradient ascent (Adam) on the mean log-likelihood of the lines' labels."""
    y, x, at = sample.labels, sample.x, sample.chains
    known = set(y.tolist())
    if len(known) < 2 or not len(x):
        return Model(np.zeros((3 * N_OWN, 2)), np.zeros((2, 2)), 0.5 if not known else float(np.mean(y)))
    lens = np.diff(at)
    label = np.repeat(y[sample.document], lens)
    # both labels weigh the same, and so does each document
    share = np.bincount(y, minlength=2) / len(y)
    of_document = np.bincount(sample.document, lens, len(y))
    weight = np.repeat(1 / of_document[sample.document], lens) / np.maximum(share, 1e-9)[label]
    weight /= weight.sum()
    own = np.eye(2)[label]
    seen = np.zeros((len(label), 2, 2))
    inner = np.ones(len(label), bool)
    inner[at[:-1][lens > 0]] = False
    k = np.flatnonzero(inner)
    seen[k, label[k - 1], label[k]] = 1
    params = [np.zeros((3 * N_OWN, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, how.steps + 1):
        one, pair = _smooth(x @ params[0], params[1], at)
        grads = [x.T @ ((own - one) * weight[:, None]) - how.l2 * params[0], ((seen - pair) * weight[:, None, None]).sum(0) - how.l2 * params[1]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] + how.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return Model(params[0], params[1], float(np.mean(y)))


def score_batch(col: pa.Array, model: Model) -> pa.StructArray:
    buf, offs = bt.flatten(col)
    score, lines, bad = [], [], []
    for i, j in bt.slices(offs):
        o = offs[i : j + 1] - offs[i]
        x, at, chars = line_features(buf[offs[i] : offs[j]], o)
        one, _ = _smooth(_with_neighbours(x, at) @ model.weights.astype(np.float32), model.move, at)
        good = one[:, 1] if len(one) else np.zeros(0)
        if not model.weights.any():
            good = np.full(len(good), model.prior)
        rows = np.repeat(np.arange(j - i), np.diff(at))
        total = np.bincount(rows, chars, j - i)
        got = np.bincount(rows, good * chars, j - i)
        score.append(np.clip(np.where(total > 0, got / np.maximum(total, 1), model.prior), 0, 1))
        lines.append(np.diff(at))
        bad.append(np.bincount(rows, good < 0.5, j - i).astype(np.int64))
    cat = lambda a, t: pa.array(np.concatenate(a) if a else np.zeros(0), t)
    return pa.StructArray.from_arrays([cat(score, pa.float64()), cat(lines, pa.int64()), cat(bad, pa.int64())], ["score", "n_lines", "n_bad_lines"])


def score_of(text: Column, model: Model) -> Column:
    """struct(score, n_lines, n_bad_lines) for a text column."""

    def f(col: pa.Array) -> pa.Array:
        return score_batch(col, model)

    return arrow_udf(f, "score double, n_lines bigint, n_bad_lines bigint").asNondeterministic()(text)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None, how: Fit = Fit()) -> Sample:
    """The training lines of about `how.per_label` documents of each label, chosen by a hash of their id; rows without id or label are skipped.

    One counting pass over `labels`.  Should ids repeat, the `how.most_rows` first rows by that hash are taken.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if allowed is not None:
        known = known.where(allowed)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return _sample([], [], [])
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(1_000_000))
    most = F.lit(0)
    for y, n in sorted(counts.items()):
        most = F.when(F.col("y") == y, F.lit(min(1_000_000, -(-how.per_label * 1_000_000 // n)))).otherwise(most)
    chosen = known.where(spread < most).dropDuplicates(["id"])
    lines = arrow_udf(lambda col: sample_lines(col, how), "features array<float>, sizes array<int>").asNondeterministic()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("id", "y", lines("text").alias("s")).orderBy(F.xxhash64("id"), "id", "s").limit(how.most_rows).collect()
    return _sample([r.s.features for r in rows], [r.s.sizes for r in rows], [r.y for r in rows])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with score (0 to 1), predicted (1 if score >= 0.5), n_lines and n_bad_lines."""
    names = [f"{prefix}{x}" for x in ("score", "predicted", "n_lines", "n_bad_lines")]
    mark, own = spare(docs, "crf"), kept(docs, names)
    q = F.col(mark)
    new = (q.score, (q.score >= 0.5).cast("int"), q.n_lines, q.n_bad_lines)
    return docs.select(*own, score_of(F.col(f"`{text_col}`"), model).alias(mark)).select(*own, *[c.alias(n) for c, n in zip(new, names, strict=True)])


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `least` or more, with the columns of `docs`."""
    mark = spare(docs, "crf")
    return docs.select("*", score_of(F.col(f"`{text_col}`"), model).alias(mark)).where(F.col(f"{mark}.score") >= least).drop(mark)
