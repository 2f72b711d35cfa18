"""Language identification: a bidirectional gated recurrent network over bytes.

A forward and a backward GRU read a text's UTF-8 bytes in windows; at every byte both states give a distribution
over the languages, and a document's probabilities are the mean over all of its bytes.  The network is trained in
numpy by backpropagation through time on a bounded sample of labelled rows: about `Fit.per_lang` documents of each
language and `Fit.most_rows` in all, each with one window at a place drawn over the whole text.  Windows of the same length advance together, so a step is a few small matrix products over
thousands of windows.  Every byte of every text is labelled; a window starts from the zero state.

Defined cases: a text that is null or has no letter gets `und` with score 0; without training rows every text gets
`und`; with one language every text with a letter gets it with score 1; repeated rows get equal results; other
columns pass through, whatever their names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bytetext as bt
from .columns import kept, spare

UNKNOWN = "und"
SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class Fit:
    per_lang: int = 600
    most_rows: int = 100_000
    window: int = 64
    hidden: int = 8
    steps: int = 260
    batch: int = 256
    rate: float = 0.02
    seed: int = 7


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    window: int
    embed: np.ndarray  # (2, 256, 3H): a byte's input to update, reset and candidate, biases included
    loop: np.ndarray  # (2, 3H, H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(embed: np.ndarray, loop: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (T, H, N) of one direction over bytes x (T, N); with `keep`, what backpropagation needs."""
    steps, n = x.shape
    size = loop.shape[1]
    h = np.zeros((size, n), np.float32)
    states = np.empty((steps, size, n), np.float32)
    kept = []
    gates, cand = loop[: 2 * size], loop[2 * size :]
    for t in range(steps):
        e = np.ascontiguousarray(embed[x[t]].T)
        zr = _sigmoid(e[: 2 * size] + gates @ h)
        z, r = zr[:size], zr[size:]
        u = cand @ h
        c = np.tanh(e[2 * size :] + r * u)
        if keep:
            kept.append((h, z, r, u, c))
        h = c + z * (h - c)
        states[t] = h
    return states, kept


def _back(loop: np.ndarray, x: np.ndarray, kept: list, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's embedding and recurrent weights."""
    size = loop.shape[1]
    dembed, dloop = np.zeros((256, 3 * size), np.float32), np.zeros_like(loop)
    dh = np.zeros_like(dstates[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, u, c = kept[t]
        dh = dh + dstates[t]
        dz = dh * (h - c) * z * (1 - z)
        dc = dh * (1 - z) * (1 - c * c)
        dr = dc * u * r * (1 - r)
        du = dc * r
        dzr = np.concatenate([dz, dr])
        np.add.at(dembed, x[t], np.concatenate([dzr, dc]).T)
        dloop[: 2 * size] += dzr @ h.T
        dloop[2 * size :] += du @ h.T
        dh = dh * z + loop[: 2 * size].T @ dzr + loop[2 * size :].T @ du
    return dembed, dloop


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def fit(texts: list[bytes], langs: list[str], how: Fit = Fit()) -> Model:
    """Trains on one window of each text; the languages weigh the same."""
    names = tuple(sorted(set(langs)))
    rng = np.random.default_rng(how.seed)
    size, n_lang = how.hidden, len(names)
    embed = rng.normal(0, 0.3, (2, 256, 3 * size)).astype(np.float32)
    loop = rng.normal(0, 0.3, (2, 3 * size, size)).astype(np.float32)
    out = rng.normal(0, 0.3, (2 * size, max(1, n_lang))).astype(np.float32)
    bias = np.zeros(max(1, n_lang), np.float32)
    if n_lang < 2:
        return Model(names, how.window, embed, loop, out, bias)
    y = np.array([names.index(x) for x in langs])
    data = np.zeros((len(texts), how.window), np.uint8)
    real = np.zeros((len(texts), how.window), np.float32)
    for i, t in enumerate(texts):
        a = int(rng.integers(0, max(1, len(t) - how.window + 1)))
        w = t[a : a + how.window]
        data[i, : len(w)] = np.frombuffer(w, np.uint8)
        real[i, : len(w)] = 1
    by_lang = [np.flatnonzero(y == k) for k in range(n_lang)]
    params = [embed, loop, out, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, how.steps + 1):
        pick = np.concatenate([rng.choice(k, -(-how.batch // n_lang)) for k in by_lang])
        x, mask, goal = data[pick].T, real[pick].T, y[pick]
        fwd, keep_f = _run(embed[0], loop[0], x, True)
        bwd, keep_b = _run(embed[1], loop[1], x[::-1], True)
        both = np.concatenate([fwd, bwd[::-1]], 1)  # (T, 2H, N)
        p = _softmax(np.einsum("thn,hl->tln", both, out) + bias[:, None], 1)
        d = p
        d[:, goal, np.arange(len(goal))] -= 1
        d *= (mask / mask.sum())[:, None, :]
        dboth = np.einsum("tln,hl->thn", d, out)
        ef, lf = _back(loop[0], x, keep_f, dboth[:, :size])
        eb, lb = _back(loop[1], x[::-1], keep_b, dboth[::-1, size:])
        grads = [np.stack([ef, eb]), np.stack([lf, lb]), np.einsum("thn,tln->hl", both, d), d.sum((0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = how.rate * (1 if step < how.steps * 2 // 3 else 0.2)
        for i, g in enumerate(grads):
            g = g / max(1.0, norm)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Model(names, how.window, embed, loop, out, bias)


def _windows(lens: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window: full ones, then what is left of the text."""
    parts = -(-lens // window)
    text = np.repeat(np.arange(len(lens)), parts)
    a = offs[:-1][text] + window * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
    return a, np.minimum(window, offs[1:][text] - a), text


def probabilities(buf: np.ndarray, offs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean distribution over its bytes, and how many bytes are labelled as each language."""
    n, n_lang = len(offs) - 1, len(model.langs)
    pooled, labelled = np.zeros((n, n_lang)), np.zeros((n, n_lang), np.int64)
    starts, sizes, text = _windows(np.diff(offs), offs, model.window)
    order = np.argsort(-sizes, kind="stable")
    size = model.loop.shape[2]
    # windows of nearly the same length run together; the rest of the shorter ones is masked
    i, block = 0, max(256, SLICE_BYTES // model.window)
    while i < len(order):
        k = order[i : i + block]
        k = k[sizes[k] == model.window] if sizes[k[0]] == model.window else k[sizes[k] > sizes[k[0]] // 2]
        i += len(k)
        steps = int(sizes[k[0]])
        at = np.arange(steps)[:, None]
        x = buf[np.minimum(starts[k] + at, len(buf) - 1)]
        back = buf[np.maximum(starts[k] + sizes[k] - 1 - at, 0)]
        fwd, _ = _run(model.embed[0], model.loop[0], x)
        bwd, _ = _run(model.embed[1], model.loop[1], back)
        total = np.zeros((n_lang, len(k)), np.float32)
        votes = np.zeros((n_lang, len(k)), np.int32)
        out_f, out_b = model.out[:size].T.copy(), model.out[size:].T.copy()
        columns = np.arange(len(k))
        uniform = bool((sizes[k] == steps).all())
        for t in range(steps):
            late = sizes[k] - 1 - t  # the backward state of byte t stands there
            b = bwd[steps - 1 - t] if uniform else bwd[np.maximum(late, 0), :, columns].T
            e = out_f @ fwd[t] + out_b @ b + model.bias[:, None]
            e -= e.max(0)
            hit = e >= 0
            np.exp(e, out=e)
            e /= e.sum(0)
            if not uniform:
                live = late >= 0
                e *= live
                hit &= live
            total += e
            votes += hit
        for g in range(n_lang):
            pooled[:, g] += np.bincount(text[k], total[g], n)
            labelled[:, g] += np.bincount(text[k], votes[g], n).astype(np.int64)
    return pooled / np.maximum(np.diff(offs), 1)[:, None], labelled


def predict_batch(col: pa.Array, model: Model) -> pa.StructArray:
    buf, offs = bt.flatten(col)
    lettered = np.asarray(pc.match_substring_regex(col.cast(pa.large_string()).fill_null(""), r"\pL"))
    best, score, share = [], [], []
    for i, j in bt.slices(offs):
        if len(model.langs) > 1:
            p, votes = probabilities(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], model)
        else:
            p = np.ones((j - i, 1))
            votes = np.diff(offs[i : j + 1])[:, None]
        k = p.argmax(1)
        best.append(k)
        score.append(p[np.arange(len(k)), k])
        share.append(votes[np.arange(len(k)), k])
    cat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    known = lettered & bool(model.langs)
    names = np.array([*model.langs, UNKNOWN], object)
    lang = names[np.where(known, cat(best), len(model.langs))]
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(cat(score), 0, 1), 0.0), pa.float64()), pa.array(np.where(known, cat(share), 0), pa.int64())], ["lang", "score", "n_bytes_agreeing"])


def language_of(text: Column, model: Model) -> Column:
    """struct(lang, score, n_bytes_agreeing) for a text column."""

    def f(col: pa.Array) -> pa.Array:
        return predict_batch(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, model)

    return arrow_udf(f, "lang string, score double, n_bytes_agreeing bigint").asNondeterministic()(text)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed: Column | None = None, how: Fit = Fit()) -> tuple[list[bytes], list[str]]:
    """About `how.per_lang` documents of each language, `how.most_rows` at most, chosen by a hash of their id; one stretch of each, drawn over the whole text, reaches the driver."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("id is not null and lang is not null and text is not null")
    if allowed is not None:
        rows = rows.where(allowed)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(4)), F.lit(1_000_000))
    most = F.lit(0)
    for lang, n in sorted(counts.items()):
        most = F.when(F.col("lang") == lang, F.lit(min(1_000_000, -(-how.per_lang * 1_000_000 // n)))).otherwise(most)
    wide = 4 * how.window
    place = (F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.greatest(F.lit(1), F.length("text") - wide)) + 1).cast("int")
    sample = rows.where(spread < most).select("id", "lang", F.substring("text", place, F.lit(wide)).alias("text")).where(F.length(F.trim("text")) > 0)
    got = sample.orderBy(F.xxhash64("id"), "id", "text").limit(how.most_rows).collect()
    return [r.text.encode() for r in got], [r.lang for r in got]


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the predicted language, its score (0 to 1) and the number of bytes labelled as that language."""
    mark, own = spare(docs, "language"), kept(docs, (lang_col, score_col, "n_bytes_agreeing"))
    q = F.col(mark)
    return docs.select(*own, language_of(F.col(f"`{text_col}`"), model).alias(mark)).select(*own, q.lang.alias(lang_col), q.score.alias(score_col), q.n_bytes_agreeing.alias("n_bytes_agreeing"))
