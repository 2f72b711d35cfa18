"""Each operator against a plain version, and on odd inputs: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelframe.llm import bpe, chat_format, html_extract, language_id, license_scan, ngram_join, quality_crf, quality_rules, source_mix, vector_search
from voxelframe.llm import bytetext as bt

LONG = "lorem ipsum dolor sit amet, " * 4000
ODD = [None, "", "   ", "\n\n", "a", "one two", LONG, "é 中文 😀", "x" * 30000, "a\tb\x0bc\x0cd\re\x1cf", "tie tie tie", "tie tie tie"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with an id that repeats, null ids, and columns whose names operators use themselves."""
    rows = [(None if i == 4 else i // 2, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "score!", 7, [1], "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size int, ids array<int>, key string")


# --- words and hashes


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    buf, offs = bt.flatten(pa.array(texts, pa.string()))
    starts, ends, at = bt.words(buf, offs)
    got = [[buf[a:b].tobytes() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(at, at[1:])]
    assert got == [t.encode().split() for t in texts]


def test_span_hashes_follow_content():
    words = [w.encode() for w in "a b ab ba a abc abc x".split()] + [b"y" * 3_000_000, b"a"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = bt.span_hashes(buf, ends - [len(w) for w in words], ends)
    assert {(w, int(x)) for w, x in zip(words, h)} == {(w, int(h[words.index(w)])) for w in words} and len(set(h.tolist())) == len(set(words))


# --- BPE


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCAB)


def same_ids(library, texts):
    v = bpe.vocab()
    ids = v.encode(pa.array(texts, pa.string()))
    for t, got, back in zip(texts, ids.to_pylist(), v.decode(ids).to_pylist()):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got == want and back == library.decode(want, skip_special_tokens=False)


def test_bpe_odd_texts(library):
    same_ids(library, [*ODD, "<|endoftext|>", "a<|endoftext|>'s<|endoftext|><|endoftext|> b", "'s 's it's 'LL we'll're", "  \n  x", "ab" * 5000, "1²Ⅷ٣ x", "\u00a0\u2003a \u0301b"])


@given(st.lists(st.text(st.sampled_from(list("aetion 's'tre\n\t.,!1é中\u00a0<|>😀")), max_size=60), max_size=12))
@settings(max_examples=80, deadline=None)
def test_bpe_fuzz(library, texts):
    same_ids(library, texts)


def test_bpe_pieces_are_the_merges_of_the_library(library):
    rng = random.Random(0)
    v = bpe.vocab()
    for _ in range(1500):
        w = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 30)))
        assert v.encode_piece(w.encode()) == library.encode(w, add_special_tokens=False).ids


def test_bpe_caches_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    same_ids(library, ["several different words that overflow a cache of five pieces, again and again"])


def test_bpe_shared_hashes_fall_back(monkeypatch, library):
    monkeypatch.setattr(bt, "span_hashes", lambda buf, s, e, second=False: (e - s).astype(np.uint64) if not second else bt.mix64(buf[e - 1].astype(np.uint64)))
    same_ids(library, ["one two six ten ace"])


def test_bpe_frames(spark, odd):
    done = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert [r.decoded for r in done] == [r.text or "" for r in odd.collect()] and done[0].score == "score!"
    one = bpe.round_trip_documents(odd).select("ids", "decoded").collect()
    assert one == [(r.ids, r.decoded) for r in done]
    assert bpe.encode_documents(odd.where("false")).count() == 0
    strange = spark.createDataFrame([([50256, -1, 99999, None, 198],), (None,), ([],), ([128],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_documents(strange).collect()] == ["<|endoftext|>\n", None, "", bpe.vocab().flat[bpe.vocab().offsets[128] : bpe.vocab().offsets[129]].tobytes().decode("utf-8", "replace")]


# --- mixing


def filled(sizes, weights, most=3.0):
    left, free, out = sum(sizes.values()), set(sizes), {}
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if unit * weights[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weights[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check_mix(docs, got):
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    goal = filled(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)})
    for s, rows in by.items():
        assert all(r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 for r in rows)
        assert abs(sum(r.taken for r in rows) - goal[s]) <= 1
        for r in rows:
            assert 0 <= r.taken <= 3 * r["size"] and all(0 <= p <= 1 for p in r.positions)
            assert len(r.positions) == (-(-r.taken // r["size"]) if r["size"] else 0) or r.taken % r["size"] == 0


def test_mix_hot_and_null_sources(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["hot"] * 6 + ["b", "c", None, "tiny"])) for i in range(600)] + [(600, None, "b"), (0, "w w", "hot"), (0, "w w", "hot")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = source_mix.Mix(rows_per_bucket=8)
    got = source_mix.plan(docs, mix=mix).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    again = source_mix.plan(docs.repartition(7), mix=mix)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mix_counts_words_by_ascii_space(spark):
    rows = [(t,) for t in ODD]
    got = spark.createDataFrame(rows, "t string").select(source_mix.size_of(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len((t or "").encode().split()) for t in ODD]


def test_mix_schedule_is_inverted(spark):
    s = spark.createDataFrame([(k / 10,) for k in range(11)], "share double")
    for begin, end in ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5), (0.0, 2.0), (2.0, 0.0)):
        for r in s.select("share", source_mix._invert(F.col("share"), F.lit(begin), F.lit(end)).alias("t")).collect():
            assert abs(begin * r.t + (end - begin) * r.t**2 / 2 - r.share) < 1e-9


def test_mix_order_and_odd(spark, odd):
    planned = source_mix.plan(odd)
    got = planned.collect()
    assert len(got) == len(ODD) and got[0].score == "score!"
    check_mix(ODD, got)
    rows = source_mix.training_order(planned, odd.columns)
    assert rows.columns == odd.columns
    position = planned.select(F.explode("positions").alias("p"))
    assert abs(rows.count() - position.count()) <= odd.select("source").distinct().count()
    assert source_mix.plan(odd.where("false")).count() == 0
    named = source_mix.plan(odd, prefix="m_")
    assert {r["size"] for r in source_mix.training_order(named, odd.columns, prefix="m_").collect()} == {7}


def test_mix_training_order_is_sorted(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(300)], "doc_id bigint, text string, source string")
    planned = source_mix.plan(docs)
    at = {r.doc_id: sorted(r.positions) for r in planned.collect()}
    last = -1.0
    for r in source_mix.training_order(planned, docs.columns, 0.0).collect():
        p = at[r.doc_id].pop(0)
        assert p >= last
        last = p


# --- n-gram join


def grams(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_links(rows, similarity=0.8):
    """(id, class, copy, links) of every row, by comparing all pairs."""
    sets, words = [grams(t) for _, t in rows], [tuple((t or "").encode().split()) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if words[a] == words[b] or (both and both >= similarity * len(sets[a] | sets[b]) - 1e-9):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    roots, n = [find(a) for a in range(len(rows))], range(len(rows))
    return sorted(((rows[a][0], least(rows[b][0] for b in n if roots[b] == roots[a]), least(rows[b][0] for b in n if words[b] == words[a]), links[a]) for a in n), key=str), len(set(roots))


@pytest.mark.parametrize("join", [ngram_join.Join(), ngram_join.Join(block_rows=16, block_bytes=20000, tile=8), ngram_join.Join(whole=3, block_rows=40, tile=16)])
def test_ngram_join_equals_all_pairs(spark, join):
    """A large group of near copies (in several blocks with the small block), exact copies, short texts, null ids and repeated rows."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    base = [word() for _ in range(150)]
    for _ in range(60):
        t = list(base)
        t[rng.randrange(150)] = word()
        rows.append((len(rows), " ".join(t)))
    rows += [(100 + k, " ".join(base)) for k in range(20)]
    for _ in range(12):
        b = [word() for _ in range(rng.randrange(3, 80))]
        for k in range(3):
            t = list(b)
            if k:
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows) + 200, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "  \n"), (None, "a b c d e f g"), (903, "a b c d e f g"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, n_groups = plain_links(rows)
    assert sorted(map(tuple, ngram_join.near_duplicates(df, join=join).collect()), key=str) == want
    assert ngram_join.keep_one(df, join=join).count() == n_groups


def test_ngram_join_odd(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, n_groups = plain_links(rows)
    assert sorted(map(tuple, ngram_join.near_duplicates(odd).collect()), key=str) == want
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == n_groups
    assert ngram_join.near_duplicates(odd.where("false")).count() == 0 and ngram_join.keep_one(odd.where("false")).count() == 0


def test_ngram_verify_equals_plain_pairs():
    """Tiles, sides and first shared bands against all pairs of sets."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 40, rng.integers(5, 60)) for _ in range(8)]
    sets = [np.unique(np.concatenate([rng.choice(b, max(1, int(len(b) * 0.95)), False), rng.integers(0, 1 << 40, 1)])) for b in base for _ in range(6)]
    lens = np.array([len(s) for s in sets])
    flat, copies = np.concatenate(sets), rng.integers(1, 4, len(sets))
    side, bands = rng.integers(0, 2, len(sets)), rng.integers(0, 3, (len(sets), 4))
    for use_side, band in ((False, -1), (True, -1), (False, 2)):
        got = ngram_join.verify(ngram_join.Sets(flat, np.cumsum(lens) - lens, lens), copies, side if use_side else None, bands if band >= 0 else None, band, 0.8, 7)
        links, up = np.zeros(len(sets), int), list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and both >= 0.8 * (lens[i] + lens[j] - both) - 1e-9 and not (use_side and side[i] == side[j]) and not (band >= 0 and (bands[i, :band] == bands[j, :band]).any()):
                    links[i] += copies[j]
                    x, y = up[i], up[j]
                    up = [min(x, y) if u in (x, y) else u for u in up]
        assert got[0].tolist() == links.tolist() and got[1].tolist() == up


def chained(n, keep=10, words=16):
    """Texts of which each has the last words of the one before: neighbours share some n-grams and a bucket now and then, and none is a near copy."""
    return [(k, " ".join(f"w{(words - keep) * k + i}" for i in range(words))) for k in range(n)]


def test_ngram_chained_group(spark, monkeypatch):
    """10,000 classes that hang together by weak links: sets travel at most once for each band, no pair is lost, and pairs outside buckets are not compared."""
    dealt, seen = ngram_join._dealt, []

    def watched(*args):
        out = dealt(*args)
        seen.extend(out.groupBy("band", "split").agg(F.countDistinct("key").alias("keys"), F.max("parts").alias("parts"), F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(ngram_join, "_dealt", watched)
    rows = chained(10_000, keep=14)
    rows += [(20_000 + k, rows[k][1] + " more") for k in range(0, 10_000, 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    want = {k: (k, 0) for k, _ in rows}
    for k in range(0, 10_000, 100):
        want[k] = want[20_000 + k] = (k, 1)
    assert got == want
    by_bucket = [r for r in seen if r.band >= 0]
    assert sum(r.n for r in by_bucket) > 10_000 and len(by_bucket) == 38  # the chain is one group, and goes by its buckets
    assert all(r.parts == 1 and r.n == r.keys for r in seen)  # a set travels at most once for each band


def test_ngram_large_group_goes_by_buckets(spark):
    """One group of a chain and a dense part, dealt by bucket and dealt as a whole: the same rows."""
    rng = random.Random(8)
    rows = chained(400, keep=12, words=14)
    for k in range(0, 400, 10):
        rows.append((1000 + k, rows[k][1] + f" x{rng.randrange(3)}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    by = [sorted(map(tuple, ngram_join.near_duplicates(df, join=ngram_join.Join(whole=w, block_rows=b)).collect())) for w, b in ((4, 8), (10_000, 4096))]
    assert by[0] == by[1] and len({r[1] for r in by[0]}) < len(rows)


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.99999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = ngram_join.bands_for(similarity, recall, 96 if similarity != 0.8 else 240)
        assert bands * rows <= (96 if similarity != 0.8 else 240) and 1 - (1 - similarity**rows) ** bands >= recall
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.99999, 8)


# --- language


def bilingual(n=120):
    rng = random.Random(3)
    make = lambda sound: " ".join("".join(rng.choice(sound) for _ in range(rng.randrange(1, 4))) for _ in range(60))
    return [(make(["tha", "ing", "er", "wh"]), "en") for _ in range(n)] + [(make(["ção", "ñe", "os", "que"]), "es") for _ in range(n)]


def test_gru_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    embed, loop = rng.normal(0, 0.5, (256, 9)), rng.normal(0, 0.5, (9, 3))
    x, goal = rng.integers(0, 4, (6, 5)), rng.normal(size=(6, 3, 5))

    def run(e, w):
        h, out = np.zeros((3, 5)), 0.0
        for t in range(6):
            i = e[x[t]].T
            zr = 1 / (1 + np.exp(-(i[:6] + w[:6] @ h)))
            c = np.tanh(i[6:] + zr[3:] * (w[6:] @ h))
            h = c + zr[:3] * (h - c)
            out += (h * goal[t]).sum()
        return out

    states, kept = language_id._run(embed.astype(np.float32), loop.astype(np.float32), x, True)
    assert abs((states * goal).sum() - run(embed, loop)) < 1e-3
    de, dl = language_id._back(loop.astype(np.float32), x, kept, goal.astype(np.float32))
    for k in [(0, 0), (4, 2), (8, 1)]:
        step = np.zeros_like(loop)
        step[k] = 1e-5
        assert abs((run(embed, loop + step) - run(embed, loop - step)) / 2e-5 - dl[k]) < 1e-2
    for k in [(0, 1), (3, 5), (2, 8)]:
        step = np.zeros_like(embed)
        step[k] = 1e-5
        assert abs((run(embed + step, loop) - run(embed - step, loop)) / 2e-5 - de[k]) < 1e-2


def test_language_learns_and_labels_every_byte(spark, odd):
    rows = bilingual()
    model = language_id.fit([t.encode() for t, _ in rows[::2]], [y for _, y in rows[::2]], language_id.Fit(steps=80))
    texts = [t for t, _ in rows[1::2]]
    got = language_id.predict_batch(pa.array(texts), model).to_pylist()
    assert sum(g["lang"] == y for g, (_, y) in zip(got, rows[1::2])) >= 0.95 * len(got)
    buf, offs = bt.flatten(pa.array([*texts[:5], "", "x"]))
    p, votes = language_id.probabilities(buf, offs, model)
    assert (votes.sum(1) == np.diff(offs)).all() and np.allclose(p[:5].sum(1), 1, atol=1e-4)
    done = language_id.identify(odd, model).collect()
    for r, t in zip(done, ODD):
        letter = any(c.isalpha() for c in t or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1 and (letter or r.score == 0)
    assert done[0].n_chars == 0 and language_id.identify(odd.where("false"), model).count() == 0


def test_language_windows_dont_depend_on_neighbours():
    rows = bilingual(20)
    model = language_id.fit([t.encode() for t, _ in rows], [y for _, y in rows], language_id.Fit(steps=20))
    alone = language_id.predict_batch(pa.array([rows[0][0]]), model).to_pylist()[0]["score"]
    among = language_id.predict_batch(pa.array([t for t, _ in rows]), model).to_pylist()[0]["score"]
    assert abs(alone - among) < 1e-5


def test_language_without_or_with_one_language():
    none = language_id.fit([], [])
    assert language_id.predict_batch(pa.array(["abc", None]), none).to_pylist()[0]["lang"] == "und"
    one = language_id.fit([b"abc"], ["en"])
    assert language_id.predict_batch(pa.array(["abc", "12"]), one).to_pylist() == [{"lang": "en", "score": 1.0, "n_bytes_agreeing": 3}, {"lang": "und", "score": 0.0, "n_bytes_agreeing": 0}]


# --- quality classifier


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    score, move, at = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 7])
    one, pair = quality_crf._smooth(score, move, at)
    for a, b in zip(at, at[1:]):
        n = b - a
        total, mark, pairs = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
        for code in range(2**n if n else 0):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(score[a + k, y[k]] for k in range(n)) + sum(move[y[k - 1], y[k]] for k in range(1, n)))
            total += p
            for k in range(n):
                mark[k, y[k]] += p
                if k:
                    pairs[k, y[k - 1], y[k]] += p
        if n:
            assert np.allclose(one[a:b], mark / total) and np.allclose(pair[a + 1 : b], pairs[1:] / total)


def quality_rows():
    rng = random.Random(4)
    prose = lambda: "\n".join(" ".join("".join(rng.choice("aeiorstln") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 40))) + "." for _ in range(rng.randrange(1, 6)))
    bad = lambda t: rng.choice([" ".join(w + "###$$" for w in t.split()), " ".join(w.upper() + "!!" for w in t.split()), " ".join([t.split()[0]] * 80)])
    return [(prose(), 1) for _ in range(150)] + [(bad(prose()), 0) for _ in range(150)]


def test_crf_learns(spark, odd):
    rows = quality_rows()
    model = quality_crf.fit(quality_crf.sample_of([t for t, _ in rows[::2]], [y for _, y in rows[::2]]), quality_crf.Fit(steps=60))
    got = quality_crf.score_batch(pa.array([t for t, _ in rows[1::2]]), model).to_pylist()
    assert sum((g["score"] >= 0.5) == y for g, (_, y) in zip(got, rows[1::2])) >= 0.95 * len(got)
    mixed = rows[0][0] + "\n" + rows[-1][0]
    line_bad = quality_crf.score_batch(pa.array([mixed]), model).to_pylist()[0]
    assert 0 < line_bad["n_bad_lines"] < line_bad["n_lines"]
    done = quality_crf.score_documents(odd, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in done)
    assert done[0].score == done[1].score == model.prior and done[-1].score == done[-2].score
    assert quality_crf.keep_good(odd, model).columns == odd.columns and quality_crf.score_documents(odd.where("false"), model).count() == 0


def test_crf_without_training_rows(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    none, one = quality_crf.fit(quality_crf.training_sample(odd, empty)), quality_crf.fit(quality_crf.sample_of(["x"], [1]))
    assert quality_crf.score_batch(pa.array(["a b", None]), none).field("score").to_pylist() == [0.5, 0.5]
    assert quality_crf.score_batch(pa.array(["a b"]), one).field("score").to_pylist() == [1.0]
    assert quality_crf.fit(quality_crf.sample_of([None, ""], [0, 1])).prior == 0.5


def test_crf_sample_is_bounded_and_skips_nulls(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(3, None), (None, 1), (4, 0)], "doc_id bigint, quality int")
    how = quality_crf.Fit(per_label=100)
    sample = quality_crf.training_sample(docs, labels, allowed=F.col("id") % 5 != 0, how=how)
    assert 100 < len(sample.labels) < 320 and set(sample.labels.tolist()) == {0, 1} and len(sample.x) == len(sample.document) == len(sample.labels)
    few = quality_crf.training_sample(docs.unionByName(docs), labels, how=quality_crf.Fit(per_label=100, most_rows=50))
    assert len(few.labels) == 50


def test_crf_sample_spreads_over_the_whole_text(spark):
    """Of a long text, runs of lines from the first to the last; they are those of the whole text, neighbours included."""
    assert quality_crf._stretches(0, quality_crf.Fit()) == [] and quality_crf._stretches(40, quality_crf.Fit()) == [(0, 40)]
    assert quality_crf._stretches(1000, quality_crf.Fit()) == [(0, 10), (330, 340), (660, 670), (990, 1000)]
    text = "\n".join("word " * (k % 7 + 1) + "!" * (k % 3) + "X" * (k % 11) for k in range(1000))
    docs = spark.createDataFrame([(1, text), (2, "short one\n\nof two lines")], "doc_id bigint, text string")
    sample = quality_crf.training_sample(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int"))
    x, at, _ = quality_crf.line_features(*bt.flatten(pa.array([text])))
    whole = quality_crf._with_neighbours(x, at)
    k = sample.labels.tolist().index(0)
    rows = np.concatenate([sample.x[a:b] for d, a, b in zip(sample.document, sample.chains, sample.chains[1:]) if d == k])
    assert np.array_equal(rows.astype(np.float32), np.concatenate([whole[a:b] for a, b in quality_crf._stretches(1000, quality_crf.Fit())]))
    assert len(sample.x) == 42 and np.diff(sample.chains).tolist().count(10) == 4


def plain_line(words, before):
    """The features of a line, a word at a time."""
    text = b"".join(words)
    n = len(text)
    count = lambda chars: sum(c in chars for c in text)
    pairs = list(zip(words, words[1:]))
    return [
        1.0,
        min(1, 8 * count(quality_crf.SYMBOLS) / n),
        min(1, 2 * sum(65 <= c <= 90 for c in text) / n),
        min(1, 2 * sum(48 <= c <= 57 for c in text) / n),
        min(1, 8 * count(b"!?") / n),
        sum(a == b for a, b in pairs) / len(words),
        (len(pairs) - len(set(pairs))) / len(words),
        min(1, 4 * count(b"|") / len(words)),
        sum(len(w) <= 2 for w in words) / len(words),
        sum(len(w) >= 20 for w in words) / len(words),
        float(len(words) < 4),
        float(len(words) > 60),
    ]


def plain_quality(text, model):
    """The score of a text: plain features, and marginals by sums over the labels before and after each line."""
    lines = [w for x in (text or "").split("\n") if (w := x.encode().split())]
    if not lines:
        return model.prior, 0, 0
    own = [plain_line(w, None) for w in lines]
    zero = [0.0] * len(own[0])
    e = [np.array(o + (own[k - 1] if k else zero) + (own[k + 1] if k + 1 < len(own) else zero)) @ model.weights for k, o in enumerate(own)]
    fwd, bwd = [e[0]], [np.zeros(2)]
    for k in range(1, len(e)):
        fwd.append(np.array([e[k][y] + np.logaddexp(fwd[-1][0] + model.move[0, y], fwd[-1][1] + model.move[1, y]) for y in (0, 1)]))
        n = e[-k] + bwd[0]
        bwd.insert(0, np.array([np.logaddexp(n[0] + model.move[y, 0], n[1] + model.move[y, 1]) for y in (0, 1)]))
    good = [float(1 / (1 + np.exp(f[0] + b[0] - f[1] - b[1]))) for f, b in zip(fwd, bwd)]
    size = [sum(map(len, w)) for w in lines]
    return sum(g * s for g, s in zip(good, size)) / sum(size), len(lines), sum(g < 0.5 for g in good)


def test_crf_documents_equal_plain():
    rows = quality_rows()
    model = quality_crf.fit(quality_crf.sample_of([t for t, _ in rows], [y for _, y in rows]), quality_crf.Fit(steps=40))
    texts = [t for t, _ in rows[::10]] + [a[0] + "\n" + b[0] for a, b in zip(rows[:10], rows[-10:])] + [t for t in ODD if t is None or len(t) < 1000]
    for t, g in zip(texts, quality_crf.score_batch(pa.array(texts, pa.string()), model).to_pylist()):
        score, lines, bad = plain_quality(t, model)
        assert abs(g["score"] - score) < 1e-4 and (g["n_lines"], g["n_bad_lines"]) == (lines, bad)


def test_crf_many_lines_and_long_lines():
    rows = quality_rows()
    model = quality_crf.fit(quality_crf.sample_of([t for t, _ in rows], [y for _, y in rows]), quality_crf.Fit(steps=20))
    got = quality_crf.score_batch(pa.array(["a line of text\n" * 20000, "word " * 200000]), model).to_pylist()
    assert [g["n_lines"] for g in got] == [20000, 1] and all(0 <= g["score"] <= 1 for g in got)


# --- HTML


TREE = html_extract.fit_tree()


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><article><h1>A &amp; B</h1><p>one <b>t</b>wo&nbsp;\n three<p>four</article></body>", "A & B one two three four"),
        ("<article><p>a<br>b</p><nav>menu</nav><aside>side</aside><form>f</form><footer>foot</footer></article>", "a b"),
        ("<nav>x</nav><main><p>keep</p><div class='comments'><p>a comment of a reader that is quite long, really</p></div></main>", "keep"),
        ("<article><script>var a = '</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<article><p title='a > b'>quoted</p><p title=\"it's\">too</p>", "quoted too"),
        ("<header>site</header><article><header><h1>T</h1></header><p>body</p></article>", "T body"),
        ("<article><p>a &lt;b&gt; &#233;&eacute; 1 < 2</p></article>", "a <b> éé 1 < 2"),
        ("<div id='cookie-notice'>We use cookies on this site to make it better for you and for all.</div><article>x</article>", "x"),
        ("<article><p>cut of", "cut of"),
        ("<article>open <script>never closed <p>gone", "open"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_html(page, text):
    assert html_extract.main_text(page, TREE)[0] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><svg class="icon"/><p>a</p><p>b</p></article>', "a b"),
        ("<div><svg class='icon'/></div><article><p>a</p><math/><p>b</p></article><footer>f</footer>", "a b"),
        ("<article><div><video src=x>no</div><p>a</p><div><object data=y><p>no</div><p>b</p></article>", "a b"),
        ("<article><p><canvas id=c>no</p><p>a</p><ul><li><audio src=x>no</li><li>b</li></ul></article>", "a b"),
        ("<div><select><option>no<option>no</div><article><span><video>no</span><p>a</p></article>", "a"),
        ("<article><p>a</p><svg><title/><style/><g><text>no</text></g></svg><p>b</p></article>", "a b"),
        ("<article><svg><title>no</title><foreignObject><p>no</p><script>'</svg>'</script></foreignObject></svg><p>a</p></article>", "a"),
        ("<article><template><article><p>no</p></article></template><object><object>no</object>no</object><p>a</p></article>", "a"),
        ("<article><video controls><source src=x><p>no <a href=y>no</a></p></video><p>a</p><script>no", "a"),
        ("<article><p>a</p><script/><p>no</p>", "a"),
    ],
)
def test_html_skipped_elements(page, text):
    assert html_extract.main_text(page, TREE)[0] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>a</p><span class='ad'>buy <span>now</span> cheap</span><p>b</p></article>", "a b"),
        ("<article><p>a</p><a class='ad' href=x><div>no <a>no</a></div><p>b</p></a></article>", "a"),
        ("<article><p>a</p><ul><li class='comment'><p>Great post, and a long one</p><p>no</p><li>b</ul><p>c</p></article>", "a b c"),
        ("<article><ul><li class='comment'>no<ul><li>no</li></ul>no</li><li>b</li></ul></article>", "b"),
        ("<article><p class='ad'>no<p>a<p id=notice>no<div>b</div></article>", "a b"),
        ("<article><table><tr><td class='ad'>no<td>a<tr class='ads'><td>no<td>no<tr><td>b</table></article>", "a b"),
        ("<article><dl><dt class=promo>no<dd>a<dt>b</dl></article>", "a b"),
        ("<article><div class='legal-news'><p>a</p></div><p class='menu-review'>b</p><section id='related-work'>c</section></article>", "a b c"),
        ("<article><div class='comment-list'>no</div><div id='siteFooter'>no</div><div class='x ad-unit-2'>no</div><p>a</p></article>", "a"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>no</annotation></math> be</p></article>", "let x=1 be"),
        ("<article><p title='a hidden thing' data-id='ad'>a</p><p hidden>no</p><p style='DISPLAY: none'>no</p><p aria-hidden=true>no</p></article>", "a"),
        ("<body class='comments'><article class='notice'><p>a</p></article><article class='comment'><p>no</p></article>", "a"),
    ],
)
def test_html_marked_elements(page, text):
    assert html_extract.main_text(page, TREE)[0] == text


def test_tree_knows_no_element_names():
    """Lists of links go and text stays, whatever the elements are called; links among text stay."""
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    links = "".join(f"<div><a href=/{k}>Link {k}</a></div>" for k in range(5))
    text = f"<div>{words(4)}</div><div>{words(50)}</div><div><a href=x>{words(3)}</a></div><div>{words(30)} <a>{words(9)}</a></div><div>x</div>"
    want = f"{words(4)} {words(50)} {words(3)} {words(30)} {words(9)} x"
    for a, b in (("", ""), ("<article>", "</article>"), ("<div>", "</div>"), ("<section><div>", "</div></section>")):
        assert html_extract.main_text(f"<body>{links}{a}{text}{b}{links}", TREE)[0] == want
    assert html_extract.main_text(f"{links}<div>Menu</div>{links}", TREE)[0] == ""


def test_html_skipped_elements_are_linear():
    for page in ("<svg>" + "<title/>" * 20000, "<svg/>" * 20000, "<video><p>" * 20000, "<script/>" * 20000):
        html_extract.main_text(page, TREE)


def test_html_without_article_element():
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    page = f"<body><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><h2>Title here</h2><p>{words(60)}</p><p>{words(40)}</p><p><a href=/>next</a></p></body>"
    assert html_extract.main_text(page, TREE)[0] == f"Title here {words(60)} {words(40)}"


def test_html_hostile_pages_are_linear():
    for page in ("<" * 50000, "<a " + '"x' * 50000, "<p>" + "a'" * 50000, "<!--" * 20000, "<p " + "a=" * 50000, "<p " + "a=\"'" * 50000 + ">", "<p class=ad>" * 20000, "<span class=ad>" * 3000, "<li class=ad><ul>" * 20000 + "<li>" * 20000, "<div>" * 40000 + "</p></section>" * 40000, "<span class=ad>" + "<div>" * 20000 + "<span>" * 20000):
        html_extract.main_text(page, TREE)


def test_tree_fits_its_table():
    assert all(html_extract.classify(TREE, x) == y for x, y in html_extract.LABELLED)
    assert html_extract.fit_tree((((0.0,), 1), ((1.0,), 1))) == (1,)


def test_html_frame(spark):
    rows = [(0, "u", None, "clash"), (0, "u", "<article>x é😀</article>", "clash"), (None, None, "", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars string")
    got = html_extract.extract(pages).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0), ("x é😀", 4), ("", 0)]
    assert html_extract.extract(pages.where("false")).count() == 0


# --- quality rules


def plain_rules(t):
    w = (t or "").encode().split()
    windows = Counter(zip(w, w[1:], w[2:]))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            mark[i] = mark[i + 1] = mark[i + 2] = True
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    n, rep = len(w), sum(mark)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def plain_bands(t):
    """ratio, chunks, chunks out of their limits and whether the bands keep a text."""
    import math

    import zstandard

    b = (t or "").encode()
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))

    def fine(x):
        n, table = len(x), quality_rules.LIMITS
        if n < table[0][0]:
            return True
        for (a, lo, hi), (c, lo2, hi2) in zip(table, table[1:]):
            if n <= c:
                part = math.log(n / a) / math.log(c / a)
                return lo + part * (lo2 - lo) <= ratio(x) <= hi + part * (hi2 - hi)
        return table[-1][1] <= ratio(x) <= table[-1][2]

    if not b:
        return None, 0, 0, True
    size = 4096 if len(b) >= 4096 else 1024
    chunks = [b[k : k + size] for k in range(0, len(b) - size + 1, size)]
    if chunks and len(b) % size:
        chunks.append(b[-size:])
    bad = sum(not fine(c) for c in chunks)
    return ratio(b), len(chunks), bad, fine(b) and 3 * bad <= len(chunks)


@given(st.lists(st.text(st.sampled_from(list("ab \n#\té")), max_size=80), max_size=6))
@settings(max_examples=80, deadline=None)
def test_rules_equal_plain_counts(texts):
    for t, g in zip(texts, quality_rules.measure(pa.array(texts, pa.string())).to_pylist()):
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == plain_rules(t)


def test_rules_bands():
    rng = random.Random(0)
    prose = " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) for _ in range(2000))
    lines = "\n".join(f"entry number {k} of a list that repeats itself over and over, {'so it packs well ' * 3}" for k in range(400))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(5)) for _ in range(3000))
    got = quality_rules.measure(pa.array([prose, lines, prose + " " + " ".join(f"{k} of the list again" for k in range(30000)), noise])).to_pylist()
    assert got[0]["kept"] and not got[1]["kept"] and not got[2]["kept"] and got[2]["n_bad_chunks"] > 0
    tight = quality_rules.Rules(limits=((1, 2.5, 9.0),))
    assert not quality_rules.measure(pa.array([noise]), tight).to_pylist()[0]["kept"]


def test_rules_chunks_cover_the_whole_text():
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) for _ in range(2000))
    noise = "".join(chr(rng.randrange(33, 127)) + " " * (rng.random() < 0.02) for _ in range(9000))  # packs to a bit less
    tight = quality_rules.Rules(limits=((64, 0.5, 9.0), (1000, 1.3, 9.0), (2000, 1.3, 9.0), (2001, 0.5, 9.0), (4095, 0.5, 9.0), (4096, 1.3, 9.0), (4097, 0.5, 9.0)))
    texts = [prose[:8191], prose[:4096] + noise[:4095], prose[:4096] + noise[:4096], prose[:3000], prose[:1024] + noise[:1976], prose[:1024], prose[:1023], prose[:4097]]
    got = quality_rules.measure(pa.array(texts), tight).to_pylist()
    assert [g["n_chunks"] for g in got] == [2, 2, 2, 3, 3, 1, 0, 2]
    assert [g["n_bad_chunks"] for g in got] == [0, 1, 1, 0, 2, 0, 0, 0]
    assert [g["kept"] or g["base_failed"] for g in got[:4]] == [True, False, False, True] and not got[4]["kept"]


def test_rules_frames(odd):
    got = quality_rules.apply_rules(odd).collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [plain_rules(t) for t in ODD]
    assert not any(r.kept for r in got if r.base_failed) and got[0].ratio is None
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got) and quality_rules.apply_rules(odd.where("false")).count() == 0


# --- licences


def test_license_rules(spark, duck):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    bsd = [t for i, t in license_scan.SENTENCES if i.startswith("bsd")]
    texts = [mit, "\n".join(bsd), "\n".join(bsd[:3]), "\n".join(reversed(bsd)), "Text. Licensed under CC BY-NC 4.0. More", "ALL   RIGHTS,reserved", "all rights reserved here", None, "", "x. Released under the MIT License. All rights reserved."]
    got = [r.licenses for r in license_scan.scan(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, licenses string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "", "CC-BY-NC-4.0", "all rights reserved", "", "", "", "MIT,all rights reserved"]


def test_license_sql_on_odd(spark, odd, duck):
    rows = odd.select("doc_id", "text").toPandas()
    duck.register("odd_docs", rows)
    want = duck.execute(license_scan.sql("odd_docs")).fetchall()
    assert sorted(map(str, map(tuple, license_scan.scan(odd.select("doc_id", "text")).drop("text").collect()))) == sorted(str(tuple(None if x != x else int(x) if isinstance(x, float) else x for x in r)) for r in want)


def test_license_wrapped_files(spark, duck):
    """Hard-wrapped licences and headers, plain and as comments; empty lines and other words still end a sentence."""
    import textwrap

    known = lambda *names: [next(t for i, t in license_scan.SENTENCES if i == n) for n in names]
    fill = lambda t, width, mark="": textwrap.fill(t, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False)
    grant, condition, as_is = known("mit-grant", "mit-condition", "as-is")
    bsd = known("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")
    gpl = known("gpl-free")[0] + "\n\n" + known("gpl-hope")[0] + " without even the implied warranty of MERCHANTABILITY."
    texts, want = [], []
    for width in (40, 72, 80):
        for mark, blank in (("", "\n"), (" * ", " *\n"), ("# ", "#\n"), ("// ", "//\n"), (";; ", ";;\n"), ("! ", "!\n"), ("dnl ", "dnl\n"), ("REM ", "REM\n")):
            paragraphs = lambda parts: ("\n" + blank).join(fill(t, width, mark) for t in parts) + "\n"
            texts += [paragraphs(["MIT License", "Copyright (c) 2020 A. Person", grant, condition, as_is + " IN NO EVENT SHALL THE AUTHORS BE LIABLE"])]
            texts += [paragraphs(["Copyright 2020, all of us", bsd[0], *[f"{k}. {t}" for k, t in enumerate(bsd[1:], 1)]]), paragraphs(["Copyright", *bsd[:3]]), paragraphs(gpl.split("\n\n"))]
            want += ["MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0"]
    texts += [texts[0].replace("\n", "\r\n"), "All rights\n\nreserved.", "see: all rights\nreserved, or not", "we say all rights\nreserved.", "MIT License\nCopyright (c) 2020", "Licensed under the Apache License, Version 2.0\n(the \"License\"); more"]
    want += ["MIT", "", "", "", "", ""]
    headers = {
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
    }
    for name, t in headers.items():
        texts += [fill(t, width, mark) for width, mark in ((1000, ""), (78, ""), (60, " * "), (70, "dnl "))]
        want += [name] * 4
    texts += ["dnl\ndnl All rights\ndnl reserved.\ndnl\nAll rights reserved", ";; dnl\nMIT License\n\n; MIT License ;", "MIT License|MIT License", "MIT License\nMIT License\nMIT\nLicense"]
    want += ["all rights reserved", "", "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = license_scan.scan(df).orderBy("doc_id").collect()
    assert [r.primary_license for r in got] == want
    duck.register("wrapped_docs", df.toPandas())
    assert [tuple(r) for r in license_scan.scan(df).drop("text").orderBy("doc_id").collect()] == duck.execute(license_scan.sql("wrapped_docs") + " ORDER BY doc_id").fetchall()
    assert got[0].sentence_ids == "mit-title mit-grant mit-condition as-is"
    by_text = {t: r.sentence_ids for t, r in zip(texts, got)}
    assert by_text["MIT License\nCopyright (c) 2020"] == "mit-title" and by_text["Licensed under the Apache License, Version 2.0\n(the \"License\"); more"] == "apache-header"
    assert license_scan.scan(spark.createDataFrame([(". " * 200000 + "\n" * 200000 + "All rights\nreserved",)], "text string")).head().sentence_ids == "reserved"


# --- chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool\n### x", "", "\\"]), st.text(st.sampled_from(list("\\#<>/turn \n:é😀Asit")), max_size=30)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert chat_format.masked(text, spans) == "".join(t for r, t in turns if r == "assistant")
    assert text.count("\n### ") + text.startswith("### ") >= len(turns) or not turns


LAYOUT_CASES = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, []),
    ({"system": "s", "messages": [{"content": "q", "role": "user"}]}, [("system", "s"), ("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
    ({"output": {"text": "o"}, "input": {"prompt": "p"}}, [("user", "p"), ("assistant", "o")]),
    ({"data": {"messages": [{"role": None, "content": "x"}]}}, [("", "x")]),
]


def test_chat_layouts(spark):
    rows = [(json.dumps(r),) for r, _ in LAYOUT_CASES] + [('{"other":1}',), ("no json",), (None,), ("[1]",)]
    got = chat_format.format_records(spark.createDataFrame(rows, "record string").withColumn("layout", F.lit(5))).collect()
    for g, (_, turns) in zip(got, LAYOUT_CASES):
        assert chat_format.parse(g.formatted) == turns and g.n_turns == len(turns)
    assert [(g.formatted, g.fingerprint is None) for g in got[len(LAYOUT_CASES) :]] == [(None, False), (None, True), (None, True), (None, True)]
    assert chat_format.format_records(spark.createDataFrame([], "record string")).count() == 0


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    records = chat_format.records_of_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: chat_format.parse(r.formatted) for r in chat_format.format_records(records).collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("", "x")], None: [("user", "n")]}


# --- vectors


def plain_top(rows, k):
    out = []
    use = [(i, n, v) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in use), default=0)
    pad = lambda v: np.array(list(v) + [0.0] * (width - len(v)))
    for i, n, v in use:
        if i is not None and i % 20 == 0:
            found = sorted(((-float(pad(v) @ pad(w)), j is None, j or 0, j) for j, m, w in use if m != n))[:k]
            out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [vector_search.Search(least_blocks=1), vector_search.Search(least_blocks=7, tile=16, batch=3, groups=2), vector_search.Search(block_bytes=400, least_blocks=2)])
def test_vectors_equal_all_pairs(spark, how):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.integers(-30, 30, 6)]) for i in range(150)]
    rows += [(200 + i, [5.0] * 6) for i in range(40)] + [(20, [5.0] * 6), (40, rows[40][1]), (40, rows[40][1]), (None, [9.0] * 6), (7, rows[7][1])]
    rows += [(60, None), (80, []), (300, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (320, [float("nan")] * 6), (340, [float("inf")] * 6), (360, [4.0, -4.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    got = vector_search.top_k(df, F.col("id") % 20 == 0, k=5, integer=True, how=how)
    assert sorted(((*r[:3], float(r[3])) for r in got.collect()), key=str) == plain_top(rows, 5)


def test_vectors_few_or_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert vector_search.top_k(spark.createDataFrame([], schema), F.col("id") % 20 == 0).count() == 0
    assert vector_search.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("id") % 20 == 0).count() == 0
    assert vector_search.top_k(spark.createDataFrame([(1, [1.0])], schema), F.col("id") % 20 == 0).count() == 0
    assert vector_search.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("id") % 20 == 0).count() == 1


def test_vectors_of_reals_and_copies(spark):
    """A third of the rows have one vector, and all of them are queries; the others are reals of many sizes."""
    rng = np.random.default_rng(3)
    same = rng.normal(size=4).tolist()
    rows = [(20 * i, same) for i in range(60)] + [(int(i), (rng.normal(size=4) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(2001, 2101)] + [(3000, [0.0] * 4), (3020, [1e150, -1e150, 1e-150, 0.0]), (3040, [])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0, k=7, how=vector_search.Search(least_blocks=3)).collect()
    want = plain_top(rows, 7)
    assert [r[:3] for r in sorted((tuple(r) for r in got), key=str)] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in sorted((tuple(r) for r in got), key=str)], [r[3] for r in want], rtol=1e-9)


def test_vector_bounds_hold():
    rng = np.random.default_rng(1)
    for scale, shift in ((1.0, 0.0), (1e-9, 1e3), (1e120, 0.0)):
        x, q = rng.normal(size=(300, 16)) * scale + shift, rng.normal(size=(9, 16))
        grid = vector_search.Grid.over(x.min(0), x.max(0))
        lower, upper = vector_search.bounds(grid, grid.cells(x), q)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()


def test_vector_scan_reads_little():
    """Of 20,000 vectors a query reads less than 1 % exactly, and finds what the dense product finds."""
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(20000, 32)) / 6)
    block = vector_search.Block(x, np.arange(20000), vector_search.Grid.over(x.min(0), x.max(0)))
    query, vector, score = block.search(x[:64], 21, True)
    dense = x[:64] @ x.T
    want = [np.lexsort((np.arange(20000), -s))[:21] for s in dense]
    assert np.array_equal(vector.reshape(64, 21), want) and np.array_equal(score.reshape(64, 21), np.take_along_axis(dense, np.array(want), 1))
    assert block.cells.dtype == np.uint8 and block.reads < 64 * 200


def test_large_whole_numbers_are_exact():
    q, x = np.array([[2.0**30, 1.0]] * 2), np.array([[2.0**30, 1.0], [2.0**30, -1.0]])
    assert vector_search.exact(q, x, True).tolist() == [float(2**60 + 1), float(2**60 - 1)]


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


# --- clashing names


def clashing(spark, *names):
    """A table whose other columns have the names that operators use for themselves, in another letter case, too."""
    rows = [(1, "some text here", "en", "s", *names), (None, None, None, None, *names)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "lang string", "source string", *[f"`{n}` string" for n in names]]))


def test_own_names_of_operators_are_free(spark):
    """Columns of any name pass through; only those with the name of a new column are replaced."""
    names = ["crf", "CRF_", "rules", "Language", "license_found", "html_extract", "chat", "bpe_text", "row", "ROW2", "maybe", "word", "bits", "mix_size", "mix_total", "Mix_key", "mix_position", "key", "id", "quality_crf_struct", "bpe_text_"]
    docs = clashing(spark, *names)
    model, lang = quality_crf.fit(quality_crf.sample_of(["x"], [1])), language_id.fit([b"abc"], ["en"])
    planned = source_mix.plan(docs, prefix="p_")
    out = [
        quality_crf.score_documents(docs, model),
        quality_crf.keep_good(docs, model),
        quality_rules.apply_rules(docs),
        quality_rules.keep_good(docs, rules=quality_rules.Rules(min_words=0)),
        language_id.identify(docs, lang),
        license_scan.scan(docs),
        html_extract.extract(docs, html_col="text", text_col="main"),
        bpe.encode_documents(docs),
        bpe.round_trip_documents(docs),
        ngram_join.keep_one(docs),
        planned,
        source_mix.passes(planned, docs.columns, prefix="p_"),
        source_mix.training_order(planned, docs.columns, prefix="p_"),
        chat_format.format_records(docs, "text"),
    ]
    for df in out:
        assert set(docs.columns) <= set(df.columns), df.columns
        for r in df.collect():
            assert all(r[n] == n for n in names)
    assert out[1].columns == out[3].columns == out[9].columns == docs.columns
    new = clashing(spark, "score", "N_Lines", "kept", "ratio", "taken", "licenses", "n_turns", "ids")
    assert quality_crf.score_documents(new, model).columns.count("score") == 1 and "N_Lines" not in quality_crf.score_documents(new, model).columns
    assert quality_rules.apply_rules(new).select("kept", "ratio").schema[0].dataType.simpleString() == "boolean"
    assert source_mix.plan(new).schema["taken"].dataType.simpleString() == "bigint" and bpe.encode_documents(new).schema["ids"].dataType.simpleString() == "array<int>"


# --- language documents against a plain network


def plain_language(text, model):
    """Pooled probabilities and the labels of every byte, a byte at a time."""
    data, size = text.encode(), model.loop.shape[2]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(part, d):
        h, out = np.zeros(size), []
        for b in part:
            i, w = model.embed[d, b].astype(float), model.loop[d].astype(float)
            z, r = sig(i[:size] + w[:size] @ h), sig(i[size : 2 * size] + w[size : 2 * size] @ h)
            c = np.tanh(i[2 * size :] + r * (w[2 * size :] @ h))
            h = c + z * (h - c)
            out.append(h)
        return out

    total, votes = np.zeros(len(model.langs)), np.zeros(len(model.langs), int)
    for k in range(0, len(data), model.window):
        part = data[k : k + model.window]
        for f, b in zip(states(part, 0), states(part[::-1], 1)[::-1]):
            e = np.concatenate([f, b]) @ model.out + model.bias
            p = np.exp(e - e.max())
            total += p / p.sum()
            votes[e.argmax()] += 1
    return total / max(1, len(data)), votes


def test_language_documents_equal_plain():
    rows = bilingual(40)
    model = language_id.fit([t.encode() for t, _ in rows], [y for _, y in rows], language_id.Fit(steps=40))
    texts = [rows[0][0], rows[-1][0], rows[0][0][:70] + rows[-1][0][:200], "é 中文 😀 abc", "x", rows[1][0][:64], rows[1][0][:65]]
    got = language_id.predict_batch(pa.array(texts), model).to_pylist()
    p, votes = language_id.probabilities(*bt.flatten(pa.array(texts)), model)
    for k, t in enumerate(texts):
        want, labels = plain_language(t, model)
        assert np.allclose(p[k], want, atol=1e-5) and np.abs(votes[k] - labels).sum() <= 2  # a tie may round either way
        assert got[k]["lang"] == model.langs[int(want.argmax())] and abs(got[k]["score"] - want.max()) < 1e-5
