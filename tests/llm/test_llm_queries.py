"""The queries over whole tables against plain versions, and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF

from voxelframe.llm import queries as q

MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(duck):
    return {r[0]: r for r in duck.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1(spark, docs):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(q.bpe.DEFAULT_VOCAB)
    rows = q.op1_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_op2(spark, docs):
    rows = q.op2_source_mix(spark, SF).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len((d[1] or "").encode().split()) for i, d in docs.items()}
    target, taken = {}, defaultdict(int)
    for r in rows:
        target[docs[r.doc_id][3]] = r.target
        taken[docs[r.doc_id][3]] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-3
    assert sorted(map(str, q.op2_source_mix(spark, SF).collect())) == sorted(map(str, rows))


def test_op2_rows_are_in_training_order(spark, docs):
    plan = {r.doc_id: r for r in q.source_mix.plan(q.table(spark, SF, "documents")).collect()}
    first = [r.first_position for r in q.op2_source_mix(spark, SF).collect()]
    known = [x for x in first if x is not None]
    assert known == sorted(known) and first[: len(known)] == known and len(first) == len(docs)
    rows = q.op2_training_order(spark, SF).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r["pass"], r.position, r.n_words))
        assert (r.source, r.text) == (docs[r.doc_id][3], docs[r.doc_id][1])
    for i, r in plan.items():
        assert [x[1] for x in sorted(got[i])] == r.positions and sum(x[2] for x in got[i]) == r.taken
    assert max(map(len, got.values())) > 1


def test_pipeline_keeps_the_training_order(spark):
    import corpus_pipeline as p

    from voxelframe.plans.tables import Tables

    docs = q.table(spark, SF, "documents").repartition(8)
    planned = q.source_mix.plan(docs, prefix="mixed_")
    written = Tables(spark).cut(q.source_mix.training_order(planned, docs.columns, partitions=5, prefix="mixed_"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = p.tokenise(spark, written, SF).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.training_rank for r in rows}) == len(rows)
    positions, times, last = {r.doc_id: r.mixed_positions for r in planned.collect()}, defaultdict(int), 0.0
    for r in sorted(rows, key=lambda r: r.training_rank):
        at = positions[r.doc_id][times[r.doc_id]]
        times[r.doc_id] += 1
        assert at >= last
        last = at


def test_pipeline_decodes(spark, docs):
    import corpus_pipeline as p

    rows = p.tokenise(spark, q.table(spark, SF, "documents"), SF).collect()
    assert len(rows) == len(docs) and all(r.decoded_sha256 == sha(docs[r.doc_id][1] or "") and r.round_trips for r in rows)
    assert p.STAGES[-1][0] == "BPE encoding and decoding"


def test_op3(spark, docs):
    from test_operators import plain_links

    want, _ = plain_links([(d[0], d[1]) for d in docs.values()])
    assert sorted(map(tuple, q.op3_ngram_join(spark, SF).collect()), key=str) == want


def test_op4_held_out(spark):
    import duckdb

    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MORE}/documents.parquet'").fetchall())
    rows = q.op4_language_id(spark, MORE).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op5_held_out(spark):
    import duckdb

    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{MORE}/labels.parquet'").fetchall())
    rows = q.op5_quality_crf(spark, MORE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op6(spark, duck):
    import html
    import re

    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    for r in q.op6_html_extract(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id] or "", re.S)
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", inner[1]).replace("<b>", "").replace("</b>", "")).split()) if inner else ""
        assert (r.text, r.n_chars) == (want, len(want))


def test_op6_tree_decides(duck):
    """Without the article element the texts are the same; all menus go by the tree alone, which knows no elements."""
    h, tree, dropped, menus = q.html_extract, q.html_extract.fit_tree(), 0, 0
    for (page,) in duck.execute("SELECT html FROM pages WHERE html IS NOT NULL").fetchall():
        text = h.main_text(page, tree)[0]
        assert h.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>"), tree)[0] == text
        assert h.main_text(page.replace("<nav>", "<div>").replace("</nav>", "</div>"), tree)[0] == text
        found = h.blocks(page)
        dropped += sum(not h.classify(tree, x) for x in h.features(found))
        menus += page.count("<li>")
    assert dropped >= 0.99 * menus > 0


def test_op7(spark, docs):
    from test_operators import plain_bands, plain_rules

    for r in q.op7_quality_rules(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(docs[r.doc_id][1])
        ratio, chunks, bad, ok = plain_bands(docs[r.doc_id][1])
        assert (r.ratio, r.n_chunks, r.n_bad_chunks, r.kept) == (ratio, chunks, bad, ok and not r.base_failed)


def test_op7_bands_decide(spark):
    """Of labelled texts that pass the base rules, the bands reject half of the bad ones and at most 2 % of the good ones."""
    import duckdb

    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{MORE}/labels.parquet'").fetchall())
    rows = [r for r in q.op7_quality_rules(spark, MORE).collect() if not r.base_failed]
    share = {y: np.mean([r.kept for r in rows if label.get(r.doc_id) == y]) for y in (0, 1)}
    assert share[0] <= 0.5 and share[1] >= 0.98


def test_op8(spark, duck):
    answer = duck.execute(q.oracle_sql()["op8_license_scan"])
    names = [c[0] for c in answer.description]
    assert sorted(map(tuple, q.op8_license_scan(spark, SF).select(*names).collect())) == sorted(answer.fetchall())


def test_op9(spark, duck):
    by = defaultdict(list)
    for r in duck.execute("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        by[r[0]].append(r[2:])
    by[-7] = [("user", q.ODD_TEXT), ("assistant", q.ODD_TEXT)]
    rows = q.op9_chat_format(spark, SF).collect()
    assert len(rows) == len(by)
    for r in rows:
        turns = [(a or "", b or "") for a, b in by[r.conv_id]]
        loss = "".join(t for a, t in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss))


def test_op10(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.floor(np.array([r[1] for r in rows], float) * 64)
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        want += [(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)]
    assert sorted(map(tuple, q.op10_vector_search(spark, SF).collect())) == sorted(want)


def test_op2_plan_is_native(spark):
    for name in ("op2_source_mix", "op8_license_scan"):
        plan = q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_names():
    assert [int(n[2:].split("_")[0]) for n in q.queries()] and {int(n[2:].split("_")[0]) for n in q.queries()} == set(range(1, 11))
    assert set(q.oracle_sql()) <= set(q.queries())


def test_pipeline(spark, docs, duck):
    """Stage by stage against the plain versions, and the whole run against the stages."""
    import corpus_pipeline as p
    from test_operators import plain_links

    from voxelframe.plans.tables import Tables

    tables, now, kept = Tables(spark), q.table(spark, SF, "documents"), []
    for _, stage in p.STAGES:
        before, now = now, tables.cut(stage(spark, now, SF))
        kept.append((before, now))
        if len(kept) < len(p.STAGES):
            assert now.columns == before.columns
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    label = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    good = set(ids(kept[0][1]))
    assert sum((i in good) == bool(y) for i, y in label.items()) >= 0.95 * len(label)
    verdict = {r.doc_id: r.kept for r in q.quality_rules.apply_rules(kept[1][0]).collect()}
    assert set(ids(kept[1][1])) == {i for i, k in verdict.items() if k}
    rows = [(r.doc_id, r.text) for r in kept[2][0].collect()]
    want, n_groups = plain_links(rows)
    assert sorted(ids(kept[2][1])) == sorted({w[1] for w in want}) and len(ids(kept[2][1])) == n_groups
    planned = {r.doc_id: r for r in q.source_mix.plan(kept[3][0]).collect()}
    times = defaultdict(int)
    for r in kept[3][1].collect():
        times[r.doc_id] += 1
        assert r.text == docs[r.doc_id][1]
    assert all(abs(times[i] - r.taken / r["size"]) <= 0.5 + 1e-9 for i, r in planned.items())
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(q.bpe.DEFAULT_VOCAB)
    last = kept[4][1].collect()
    assert len(last) == sum(times.values()) and all(r.ids == lib.encode(docs[r.doc_id][1], add_special_tokens=False).ids for r in last)
    assert sorted((r.doc_id, r.n_tokens) for r in p.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in last)
