"""Columns and types of the registered queries, and the pipeline's stages on awkward tables."""

import zlib

import pytest

import corpus_pipeline
from ocellus.llm import common, mixing, ngram_join, queries

L, D, S, B, I = "bigint", "double", "string", "boolean", "int"
COLUMNS = {
    "op1_ngram_join": dict(doc_id=L, n_shingles=L, component_id=L),
    "op2_license_scan": dict(doc_id=L, license=S),
    "op3_quality": dict(doc_id=L, held_out=B, score=D, predicted=I),
    "op4_secret_scan": dict(doc_id=L, n_assign=L, n_access=L, n_hex=L, base_sha256=S, spans=S),
    "op5_mix_sources": dict(doc_id=L, size=L, source_size=L, target=D, taken=L),
    "op6_lm_scores": dict(doc_id=L, held_out=B, n_tokens=L, n_known=L, train_tokens=L, base_score=D, score=D),
    "op7_exact_dedup": dict(doc_id=L, keep_id=L, group_size=L, kept=B, text_sha256=S),
    "op8_fingerprints": dict(doc_id=L, n_chars=L, edited_sha256=S, fingerprint=S, edited_fingerprint=S, near_edited=D, near_next=D),
    "op9_pack": dict(doc_id=L, start=L, length=L, ids_crc32=L, doc_tokens=L, sequence_id=L, offset=L),
    "op10_suffix_dedup": dict(doc_id=L, n_bytes=L, n_removed=L, n_spans=L, kept_sha256=S),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_queries(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    types = dict(got.dtypes)
    assert {k: types[k] for k in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted({r.doc_id for r in rows}) == ids and (name == "op9_pack" or len(rows) == len(ids))
    for r in rows:
        if name == "op3_quality":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        if name == "op6_lm_scores":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_fingerprints_of_near_texts_are_near(spark, sf):
    """An unchanged half keeps about the share of minima that the shingle sets have in common."""
    from ocellus.llm import minhash

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(text)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    off = []
    for r in minhash.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        t, u = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(t) // 2
        a, b = grams(t), grams(t[: len(t) - half] + u[:half])
        off.append(r.near_edited - len(a & b) / len(a | b))
    assert max(map(abs, off)) < 0.35 and abs(sum(off) / len(off)) < 0.03


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, row string, _gone long, _piece string, copy int"


@pytest.fixture(scope="module")
def awkward(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    texts = [(1, prose), (2, prose), (2, prose.replace("word40", "other")), (None, prose.upper()), (None, None), (3, ""), (4, "  "), (5, "x" * 200_000), (6, "é " * 3000), (6, "é " * 3000), (7, "short one")]
    return spark.createDataFrame([(i, t, None, None if k % 3 else f"s{k}", None, 1, "r", 2, "p", 3) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_awkward_tables(spark, sf, awkward, number):
    name, stage = corpus_pipeline.STAGES[number]
    for table in (awkward, awkward.filter("false")):
        out = stage(spark, table, sf)
        rows = out.collect()
        if table is not awkward:
            assert rows == []
        elif number < 4:
            assert out.columns == table.columns and rows
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "source mixing", "packing"]


def test_stages_remove_what_they_should(spark, sf, awkward):
    _, dedup = corpus_pipeline.STAGES[1]
    kept = dedup(spark, awkward, sf).collect()
    assert len(kept) == 7  # the prose in three rows, the edited one, blanks (null and empty are one), the others once each
    _, near = corpus_pipeline.STAGES[2]
    left = near(spark, awkward, sf).collect()
    assert sum((r.text or "").lower().startswith("word0") for r in left) == 1 and {r.doc_id for r in left} >= {3, 4, 5, 6, 7}


def test_pipeline_equals_its_operators_one_by_one(spark, sf):
    """The whole run against the stages applied by hand, with ids, sizes and texts checked by plain code."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = common.written(corpus_pipeline.STAGES[0][1](spark, docs, sf), keep=True).collect()
    by_text = {}
    for r in good:
        key = "".join(c.lower() if c.isascii() else c for c in r.text or "")
        by_text[key] = min(by_text.get(key, r.doc_id), r.doc_id)
    frame = common.written(docs.join(spark.createDataFrame([(i,) for i in by_text.values()], "doc_id long"), "doc_id", "left_semi"), keep=True)
    near = ngram_join.ngram_links(frame, 5, 8, 10)
    stay = common.written(frame.join(near.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi"), keep=True)
    mixed = {r.doc_id: r.taken for r in mixing.mixed(stay).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert set(tokens) == {i for i, n in mixed.items() if n}
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
