"""Every registered query on the driver's smallest tables, held against its contract row by row."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from cellforge.llm import common, decontaminate, language, license_scan, pieces, pii, queries
from tests.llm.test_near_copies import brute_fingerprint, brute_repeats
from tests.llm.test_text import brute_base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").orderBy("doc_id").collect()


def run(spark, name):
    return queries.queries()[name](spark, SF)


def test_op1(spark, docs):
    frame = run(spark, "op1_toxicity")
    assert frame.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in frame.collect()}
    assert set(rows) == {d.doc_id for d in docs}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op1_on_held_out_rows(spark):
    """A larger table: half the toxic rows at least are caught, and one clean row in fifty at most taken for one."""
    larger = "/root/testdata/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("the driver's tables aren't here")
    labels = common.table(spark, larger, "labels").select("doc_id", "toxic")
    rows = queries.queries()["op1_toxicity"](spark, larger).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert np.mean(caught) >= 0.5 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.02


def test_op2(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op2_pii").collect()}
    assert len(rows) == len(docs)
    for d in docs:
        base = brute_base(d.text or "")
        text = [f"{k}:{s}:{e}" for k, s, e in base]
        r = rows[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert set(text) <= set(own) and len(own) == len(text) + r.n_added
        places = [(pii.ALL_KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in own)]
        assert places == sorted(places)


def test_op4(spark, docs):
    """The scanner over whole texts, without triggers or blocks, finds the same notices."""
    scanner = license_scan._scanner(tuple(sorted(license_scan.TEMPLATES.items())))
    want = sorted((d.doc_id, s, e, name) for d in docs if d.text and len(d.text) < 20_000 for s, e, name, _, _ in scanner.scan(d.text))
    short = {d.doc_id for d in docs if d.text and len(d.text) < 20_000}
    got = sorted((r.doc_id, r.start, r.end, r.license) for r in run(spark, "op4_license").collect() if r.doc_id in short)
    assert got == want and got


def test_op5(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = pieces.Vocabulary(path)
    want = {}
    for d in docs:
        text = d.text or ""
        lattices = pieces.Lattices(vocabulary, [text])
        for r, (arcs, w, g, q) in enumerate(lattices.sample(2, [xxhash.xxh64_intdigest(f"5:{d.doc_id}:".encode() + text.encode())])[0]):
            ids = lattices.piece_ids(arcs)
            want[d.doc_id, r] = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), pytest.approx(w), pytest.approx(g), pytest.approx(q))
    got = {(r.doc_id, r.sample): r for r in run(spark, "op5_pieces").collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.decoded and (r.n_ids, r.ids_crc32, r.log_prob, r.perturbed, r.log_inclusion) == want[k]
    pairs = {}
    for (i, _), r in got.items():
        pairs.setdefault(i, []).append(r.ids_crc32)
    assert all(len(set(x)) == len(x) for x in pairs.values())  # distinct segmentations


def test_op5_returns_the_segmentations(spark, docs):
    """The ids themselves, which give the text again and have the given count and checksum."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {d.doc_id: d.text or "" for d in docs}
    rows = run(spark, "op5_pieces").collect()
    for r in rows:
        assert sp.decode(r.ids) == texts[r.doc_id]
        assert (r.n_ids, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    assert {r.doc_id for r in rows} == set(texts)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), run(spark, name)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
    assert decontaminate.ORACLE_SQL in queries.oracle_sql().values()


def test_op7(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op7_simhash").collect()}
    fp = np.array([brute_fingerprint(d.text) for d in docs], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    root = common.local_labels(len(fp), a, b)
    assert got == {d.doc_id: (f"{int(f):016x}", docs[int(r)].doc_id) for d, f, r in zip(docs, fp, root, strict=True)}


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op8_token_files").collect()}
    at, want = 0, {}
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        want[d.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_op9(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op9_language").collect()}
    assert set(rows) == {d.doc_id for d in docs}
    learned = {d.lang for d in docs if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 5}
    right = []
    for d in docs:
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in (learned if language.words_of(d.text) else {"und"})
        right += [r.lang_pred == d.lang] if r.held_out and d.lang and language.words_of(d.text) else []
    assert np.mean(right) > 0.9


def test_op10(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op10_suffix_array").collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, brute_repeats([d.text for d in docs], 200), strict=True)}
