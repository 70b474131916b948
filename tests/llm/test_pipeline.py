import os
import re

import public_tokenizers
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from cellforge.llm import common, pieces, pii, queries, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages_keep_columns_and_take_effect(spark, odd):
    docs = common.table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF), name)
        assert docs.columns == common.DOC_COLUMNS
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[4] == sizes[3] <= sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("not decoded").count() == 0 and last.select("doc_id").distinct().count() == sizes[4]
    rows = odd.select(common.DOC_COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        rows = common.cut(stage(spark, rows, SF), "odd")
    assert {r.doc_id for r in rows.collect()} == {1, 3, 4, 6, 7, 8, None}


def test_rows_that_repeat_a_doc_id(spark):
    """Rows stay or go by their own text: a text that is a copy of nothing stays whatever else has its doc_id."""
    a, b, c = "one text about a river and its many stones", "another text on the price of bread in towns", "a third one of clouds above the northern sea"
    rows = [(2, b, "x"), (4, a, "x"), (4, b, "x"), (5, c, "y"), (5, c, "y"), (5, c, "z"), (None, a, "x"), (None, "no id " + c * 3, "x"), (None, "no id " + c * 3, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text, r.source) for r in got.collect())) == sorted([(2, b, "x"), (4, a, "x"), (5, c, "y"), (0, "no id " + c * 3, "x")])


def brute_near_copies(rows):
    """Smallest doc_id of each group of fingerprints within three bits."""
    fp = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}


def test_run_against_brute_force(spark):
    """Every stage redone row by row, by the operators' models but none of their plans."""
    docs = {r.doc_id: r for r in common.table(spark, SF, "documents").collect()}
    lexicon = toxicity.fit_tables(spark, SF)
    left = sorted((i, r.text) for i, r in docs.items() if lexicon.score(r.text) < 0.7)
    keep = brute_near_copies(left)
    left = [(i, t) for i, t in left if i in keep]
    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    words = lambda t: re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", t or "").split()
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = [grams(w, min(5, len(w))) for w in map(words, items) if w]
    own = {i: {n: grams(words(t), n) for n in {len(next(iter(g))) for g in wanted}} for i, t in left}
    left = [(i, t) for i, t in left if not any(len(g & own[i][len(next(iter(g)))]) >= 0.8 * len(g) for g in wanted)]
    chain = pii.fit()
    for n, (i, t) in enumerate(left):
        out, done = "", 0
        for kind, s, e, _ in sorted(pii.find_spans(chain, [t])[0], key=lambda x: (x[1], -x[2])):
            if s >= done:
                out += (t or "")[done:s] + f"[{kind.upper()}]"
            done = max(done, e)
        left[n] = i, out + (t or "")[done:]
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, t in left:
        lattices = pieces.Lattices(vocabulary, [t])
        for r, (arcs, _, _, _) in enumerate(lattices.sample(2, [xxhash.xxh64_intdigest(f"5:{i}:".encode() + t.encode())])[0]):
            want.add((i, r, tuple(lattices.piece_ids(arcs).tolist())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.sample, tuple(r.ids)) for r in got} == want and len(got) == len(want) and all(r.decoded for r in got)


def test_registry():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
