import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cellforge.llm import common, embedding, simhash, suffix_array


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_and_components(spark, odd, none):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in range(120):
        own = rng.choices(words, k=rng.randrange(5, 200))
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join(own)))
            own[rng.randrange(len(own))] = rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fp = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert got == {i: (int(f), int(c)) for i, (f, c) in enumerate(zip(fp, common.local_labels(len(fp), a, b), strict=True))}
    # tiles and salts give the same links
    own = fp.view(np.int64).tolist()
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(own) if own.index(f) == i], "fp long, rep long")
    small = {r.node: r.component for r in common.components(simhash.links(classes, group=8, tile=4)).collect()}
    whole = {r.node: r.component for r in common.components(simhash.links(classes)).collect()}
    assert small == whole
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {r.component_id for r in out if r.doc_id in (1, 2)} == {1} and {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and {got[i] for i in range(101, 160)} == {100} and got[300] == 200
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 32))
    near = base[:40, None] + rng.standard_normal((40, 5, 32)) * np.linspace(0.02, 0.35, 5)[None, :, None]
    x = np.concatenate([base, near.reshape(-1, 32), base[:10], 3 * base[:5]]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    extra = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [None] * 32, 1), (904, [float("nan")] * 32, 1), (905, [float("inf")] * 32, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1e-200, 2e-200], 1)]
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, n_links int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum()
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert [got[i].n_links for i in (906, 907, 908)] == [2, 2, 2] and got[908].component_id == 906
    tiles = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), tile=3)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in tiles.collect()) == sorted((i, got[i].n_links, got[i].component_id) for i in range(len(x)))
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_links_at_the_threshold(spark):
    """20,000 vectors, as op3's query takes them, a tenth in pairs of cosine 0.90 to 0.92: every link by brute force."""
    rng = np.random.default_rng(8)
    n, dim = 20_000, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 2000, 2):
        other = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        c = rng.uniform(0.9005, 0.92)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    x = (x * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.array([r.n_links for r in embedding.near_duplicates(table).orderBy("vec_id").collect()])
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 2000] @ u.T >= 0.9).sum(axis=1) - 1 for i in range(0, n, 2000)])
    assert want.sum() >= 2000 and (got <= want).all() and got.sum() >= 0.98 * want.sum()


def test_links_equal_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(9)
    base = rng.standard_normal((30, 8))
    x = [(base[i % 30] + 0.2 * rng.standard_normal(8)).tolist() for i in range(90)]
    rows = [(i, v) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, x[3]), (205, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.op3_embedding(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(embedding.ORACLE_SQL).fetchall()) and sum(r[1] for r in got) > 50


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(50))] + [-1]
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_anchors_of_one_hash_are_told_apart_by_their_bytes():
    """Contexts that meet by hash alone share no string, though the rest of them is the same."""
    one, two = b"left" + b"A" * 10 + b"right-hand", b"left" + b"B" * 10 + b"right-hand"
    for alone in (True, False):
        ranges, _ = suffix_array.tile_starts([(one, 4, 5), (two, 4, 5)], 20, alone)
        assert ranges == []
    ranges, strings = suffix_array.tile_starts([(one, 4, 5), (b"some" + one[4:], 4, 5), (two, 4, 5)], 20, False)
    # of the starts 0 to 4, only the last one's string, anchor first, is in both
    assert sorted(ranges) == [(0, 4, 4), (1, 4, 4)] and len(strings) == 5 + 4 + 5 and sum(once for _, _, once in strings) == 4 + 4 + 5


def brute_repeats(texts, length):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), sum(bool(x) for x in bytes(gone).split(b"\0")), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("cap", [512, 3])
def test_repeats_against_brute_force(spark, odd, none, monkeypatch, cap):
    monkeypatch.setattr(suffix_array, "TILE_CONTEXTS", cap)
    rng = random.Random(cap)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(rng.randrange(30, 120)) for _ in range(12)]
    texts = ["".join(noise(rng.randrange(50)) + rng.choice(shared)[rng.randrange(6) :] for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [texts[0], texts[0][:-1] + "x", "ab" * 150, "a" * 300, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.remove_repeats(docs, 40).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 40)))
    out = suffix_array.remove_repeats(odd).collect()
    assert len(out) == odd.count() and {r.n_removed for r in out if r.doc_id == 6} == {5000} and {r.n_bytes for r in out if r.doc_id in (1, 2)} == {0}
    assert suffix_array.remove_repeats(none).count() == 0


def test_many_near_copies_are_sorted_as_few_ranges(spark, monkeypatch):
    """One text with an edit of a byte here and there: rows made by sorting follow the contexts, not their strings."""
    monkeypatch.setattr(suffix_array, "TILE_CONTEXTS", 8)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = [base]
    for _ in range(150):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("ABCDEFGHIJ") + base[at + rng.randrange(2) :])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, cut = Counter(), common.cut

    def counted(df, label="cut"):
        out = cut(df, label)
        made[label] += out.count()
        return out

    monkeypatch.setattr(common, "cut", counted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))
    assert made["sorted"] <= 4 * made["contexts"], made
