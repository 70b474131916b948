import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cellforge.llm import decontaminate, language, license_scan, pieces, pii, token_files, toxicity

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for bits in (0, 1, 5, 17, 60, 64):
            v = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(max(0, 63 - bits)) if bits else np.zeros(n, np.uint64)
            if bits == 64 and n:
                v[rng.integers(0, n, 3)] = np.uint64(2**64 - 1)
            words, sizes = token_files.pack(v)
            assert np.array_equal(token_files.unpack(words, sizes, n), v)
    words, _ = token_files.pack(np.arange(1280) % 8)
    assert len(words) <= 1280 / 20 + 10


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = token_files.decode(token_files.common.cut(token_files.encode(odd, BPE, segment_ids=100))).collect()
    assert len(got) == odd.count()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd.collect()), key=lambda x: x[:2])
    at = 0
    for r, (_, _, ids) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        assert r.ids == ids and (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    assert token_files.decode(token_files.common.cut(token_files.encode(none, BPE))).count() == 0
    # many rows of one doc_id have one order, whatever the partitions
    same = spark.createDataFrame([(1, f"text {i} <|endoftext|>") for i in range(200)], "doc_id long, text string")
    runs = [token_files.decode(token_files.common.cut(token_files.encode(same.repartition(n), BPE)), keep_ids=False).collect() for n in (2, 5)]
    assert sorted(runs[0]) == sorted(runs[1]) and max(r.start + r.n_tokens for r in runs[0]) == sum(len(library.encode(f"text {i} <|endoftext|>").ids) + 1 for i in range(200))


def test_parts_of_odd_texts_encode_alike():
    e = token_files.UnitEncoder(BPE)
    texts = ["a  b   c \n d", "\t x  \n\n  y '  's don't", "<|endoftext|> a<|endoftext|>", "a\0 b\0", "x\x1c y", "it's  we'll 12 34", "\x85 a", "a_b. é'é ª. x²", "Ünder,, (x) foo-bar.baz", "\na.\nb c\n", "a.\n\nb", "a\n\tb\nc"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def brute_base(text):
    plain = lambda p: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text)]
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", s, e) for s, e, _ in plain(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", s, e) for s, e, x in plain(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in x.split("."))]
    out += [("card", s, e) for s, e, x in plain(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(x)) <= 19 and pii.luhn(digits(x))]
    return out + [("phone", s, e) for s, e, x in plain(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(x)) <= 15]


def test_base_spans_against_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+-( )2%0") for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == brute_base(text)
    assert pii.base_spans("9" * 100_000 + "@" + "a" * 100_000) == []


def path_scores(model, e):
    """(score, tags) of all tag sequences of a chain between tokens that are O."""
    for tags in itertools.product(range(len(pii.TAGS)), repeat=len(e)):
        whole = (0, *tags, 0)
        yield sum(e[t, k] for t, k in enumerate(tags)) + sum(model.move[a, b] for a, b in itertools.pairwise(whole)), tags


def test_viterbi_and_cuts_against_enumeration():
    model = pii.fit()
    for text in ("call +1 (555)", 'token = "9f86d081884c7d659a2feaa0"', "Dear Anna Schmidt", "10.0.0.1 and 4111111111111111", "x"):
        words = text.split()
        e, starts = model.scores([words])
        own = e[starts[0] : starts[0] + len(words)]
        best = max(path_scores(model, own))
        for cut in (True, False):
            tags, at = model.decode([words], cut)
            assert tuple(tags[at[0] : at[0] + len(words)].tolist()) == best[1]


def test_learning_follows_the_likelihood():
    """At the optimum of the likelihood, a one-feature chain's tag odds are those of the table."""
    table = [((f"{'a' * (1 + i % 2)}", "B-name" if i % 10 < 3 else "O"),) for i in range(100)]
    model = pii.fit(table, rounds=600, ridge=0.0, move_ridge=0.0)
    for word, share in (("a", 0.2), ("aa", 0.4)):
        e, starts = model.scores([[word]])
        weights = np.exp([s for s, _ in path_scores(model, e[starts[0] : starts[0] + 1])])
        both = weights[pii.TAGS.index("B-name")] / weights.sum()
        assert abs(both - 0.3) < 0.03 and share  # both words have the same features, so the table's odds as a whole


def test_chain_on_held_out_rows_and_whole_texts(spark, odd, none):
    model = pii.fit()
    table = pii.training_table(3, seed=99)
    tags, starts = model.decode([[w for w, _ in row] for row in table])
    right = sum(pii.TAGS[tags[s + i]] == y for s, row in zip(starts, table, strict=True) for i, (_, y) in enumerate(row))
    assert right / sum(len(row) for row in table) > 0.97
    text = 'call (509) 555-6973 or mail joe.1@mail.example.com, not 4111111111111112.\nMy name is Clara Brown and token = "91ab85687d33eeaaf9ac699e1188f962" so 2353820953013749 4550997810720808'
    (spans,) = pii.find_spans(model, [text])
    assert [(k, text[s:e], b) for k, s, e, b in spans] == [
        ("email", "joe.1@mail.example.com", True), ("card", "4550997810720808", False), ("phone", "(509) 555-6973", False), ("secret", "91ab85687d33eeaaf9ac699e1188f962", False), ("name", "Clara Brown", False),
    ]
    assert [r.spans for r in pii.detect(odd, model).where("doc_id < 3").collect()] == [[], []]
    clash = pii.detect(odd.withColumn("spans", F.lit("mine")), model)
    assert dict(clash.dtypes)["spans"].startswith("array") and clash.count() == odd.count()
    docs = spark.createDataFrame([(1, text, len(text)), (2, None, 0)], "doc_id long, text string, n_chars long")
    (one, two) = pii.redact(docs, model).orderBy("doc_id").collect()
    assert one.text.startswith("call [PHONE] or mail [EMAIL], not 4111111111111112.\nMy name is [NAME] and token = \"[SECRET]\"") and one.n_chars == len(one.text) and two.text is None
    assert pii.redact(odd, model).columns == odd.columns and pii.detect(none, model).count() == 0


def brute_containment(text, item, k=5):
    words = lambda t: re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", t).split()
    w = words(item)
    n = min(k, len(w))
    grams = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
    return len(grams(w) & grams(words(text))) / len(grams(w)) if w else 0


def test_decontamination_against_brute_force(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 8, 12, 20, 33, 57, 90])] + [(50, None), (51, ""), (52, "...")]
    texts = []
    for _, item in items[:8]:
        w = item.split()
        for edits in range(3):
            own = list(w)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join([*(word() for _ in range(rng.randrange(900))), *own, *(word() for _ in range(rng.randrange(900)))]))
    texts += [items[4][1].upper().replace(" ", ", "), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i, round(c, 9)) for d, t in enumerate(texts) for i, x in items[:8] if (c := brute_containment(t or "", x)) >= 0.8}
    for block in (20_000, 3):
        got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in decontaminate.find(docs, bench, block=block).collect()}
        assert got == want and len(want) >= 9
        left = {r.doc_id for r in decontaminate.clean(docs, bench, block=block).collect()}
        assert left == set(range(len(texts))) - {d for d, _, _ in want}
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.clean(none, bench).count() == 0
    assert decontaminate.find(docs, bench.where("item_id > 99")).count() == 0


def test_licenses(spark, odd, none):
    rows = [(1, "foo\nLicensed under CC BY-NC 4.0.\nbar"), (2, "Licensed under CC BY 4.0."), (3, "license plates under the released hood"), (4, None), (5, "x. Released under the MIT License. y"), (5, "x. Released under the MIT License. y")]
    rows.append((6, "y " * 10_000 + "This work is licensed under the GNU General Public License, version 3." + " z" * 10_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.missing_words) for r in license_scan.scan(docs).where("doc_id < 6").collect())
    assert got == [(1, "CC-BY-NC-4.0-line", 0), (2, "CC-BY-4.0-line", 0), (5, "MIT-line", 0), (5, "MIT-line", 0)]
    (one,) = license_scan.scan(docs).where("doc_id = 1").collect()
    assert rows[0][1][one.start : one.end] == "Licensed under CC BY-NC 4.0."
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0


def test_sampled_segmentations(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.sample(odd, MODEL, k=3).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.n_ids), r)
        assert r.decoded and r.log_inclusion <= 0
    texts = dict(odd.select("doc_id", "text").collect())
    for r in rows:
        if r.doc_id is not None and texts[r.doc_id]:
            assert sp.decode(r.ids) == texts[r.doc_id]
    assert len({tuple(r.ids) for r in rows if r.doc_id == 5}) == 3
    assert [r.n_ids for r in rows if r.doc_id in (1, 2)] == [0, 0]
    back = pieces.decode(pieces.sample(odd, MODEL, k=1).select("doc_id", "ids", F.lit(7).alias("TEXT")), MODEL)
    assert back.dtypes == [("doc_id", "bigint"), ("ids", "array<int>"), ("text", "string")]
    assert {r.text for r in back.where("doc_id = 7").collect()} == {texts[7]}
    assert pieces.sample(none, MODEL).count() == 0


def test_samples_follow_the_lattice():
    vocabulary = pieces.Vocabulary(MODEL, temperature=20000.0)
    n = 4000
    out = pieces.Lattices(vocabulary, ["the"] * n).sample(2, list(range(1, n + 1)))
    first = [tuple(s[0][0].tolist()) for s in out]
    odds = {tuple(a.tolist()): np.exp(w) for s in out for a, w, _, _ in s}
    for path, p in odds.items():
        assert abs(first.count(path) / n - p) < 0.04
    # inverse inclusion scores count each segmentation once
    total = sum(np.exp(-q) for s in out for a, _, _, q in s if odds[tuple(a.tolist())] > 0.05)
    assert abs(total / n - sum(p > 0.05 for p in odds.values())) < 0.1


def brute_paths(vocabulary, text):
    """All segmentations of a text into pieces and bytes: ids and weights."""
    unit = pieces.SPACE + text.replace(" ", pieces.SPACE)

    def rest(i):
        if i == len(unit):
            yield (), 0.0
        for j in range(i + 1, len(unit) + 1):
            k = vocabulary.pieces.get(unit[i:j])
            if k is not None:
                for ids, w in rest(j):
                    yield (k, *ids), vocabulary.weights[k] + w
            elif j == i + 1:
                own = [int(vocabulary.bytes[x]) for x in unit[i].encode()]
                for ids, w in rest(j):
                    yield (*own, *ids), len(own) * vocabulary.byte_weight + w

    return dict(rest(0))


def test_samples_against_all_segmentations():
    vocabulary = pieces.Vocabulary(MODEL, temperature=20000.0, limit=50)
    for text in ("a b", "thé, x", "the\nox", "☃ 1"):
        want = brute_paths(vocabulary, text)
        norm = np.logaddexp.reduce(list(want.values()))
        lattices = pieces.Lattices(vocabulary, [text, "other", text])
        got = lattices.sample(len(want) + 5, [1, 2, 3])
        for own in (got[0], got[2]):
            ids = [tuple(lattices.piece_ids(a).tolist()) for a, _, _, _ in own]
            assert sorted(ids) == sorted(want)  # each once, and all of them
            assert np.allclose([w for _, w, _, _ in own], [want[i] - norm for i in ids], atol=1e-9)
            g = [x for _, _, x, _ in own]
            assert g == sorted(g, reverse=True) and all(q == 0 for _, _, _, q in own)
        # the k best of perturbed ones, and their scores given the next one's
        some = lattices.sample(2, [1, 2, 3])
        for few, all_ in ((some[0], got[0]), (some[2], got[2])):
            assert [a.tolist() for a, _, _, _ in few] == [a.tolist() for a, _, _, _ in all_[:2]]
            left = all_[2][2] if len(all_) > 2 else -np.inf
            assert np.allclose([q for _, _, _, q in few], [pieces._log_inclusion(w - left) for _, w, _, _ in few])


def toxic_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["zorgul", "zorgulix", "vrakta", "idiot"])
        rows.append((i, " ".join(words) + ".", int(bad)))
    return rows


def test_toxicity_learns_and_holds_out(spark, odd, none):
    rows = toxic_rows()
    learn = spark.createDataFrame([(t, y, i) for i, t, y in rows[:400]], "text string, label int, key long")
    lexicon = toxicity.fit(learn)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[400:]], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    for i, _, y in rows[400:]:
        assert (got[i] >= 0.7) == bool(y)
    scored = toxicity.score(odd, lexicon)  # it has a column score of its own
    assert scored.columns == [*(c for c in odd.columns if c != "score"), "score"]
    assert scored.count() == odd.count() and scored.where("score >= 0.5 or score is null").count() == 0
    assert toxicity.score(none, lexicon).count() == 0
    assert toxicity.fit(learn.where("label = 0")).words == toxicity.Lexicon().words


def test_grammar_scores_clauses():
    x = toxicity.Lexicon()
    plain = x.clause("what an idiot".split())
    assert x.clause("not an idiot".split()) < plain < x.clause("you idiot".split())
    assert x.clause("she said what an idiot".split()) < x.clause("she thinks what an idiot".split())
    assert x.clause("we kill time".split()) == 0 < x.clause("you will be hurt by them i will kill you".split())
    assert x.clauses("you idiot. fine day") and not x.clauses("a fine day")
    assert x.clauses("du bist kein trottel") < x.clauses("du bist ein trottel") and x.clauses("you're an idiot") == x.clauses("youre an idiot")
    assert x.clauses("l'idiot") == x.clauses("l idiot") and x.clauses("id'iot") == []


def brute_marks(kinds):
    """Each word's marks by the grammar's rules, read off the sentence as a whole."""
    out, verbs = [set() for _ in kinds], []
    last = lambda i, kind, span: any(kinds[j] == kind for j in range(max(0, i - span), i))
    begun = 0  # a threat at a verb or a target uses up what came before it
    for i, k in enumerate(kinds):
        if k == "insult":
            out[i].add("insult")
            if i and kinds[i - 1] == "degree":
                out[i].add("stressed")
            if i and kinds[i - 1] == "insult":
                out[i].add("chained")
        reach = lambda kind, span: any(kinds[j] == kind for j in range(max(begun, i - span), i))  # noqa: E731, B023
        if k == "threat" and reach("intent", 3):
            if reach("target", 6):
                out[i].add("struck")
                verbs = []
            else:
                verbs = [i]
            begun = i + 1
        if k == "target":
            if any(i - v <= 3 for v in verbs):
                out[i].add("struck")
            verbs = []
    for i in range(len(kinds)):
        if out[i] & toxicity.ACCEPTED:
            out[i] |= {m for kind, span, m in (("negation", 3, "negated"), ("report", 8, "reported"), ("target", 6, "targeted")) if last(i, kind, span)}
    return out


def test_composed_machines_against_the_rules():
    rng = random.Random(1)
    for _ in range(3000):
        kinds = [rng.choice(["other", "insult", *toxicity.KINDS]) for _ in range(rng.randrange(1, 14))]
        state, got = toxicity.FORWARD.start, []
        for k in kinds:
            state, marks = toxicity.FORWARD(state, k)
            got.append(set(marks))
        assert got == brute_marks(kinds), kinds


def test_language(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(v) for _ in range(8)), lang) for i, (lang, v) in enumerate([("en", ["the", "house", "with", "green", "window"]), ("de", ["das", "haus", "mit", "grünem", "fenster"])] * 60)]
    model = language.fit(spark.createDataFrame([(t, lang, i) for i, t, lang in rows], "text string, lang string, key long"))
    scorer = language.Scorer(model)
    assert scorer("the green window")[0] == "en" and scorer("mit dem hausfenster")[0] == "de"
    assert all(scorer(t) == ("und", 0.0) for t in ("²", "½ Ⅷ", "_ 3", "\u0301"))
    assert scorer("the²green")[0] == "en" and language.words_of("ab²c d_e") == ["ab", "c", "d", "e"]
    assert scorer("winndow housse")[0] == "en" and scorer(None) == scorer("") == scorer("12 ?!") == ("und", 0.0)
    got = language.predict(odd, model)
    assert got.count() == odd.count() and {r.lang_pred for r in got.where("doc_id < 3").collect()} == {"und"}
    assert language.predict(none, model).count() == 0
    empty = language.fit(spark.createDataFrame([], "text string, lang string, key long"))
    assert language.Scorer(empty)("some words") == ("und", 0.0)
