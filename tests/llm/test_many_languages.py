from cellforge.llm import language


def test_more_than_a_thousand_languages(spark):
    letters = "abcdefghijk"
    words = [a + b + c for a in letters for b in letters for c in letters][:1010]
    rows = [(w, f"x-{w}", i) for i, w in enumerate(words)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string, key long"))
    assert model.langs == sorted(f"x-{w}" for w in words)
    scorer = language.Scorer(model, limit=2000)
    assert all(scorer(w)[0] == f"x-{w}" for w in words[-20:])
