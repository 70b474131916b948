import random

from cellforge.llm import decontaminate


def test_short_items_and_repeated_words_are_never_lost():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 7)))) for i in range(600)] + [(600, "ding " * 100)]
    indexes = [decontaminate.Index(items), decontaminate.Index(items, hashes=1)]  # whatever the hashes draw
    texts, want = [], []
    for at in range(0, len(items), 10):
        some = items[at : at + 10]
        texts.append(" ".join(" ".join([*(word() for _ in range(40)), x]) for _, x in some))
        want.append([(i, 1.0) for i, _ in some])
    for index in indexes:
        assert index.matches(texts) == want
