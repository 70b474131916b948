import numpy as np
import public_tokenizers
import pytest

from cellforge.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_full_arrays_keep_the_units_met_most_often():
    vocabulary = pieces.Vocabulary(MODEL, limit=400)
    added, add = [], vocabulary._add
    vocabulary._add = lambda new: (added.extend(new), add(new))
    texts = [f"often, word{i} often  漢{chr(0x4E00 + i)}\nseldom{chr(97 + i % 26) * (i // 26 + 1)} often" for i in range(200)]
    for i, text in enumerate(texts):
        lattices = pieces.Lattices(vocabulary, [text, ""])
        alone = pieces.Vocabulary(MODEL) if i % 20 == 0 else None
        for (arcs, *scores), other in zip(lattices.sample(2, [i, 0])[0], pieces.Lattices(alone, [text, ""]).sample(2, [i, 0])[0] if alone else [None] * 2):
            assert vocabulary.decode(lattices.piece_ids(arcs)) == text
            if alone:
                assert scores == pytest.approx(other[1:])
                assert np.array_equal(lattices.piece_ids(arcs), pieces.Lattices(alone, [text, ""]).piece_ids(other[0]))
    assert added.count("▁often") == 1 and added.count(",") == 1
    assert len(vocabulary.places) < len(set(added)) / 2


def test_ids_of_many_paths_end_where_each_path_does():
    vocabulary = pieces.Vocabulary(MODEL)
    texts = ["\U00020000a é", "", "plain words", "▁ mark", "漢\u0001字"]
    lattices = pieces.Lattices(vocabulary, texts)
    paths = [found[0][0] for found in lattices.sample(1, list(range(5)))]
    ids, ends = lattices.all_piece_ids(paths)
    for path, own in zip(paths, np.split(ids, ends[:-1]), strict=True):
        assert np.array_equal(own, lattices.piece_ids(path))
    assert vocabulary.gives(ids, ends, texts) == [True, True, True, False, True]
    assert vocabulary.gives(ids, ends, ["other"] * 5) == [False] * 5
