import numpy as np
import public_tokenizers

from cellforge.llm import pieces


def test_a_unit_of_over_a_million_characters():
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text = "漢字かな\U00020000" * ((1 << 20) // 5 + 1)
    lattices = pieces.Lattices(vocabulary, [text, "a b"])
    assert len(lattices.docs[0]) == 1 and lattices.ids.min() == -1 - 0x20000
    assert int(lattices.end[: lattices.first[lattices.stop[0]]].max()) == len(text) + 1
    (((arcs, log, _, _),), _) = lattices.sample(1, [1, 2])
    assert np.isfinite(log) and vocabulary.decode(lattices.piece_ids(arcs)) == text
