import numpy as np
import public_tokenizers

from cellforge.llm import token_files


class Counted(str):
    looks = 0

    def __contains__(self, part):
        type(self).looks += 1
        return str.__contains__(self, part)


def test_ascii_texts_are_looked_through_for_ascii_white_space_alone():
    encoder = token_files.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.parts(Counted("two lines,\nof words")) == ["two", " lines,", "\n", "of", " words"]
    assert Counted.looks <= 20


def test_words_with_room_beyond_their_block():
    rng = np.random.default_rng(3)
    for top in (2, 200, 50_000, 1 << 16, 1 << 20, 1 << 58):
        for n in (1, 127, 128, 129, 1000):
            ids = rng.integers(0, top, n).astype(np.uint64) * (rng.random(n) < 0.7).astype(np.uint64)
            assert np.array_equal(token_files.unpack(*token_files.pack(ids), n), ids)
