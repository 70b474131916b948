import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cellforge.llm import token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_special_tokens_are_one_id():
    texts = ["<|endoftext|>", "a b <|endoftext|> c", "x<|endoftext|><|endoftext|>\n\ny  z <|endoftext", "don't<|endoftext|>'s  <|endoftext|> ", "plain text"]
    want = [Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.UnitEncoder(BPE).encode(texts)]
    assert got == want and got[0] == [50256]
