"""Words of texts with doubled spaces, line ends or no spaces are merged once."""

import public_tokenizers
from tokenizers import Tokenizer

from voltaflow.llm import bpe


def test_words_of_irregular_texts_are_merged_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        own = bpe.ByteBpe(f.read())
    texts = [" a  b qwzzyx\n\tc qwzzyx  d \n", "  ", "x ", " \n y", "qwzzyx  e qwzzyx  f g\x85 h ", "a\x1c b \x1fc  d", "e 　 f  ", "x\n\n y  z\n "]
    reference = Tokenizer.from_file(path)
    reference.no_truncation()
    reference.no_padding()
    for _ in range(2):
        for t in texts:
            assert bpe.np.frombuffer(own.encode(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)
    merged = []
    own.merge, merge = lambda raw: merged.append(raw) or merge(raw), own.merge
    for _ in range(3):
        own.encode("one  two uvwqq uvwqq\n three uvwqq  four ")
    assert merged.count(b" uvwqq") == 1
