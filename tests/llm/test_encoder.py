"""Both splitting rules of the token store's encoder against the library."""

import random

import pytest

from stumpwright.llm import token_store

public_tokenizers = pytest.importorskip("public_tokenizers")

LATIN = [*"aZ é ß\xaa\xb5\xd7\xf7\xa0\xad\xff 09²¾ '.,-_\"\n\t\r", "'s", "'re", "'ll", "'v", "  ", " \n", "\r\n"]


@pytest.mark.parametrize("signs, rule", [(LATIN, "_LATIN_PIECE"), ([*LATIN, "ā", "œ", "ɏ"], "_PIECE"), ([*LATIN, "\x85", "\x1c", "\x0b", "\x00", "\x7f", "語"], None)])
def test_pieces_are_the_librarys(signs, rule):
    rng = random.Random(7)
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) + (signs[-1] if rule != "_LATIN_PIECE" else "") for _ in range(2000)]
    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert e.encode(texts) == [e._whole(t) + e.end for t in texts]
    if rule:
        seen = set()
        e.known = type("Seen", (), {"__getitem__": lambda self, p: seen.add(p) or b""})()
        e.encode(texts)
        assert seen == {p for t in texts for p in getattr(token_store, rule).findall(t)}
