import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm.packing import UnitEncoder, hashed_vectors, hilbert_keys, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_units_encode_as_the_tokenizer_does(tokenizer):
    encoder, rng = UnitEncoder(PATH, public_tokenizers.PATTERN), random.Random(1)
    pieces = [*"ab1 .\n\t  \r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u200b\u2028\u3000\u00e9\u6f22'!s", "<|endoftext|>", " <|endoftext|>", "'ll", "word ", " word"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_a_text_is_encoded_in_one_call(tokenizer):
    encoder, calls = UnitEncoder(PATH, public_tokenizers.PATTERN), []
    fast = encoder.fast.encode_ordinary
    encoder.fast.encode_ordinary = lambda text: calls.append(text) or fast(text)
    text = " ".join(f"word{k}" for k in range(1000))
    assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert calls == [text]


def test_a_long_run_of_white_space_ends(tokenizer):
    text = "a" + " " * 1_200_000 + "b"
    assert UnitEncoder(PATH, public_tokenizers.PATTERN).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("partitions", [1, 5])
def test_round_trip(docs, rows, no_docs, tokenizer, partitions):
    pieces = pack(docs, partitions=partitions).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert pack(no_docs).count() == 0


def test_hilbert_keys_walk_to_neighbours():
    """Along the whole curve of 2 dimensions and 3 levels each step changes one coordinate by one."""
    side = np.arctanh(np.clip((np.arange(8) / 7) * 2 - 1, -0.999999, 0.999999)) / 4
    points = np.array([(x, y) for x in side for y in side])
    keys = hilbert_keys(points, bits=3)
    assert sorted(keys) == list(range(64))
    cells = np.array([(x, y) for x in range(8) for y in range(8)])[np.argsort(keys)]
    assert (np.abs(np.diff(cells, axis=0)).sum(axis=1) == 1).all()


def test_like_texts_have_like_vectors():
    a, b, c = hashed_vectors([b"the cat sat on the mat " * 20, b"the cat sat on the mat " * 19 + b"dog", bytes(range(65, 91)) * 20])
    assert np.abs(a - b).sum() < np.abs(a - c).sum()
    assert not hashed_vectors([b"", b"abc"]).any()


def test_tokenizer_is_loaded_only_for_texts_that_ask_for_it():
    encoder = UnitEncoder(PATH, public_tokenizers.PATTERN)
    encoder.encode("The garden of the old house, twice.")
    assert "tokenizer" not in vars(encoder)
    encoder.encode(f"a {encoder.specials[0]} b")
    assert "tokenizer" in vars(encoder)
