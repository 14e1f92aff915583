import hashlib
import random

import pytest

from postmatch.llm import pieces
from tests.llm import odd_tables as samples

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.PieceModel(PATH)


def test_random_strings_code_as_the_library_does(lib, own):
    rng = random.Random(1)
    units = ["a", "b", "é", " ", "  ", "   ", "\n", "\t", "▁", "▁▁", "the", "梦", "𝒳", "́", "1", "00", "==",
             "--", "\x00", "th", "in", "tion", "'s", "    " * 3, "</s>", "<0x41>"]
    for _ in range(6000):
        text = "".join(rng.choice(units) for _ in range(rng.randrange(1, 14)))
        ids = lib.encode(text, add_eos=True)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == lib.decode(ids), repr(text)


def test_runs_of_spaces(lib, own):
    for n in range(1, 70):
        for text in (" " * n, "a" + " " * n, " " * n + "b", " " * n + "\n"):
            assert own.encode(text) == lib.encode(text, add_eos=True)


def test_any_ids_decode_as_the_library_does(lib, own):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(0, 700) for _ in range(rng.randrange(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_forgetting_changes_nothing(lib, own, monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    for text in samples.texts():
        assert own.encode(text) == lib.encode(text, add_eos=True)


def test_documents(spark, lib):
    got = pieces.encode_digests(samples.documents(spark), PATH, with_ids=True).collect()
    want = []
    for row in samples.rows():
        ids = lib.encode(row[1] or "", add_eos=True)
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids).encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    plain = {r.doc_id: r for r in pieces.encode_documents(samples.documents(spark), PATH).collect()}
    assert plain[0].decoded == lib.decode(plain[0].ids) == samples.rows()[0][1]


def test_empty_table(spark):
    assert pieces.encode_digests(samples.empty(spark), PATH).count() == 0
