"""The transducer gives the ids of the tokenizers library, also through small windows and pieces."""

import random

import pytest

from arbora.llm import bpe
from arbora.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
LETTERS = "aabbcdeéΣσςİıßẞ  \t\n'stlmrve123,.!?<|>ñ̃é漢字ﬁ　\x1c\x85​😀ͅǅK"


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path()
    return bpe.Vocabulary(path), tokenizers.Tokenizer.from_file(path)


def texts():
    rng = random.Random(4)
    out = [None, "", "   ", "I'm it's we'll", "<|startoftext|>hi<|endoftext|>", "<|endoftext|><|endoftext|> x <|start", "Σας ΟΔΟΣ", "e" + "́" * 50]
    out += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 80))) for _ in range(500)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "ha" * 5000 + "!" * 3000, "word " * 30000]
    return out


def same(vocabulary, library):
    for t in texts():
        ids = [i for part in vocabulary.encode(t) for i in part]
        expected = library.encode(t or "", add_special_tokens=False).ids
        assert ids == expected, (t or "")[:60]
        decoder = bpe.Decoder(vocabulary)
        assert "".join(decoder.feed([i]) for i in ids) == library.decode(expected, skip_special_tokens=False)


def test_ids_and_texts(both):
    same(*both)


def test_small_windows_and_pieces(both, monkeypatch):
    vocabulary, library = both
    monkeypatch.setattr(bpe, "WINDOW", 1)  # windows of four times the lookahead
    monkeypatch.setattr(bpe, "CHUNK", 7)
    monkeypatch.setattr(bpe, "CACHE", 3)
    vocabulary.known.clear()
    same(vocabulary, library)


def test_lookahead_by_hand():
    # "ab" needs what follows "b"; the chain a+bc after b+c moves the boundary by two symbols
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "bc")], "") == 2 + 3
    assert bpe.sufficient_lookahead([], "") == 1


def test_plain_text_round_trip(both):
    vocabulary, _ = both
    decoder = bpe.TextDecoder(vocabulary)
    ids = [i for part in vocabulary.encode("Ünï 漢字 😀 test") for i in part]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == "ünï 漢字 😀 test "


def test_rows(frame):
    rows = frame([(1, None, 5), (None, "", 5), (2, "a b", 5), (2, "a b", 5)], "doc_id long, text string, ids int")
    out = bpe.digests(rows, vocabulary_path(), with_ids=True).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 2, 2] and bpe.digests(rows.limit(0), vocabulary_path()).count() == 0
    assert [r.text for r in bpe.decode(bpe.encode(rows.where("doc_id = 2"), vocabulary_path()), vocabulary_path()).collect()] == ["a b ", "a b "]
