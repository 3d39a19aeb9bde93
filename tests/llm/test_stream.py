"""Ids are committed where surviving paths meet, on prose and on vocabularies of every kind."""

import random

import public_tokenizers
import pytest
from conftest import SF
from fixtures import texts

from pairlens.llm import unigram


def random_vocabulary(rng, inner_marks):
    made = {"".join(rng.choices("ab▁", k=rng.randint(1, 5))) for _ in range(60)} | {"a", "b", "▁"}
    pieces = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    pieces += [(p, -float(rng.randint(1, 9))) for p in sorted(made) if inner_marks or "▁" not in p.lstrip("▁")]
    return unigram.Vocabulary(pieces, {b: b for b in range(256)})


def ids_of(coder, text):
    return unigram.np.frombuffer(coder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("inner_marks", [False, True])
def test_words_go_through_the_stream(monkeypatch, inner_marks):
    """Also where pieces span words, so that only the paths themselves tell where a word can be remembered."""
    rng = random.Random(5)
    for _ in range(8):
        vocabulary = random_vocabulary(rng, inner_marks)
        assert vocabulary.splits or inner_marks
        samples = [" ".join("".join(rng.choices("abé", k=rng.randint(0, 60))) for _ in range(20)) for _ in range(20)]
        samples += [" ".join(rng.choices(["a", "b", "ab", "ba", "aab", ""], k=200)) for _ in range(5)] + [t for _, t in texts() if t and "▁" not in t and len(t) < 3000]
        want = [unigram.encode_whole(vocabulary, (" " + t).replace(" ", "▁")) for t in samples]
        with monkeypatch.context() as patch:
            patch.setattr(unigram, "encode_whole", lambda *_: pytest.fail("a full table ran"))
            coder = unigram.Encoder(vocabulary)
            assert [ids_of(coder, t) for t in samples] == want
            assert [ids_of(coder, t) for t in samples] == want  # with all words remembered


def test_convergence_decides_on_prose(spark):
    """Ordinary documents under the real vocabulary: nearly all ids come from meeting paths, and every remembered word from a meeting at its end."""
    coder = unigram.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    own = unigram.Encoder(coder.vocabulary)
    finished = []
    finish = own.stream.finish
    own.stream.finish = lambda: finished.append(finish()) or finished[-1]
    docs = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r[0]]
    total, parts = 0, 0
    for text in docs:
        total += len(ids_of(own, text))
        parts += (" " + text).count("▁") + 1
    assert own.stream.commits >= len(own) > 5000
    assert len(finished) <= parts and sum(map(len, finished)) < 0.01 * total


def test_remembered_words_are_what_the_table_gives():
    coder = unigram.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    own = unigram.Encoder(coder.vocabulary)
    own.encode(" ".join(t for _, t in texts() if t and len(t) < 5000))
    assert len(own) > 100
    for word, ids in list(own.items())[::7]:
        assert unigram.np.frombuffer(ids, "<u4").tolist() == unigram.encode_whole(coder.vocabulary, word)
