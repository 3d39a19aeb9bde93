"""Packing and Viterbi coding against the tokenizers and full tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, rows_of, texts, words
from tokenizers import Tokenizer

from pairlens.llm import packing, tokens, unigram
from pairlens.llm.tokens import WordEncoder

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_word_encoder_equals_the_tokenizer():
    encoder, rng = WordEncoder(WORD), random.Random(1)
    odd = "aZé'sΣİßñ ²½_<|>\t\n.d1٣ \x1c\x85\xa0µªΩǅll've"
    cases = [t for _, t in texts() if t] + ["".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(500)] + ["".join(chr(rng.randrange(32, 0x250)) for _ in range(50)) for _ in range(300)]
    for text in cases:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_remembers_few_and_short_words(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 50)
    encoder, text = WordEncoder(WORD), words(1, 2000) + " " + "longword" * 5 + ", " + "longword" * 6
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
    assert 0 < len(encoder.words) <= 50 and len(encoder.words.pieces) <= 50
    assert max(map(len, [*encoder.words, *encoder.words.pieces])) <= 24


@pytest.mark.parametrize("capacity,extra", [(64, False), (4096, True)])
def test_packing_places_every_token_once(spark, capacity, extra):
    rows = texts() + [(500 + i, words(i, i % 40)) for i in range(300)]
    out = packing.pack(documents(spark, rows, extra), WORD, capacity, 1).toPandas()
    tokenizer, want = Tokenizer.from_file(WORD), []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    got = [(None if d != d else int(d), *(int(x) for x in r)) for d, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = out.sort_values(["sequence_id", "offset"])
    ends = out.groupby("sequence_id").length.cumsum()
    assert (ends - out.length == out.offset).all() and (ends <= capacity).all()
    assert out.sequence_id.nunique() <= 1.05 * -(-out.length.sum() // capacity) + 2


def test_packing_of_one_length_and_of_nothing(spark):
    pieces = spark.createDataFrame([(i, 30) for i in range(500)], "uid bigint, length bigint")
    placed = packing.best_fit(pieces, 100).toPandas()
    assert len(placed) == 500 and placed.groupby("sequence_id").size().max() <= 3
    assert placed.sequence_id.nunique() <= 185
    assert packing.pack(documents(spark, []), WORD).count() == 0


def full_viterbi(vocabulary, text):
    """All splits by a table: the largest sum, of equals the one whose last pieces are longest."""
    best = [(0.0, [])]
    for j in range(1, len(text) + 1):
        options = [(best[j - 1][0] + vocabulary.byte_score * len(text[j - 1].encode()), -1, best[j - 1][1] + vocabulary.byte_ids(text[j - 1]))]
        for i in range(j):
            found = vocabulary.match.get(text[i:j])
            if found:
                options.append((best[i][0] + found[0], j - i, best[i][1] + [found[1]]))
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


def test_streaming_viterbi_equals_the_full_table():
    pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + [("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("ba", -4.5), ("▁a", -4.0), ("aba", -6.0), ("abab", -7.0), ("▁▁", -3.0), ("c", -1.0)]
    vocabulary = unigram.Vocabulary(pieces, {b: b + 1 for b in range(256)})
    assert vocabulary.splits
    rng = random.Random(3)
    for k in range(400):
        text = "".join(rng.choices("aabbc▁é", k=k))
        stream = unigram.StreamingViterbi(vocabulary)
        parts, held = [], 0
        for char in text:
            parts += [x for part in stream.feed(char) for x in part]
            held = max(held, len(stream.chars))
        parts += stream.finish()
        assert parts == full_viterbi(vocabulary, text) == unigram.encode_whole(vocabulary, text)
        assert held < 8 * vocabulary.longest or "c" not in text


def test_long_text_without_spaces_keeps_a_window():
    coder = unigram.encoder(PIECE)
    stream = unigram.StreamingViterbi(coder.vocabulary)
    text, held, ids = words(9, 800).replace(" ", ""), 0, []
    for char in text:
        for part in stream.feed(char):
            ids += part
        held = max(held, len(stream.chars))
    ids += stream.finish()
    assert ids == unigram.encode_whole(coder.vocabulary, text)
    assert held <= 8 * coder.vocabulary.longest


@pytest.mark.parametrize("extra", [False, True])
def test_coding_round_trip(spark, extra):
    out = unigram.decode(unigram.encode(documents(spark, extra=extra), PIECE), PIECE)
    assert rows_of(out, "doc_id", "decoded") == sorted(texts(), key=repr)
    assert unigram.encode(documents(spark, []), PIECE).count() == 0
