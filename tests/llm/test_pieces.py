"""Streaming Viterbi against the library's own encoding, and exact round trips."""

import random

import numpy as np
from phenogrid.llm import pieces
from sentencepiece import SentencePieceProcessor


def library():
    return SentencePieceProcessor(model_file=pieces.default_vocabulary())


def test_equals_library_on_awkward_texts():
    rng, own, lib = random.Random(3), pieces.codec(pieces.default_vocabulary()), library()
    bits = list("abcdehinorst   \n\té▁一①　𝄞") + ["the", "ing", " the", "    ", "aaaa", "0000", "<s>", "<0x0A>", "<unk>", "====", "----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a" * 500, "=" * 300, " " * 100, "ab" * 400, ""]
    for text in texts:
        want = lib.encode(text)
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == want, repr(text)
        if text:
            assert np.frombuffer(own._segment(pieces.SPACE + text.replace(" ", pieces.SPACE)), own.dtype).tolist() == want, repr(text)
        if pieces.SPACE not in text:
            assert own.decode(own.encode(text)) == text


def test_commits_before_the_end():
    viterbi = pieces.StreamingViterbi(pieces.codec(pieces.default_vocabulary()).v)
    parts = list(viterbi.run("thequickbrownfoxjumps" * 40))
    assert len(parts) > 5 and len(viterbi.back) == 1


def test_documents(documents, texts, odd, empty):
    lib = library()
    for r in pieces.encoded(documents).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == lib.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]
    got = sorted((r.doc_id, r.decoded) for r in pieces.encoded(odd).where("doc_id IS NOT NULL").collect())
    assert got == sorted((r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None)
    assert pieces.encoded(empty).count() == 0
