"""Pieces of words are encoded as whole texts are, and are fewer than words."""

import json
import random
import shutil

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import wavelet
from tidemark.llm.word_pieces import Encoder, added_tokens, pieces
from tidemark.llm.words import Hasher, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# letters with and without composed forms, marks that join them or signs, other digits and spaces
PARTS = [
    *"abeghijkstvmldrSTRVMLDEHIKÉÑÞßÿþ×÷ĳſİıKÅŉǅΣςДжاहि한漢ﬁ", "ll", "re", "ve", "'", "'", "'", "’", "''", "'S", "'LL", "'ř",
    *"0159٣²½Ⅷ", *".,;!?<>=|&-_/\\\"`^~()[]{}#*\x00\x01\x1c\x1f\x7f", *" \t\n\v\f\r", "\u0085", " ", " ", "​", "　",
    "̀", "́", "̇", "̈", "̧", "̱", "̸", "ͅ", "⃣", "️", "ِ", "\U0001f600",
    "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "endoftext", "Tide", "HARBOUR", "café",
]


def encoded(encoder, texts):
    """Ids of every text by way of pieces."""
    out = []
    for _, _, part in slices(pa.array(texts, pa.string()), 3000):
        p = pieces(part, encoder.added)
        flat, bounds = encoder.ids(Hasher(p.data, False).of(p.start, p.end), p.data, p.start, p.end)
        ends = bounds[p.first]
        out += [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


def test_pieces_are_encoded_as_the_whole_text():
    rng = random.Random(7)
    texts = [None, "", " ", "́", "A", "́A", "x'", "'s", "H", "̱", "é", "É", *PARTS]
    texts += ["".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(6000)]
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.added == [b"<|startoftext|>", b"<|endoftext|>"]
    assert encoded(encoder, texts) == want
    assert encoded(encoder, texts[::-1]) == want[::-1]


def test_ids_that_do_not_tell_pieces_apart_are_made_one_by_one(monkeypatch):
    encoder, texts = Encoder(VOCABULARY), ["Tide, TIDE (tide) 12 o'clock", "harbour café"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(encoder, "_joined", lambda data, end: None)
    assert encoded(encoder, texts) == want


def test_a_vocabulary_with_other_rules_keeps_whole_words(tmp_path):
    with open(VOCABULARY, encoding="utf-8") as file:
        known = json.load(file)
    cased = known | {"normalizer": {"type": "NFC"}}
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(cased, file)
    texts = ["Tide, TIDE (tide) 12 o'clock", None, "", " harbour\tcafé "]
    tokenizer = Tokenizer.from_file(path)
    assert added_tokens(path) is None
    assert encoded(Encoder(path), texts) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for change in ({"normalized": True}, {"lstrip": True}, {"content": "tide"}, {"content": "a b"}):
        with open(path, "w", encoding="utf-8") as file:
            json.dump(known | {"added_tokens": [*known["added_tokens"], {**known["added_tokens"][0], "id": 49408, **change}]}, file)
        assert added_tokens(path) is None


def test_variants_of_a_word_share_its_pieces(spark, tmp_path):
    path = str(tmp_path / "vocabulary.json")  # a name of its own, so that workers know none of it
    shutil.copy(VOCABULARY, path)
    letters = "abcdefghij"
    words = [a + b + c + "tide" for a in letters for b in letters for c in letters]
    forms = ["{}", "{},", "({})", "{}!", '"{}"', "{}.", "{}7", "#{}", "{}-", "*{}*"]
    rows = [(i, " ".join(f.format(x) for w in words for x in (w, w.upper(), w.title()))) for i, f in enumerate(forms)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in wavelet.wavelet_tokens(docs, path).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}

    def held(batches):
        for _ in batches:
            pass
        for kept, encoder in wavelet._LOADED.items():
            yield pa.RecordBatch.from_pydict({"path": [kept], "held": [encoder.keys.size]})

    seen = spark.range(64).repartition(16).mapInArrow(held, "path string, held bigint").collect()
    sizes = [r.held for r in seen if r.path == path]
    assert sizes and max(sizes) <= len(words) + 12


def test_wavelet_values_of_all_widths():
    rng = np.random.default_rng(3)
    for bits, dtype in ((1, np.uint16), (9, np.uint16), (16, np.uint16), (17, np.uint32), (32, np.uint32)):
        ids = rng.integers(0, 1 << bits, 5000).astype(dtype)
        _, _, matrix = wavelet.open_shard(wavelet.pack_shard(ids, [1], np.array([5000]), bits))
        assert (matrix.decode() == ids).all() and (matrix.decode(dtype) == ids).all()
