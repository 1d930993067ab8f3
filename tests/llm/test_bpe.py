import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm.bpe import Encoder, cuts, decode_ids, digests, encode_documents, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(3)
    letters = list("abcdefghij  \n\t.,'É́é̂ßΣσςİı中文  \x1c\x85\x0b<|>0123") + ["<|endoftext|>", "don't", "'ll", "́", "é", "\x00"]
    out = ["", None, " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "́a ́", "Hello, World! " * 400]
    out += ["".join(r.choice(letters) for _ in range(r.choice([1, 5, 60, 600, 5000]))) for _ in range(150)]
    shared = "".join(r.choice("abcd efg hij") for _ in range(4000))
    out += [f"{i} " + shared[i * 7 :] + shared for i in range(20)]
    return out


def test_equal_to_whole_texts(spark):
    t = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    dig = {r.doc_id: r for r in digests(encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)), repr(x)[:80]
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert dig[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert dig[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_chunks_are_reused():
    import numpy as np

    e = Encoder(PATH)
    r = random.Random(5)
    text = "".join(r.choice("abcd efg hij") for _ in range(20000)).encode()
    e.encode(text)
    first = e.encoded
    e.encode(b"new start " + text)
    assert e.encoded - first <= 3 and e.reused > 10
    assert cuts(np.frombuffer(text, np.uint8))[-1] == 20000


@pytest.mark.parametrize("schema", ["doc_id long, text string, ids int, decoded int, n_tokens int"])
def test_edges(spark, schema):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3), (1, "a b", 1, 2, 3), (None, "c", 1, 2, 3)], schema)
    out = encode_documents(df, PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == 3
    assert encode_documents(df.limit(0), PATH).count() == 0
    assert {tuple(r.ids) for r in token_ids(out).collect()} and decode_ids(out.select("doc_id", "ids"), PATH).where("decoded = 'c</w>'").count() == 1


def test_five_megabytes_without_white_space(spark):
    r = random.Random(8)
    text = "".join(r.choice("abcdefghij.,") for _ in range(5_000_000))
    t = Tokenizer.from_file(PATH)
    got = Encoder(PATH).encode(text.encode())
    assert got[1] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids))


def test_tables_are_bounded_by_bytes(monkeypatch):
    e = Encoder(PATH, stretch_bytes=100_000)
    r = random.Random(6)
    t = Tokenizer.from_file(PATH)
    for i in range(40):
        text = " ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(400)) + " " + "x" * 20_000 * (i % 2)
        ids = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text.encode())[:2] == (len(ids), " ".join(map(str, ids)))
        assert e.stretches.size <= 100_000 and e.chunks.size <= 8_000_000
    assert all(len(k) < 12_500 for k in (*e.stretches.young, *e.stretches.old))


def test_other_files_are_encoded_as_wholes():
    """The byte-level vocabulary joins a space to the word after it, so white space is no agreement point there."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = Encoder(path), Tokenizer.from_file(path)
    text = "some words,  shared\nby " * 300
    assert not e.agrees and Encoder(PATH).agrees
    assert e.encode(text.encode())[1] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids))


def test_disagreement_at_a_join(monkeypatch):
    """Were the words around a join to come out otherwise, the text would be encoded as a whole."""
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    r = random.Random(12)
    text = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(2000))
    want = t.encode(text, add_special_tokens=False).ids
    real, calls = Encoder._ids, []
    monkeypatch.setattr(Encoder, "_ids", lambda self, x: (calls.append(x), real(self, x))[1][: None if x == text else -1])
    assert e.encode(text.encode())[1] == " ".join(map(str, want)) and calls[-1] == text and len(calls) > 1


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode(self, text, **kw):
        self.texts += 1
        return self.inner.encode(text, **kw)

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **kw)


def some_words(r, n, others):
    letters = "abcdeghnrstABCDEÀÉÈÖÜßàéèçêöüñÿ"
    out = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", ",", "!?", "***", ",&&&"]) for _ in range(n)]
    return [r.choice(others) + w if r.random() < 0.1 else w for w in out] if others else out


def test_new_plain_words_go_to_the_model():
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    e.tokenizer = Counted(e.tokenizer)
    text = " ".join(some_words(random.Random(21), 5000, []))
    ids = t.encode(text, add_special_tokens=False).ids
    assert e.encode(text.encode())[:2] == (len(ids), " ".join(map(str, ids)))
    assert e.tokenizer.texts < 500


def test_words_that_are_not_plain():
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    r = random.Random(22)
    others = ["'s", "don't", "1", "́", "H̱", "İ", "İ", "\xa0", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "a.b", "×", "ª", "\x01", "-.-.-.-.-.-.-", "ſ", "K"]
    texts = [" ".join(some_words(r, r.choice([3, 80, 900]), others)) for _ in range(60)] + ["\xa0 \xa0", "\xa0", " \x1c "]
    for (n, ids, decoded), x in zip(e.encode_all([x.encode() for x in texts]), texts):
        want = t.encode(x, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False))


def test_letters_that_could_hold_an_added_token(tmp_path):
    t = Tokenizer.from_file(PATH)
    t.add_tokens(["thing"])
    t.save(path := f"{tmp_path}/t.json")
    e = Encoder(path)
    assert e.letters is None and Encoder(PATH).letters and Encoder(PATH).folds
    text = "some things, anything. " * 200
    assert e.encode(text.encode())[1] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids))
