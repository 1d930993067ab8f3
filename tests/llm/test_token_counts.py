import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessella.llm.common import flat
from tessella.llm.token_counts import Ledger, count_tokens, word_counts
from tessella.llm.training_order import _tiktoken

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, op string"


def test_counts(spark):
    import pyarrow as pa

    r = random.Random(1)
    texts = ["", None, " a", "é b\n", "x" * 100] + ["".join(r.choice("ab \n\té") for _ in range(r.randint(0, 60))) for _ in range(100)]
    n = word_counts(*flat(pa.array(texts)))
    assert n.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    df = spark.createDataFrame([(i, t, "s", "l", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_tokens int")
    got = {(x.doc_id, x.tokenizer_version): x.n_tokens for x in count_tokens(df, RANKS).collect()}
    e = _tiktoken(RANKS)
    assert got == {(i, v): (len(e.encode_ordinary(t or "")) if v == "byte_bpe_50k" else int(n[i])) for i, t in enumerate(texts) for v in ("byte_bpe_50k", "words_v1")}
    assert count_tokens(df.limit(0), RANKS).count() == 0


def test_ledger_against_replay(spark, tmp_path):
    r, state = random.Random(2), {}
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    for batch in range(4):
        changes = {}
        for _ in range(60):
            key = (r.randrange(50), r.choice(["v1", "v2"]))
            changes[key] = (key[0], r.choice(["s1", "s2", None]), r.choice(["en", None]), key[1], r.randrange(100), r.choice(["insert", "revise", "delete"] if batch else ["insert"]))
        rows = list(changes.values()) * 2 + [(None, "s", "l", "v1", 5, "insert"), (77, "s", "l", None, 5, "insert"), (78, "s", "l", "v1", None, "insert"), (999, None, None, "v1", None, "delete")]
        df = spark.createDataFrame(rows, SCHEMA)
        assert ledger.apply(f"b{batch}", df)
        for key, c in changes.items():
            state.pop(key, None)
            if c[5] != "delete":
                state[key] = c
        want = defaultdict(lambda: [0, 0])
        for c in state.values():
            want[c[1:4]][0] += 1
            want[c[1:4]][1] += c[4]
        got = lambda: {(t.source, t.lang, t.tokenizer_version): [t.n_docs, t.n_tokens] for t in ledger.totals().collect()}
        assert got() == dict(want)
        assert not ledger.apply(f"b{batch}", df) and got() == dict(want)
    ledger.compact()
    assert got() == dict(want) and not ledger.apply("b1", df) and Ledger(spark, f"{tmp_path}/ledger").batches() == ["b0", "b1", "b2", "b3"]
    assert {(x.doc_id, x.tokenizer_version): (x.source, x.lang, x.tokens, x.documents) for x in ledger.documents().collect()} == {k: (c[1], c[2], c[4], 1) for k, c in state.items()}
    assert ledger.apply("empty", spark.createDataFrame([], SCHEMA)) and ledger.batches() == ["b0", "b1", "b2", "b3", "empty"]
    assert got() == dict(want) and np.sum([v[0] for v in want.values()]) == len(state)


def test_ties_within_a_batch(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    ledger.apply("a", spark.createDataFrame([(1, "s", "l", "v", 5, "insert"), (1, "s", "l", "v", 9, "insert"), (2, "s", "l", "v", 5, "insert"), (2, "s", "l", "v", 5, "delete")], SCHEMA))
    assert [tuple(x) for x in ledger.totals().collect()] == [("s", "l", "v", 1, 9)]


def test_query_against_replay(spark, tmp_path):
    from tessella.llm.registry import op6_delta_token_counts

    r, e = random.Random(5), _tiktoken(RANKS)
    docs = [(i, " ".join(r.choice(["ab", "é", "x  y", "\n"]) for _ in range(r.randint(0, 30))), r.choice(["en", "de"]), f"s{i % 3}", 1) for i in range(200)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 220, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic, poor = {i for i, _, t in labels if t}, {i for i, q, t in labels if not t and not q}
    want = defaultdict(lambda: [0, 0])
    for i, t, lang, source, _ in docs:
        if i in toxic:
            continue
        t = re.sub(r"[ \t\n]+", " ", t).strip(" ") if i in poor else t
        for v, n in (("byte_bpe_50k", len(e.encode_ordinary(t))), ("words_v1", len(re.findall(r"[^\x20\x09-\x0D]+", t)))):
            want[source, lang, v][0] += 1
            want[source, lang, v][1] += n
    got = {(t.source, t.lang, t.tokenizer_version): [t.n_docs, t.n_tokens] for t in op6_delta_token_counts(spark, str(tmp_path)).collect()}
    assert got == dict(want)


def test_two_writers_and_broken_commits(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/l"
    a, b = Ledger(spark, root), Ledger(spark, root)
    one = spark.createDataFrame([(1, "s", "l", "v", 5, "insert")], SCHEMA)
    assert a.apply("first", one)
    written = Ledger._written

    def race(self, name, rows):
        """While b has written its rows and not committed, a commits another batch for the same document, then the same batch."""
        folder = written(self, name, rows)
        monkeypatch.setattr(Ledger, "_written", written)
        assert a.apply(others.pop(0), one if name == "same" else spark.createDataFrame([(1, "t", "l", "v", 7, "revise")], SCHEMA))
        return folder

    others = ["other"]
    monkeypatch.setattr(Ledger, "_written", race)
    assert b.apply("mine", spark.createDataFrame([(1, "u", "l", "v", 9, "revise")], SCHEMA))
    assert [tuple(x) for x in a.totals().collect()] == [("u", "l", "v", 1, 9)] == [tuple(x) for x in b.totals().collect()]
    others = ["same"]
    monkeypatch.setattr(Ledger, "_written", race)
    assert not b.apply("same", one)
    assert [tuple(x) for x in b.totals().collect()] == [("s", "l", "v", 1, 5)]
    for bad in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            a.apply(bad, one)
    monkeypatch.setattr(Ledger, "WAIT", 0.1)
    (tmp_path / "l" / "commits" / f"{len(a._commits()):010d}").touch()
    with pytest.raises(RuntimeError, match="broken off"):
        a.totals()
