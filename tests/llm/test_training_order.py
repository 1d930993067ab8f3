import random

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tessella.llm.training_order import _tiktoken, feistel_slots, read_slots, sequences_in_training_order, training_order, write_shards

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097, 65536])
def test_feistel_is_a_keyed_permutation(n):
    a, b = feistel_slots(np.arange(n), n, 1), feistel_slots(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    if n >= 1000:
        assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.15


def rows():
    r = random.Random(3)
    out = [(i * 7 % 501, " ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(r.choice([1, 10, 60])))) for i in range(400)]
    return out + [(5, "same"), (5, "same"), (None, "no id"), (9001, None), (9002, "")]


def brute(data, length, key):
    e, seqs = _tiktoken(RANKS), []
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, 42 if x[1] is None else xxhash.xxh64(x[1].encode(), 42).intdigest(), x[1] or "", x[1] is not None)):
        ids = [*e.encode_ordinary(t or ""), 50256]
        for j in range(0, len(ids), length):
            part = ids[j : j + length]
            seqs.append((i, j // length, len(part), part + [50256] * (length - len(part))))
    slots = feistel_slots(np.arange(len(seqs)), len(seqs), key).tolist()
    return {s: x for s, x in zip(slots, seqs)}


def test_slots_and_shards(spark, tmp_path):
    data, want = rows(), brute(rows(), 16, 7)
    for parts in (1, 5):
        df = spark.createDataFrame([(*x, 1, "s") for x in data], "doc_id long, text string, slot int, shard string").repartition(parts)
        got = sequences_in_training_order(df, RANKS, length=16, slots_per_shard=50, key=7)
        seen = {g.slot: (g.doc_id, g.seq_no, g.n_tokens, np.frombuffer(g.tokens, "<u2").tolist()) for g in got.collect()}
        assert seen == want
        assert all(g.shard == g.slot // 50 and g.byte_offset == g.slot % 50 * 32 for g in got.collect())
    files = write_shards(got, f"{tmp_path}/shards", 32).collect()
    assert sorted((f.shard, f.slots) for f in files) == [(i, min(50, len(want) - 50 * i)) for i in range(-(-len(want) // 50))]
    (tmp_path / "shards" / "shard-00000001.bin").unlink()
    write_shards(got, f"{tmp_path}/shards", 32).collect()
    back = read_slots(spark, f"{tmp_path}/shards", 30, len(want), 16, 50)
    assert [x.tolist() for x in back] == [want[s][3] for s in range(30, len(want))]


def test_empty(spark):
    assert sequences_in_training_order(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_query_writes_its_shards(spark, monkeypatch, tmp_path):
    from tessella.llm import registry

    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registry, "scratch", lambda _, name: f"{tmp_path}/{name}")
    got = registry.op10_feistel_training_order(spark, str(tmp_path)).collect()
    want = brute(data, 512, 20240607)
    held = b"".join(p.read_bytes() for p in sorted((tmp_path / "shards").glob("shard-*.bin")))
    assert len(got) == len(want) and len(held) == 1024 * len(want)
    assert all(bytes(g.tokens) == held[1024 * g.slot : 1024 * g.slot + 1024] == np.array(want[g.slot][3], "<u2").tobytes() for g in got)
    assert {g.slot: (g.doc_id, g.seq_no, g.n_tokens) for g in got} == {s: x[:3] for s, x in want.items()}


def test_rows_come_from_the_files(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = training_order(df, RANKS, f"{tmp_path}/shards", length=16, slots_per_shard=50, key=7)
    assert {g.slot: (g.shard, g.byte_offset, np.frombuffer(g.tokens, "<u2").tolist()) for g in got.collect()} == {s: (s // 50, s % 50 * 32, x[3]) for s, x in brute(rows(), 16, 7).items()}
    file = tmp_path / "shards" / "shard-00000001.bin"
    file.write_bytes(bytes(file.stat().st_size))
    with pytest.raises(Exception, match="does not hold its slots"):
        got.collect()
    assert training_order(df.limit(0), RANKS, f"{tmp_path}/none").count() == 0


def test_another_key_leaves_no_shard_of_the_first(spark, tmp_path):
    import json

    df = spark.createDataFrame(rows(), "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, data in ((7, rows()), (8, rows()), (8, rows()[:100])):
        got = training_order(df if len(data) > 100 else spark.createDataFrame(data, "doc_id long, text string"), RANKS, f"{tmp_path}/shards", length=16, slots_per_shard=50, key=key)
        want = brute(data, 16, key)
        assert {g.slot: np.frombuffer(g.tokens, "<u2").tolist() for g in got.collect()} == {s: x[3] for s, x in want.items()}
        assert [x.tolist() for x in read_slots(spark, f"{tmp_path}/shards", 0, 10**6, 16, 50)] == [want[s][3] for s in range(len(want))]
        assert len(list((tmp_path / "shards").glob("shard-*"))) == -(-len(want) // 50)
        assert json.loads((tmp_path / "shards" / "manifest.json").read_text())["slots"] == len(want)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= min(512, int(before))


def test_a_split_shard_is_an_error(spark, tmp_path):
    got = sequences_in_training_order(spark.createDataFrame(rows(), "doc_id long, text string"), RANKS, length=16, slots_per_shard=50, key=7)
    with pytest.raises(Exception, match="not whole"):
        write_shards(got.repartition(7), f"{tmp_path}/shards", 32).collect()


def test_cut_points_split_a_hot_id():
    from tessella.llm.training_order import _cut_points

    ids, shares = _cut_points([1.0, 5.0, 5.0, 5.0, 9.0])
    assert ids.tolist() == [1, 5, 5, 5, 9] and np.allclose(shares, [1, 1 / 3, 2 / 3, 1, 1])


def test_hot_ids_and_long_texts(spark):
    data = [(1, f"copy {i % 30}") for i in range(300)] + [(None, "n")] * 40 + [(2, "long " * 30_000)]
    got = sequences_in_training_order(spark.createDataFrame(data, "doc_id long, text string"), RANKS, length=64, slots_per_shard=50, key=3)
    want = brute(data, 64, 3)
    assert {g.slot: (g.doc_id, g.seq_no, g.n_tokens, np.frombuffer(g.tokens, "<u2").tolist()) for g in got.collect()} == want


def test_token_ids_without_lookahead():
    """The faster pattern is used, and gives the ids of whole texts whatever white space they hold."""
    from tessella.llm.training_order import _RARE_LEADS, _WHITE, _token_ids, _without_lookahead

    e, r = _tiktoken(RANKS), random.Random(14)
    assert _without_lookahead(RANKS) is not None
    assert all(x.encode().startswith(_RARE_LEADS) for x in map(chr, range(128, 0x3100)) if x.isspace())
    white = "\t\n\x0b\x0c\r \x85\xa0        　"
    some = [*white, *white, " ", " ", "  ", "\n\n", "\x1c", "\x1f", "​", "᠎", "﻿", "a", "The", "words", "é", "'s", "'", "n't", "12", ".", ",,", "中", "-", "\x00"]
    for _ in range(20_000):
        text = "".join(r.choices(some, k=r.randint(0, 9)))
        assert _token_ids(RANKS, text) == e.encode_ordinary(text), repr(text)
    assert _WHITE.startswith("\t-\r ")
