"""Operator 10: token sequences in training order, by a keyed permutation of their numbers.

Documents are tokenised in the order of their ids and cut into sequences of a fixed length, so each sequence has a number in
0 to N - 1. A Feistel network over the next even power of two, walked along its cycle until the value is below N,
sends the number to a global slot: a permutation that needs no table, and any slot's place is known beforehand. Slots
are dealt to shards by range; a shard is slots of equal size one after the other, so training reads it
sequentially and resumes at any slot.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_batches, flat, open_store, tidy
from tessella.llm.exchange import SENT, receive, send
from tessella.storage import scratch

ROUNDS = 6
#: Parts in which the shards are written: disk holds the shuffle of one of them beside the shards.
WAVES = 2
#: Sequences in a row of the staged table: a batch of 512 rows is what Python gets at once.
HELD = 128
#: Rows of the staged table whose sequences are dealt together: 2 MB of tokens.
DEALT = 16
#: Columns of sequences in training order.
ROWS = "slot long, shard long, byte_offset long, doc_id long, seq_no long, n_tokens int, tokens binary"
#: Rank of rows without id: before all ids.
_NO_ID = float("-inf")


def _round(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel_slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots in 0 to n - 1 of the numbers; a permutation of range(n) for each key."""
    if n <= 1:
        return np.zeros(len(numbers), np.int64)
    half = max(1, -(-(int(n - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int(v)) for v in np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 64, ROUNDS, dtype=np.uint64)]
    x = numbers.astype(np.uint64)
    out, open_ = np.empty(len(x), np.int64), np.arange(len(x))
    while len(open_):
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (_round(right, k) & low)
        x = left << np.uint64(half) | right
        done = x < np.uint64(n)
        out[open_[done]] = x[done].astype(np.int64)
        open_, x = open_[~done], x[~done]
    return out


def _cut_points(quantiles: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets end, as ids and shares of the range of hashes: at the end of an id's rows, or, for an id that is several quantiles,
    after equal shares of its rows as well. Ids beyond 2 ** 53 are not told apart as doubles and not split."""
    ids, times = np.unique(np.array(quantiles, np.float64), return_counts=True)
    times = np.where((np.abs(ids) < 2.0**53) | (ids == _NO_ID), times, 1)
    return np.repeat(ids, times), np.concatenate([np.arange(1, t + 1) / t for t in times] or [np.zeros(0)])


@lru_cache(maxsize=2)
def _tiktoken(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: How the tokenizer's pattern ends, white space by its meaning, and where a run of it must be cut to do without the lookahead.
_LOOKAHEAD, _WHITE = r"|\s+(?!\S)|\s+", "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}](?=[{_WHITE}][^{_WHITE}])")
_TO_SPACE = bytes(32 if i in range(9, 14) else i for i in range(256))
#: What the other white space begins with in UTF-8.
_RARE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


@lru_cache(maxsize=1)
def _without_lookahead(path: str):
    """An encoding that gives the same tokens where no run of white space is followed by something else, and is faster; None for another pattern."""
    import public_tokenizers
    import tiktoken

    if not public_tokenizers.PATTERN.endswith(_LOOKAHEAD):
        return None
    pattern = public_tokenizers.PATTERN.removesuffix(_LOOKAHEAD) + r"|\s+"
    return tiktoken.Encoding("ranks, no lookahead", pat_str=pattern, mergeable_ranks=_tiktoken(path)._mergeable_ranks, special_tokens={})


def _token_ids(path: str, text: str) -> list[int]:
    """Ids of the whole text. The pattern's lookahead leaves the last character of a run of white space to what follows; as the text
    is cut there, each part is matched the same way without it."""
    fast = _without_lookahead(path)
    if fast is None:
        return _tiktoken(path).encode_ordinary(text)
    raw = text.encode().translate(_TO_SPACE)
    if b"  " not in raw and not any(x in raw for x in _RARE_LEADS):
        return fast.encode_ordinary(text)
    out, begin = [], 0
    for m in _RUN.finditer(text):
        out += fast.encode_ordinary(text[begin : m.end()])
        begin = m.end()
    return out + fast.encode_ordinary(text[begin:])


def sequences_in_training_order(
    df: DataFrame, ranks_path: str, end_id: int = 50256, length: int = 512, slots_per_shard: int = 4096, key: int = 20240607,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per sequence: slot, shard, byte_offset (in the shard), doc_id, seq_no, n_tokens (without padding), tokens.

    A document's tokens and end_id are cut into sequences of length; tokens holds them as little-endian unsigned 16-bit
    numbers, padded with end_id to the fixed stride 2 * length. Null and empty texts give one sequence of end_id. Numbers
    follow doc_id (null first), then the text's hash and the text among repeated ids, which may thus be dealt to several tasks, so that result and slots depend on rows, key and
    length alone. Rows come in slot order within a partition, a shard in one partition. An empty table gives an empty one.
    """
    return _in_waves(df, ranks_path, end_id, length, slots_per_shard, key, id_col, text_col, 1)[0]


def _in_waves(df: DataFrame, ranks_path: str, end_id: int, length: int, slots_per_shard: int, key: int, id_col: str, text_col: str, waves: int) -> list[DataFrame]:
    """The rows of sequences_in_training_order as waves tables of whole shards, so that a table's shuffle can go before the next one's."""
    spark = df.sparkSession
    arrow_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = docs.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(_NO_ID)).alias("x"))
    cut_ids, cut_shares = _cut_points(ranked.approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [])

    def by_id(batches):
        for b in batches:
            ids = b.column(0).cast(pa.float64(), safe=False).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            share = b.column(2).to_numpy().view(np.uint64) / 2.0**64
            first, last = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
            bucket = first.astype(np.int64)
            for r in np.flatnonzero(last > first):  # the id is a cut: its rows are dealt by their hash
                bucket[r] += np.searchsorted(cut_shares[first[r] : last[r]], share[r], "right")
            yield bucket, b

    def cut(bucket, tables):
        table = tables[0]
        ids, texts, hashes = table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_numpy().view(np.uint64).tolist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, hashes[i], texts[i] or "", texts[i] is not None))
        number, held = 0, []

        def out(begin):
            rows = [h[:3] for h in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([begin], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                 pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([[r[2] for r in rows]], pa.list_(pa.int32())), pa.array([b"".join(h[3] for h in held)], pa.binary())],
                names=["bucket", "begin", "n", "doc_ids", "seq_nos", "n_tokens", "tokens"],
            )

        for i in order:
            t = [*_token_ids(ranks_path, texts[i] or ""), end_id]
            n = len(t)
            t = struct.pack(f"<{n}H", *t) + struct.pack("<H", end_id) * (-n % length)
            for j in range(0, n, length):
                held.append((ids[i], j // length, min(length, n - j), t[2 * j : 2 * (j + length)]))
                if len(held) == HELD:
                    yield out(number)
                    number += len(held)
                    held = []
        if held:
            yield out(number)

    path = scratch(spark, "sequences")
    staged_schema = "bucket int, begin long, n long, doc_ids array<long>, seq_nos array<long>, n_tokens array<int>, tokens binary"
    receive(docs.mapInArrow(tidy(lambda it: send(by_id(it))), SENT), cut, staged_schema, parts).write.option("compression", "zstd").parquet(path)
    cuts_ = spark.read.schema(staged_schema).parquet(path)
    sums = {r.bucket: r.n for r in cuts_.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row per partition
    first, total = {}, 0
    for b in sorted(sums):
        first[b] = total
        total += sums[b]
    shards = -(-total // slots_per_shard)
    per_group = max(1, -(-shards // parts)) * slots_per_shard

    def to_slots(batches, wave):
        for b in batches:
            for r in range(0, b.num_rows, DEALT):
                bucket, begin, n, doc_ids, seq_nos, n_tokens, tokens = b.slice(r, DEALT).columns
                numbers = [first[k] + i + np.arange(m) for k, i, m in zip(bucket.to_pylist(), begin.to_pylist(), n.to_pylist())]
                slots = feistel_slots(np.concatenate(numbers), total, key)
                group = slots // per_group
                mine = group % waves == wave
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(slots), doc_ids.flatten(), seq_nos.flatten(), n_tokens.flatten(), pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(slots), [None, pa.py_buffer(flat(tokens)[0])])],
                    names=["slot", "doc_id", "seq_no", "n_tokens", "tokens"],
                )
                yield (group, rows) if mine.all() else (group[mine], rows.filter(pa.array(mine)))

    def in_order(group, tables):
        t = tables[0].sort_by("slot")
        for b in t.to_batches(max_chunksize=1024):
            slot = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(slot // slots_per_shard), pa.array(slot % slots_per_shard * 2 * length), b.column(1), b.column(2), b.column(3), b.column(4).cast(pa.binary())],
                names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "tokens"],
            )

    return [receive(cuts_.mapInArrow(tidy(lambda it, w=w: send(to_slots(it, w))), SENT), in_order, ROWS, parts) for w in range(waves)]


#: Columns of what write_shards() gives; the lists are by slot.
WRITTEN = "shard long, slots long, file string, n_bytes long, sha256 string, doc_ids array<long>, seq_nos array<long>, n_tokens array<int>"


def write_shards(sequences: DataFrame, path: str, stride: int) -> DataFrame:
    """Write shard-<number>.bin files into path (a folder or URI that all executors reach): slots in order, stride bytes
    each. A shard is written under another name and renamed when whole; one that is there already is left alone if size and hash are those of
    its slots, so a job that broke off resumes and nothing of another key, length or corpus stays. A shard's rows must come whole and in slot
    order in one partition; if not, it is an error. Returns shard, slots, file, n_bytes and sha256, and by slot doc_ids, seq_nos, n_tokens."""

    def run(batches):
        from pyarrow import fs

        store, root = open_store(path)
        store.create_dir(root, recursive=True)

        def digest(parts):
            h = hashlib.sha256()
            for p in parts:
                h.update(p)
            return h.hexdigest()

        def is_there(file, size, sha):
            info = store.get_file_info(file)
            if info.type == fs.FileType.NotFound or info.size != size:
                return False
            with store.open_input_stream(file) as f:
                return digest(iter(lambda: f.read(1 << 20), b"")) == sha

        def close(shard, rows):
            parts = rows["tokens"]
            file, size, sha = f"{root}/shard-{shard:08d}.bin", sum(map(len, parts)), digest(parts)
            if rows["byte_offset"] != list(range(0, size, stride)):
                raise ValueError(f"the rows of shard {shard} are not whole and in order in one partition")
            if not is_there(file, size, sha):
                with store.open_output_stream(temporary := f"{file}.{uuid.uuid4().hex}") as f:
                    for p in parts:
                        f.write(p)
                store.move(temporary, file)
            lists = [pa.array([rows[c]], pa.list_(kind)) for c, kind in (("doc_id", pa.int64()), ("seq_no", pa.int64()), ("n_tokens", pa.int32()))]
            head = [pa.array([x]) for x in (shard, size // stride, file, size, sha)]
            return pa.RecordBatch.from_arrays([*head, *lists], names=["shard", "slots", "file", "n_bytes", "sha256", "doc_ids", "seq_nos", "n_tokens"])

        names = ("tokens", "byte_offset", "doc_id", "seq_no", "n_tokens")
        now, rows = None, {c: [] for c in names}
        for b in batches:
            shards = b.column(0).to_numpy()
            begin = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(shards) else []
            for i, j in zip(begin, [*begin[1:], len(shards)]):
                if shards[i] != now and rows["tokens"]:
                    yield close(now, rows)
                    rows = {c: [] for c in names}
                now = int(shards[i])
                for k, c in enumerate(names, 1):
                    rows[c] += b.column(k).slice(i, j - i).to_pylist()
        if rows["tokens"]:
            yield close(now, rows)

    return sequences.select("shard", "tokens", "byte_offset", "doc_id", "seq_no", "n_tokens").mapInArrow(tidy(run), WRITTEN)


def read_shards(written: DataFrame, path: str, length: int = 512, slots_per_shard: int = 4096) -> DataFrame:
    """The rows of sequences_in_training_order from the files that write_shards has written to path; a file whose size or hash is not
    that of its slots is an error."""
    stride = 2 * length

    def run(batches):
        store, root = open_store(path)
        for b in batches:
            for r in b.to_pylist():
                with store.open_input_stream(f"{root}/shard-{r['shard']:08d}.bin") as f:
                    data = f.read()
                if len(data) != r["n_bytes"] or hashlib.sha256(data).hexdigest() != r["sha256"]:
                    raise ValueError(f"{r['file']} does not hold its slots")
                for i in range(0, r["slots"], 1024):
                    n = min(1024, r["slots"] - i)
                    at = np.arange(i, i + n)
                    tokens = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), n, [None, pa.py_buffer(data[i * stride : (i + n) * stride])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r["shard"] * slots_per_shard + at), pa.array(np.full(n, r["shard"])), pa.array(at * stride),
                         *(pa.array(r[c][i : i + n], kind) for c, kind in (("doc_ids", pa.int64()), ("seq_nos", pa.int64()), ("n_tokens", pa.int32()))), tokens.cast(pa.binary())],
                        names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "tokens"],
                    )

    return written.select("shard", "slots", "file", "n_bytes", "sha256", "doc_ids", "seq_nos", "n_tokens").mapInArrow(tidy(run), ROWS)


def training_order(
    df: DataFrame, ranks_path: str, path: str, end_id: int = 50256, length: int = 512, slots_per_shard: int = 4096, key: int = 20240607,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The whole job: sequences in training order are written to path as shard files, and the rows come from these files.

    manifest.json beside the shards states key, length, slots and shards; it is written when all shards are whole and removed before
    any is touched, and files of shards beyond the last, of an earlier and longer job, are removed."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, index = spark.conf.get(cleanup, "false"), scratch(spark, "shards")
    store, root = open_store(path)
    store.create_dir(root, recursive=True)
    _remove_files(store, root, lambda name: name == "manifest.json")
    spark.conf.set(cleanup, "true")  # each plan here runs once: its shuffle goes before the next one writes
    try:
        for sequences in _in_waves(df, ranks_path, end_id, length, slots_per_shard, key, id_col, text_col, WAVES):
            write_shards(sequences, path, 2 * length).write.mode("append").parquet(index)
    finally:
        spark.conf.set(cleanup, before)
    written = spark.read.schema(WRITTEN).parquet(index)
    held = written.agg(F.count("*").alias("shards"), F.sum("slots").alias("slots"), F.countDistinct("shard").alias("names"), F.max("shard").alias("last")).first()
    if held.shards and not held.shards == held.names == held.last + 1:
        raise RuntimeError("a shard is missing or was written twice")
    _remove_files(store, root, lambda name: name.startswith("shard-") and (not re.fullmatch(r"shard-[0-9]{8,}\.bin", name) or int(name[6:-4]) >= held.shards))
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"key": key, "length": length, "end_id": end_id, "slots_per_shard": slots_per_shard, "slots": held.slots or 0, "shards": held.shards}).encode())
    return read_shards(written, path, length, slots_per_shard)


def _remove_files(store, root: str, which) -> None:
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and which(info.base_name):
            store.delete_file(info.path)


def read_slots(spark: SparkSession, path: str, begin: int, count: int, length: int = 512, slots_per_shard: int = 4096) -> list[np.ndarray]:
    """count sequences from slot begin on, read one after the other: what a training process resumes with."""
    store, root = open_store(path)
    out = []
    while len(out) < count:
        shard, at = divmod(begin + len(out), slots_per_shard)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            take = min(count - len(out), slots_per_shard - at, f.size() // (2 * length) - at)
            f.seek(at * 2 * length)
            x = np.frombuffer(f.read(take * 2 * length), "<u2").reshape(-1, length)
        if not take:
            break
        out += list(x)
    return out
