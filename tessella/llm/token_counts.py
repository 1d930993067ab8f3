"""Operator 6: token counts by source, language and tokenizer version, kept up to date by signed deltas.

A ledger is a folder of commits. A batch turns its changes into signed rows: an insert is +1 document and +n tokens,
a delete takes back exactly what the ledger holds for the document, a revision does both. Each batch
stores these rows and their partial totals; totals are the sum over batches, so nothing is ever recounted.

A batch's rows are written aside. What commits it is a marker file with the next version number, which only one writer can
create; one that comes second computes its rows again from the newer state, or finds that its batch was committed
meanwhile. A batch id that a marker names was committed, and applying it again changes nothing. compact() replaces the rows
so far by what they add up to, as a commit of its own, so that lookups don't read the whole history.
"""

from __future__ import annotations

import json
import re
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_batches, flat, SPACES, tidy
from tessella.llm.training_order import _tiktoken

KEY = ("source", "lang", "tokenizer_version")
_ROW = "doc_id long, source string, lang string, tokenizer_version string, documents long, tokens long"


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of bytes other than space and \\t to \\r in each text."""
    word = ~SPACES[data]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    begins = offsets[:-1]
    before[begins[begins < len(word)]] = False
    total = np.concatenate([[0], np.cumsum(word & ~before)])
    return total[offsets[1:]] - total[offsets[:-1]]


def count_tokens(df: DataFrame, ranks_path: str | None, bpe_version: str = "byte_bpe_50k", words_version: str = "words_v1") -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens for both tokenizers (words alone without ranks_path); null and empty
    texts have none. Rows stay rows."""
    arrow_batches(df.sparkSession)

    def run(batches):
        encoding = _tiktoken(ranks_path) if ranks_path else None
        for b in batches:
            counts = [(words_version, word_counts(*flat(b.column(3))))]
            if encoding:
                counts.append((bpe_version, [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(3).to_pylist()]))
            for version, n in counts:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([version] * b.num_rows), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer_version", "n_tokens"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
    return df.select(*cols).mapInArrow(tidy(run), "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


class Ledger:
    """Commits under a folder that all executors reach."""

    #: Seconds that a reader waits for a marker whose writer has created it and not filled it in yet.
    WAIT = 10.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("commits", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))
        self._seen: list[dict] = []

    def _marker(self, version: int) -> str:
        return f"{self.root}/commits/{version:010d}"

    def _commits(self) -> list[dict]:
        """All markers by version: batch (None for a compaction), folder, and since: the first version whose rows count. Markers never
        change, so only new ones are read."""
        while self._fs.exists(self._path(self._marker(len(self._seen)))):
            path, until = self._path(self._marker(len(self._seen))), time.monotonic() + self.WAIT
            while not (text := self._text(path)).endswith("\n"):
                if time.monotonic() > until:
                    raise RuntimeError(f"the commit {path.toString()} was broken off: remove this file, its batch was not committed")
                time.sleep(0.05)
            self._seen.append(json.loads(text))
        return self._seen

    def _text(self, path) -> str:
        size = self._fs.getFileStatus(path).getLen()
        if not size:
            return ""
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, version: int, entry: dict) -> bool:
        """Create the marker of the version; False where another writer was first."""
        path = self._path(self._marker(version))
        try:
            out = self._fs.create(path, False)
        except Exception as e:  # noqa: BLE001  a Java exception, which only its class tells from others
            if self._fs.exists(path):
                return False
            raise e
        try:
            out.write(bytearray((json.dumps(entry) + "\n").encode()))
        finally:
            out.close()
        return True

    def batches(self) -> list[str]:
        return sorted(c["batch"] for c in self._commits() if c["batch"] is not None)

    def _rows(self, what: str, schema: str) -> DataFrame:
        commits = self._commits()
        since = commits[-1]["since"] if commits else 0
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{c['folder']}/{what}" for c in commits[since:]])

    def documents(self, among: DataFrame | None = None) -> DataFrame:
        """What the ledger holds now: one row per document, tokenizer version, source and language; among: only for these doc_id and
        tokenizer_version, whose rows are picked before they are added up."""
        rows = self._rows("rows", _ROW)
        if among is not None:
            rows = rows.join(among, ["doc_id", "tokenizer_version"], "left_semi")
        return rows.groupBy("doc_id", *KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups without documents are left out."""
        t = self._rows("totals", "source string, lang string, tokenizer_version string, documents long, tokens long")
        return t.groupBy(*KEY).agg(F.sum("documents").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")

    def _written(self, name: str, rows: DataFrame) -> str:
        """Write rows and their totals aside; the folder's name."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/data/{folder}/rows")
        signed = self.spark.read.schema(_ROW).parquet(f"{self.root}/data/{folder}/rows")
        signed.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{self.root}/data/{folder}/totals")
        return folder

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit changes: doc_id, source, lang, tokenizer_version, n_tokens, op (insert, revise: the count from now on,
        wherever the document stood; delete: the rest of the row but doc_id and tokenizer_version is ignored).

        False where batch_id is committed already, by this or another writer. Deleting what isn't there and repeated rows change nothing; of
        several rows for one document and version a delete wins, then the largest count, then the last source and language. Null
        sources and languages are groups of their own; rows without doc_id, version, or count (but for a delete) are ignored.
        Batch ids are letters, digits, dots, dashes and underscores.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        c = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), *(F.col(k).cast("string").alias(k) for k in KEY),
            F.col("n_tokens").cast("long").alias("n"), (F.col("op") == "delete").alias("gone"),
        ).where("doc_id IS NOT NULL AND tokenizer_version IS NOT NULL AND (gone OR n IS NOT NULL)")
        last = c.groupBy("doc_id", "tokenizer_version").agg(F.max(F.struct("gone", "n", "source", "lang")).alias("x"))
        while True:
            commits = self._commits()
            if any(x["batch"] == batch_id for x in commits):
                return False
            version, since = len(commits), commits[-1]["since"] if commits else 0
            put = last.where("NOT x.gone").select("doc_id", "x.source", "x.lang", "tokenizer_version", F.lit(1).cast("long").alias("documents"), F.col("x.n").alias("tokens"))
            rows = put
            if version:
                held = self.documents(last.select("doc_id", "tokenizer_version"))
                rows = put.unionByName(held.select("doc_id", *KEY, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
            folder = self._written(batch_id, rows)
            if self._commit(version, {"batch": batch_id, "folder": folder, "since": since}):
                return True
            self._drop(folder)  # another writer has committed meanwhile: its state is the one to start from

    def compact(self) -> None:
        """Replace the rows of all commits by what they add up to. Their folders stay, as readers may still use them."""
        while version := len(self._commits()):
            folder = self._written("compact", self.documents())
            if self._commit(version, {"batch": None, "folder": folder, "since": version}):
                return
            self._drop(folder)
