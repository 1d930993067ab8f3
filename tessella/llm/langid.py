"""Operator 9: language identification with a blended-spectrum presence kernel, Nystrom landmarks and kernel ridge regression.

k(x, y) counts the byte n-grams of 1 to 3 bytes that x and y both hold, divided by the geometric mean of what each
holds. Landmarks are labelled texts, spread over the languages; what is counted are all n-grams that a landmark holds.
phi(x) = K_mm^(-1/2) k(x, landmarks); one ridge regression per language (that language against the rest) over phi.
Texts are scored whole in blocks: a presence matrix of texts by n-grams times the landmarks' is one matrix product.

A text is of a language that wasn't learned where hardly any of its n-grams is known from the landmarks; more languages make
more n-grams known, so none of them costs documents of another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_batches, flat, _LOWER, tidy

#: Texts in a block of the presence matrix, bytes of text in it, and entries of the matrix.
BLOCK, BLOCK_BYTES, BLOCK_CELLS = 128, 1 << 20, 8 << 20
#: Bytes of text whose n-grams are looked up at once.
LOOKED_UP = 4 << 20


def _codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, their texts, and the codes of the 2 and 3 bytes from each byte on."""
    b = _LOWER[data].astype(np.int32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    two = b[:-1] << 8 | b[1:] if len(b) > 1 else np.zeros(0, np.int32)
    three = two[:-1] << 8 | b[2:] if len(b) > 2 else np.zeros(0, np.int32)
    return b, row, two, three


def _presence(model_tables, data, off) -> np.ndarray:
    """Texts x features, 0 or 1."""
    two_t, three_t, features = model_tables
    n = len(off) - 1
    b, row, two, three = _codes(data, off)
    m = np.zeros((n, features + 1), np.uint8)
    at = m.ravel()
    base = row.astype(np.int64) * (features + 1)
    at[base + two_t["one"][b]] = 1
    if len(two):
        same = row[:-1] == row[1:]
        at[(base[:-1] + two_t["two"][two])[same]] = 1
    if len(three):
        same = row[:-2] == row[2:]
        at[(base[:-2] + three_t[three])[same]] = 1
    return m[:, :features]


def _tables(grams1, grams2, grams3):
    """Lookup tables from codes to features; the last feature stands for none."""
    features = len(grams1) + len(grams2) + len(grams3)
    one = np.full(256, features, np.int32)
    one[grams1] = np.arange(len(grams1))
    two = np.full(1 << 16, features, np.int32)
    two[grams2] = len(grams1) + np.arange(len(grams2))
    three = np.full(1 << 24, features, np.uint16 if features < 65536 else np.int32)
    three[grams3] = len(grams1) + len(grams2) + np.arange(len(grams3))
    return {"one": one, "two": two}, three, features


def _kernel(presence: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    x = presence.astype(np.float32)
    n = np.sqrt(x.sum(axis=1, dtype=np.float64))
    return (x @ landmarks).astype(np.float64) / np.maximum(n[:, None] * norms[None, :], 1e-12)


def fit(texts: list[str], languages: list[str], landmarks: int = 96, ridge: float = 1e-3) -> dict:
    """Train on a list of labelled texts. landmarks: in all, dealt to the languages in turn, one of each at least. Returns what Scorer takes."""
    names = sorted(set(languages))
    by = {k: [i for i, x in enumerate(languages) if x == k] for k in names}
    chosen = sorted({by[k][j] for k in names for j in range(min(len(by[k]), max(1, landmarks // len(names))))})
    raw = [t.encode("utf-8", "replace") for t in texts]

    def joined(which):
        parts = [raw[i] for i in which]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    data, off = joined(chosen)
    b, row, two, three = _codes(data, off)
    g1 = np.unique(b)
    g2 = np.unique(two[row[:-1] == row[1:]]) if len(two) else np.zeros(0, np.int32)
    g3 = np.unique(three[row[:-2] == row[2:]]) if len(three) else np.zeros(0, np.int32)
    tables = _tables(g1, g2, g3)
    z = _presence(tables, data, off).astype(np.float32).T
    norms = np.sqrt(z.sum(axis=0, dtype=np.float64))
    k_mm = (z.T @ z).astype(np.float64) / np.maximum(norms[:, None] * norms[None, :], 1e-12)
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors @ np.diag(np.where(values > 1e-8 * values.max(), values, np.inf) ** -0.5) @ vectors.T
    m = len(chosen)
    gram, right = np.zeros((m + 1, m + 1)), np.zeros((m + 1, len(names)))
    for i in range(0, len(raw), BLOCK):
        data, off = joined(range(i, min(i + BLOCK, len(raw))))
        phi = np.hstack([_kernel(_presence(tables, data, off), z, norms) @ root, np.ones((len(off) - 1, 1))])
        y = np.where(np.array(languages[i : i + BLOCK])[:, None] == np.array(names)[None, :], 1.0, -1.0)
        gram += phi.T @ phi
        right += phi.T @ y
    w = np.linalg.solve(gram + ridge * len(raw) * np.eye(m + 1), right)
    return {"languages": names, "grams": (g1, g2, g3), "landmarks": z, "norms": norms, "weights": root @ w[:m], "bias": w[m]}


class Scorer:
    """Scores texts in blocks with what fit() has returned."""

    def __init__(self, model: dict):
        self.model, self.tables = model, _tables(*model["grams"])
        self.block = max(1, min(BLOCK, BLOCK_CELLS // max(1, self.tables[2])))

    def known(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text the share of its 3-byte places (of a shorter text: of 2 bytes, of 1) whose n-gram a landmark holds; empty: 0."""
        n, features, parts = len(off) - 1, self.tables[2], LOOKED_UP
        held, places = np.zeros((3, n)), np.maximum(np.diff(off)[None, :] - np.arange(3)[:, None], 0)
        for a in range(0, len(data), parts):  # 3-byte places may reach two bytes beyond a part
            c, d = (int(np.searchsorted(off, x, "right")) for x in (a, min(len(data), a + parts + 2) - 1))
            inner = np.clip(off[c - 1 : d + 1] - a, 0, min(len(data), a + parts + 2) - a)
            b, row, two, three = _codes(data[a : a + parts + 2], inner)
            for j, (codes, table) in enumerate(((b, self.tables[0]["one"]), (two, self.tables[0]["two"]), (three, self.tables[1]))):
                same = (row[: len(codes)] == row[j:]) & (np.arange(len(codes)) < parts)
                held[j, c - 1 : d] += np.bincount(row[: len(codes)][same], weights=table[codes[same]] < features, minlength=d - c + 1)
        size = np.clip(np.diff(off), 1, 3) - 1
        at = np.arange(n)
        return held[size, at] / np.maximum(places[size, at], 1)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts x languages; a text longer than a block is a block of its own, read in parts whose presence is joined."""
        m, out, i, n = self.model, [], 0, len(off) - 1
        while i < n:
            j = i + 1
            while j < n and j - i < self.block and off[j + 1] - off[i] <= BLOCK_BYTES:
                j += 1
            if off[j] - off[i] <= BLOCK_BYTES:
                x = _presence(self.tables, data[off[i] : off[j]], off[i : j + 1] - off[i])
            else:
                x = np.zeros((1, self.tables[2]), np.uint8)
                for a in range(int(off[i]), int(off[j]), BLOCK_BYTES):
                    part = data[a : min(a + BLOCK_BYTES + 2, int(off[j]))]
                    x |= _presence(self.tables, part, np.array([0, len(part)]))
            out.append(_kernel(x, m["landmarks"], m["norms"]) @ m["weights"] + m["bias"])
            i = j
        return np.concatenate(out) if out else np.zeros((0, len(m["languages"])))


def train(labelled: DataFrame, per_language: int = 600, **how) -> dict | None:
    """Fit on about per_language texts of each language of labelled (doc_id, text, lang): those whose hashed doc_id falls
    below per_language / the language's count. This bound is the documented parameter of the training sample; None without rows.
    A language of one row is learned from that row."""
    rows = labelled.where(F.col("lang").isNotNull() & has_letter("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    h = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("h")
    # a row for each language, of which the model itself holds hundreds of texts: smaller than what the driver trains on
    sample = rows.join(F.broadcast(counts), "lang").where(h * F.col("n") < per_language)
    got = sample.select("doc_id", "text", "lang").orderBy("lang", F.xxhash64("doc_id"), "doc_id", "text").collect()
    return fit([r.text for r in got], [r.lang for r in got], **how) if got else None


def has_letter(col: str) -> Column:
    return F.coalesce(F.col(col).rlike(r"\p{L}"), F.lit(False))


def held_out(col: str = "doc_id") -> Column:
    """Rows that must not be learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score (0 to 1).

    score is the winner's share of all languages' scores, each clipped to 0 to 1 from -1 to 1. Text that is null or has no letter, and every
    text where there is no model, is `und` with score 0. Ties go to the first language by name. Repeated rows
    stay; other columns are ignored; an empty table gives an empty one.
    """
    arrow_batches(df.sparkSession)
    schema = "doc_id long, lang_pred string, score double"

    def run(batches):
        scorer = Scorer(model) if model else None
        for b in batches:
            names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            ok = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if scorer and ok.any():
                s = scorer.scores(*flat(b.column(1).filter(pa.array(ok))))
                best = s.argmax(axis=1)
                share = np.clip((s + 1) / 2, 0, 1)
                names[ok] = np.array(model["languages"], object)[best]
                score[ok] = share[np.arange(len(best)), best] / np.maximum(share.sum(axis=1), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), has_letter(text_col).alias("ok")).mapInArrow(tidy(run), schema)


def reject_unidentified(df: DataFrame, model: dict | None, min_known: float = 0.1, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of df, with all their columns, whose language is known: text with a letter, of whose n-grams the share min_known at least
    is known to the landmarks. Null, empty and letterless texts go; without a model (no labelled row) all others stay.
    lang_col: this column becomes the predicted language (`und` without a model), whatever it held."""
    arrow_batches(df.sparkSession)
    if model is None:
        rows = df.where(has_letter(text_col))
        return rows.withColumn(lang_col, F.lit("und")) if lang_col else rows
    at = df.columns.index(text_col)
    to = df.columns.index(lang_col) if lang_col else None

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            b = b.filter(pa.array(scorer.known(*flat(b.column(at))) >= min_known))
            if to is not None and b.num_rows:
                best = scorer.scores(*flat(b.column(at))).argmax(axis=1)
                b = b.set_column(to, lang_col, pa.array([model["languages"][i] for i in best], pa.string()))
            yield b

    return df.where(has_letter(text_col)).mapInArrow(tidy(run), df.schema)


def language_id(df: DataFrame, per_language: int = 600, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of df (doc_id, text, lang): trains on rows that aren't held out, predicts all."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs.where(~held_out()), per_language, **how)
    return identify_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
