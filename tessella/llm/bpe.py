"""Operator 2: BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the last bytes cuts each text where the hash says so, so a passage that several documents
share falls into the same chunks wherever it stands. A chunk is encoded once and its result reused; what a cut
tears apart is repaired: the stretch from the last agreement point before the cut to the first one after it, over as many
chunks as it takes, is encoded anew. Agreement points are white space. That a file's tokens end there is tried out when it is
loaded, and at each join whose stretch hasn't been met before: the stretch is encoded together with its neighbours, whose tokens
must come out as they were. Where they don't, the text is encoded as a whole. So the result is always that of the whole text.
Within a chunk the stretches between agreement points are looked up by the same rule, which makes new chunks cheap. Of a stretch not met
before that is Latin letters and punctuation after them, the letters go to the file's model as its normaliser and pre-tokenizer give them,
which saves these two, and once for all ways to write them; that this gives the file's tokens is tried out when it is loaded as well.

Reuse is held per Python worker, from one task to the next, in tables of bounded bytes; results don't depend on it.
"""

from __future__ import annotations

import gc
import itertools
import os
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.llm.common import arrow_batches, flat, tidy

#: Bytes that the rolling hash sees, bits of it that must be zero at a cut (512 bytes a chunk), least bytes of a chunk.
ROLL, CUT_BITS, LEAST = 16, 9, 64
#: Bytes that a worker keeps, about: encoded stretches and encoded chunks, each in two generations of so many.
STRETCH_BYTES, CHUNK_BYTES = 50_000_000, 8_000_000
#: Bytes of results in an Arrow batch.
OUT_BYTES = 8_000_000
#: Bytes of texts whose stretches are looked up together.
AT_ONCE = 256_000
#: Plain stretches: letters and ASCII punctuation after them, without those characters that begin a contraction or an added token.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *(i for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))]))
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_PLAIN = re.compile(f"([{_LETTERS}]+)([{re.escape(_MARKS)}]{{0,8}})")
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; they depend on the ROLL bytes before them, and on LEAST."""
    n = len(data)
    if n <= LEAST:
        return np.array([n])
    g = _GEAR[data]
    h = g.copy()
    for i in (1, 2, 4, 8):  # the sum over 16 bytes, byte j shifted by j bits
        h[i:] += h[:-i] << np.uint32(i)
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for c in at[(at >= LEAST) & (at < n)].tolist():
        if c - last >= LEAST:
            out.append(c)
            last = c
    return np.array([*out, n])


class Disagreement(Exception):
    """Tokens around a join came out otherwise than without it."""


class Table:
    """Values by bytes in two generations: when the younger is full, the older one goes. What is an eighth of the limit at once isn't kept."""

    def __init__(self, limit: int):
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}

    def get(self, key: bytes):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
        return got

    def put(self, key: bytes, value: tuple, size: int) -> None:
        if 8 * size > self.limit:
            return
        if self.size + size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += size


def parted(raw: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """What stands before the first white space, the stretches between and what stands after the last; None without any."""
    pieces = raw.split()
    if pieces and len(pieces[0]) == len(raw):
        return None
    head = b"" if raw[:1].isspace() else pieces.pop(0)
    tail = b"" if raw[-1:].isspace() else pieces.pop()
    return head, pieces, tail


class Encoder:
    """Encodes byte strings with a tokenizers file; keeps what it has seen."""

    def __init__(self, path: str, stretch_bytes: int = STRETCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.token = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.decimal = {i: str(i) for i in self.token}
        self.stretches, self.chunks = Table(stretch_bytes), Table(CHUNK_BYTES)
        self.encoded = self.reused = 0
        self.agrees = self._agrees()
        self.letters, self.folds = self._letters() if self.agrees else (None, False)

    def _agrees(self) -> bool:
        """Whether white space ends tokens: texts with each kind of it between pieces of the vocabulary have the tokens of the pieces."""
        r = random.Random(11)
        pieces = [t.replace("</w>", "") for t in sorted(self.token.values())]
        pieces = [p for p in pieces if p and not any(c.isspace() for c in p)]
        for _ in range(300):
            some = r.sample(pieces, min(4, len(pieces)))
            gap = [r.choice([" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " \n "]) for _ in some]
            if self._ids("".join(g + p for g, p in zip(gap, some)) + gap[0]) != [i for p in some for i in self._ids(p)]:
                return False
        return True

    def _letters(self) -> tuple[dict[int, str] | None, bool]:
        """What the model gets for each letter, and whether that is the same for both cases; None where plain stretches don't come out
        as their letters' and their punctuation's tokens, by trial, or could hold an added token."""
        t = self.tokenizer
        if any(set(x.content) <= {*_LETTERS, *_MARKS} for x in t.get_added_tokens_decoder().values()):
            return None, False
        table = {}
        for c in _LETTERS:
            parts = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(c) if t.normalizer else c) if t.pre_tokenizer else []
            if len(parts) != 1:
                return None, False
            table[ord(c)] = parts[0][0]
        r, folds = random.Random(12), all(table[ord(c)] == table.get(ord(c.lower())) for c in _LETTERS)
        for i in range(1000):
            some = "".join(r.choices(_LETTERS if i % 2 else _LETTERS[:52], k=r.randint(1, 14)))
            marks = "".join(r.choices(_MARKS, k=r.randint(0, 8)))
            if self._ids(some + marks) != [x.id for x in t.model.tokenize(some.translate(table))] + (self._ids(marks) if marks else []):
                return None, False
        return table, folds

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _value(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.decimal[j] for j in ids]), " ".join([self.token[j] for j in ids])

    def whole(self, text: bytes) -> tuple[int, str, str]:
        return self._value(self._ids(text.decode("utf-8")))

    def _fresh(self, pieces: list[bytes]) -> dict[bytes, tuple[str, str]]:
        """Encodings of stretches that were not met before, and of letters and punctuation in them."""
        made, rest, plain, model = {}, [], [], self.tokenizer.model
        for p in pieces:
            m = _PLAIN.fullmatch(p.decode("utf-8")) if self.letters else None
            if m is None:
                rest.append(p)
                continue
            some = m[1].lower() if self.folds else m[1]
            key, marks = some.encode(), m[2].encode()
            if key not in made:
                made[key] = self.stretches.get(key) or self._value([x.id for x in model.tokenize(some.translate(self.letters))])[1:]
            if marks and marks not in made:
                made[marks] = self.stretches.get(marks) or self._value(self._ids(m[2]))[1:]
            if key != p:
                plain.append((p, key, marks))
        for p, key, marks in plain:
            made[p] = made[key] if not marks else tuple([" ".join([x for x in both if x]) for both in zip(made[key], made[marks])])
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in part], add_special_tokens=False)):
                made[p] = self._value(e.ids)[1:]
        return made

    def words(self, pieces: dict[bytes, None]) -> dict[bytes, tuple[str, str]]:
        """Ids and tokens of stretches that stand between white space."""
        young, old = self.stretches.young.get, self.stretches.old.get
        found, kept, new = {}, {}, []
        for p in pieces:
            got = young(p)
            if got is None:
                got = old(p) if p else ("", "")
                if got is None:
                    new.append(p)
                    continue
                kept[p] = got
            found[p] = got
        kept |= self._fresh(new)
        for p, v in kept.items():
            found[p] = v
            self.stretches.put(p, v, 300 + len(p) + len(v[0]) + len(v[1]))
        return found

    def join(self, before: bytes, torn: bytes, after: bytes) -> tuple[str, str]:
        """Encoding of a stretch that was torn by cuts. One that wasn't met before is encoded between the words around it."""
        got = self.stretches.get(torn)
        if got is None:
            ids = self._ids(b" ".join([before, torn, after]).decode("utf-8"))
            around = self.words({before: None, after: None})
            left, right = around[before][0], around[after][0]
            n, m = (x.count(" ") + 1 if x else 0 for x in (left, right))
            if len(ids) < n + m or " ".join(map(str, ids[:n])) != left or " ".join(map(str, ids[len(ids) - m :])) != right:
                raise Disagreement
            got = self._value(ids[n : len(ids) - m])[1:]
            self.stretches.put(torn, got, 300 + len(torn) + len(got[0]) + len(got[1]))
        return got

    def chunked(self, texts: list[list[bytes]]) -> dict[bytes, tuple]:
        """By chunk: what stands before the first agreement point, the first and last word and the encoding between, and what stands
        after the last; (chunk,) where there is no agreement point."""
        out, new, words = {}, {}, {}
        for raw in itertools.chain.from_iterable(texts):
            got = out.get(raw) or new.get(raw) or self.chunks.get(raw)
            if got is not None:
                self.reused += 1
                if raw not in new:
                    out[raw] = got
                continue
            self.encoded += 1
            got = parted(raw)
            if got is None:
                out[raw] = (raw,)
                self.chunks.put(raw, (raw,), 300 + len(raw))
            else:
                new[raw] = got
                words.update(dict.fromkeys(got[1]))
        words = self.words(words)
        for raw, (head, inner, tail) in new.items():
            found = [words[p] for p in inner]
            ends = (inner[0], inner[-1]) if inner else (b"", b"")
            got = (head, *ends, " ".join([f[0] for f in found if f[0]]), " ".join([f[1] for f in found if f[0]]), tail)
            out[raw] = got
            self.chunks.put(raw, got, 300 + len(raw) + len(got[3]) + len(got[4]))
        return out

    def encode(self, text: bytes) -> tuple[int, str, str]:
        """Number of tokens, decimal ids and tokens, each joined by one space."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """The same of several texts, whose new stretches are encoded together."""
        if not self.agrees:
            return [self.whole(t) if t else (0, "", "") for t in texts]
        parts = []
        for t in texts:
            ends = cuts(np.frombuffer(t, np.uint8)).tolist() if t else []
            parts.append([t[i:j] for i, j in zip([0, *ends], ends)])
        known, out = self.chunked(parts), []
        for t, raws in zip(texts, parts):
            try:
                out.append(self._joined(raws, known))
            except Disagreement:
                out.append(self.whole(t))
        return out

    def _joined(self, raws: list[bytes], known: dict[bytes, tuple]) -> tuple[int, str, str]:
        ids, toks, torn, before = [], [], [], b""

        def add(i, t):
            if i:
                ids.append(i)
                toks.append(t)

        for raw in raws:
            got = known[raw]
            torn.append(got[0])
            if len(got) > 1:  # agreement is reached within this chunk: repair the join before it
                _, first, last, *inner, tail = got
                if stretch := b"".join(torn):
                    add(*self.join(before, stretch, first))
                    before = stretch
                add(*inner)
                before, torn = last or before, [tail]
        if stretch := b"".join(torn):
            add(*self.join(before, stretch, b""))
        text = " ".join(ids)
        return text.count(" ") + 1 if text else 0, text, " ".join(toks)


@lru_cache(maxsize=1)
def _encoder(path: str, stretch_bytes: int) -> Encoder:
    """Held by the Python worker, which serves one task after the other."""
    return Encoder(path, stretch_bytes)


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", stretch_bytes: int = STRETCH_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids (decimal, joined by one space), decoded, and the carried columns of df as they are.

    ids are those of the tokenizers library on the whole text without special tokens added, decoded is its decode()
    with special tokens kept, for a file without a decoder: tokens joined by one space. Null and empty texts have no tokens and
    empty strings. Repeated rows stay repeated; other columns are ignored; an empty table gives an empty one.
    stretch_bytes: what a worker keeps of encoded stretches in a generation, memory against time.
    Where white space doesn't end the file's tokens, texts are encoded as wholes. All executors must have the file.
    """
    arrow_batches(df.sparkSession)

    def run(batches):
        encoder = _encoder(tokenizer_path, stretch_bytes)
        for b in batches:
            data, off = flat(b.column(1))
            raw = data.tobytes()
            held, size, begin, i = [], 0, 0, 0

            def out():
                return pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, len(held)), *(pa.array([h[j] for h in held], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))), *(b.column(2 + j).slice(begin, len(held)) for j in range(len(carried)))],
                    names=["doc_id", "n_tokens", "ids", "decoded", *carried],
                )

            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + AT_ONCE, "right")) - 1)
                gc.disable()  # the tables' many tuples hold no cycles, and looking for some in them takes a fifth of the time
                try:
                    made = encoder.encode_all([raw[off[k] : off[k + 1]] for k in range(i, j)])
                finally:
                    gc.enable()
                i, held, size = j, held + made, size + sum([len(e[1]) + len(e[2]) for e in made])
                if size > OUT_BYTES:
                    yield out()
                    held, size, begin = [], 0, i
            if held:
                yield out()

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    more = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    return df.select(*cols, *carried).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids string, decoded string" + more)


def token_ids(encoded: DataFrame) -> DataFrame:
    """The ids as array<int>."""
    ids = F.when(F.col("ids") == "", F.expr("CAST(array() AS array<int>)")).otherwise(F.split("ids", " ").cast("array<int>"))
    return encoded.withColumn("ids", ids)


def decode_ids(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (in place of any such column) for a column of decimal ids joined by spaces; null: empty. Unknown ids give no token."""
    df = df.drop("decoded")

    def run(batches):
        token = _encoder(tokenizer_path, STRETCH_BYTES).token
        for b in batches:
            col = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            text = [" ".join([token[int(i)] for i in (x or "").split(" ") if i and int(i) in token]) for x in col]
            yield b.append_column("decoded", pa.array(text, pa.string()))

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, StructField("decoded", StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text; further columns follow as they are."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *encoded.columns[4:])
