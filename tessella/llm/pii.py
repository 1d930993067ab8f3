"""Operator 8: personal data by weak supervision.

Fixed patterns give the base spans. Wider candidate patterns give spans that may be personal data as well: telephone
numbers without a plus, e-mail addresses written with words, names after a title, and secrets. Labelers of three
sorts look at each span, base or candidate: regular expressions on the span, gazetteers (word lists), and the words around it. Each
votes for, against, or not at all. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and a posterior for each pattern; a logistic regression trained on these posteriors, with votes and
shape as features, is the final span classifier. Base spans always stay; the classifier decides which candidates join them.

Counts of patterns are gathered over the whole corpus; their number is bounded by the labelers, not by the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.common import arrow_batches, tidy

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

_LOOSE_PHONE = re.compile(r"(?<![0-9+.,/:-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){2,4}(?![0-9.,/:-]*[0-9])")
_WORDED_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]{2,40} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,40}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,20})+\b")
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra)\.? ([A-ZÀ-Þ][a-zß-ÿ]{1,20}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,20})?)")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Sr")
#: Gazetteers: given names, top-level domains, prefixes of keys.
GIVEN_NAMES = frozenset("anna ana anne carlos claire david elena emma hans jan jean john jose juan julia karl laura luis maria marie mark martin mary michael paul peter pierre robert sarah sofia thomas".split())
DOMAINS = frozenset("com org net edu gov de fr es uk io info".split())
KEY_PREFIXES = ("AKIA", "ghp_", "sk-", "xoxb-", "glpat-")
#: Words before a span that speak for its kind, and words that speak against any.
BEFORE = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "karte", "carte", "tarjeta"), "phone": ("tel", "phone", "call", "fax", "mobile", "handy"),
    "name": ("dear", "by", "contact", "sincerely"), "secret": ("password", "passwd", "token", "secret", "key", "pwd"),
}
AGAINST = ("version", "page", "isbn", "invoice", "order", "sha256", "commit", "figure", "table")
#: What the counts of vote patterns are scaled to sum up to, however large the corpus.
TOTAL = 10_000.0
LABELERS = ("regex", "checksum", "gazetteer", "before", "against", "surroundings")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _entropy(s: str) -> float:
    n = np.array([s.count(c) for c in set(s)]) / len(s)
    return float(-(n * np.log2(n)).sum())


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider patterns that overlap no base span and no candidate before them."""
    out, taken = [], []
    for _, s, e in sorted(base, key=lambda x: x[1:]):  # what base spans cover, as runs that don't touch inside
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))

    def add(kind, s, e):
        i = bisect_right(taken, (s, e))
        if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
            insort(taken, (s, e))
            out.append((kind, s, e))

    if " at " in text and " dot " in text or "[at]" in text or "(at)" in text:
        for m in _WORDED_EMAIL.finditer(text):
            add(0, m.start(), m.end())
    if _DIGIT.search(text):
        for m in _SECRET.finditer(text):
            w = m[0]
            if _DIGIT.search(w) and not w.isdigit() and any(c.isalpha() for c in w):
                s, e = m.start(), m.end()
                if "=" in w[:-2]:
                    s += w[:-2].rindex("=") + 1
                if e - s >= 16:
                    add(5, s, e)
        for m in _LOOSE_PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                add(3, m.start(), m.end())
    if any(t in text for t in _TITLES):
        for m in _NAME.finditer(text):
            add(4, m.start(1), m.end(1))
    return out


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> tuple:
    """(kind, base or not, votes of LABELERS, length bucket, share of digits): a bounded number of patterns."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    name, digits = KINDS[kind], _NOT_DIGIT.sub("", span)
    regex = 1 if is_base else 0
    checksum = gazetteer = 0
    if name == "card":
        checksum = 1 if luhn(digits) else -1
    elif name == "phone":
        checksum = -1 if len(set(digits)) < 3 else 1 if 10 <= len(digits) <= 13 else 0
        regex = 1 if is_base or re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span) else 0
    elif name == "secret":
        checksum = 1 if _entropy(span) >= 3.2 else -1
        gazetteer = 1 if span.startswith(KEY_PREFIXES) else 0
        regex = 1 if re.fullmatch(r"[0-9a-f]{16,64}|AKIA[0-9A-Z]{16}|[A-Za-z0-9+/]{32,}={0,2}", span) else -1 if span.count("-") > 2 else 0
    elif name == "ip":
        checksum = 1 if len(span) <= 15 else -1
    if name == "email":
        gazetteer = 1 if re.split(r"[^a-z0-9]", span.lower())[-1] in DOMAINS else -1
    elif name == "name":
        gazetteer = 1 if span.split(" ")[0].lower() in GIVEN_NAMES else -1
        regex = 1 if " " in span else 0
    near = 1 if any(w in before for w in BEFORE[name]) else 0
    against = -1 if any(w in before for w in AGAINST) else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    surroundings = -1 if any(c.isalnum() for c in around) else 1 if around.strip(" \n\t\"',.;:()[]<>=") == "" else 0
    return kind, int(is_base), regex, checksum, gazetteer, near, against, surroundings, min(4, (end - start) // 8), min(4, 5 * len(digits) // max(1, end - start))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that a pattern is personal data, and for each labeler P(vote | clean or personal) of -1, 0, 1.

    A naive Bayes mixture of two classes with a prior for each kind; starts from the mean vote; base spans are known."""
    v, kind, base = patterns[:, 2 : 2 + len(LABELERS)] + 1, patterns[:, 0], patterns[:, 1] == 1
    p = np.where(base, 0.99, np.clip(0.35 + 0.2 * (v - 1).sum(axis=1), 0.05, 0.95))
    for _ in range(rounds):
        table = np.ones((len(LABELERS), 2, 3))
        for j in range(len(LABELERS)):
            for value in range(3):
                at = v[:, j] == value
                table[j, 1, value] += (counts * p)[at].sum()
                table[j, 0, value] += (counts * (1 - p))[at].sum()
        table[:, 0] += np.array([4, 2, 1])  # a vote for personal data is rarer on clean spans than one against
        table /= table.sum(axis=2, keepdims=True)
        prior = np.array([(1 + (counts * p)[kind == k].sum()) / (2 + counts[kind == k].sum()) for k in range(len(KINDS))])
        ratio = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(len(LABELERS)):
            ratio = ratio + np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]])
        new = np.where(base, 0.99, 1 / (1 + np.exp(-np.clip(ratio, -30, 30))))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, table


def _features(patterns: np.ndarray) -> np.ndarray:
    kind = np.eye(len(KINDS))[patterns[:, 0]]
    v = patterns[:, 2 : 2 + len(LABELERS)]
    return np.hstack([kind, v == 1, v == -1, np.eye(5)[patterns[:, 8]], np.eye(5)[patterns[:, 9]]]).astype(float)


def train_classifier(patterns: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on the posteriors, by Newton steps.

    Counts enter as shares of a fixed total: ridge and smoothing, and so the weights, are those of any multiple of the corpus."""
    weight = counts * (TOTAL / counts.sum())
    p, _ = expectation_maximisation(patterns, weight)
    x, w = _features(patterns), np.zeros(_features(patterns[:1]).shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - q)) - ridge * w
        hessian = x.T @ (x * (weight * q * (1 - q))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")


def fit(df: DataFrame, text_col: str = "text") -> np.ndarray | None:
    """Weights of the span classifier from vote patterns of all rows; None where no span is found."""
    arrow_batches(df.sparkSession)

    def count(batches):
        seen: dict = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                for spans, is_base in ((base, True), (candidate_spans(text, base), False)):
                    for k, s, e in spans:
                        key = votes(text, k, s, e, is_base)
                        seen[key] = seen.get(key, 0) + 1
        if seen:
            keys = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())], names=["key", "n"])

    got = _texts(df, text_col).mapInArrow(tidy(count), "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    if not got:
        return None
    return train_classifier(np.array([r.key for r in got]), np.array([r.n for r in got], float))


def spans_of(text: str, weights: np.ndarray | None, threshold: float) -> tuple[list, list]:
    """(base spans, all spans), each by kind and start."""
    base = base_spans(text)
    if weights is None:
        return base, base
    extra = candidate_spans(text, base)
    if not extra:
        return base, base
    x = _features(np.array([votes(text, k, s, e, False) for k, s, e in extra]))
    keep = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) >= threshold
    return base, sorted(base + [c for c, k in zip(extra, keep) if k])


def find_pii(df: DataFrame, weights: np.ndarray | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, base and spans, each an array of struct(kind, start, end) by kind as in KINDS, then start.

    Offsets are code points, the end exclusive. Null and empty texts have no spans. Repeated rows stay; other columns are
    ignored; an empty table gives an empty one. Without weights, spans are the base ones.
    """
    arrow_batches(df.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for b in batches:
            both = [spans_of(t or "", weights, threshold) for t in b.column(1).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x[j]] for x in both], pa.list_(span)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])

    s = "array<struct<kind:string,start:int,end:int>>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id long, base {s}, spans {s}")


def redact(df: DataFrame, weights: np.ndarray | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """df with each span of the text replaced by its kind in brackets, like [EMAIL]; of overlapping spans the one that
    begins first, then the longer, decides how far. Null texts stay null."""
    arrow_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def clean(text):
        if not text:
            return text
        _, spans = spans_of(text, weights, threshold)
        if not spans:
            return text
        out, last = [], 0
        for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
            if s >= last:
                out += [text[last:s], f"[{KINDS[k].upper()}]"]
            last = max(last, e)
        return "".join([*out, text[last:]])

    def run(batches):
        for b in batches:
            text = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, b.schema.field(at).with_type(pa.string()), text)

    return df.mapInArrow(tidy(run), StructType(list(df.schema.fields)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def joined(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def pii(df: DataFrame) -> DataFrame:
    return digest(find_pii(df, fit(df)))
