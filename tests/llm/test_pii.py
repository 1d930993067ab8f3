import hashlib
import random
import re

import numpy as np

from tessella.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 13 <= len(d) <= 19 and P.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_match_patterns():
    r = random.Random(4)
    for alphabet in ("ab@.-1", "0123456789.-+ ()", "a1@+ .-9é", "@@..aa11++"):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert P.base_spans(t) == brute(t), t


def rows():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(300):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            w[10] = r.choice(["me.7@mail.example.com", "+1 (555) 123-4567", "10.0.0.1", "4111 1111 1111 1111", "password=b7db7aa4a5fcc78305", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "call 555-123-4567", "Mr. John Smith"])
        if i % 50 == 7:
            w[3] = "version 12-34-56-78-90"
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, "é 1.2.3.4 \U0001f600 a@b.c"), (902, "é 1.2.3.4 \U0001f600 a@b.c"), (None, "x@y.z")]


def test_query_digest(spark):
    data = rows()
    df = spark.createDataFrame([(*x, 1, "z") for x in data], "doc_id long, text string, spans int, base string")
    got = P.pii(df).collect()
    assert len(got) == len(data)
    texts = dict(data)
    for g in got:
        b = brute(texts[g.doc_id] or "")
        line = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in b)
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == j for k, _, _ in b) for j in range(4)]
        assert set(filter(None, line.split(","))) <= set(g.spans.split(","))
    added = {texts[g.doc_id][int(s):int(e)] for g in got for k, s, e in [x.split(":") for x in g.spans.split(",") if x] if k in ("secret", "name")}
    assert {"b7db7aa4a5fcc78305", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"} <= added
    clean = P.redact(df, P.fit(df))
    assert clean.columns == df.columns
    by = {x.doc_id: x.text for x in clean.collect()}
    assert by[902] == "é [IP] \U0001f600 [EMAIL]" and by[900] is None and by[901] == ""
    assert by[1] == texts[1]


def test_em_finds_reliable_labelers():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.4
    vote = lambda acc: np.where(r.random(20000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    v = np.stack([vote(a) for a in (0.95, 0.9, 0.85, 0.6, 0.55, 0.9)], axis=1)
    full = np.hstack([np.full((20000, 1), 3), np.zeros((20000, 1), int), v, np.zeros((20000, 2), int)])
    keys, inverse, n = np.unique(full, axis=0, return_inverse=True, return_counts=True)
    p, table = P.expectation_maximisation(keys, n.astype(float))
    assert ((p[inverse.ravel()] > 0.5) == y).mean() > 0.97
    assert table[0, 1, 2] > 0.9 and 0.45 < table[4, 1, 2] < 0.65


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pii(df).count() == 0 and P.fit(df) is None
    blank = spark.createDataFrame([(1, None), (2, "nothing")], "doc_id long, text string")
    assert {x.spans for x in P.pii(blank).collect()} == {""}


def test_weights_do_not_depend_on_the_size_of_the_corpus(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    seen = {}
    for _, t in rows():
        base = P.base_spans(t or "")
        for spans, is_base in ((base, True), (P.candidate_spans(t or "", base), False)):
            for x in spans:
                key = P.votes(t, *x, is_base)
                seen[key] = seen.get(key, 0) + 1
    patterns, counts = np.array(sorted(seen)), np.array([seen[k] for k in sorted(seen)], float)
    once = P.train_classifier(patterns, counts)
    assert np.allclose(once, P.fit(df), atol=1e-6)
    for times in (3, 100_000):
        assert np.allclose(once, P.train_classifier(patterns, times * counts), atol=1e-6)
    assert np.allclose(once, P.fit(df.unionAll(df).unionAll(df)), atol=1e-6)


def test_long_secrets_and_leading_zeros():
    r = random.Random(2)
    for n in (17, 200, 201, 210, 400, 2000):
        key = "a1" + "".join(r.choice("abcdefghijkLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n - 2))
        text = f'token "{key}" end'
        assert P.candidate_spans(text, P.base_spans(text)) == [(5, 7, 7 + n)]
    for part in ("0" * 250 + "1", "0" * 300, "0" * 300 + "256", "1" * 300, "000255"):
        text = f"host {part}.2.3.4 up"
        assert [x for x in P.base_spans(text) if x[0] == 1] == [x for x in brute(text) if x[0] == 1]
