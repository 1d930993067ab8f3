import random
import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import langid
from tessella.llm.common import flat
from tessella.llm.langid import Scorer, fit, identify_language, language_id, reject_unidentified, train

SYLLABLES = {"aa": ["the", "th", "ing", "ou"], "bb": ["sch", "ung", "ü", "ein"], "cc": ["ção", "os", "el", "ñ"]}


def corpus(n=400):
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 80))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=60, landmarks=12).collect()
    assert len(got) == len(rows)
    lang = {i: x for i, _, x in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held and np.mean([lang[r.doc_id] == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_and_features_are_unused(spark):
    rows = corpus(200)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    run = lambda x: sorted(map(tuple, language_id(spark.createDataFrame(x, "doc_id long, text string, lang string"), 60, landmarks=12).collect()))
    assert run(rows) == run(swapped)


def test_kernel_equals_set_overlap():
    texts, langs = [t for _, t, _ in corpus(30)], [x for _, _, x in corpus(30)]
    model = fit(texts, langs, landmarks=6)
    s = Scorer(model)
    grams = lambda t: {b[i : i + n] for b in [t.encode().lower()] for n in (1, 2, 3) for i in range(len(b) - n + 1)}
    raw = [t.encode() for t in texts]
    x = langid._presence(s.tables, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    held = set()
    by = {k: [t for t, y in zip(texts, langs) if y == k] for k in sorted(set(langs))}
    for k in by:
        for t in by[k][:2]:
            held |= grams(t)
    assert [len(grams(t) & held) for t in texts] == x.sum(axis=1).tolist()
    long = " ".join(texts * 900)
    assert len(long) > 2 * langid.BLOCK_BYTES
    b = np.frombuffer(long.encode(), np.uint8)
    whole = langid._kernel(langid._presence(s.tables, b, np.array([0, len(b)])), model["landmarks"], model["norms"]) @ model["weights"] + model["bias"]
    assert np.allclose(s.scores(b, np.array([0, len(b)])), whole)


def test_edges(spark):
    rows = corpus(60) + [(900, None, "aa"), (901, "", None), (902, "123 !?", "aa"), (None, "the thing", "aa"), (903, "the thing", None), (903, "the thing", None)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, score int, ok double")
    got = language_id(df, 60, landmarks=6)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "aa"
    assert language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify_language(df, None).collect()} == {"und"}


def test_known_share_against_sets(monkeypatch):
    monkeypatch.setattr(langid, "LOOKED_UP", 50)
    rows = corpus(40)
    model = fit([t for _, t, _ in rows], [x for _, _, x in rows], landmarks=6)
    held = [set(g.tolist()) for g in model["grams"]]
    texts = ["", "t", "th", "qq", "the", "zzz", "th" + "x" * 200 + "e", *[t for _, t, _ in rows[:20]], "the " * 300]

    def share(t):
        b = t.encode().lower()
        n = min(3, len(b))
        codes = [int.from_bytes(b[i : i + n], "big") for i in range(len(b) - n + 1)] if n else []
        return sum(c in held[n - 1] for c in codes) / len(codes) if codes else 0.0

    assert np.allclose(Scorer(model).known(*flat(pa.array(texts))), [share(t) for t in texts])


def test_more_languages_cost_no_documents(spark):
    rows = corpus(200)
    foreign = [(1000, "это совсем другой язык", None), (1001, "这是另一种语言", None)]
    more = [(2000 + i, f"{chr(0x400 + i)}{chr(0x500 + i)} {chr(0x600 + i)}", f"l{i}") for i in range(30)]  # languages of one row each
    df = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string")
    few = train(df(rows), 60, landmarks=12)
    many = train(df(rows + more), 60, landmarks=12)
    assert len(many["languages"]) == 33
    for model in (few, many):
        assert {r.doc_id for r in reject_unidentified(df(rows + foreign), model).collect()} == {r[0] for r in rows}
    assert {r.lang_pred for r in identify_language(df(more), many).collect()} == {f"l{i}" for i in range(30)}


def test_ties_go_to_the_first_name(spark):
    same = [(i, "one text for both", "bb" if i % 2 else "aa") for i in range(20)]
    got = identify_language(spark.createDataFrame(same, "doc_id long, text string, lang string"), fit(["one text for both"] * 2, ["bb", "aa"]))
    assert {r.lang_pred for r in got.collect()} == {"aa"}
