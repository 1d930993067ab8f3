import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from test_ngram_join import brute


def documents():
    r = random.Random(9)
    voc = {"en": ["the", "thing", "ou", "er", "was"], "de": ["sch", "ung", "über", "ein"]}
    out = []
    for i in range(160):
        lang = r.choice(["en", "de"])
        out.append((i, " ".join("".join(r.choice(voc[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 60))), lang, "s", 1))
    for j in range(20):
        w = out[j][1].split(" ")
        w[-1] = "changed"
        out.append((200 + j, " ".join(w) if j % 2 else out[j][1], out[j][2], "s", 1))
    return out + [(300, None, "en", "s", 0), (301, "", None, None, None), (302, "1 2 3", "en", "s", 5), (303, out[50][1] + " x@y.com", "en", "s", 9), (303, out[50][1] + " x@y.com", "en", "s", 9)]


def test_stages_against_brute_force(spark, tmp_path):
    docs, r = documents(), random.Random(1)
    item = " ".join("".join(r.choice("qwxyzj") for _ in range(6)) for _ in range(25))
    docs.append((400, "was the thing " * 3 + item + " the was", "en", "s", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(now.collect())
        if i < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {d[0]: d[1] for d in docs}
    assert {x.doc_id for x in kept[0]} == set(texts) - {300, 301, 302} and len(kept[0]) == len(docs) - 3
    groups = brute([(x.doc_id, x.text) for x in {y.doc_id: y for y in kept[0]}.values()])
    assert sorted(x.doc_id for x in kept[1]) == sorted({c for _, _, c in groups})
    assert {x.doc_id for x in kept[2]} == {x.doc_id for x in kept[1]} - {400}
    assert {x.doc_id for x in kept[3]} == {x.doc_id for x in kept[2]}
    assert all("@" not in x.text and x.n_chars == len(x.text) for x in kept[3])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    clean = {x.doc_id: x.text for x in kept[3]}
    assert all(x.n_tokens == len(t.encode(clean[x.doc_id], add_special_tokens=False).ids) for x in kept[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, kept[4]))


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_identified_language_reaches_the_result(spark, tmp_path):
    docs = documents()
    docs = [(i, t, None if i % 7 == 0 else "en" if i == 9 else lang, s, n) for i, t, lang, s, n in docs]  # unlabelled rows, and one label that may be wrong
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    truth = {i: lang for i, _, lang, _, _ in documents()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(x.lang == truth[x.doc_id] for x in got)
