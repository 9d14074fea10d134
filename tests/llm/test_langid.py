import itertools
import random
import zlib

import numpy as np

from tidemill.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, source string, score int"
SYLLABLES = {"aa": ["la", "de", "ci", "ón", "os"], "bb": ["th", "er", "ing", "ou", "an"], "cc": ["sch", "ein", "ung", "ä", "ge"]}


def corpus(count, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang, "s", 1))
    return rows


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    field = langid.Field(["a", "b", "c"], np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    sizes = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    got, at = field.probabilities(scores, sizes), 0
    for n in sizes:
        expected = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)) if n else ():
            weight = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path)))
            for t, k in enumerate(path):
                expected[t, k] += weight
        if n:
            assert np.allclose(got[at : at + n], expected / expected.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def test_held_out_accuracy_segments_and_the_stage(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs.where("doc_id < 250"), docs_each=60)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows if r[0] >= 250]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = "la deci ónos deóns lacios thering ouan thing therou erou scheinung ungein gesch ein"
    runs = langid.segments(spark.createDataFrame([(1, mixed, None, None, 1)], SCHEMA), model).first().segments
    assert [r.lang for r in runs] == ["aa", "bb", "cc"]
    assert [mixed[r.start : r.end].split()[0] for r in runs] == ["la", "thering", "scheinung"]
    odd = spark.createDataFrame([(1, None, None, None, 1), (2, "12 _ 34", "aa", None, 1), (3, "la de", None, None, 1)], SCHEMA)
    assert [r.doc_id for r in langid.keep_identified(odd, model).collect()] == [3]
    assert langid.keep_identified(odd, model).schema == odd.schema


def test_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, None, "aa", None, 1), (2, "", None, None, 1), (3, "la de " * 20_000, "aa", None, 1), (3, "la de", "aa", None, 1), (None, "é", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, one).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "aa"), (None, "aa")}
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), nothing).collect() == []


def test_long_words_and_long_texts_count_whole():
    rng = random.Random(3)
    word = lambda lang, n: "".join(rng.choice(SYLLABLES[lang]) for _ in range(n))
    text = lambda lang, n: " ".join(word(lang, rng.randint(1, 4)) for _ in range(n))
    licence = text("cc", 600)
    model = langid.train([f"{licence} {text(lang, 900)}" for lang in ("aa", "bb") for _ in range(8)], ["aa"] * 8 + ["bb"] * 8)
    found = [[text("aa", 40).split(), text("bb", 40).split(), [word("aa", 20) + word("bb", 200)], [word("bb", 20) + word("aa", 200)]]]
    assert model.languages(found[0])[0] == ["aa", "bb", "bb", "aa"]


def test_registered_query_learns_from_the_rest_only(spark, tmp_path):
    rows = corpus(160, 4) + [(900, None, "aa", "s", 1), (None, "la de ci", "aa", "s", 1), (901, "12", None, "s", 1)]
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)
    got = {r.doc_id: r for r in queries.op6_language_crf(spark, str(tmp_path)).collect()}
    assert {d: r.held_out for d, r in got.items()} == held
    model = langid.fit(spark.createDataFrame([r for r in rows if not held[r[0]]], SCHEMA))
    for doc, text, *_ in rows:
        assert (got[doc].lang_pred, got[doc].score) == model.label([text])[0][:2]
    spark.createDataFrame([(*r[:2], "cc" if held[r[0]] else r[2], *r[3:]) for r in rows], SCHEMA).write.mode("overwrite").parquet(path)
    assert {d: r.score for d, r in got.items()} == {r.doc_id: r.score for r in queries.op6_language_crf(spark, str(tmp_path)).collect()}


def test_scores_do_not_hang_on_the_other_texts_of_a_step(monkeypatch):
    rows = corpus(300, 9)
    model = langid.train([r[1] for r in rows], [r[2] for r in rows])
    texts = [r[1] for r in rows] + ["", None, "12"]
    alone = [model.label([x])[0] for x in texts]
    assert model.label(texts) == alone
    monkeypatch.setattr(langid, "CELLS", 1)
    model.known = None
    assert model.label(texts) == alone
