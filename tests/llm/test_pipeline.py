import random
import re
import struct

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_packing import check
from tidemill.llm import bpe, langid, packing, queries, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Documents of two languages with planted toxic words, copies, near copies, personal data, digits and nulls."""
    rng = random.Random(6)
    parts = {"en": ["th", "er", "ing", "ou", "an"], "es": ["la", "de", "ci", "ón", "os"]}
    rows, labels = [], []
    for i in range(260):
        lang = "en" if i % 3 else "es"
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 70))]
        if toxic := i % 7 == 0:
            words[5] = words[9] = "vilest"
        if i % 11 == 1:
            words[3] = f"p{i}@mail.example.com"
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(400 + i, rows[i][1] + " ending", rows[i][2]) for i in range(20, 40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 456", "es"), (503, "12 " * 9000 + "the other thing", "en")]
    return rows, labels


def test_stages_and_run(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], DOCUMENTS)
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = {d: t for d, t, _ in rows}
    sf, now, kept = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (now, spark.read.parquet(str(tmp_path / name)))
        now = kept[name][1]
    ids = {name: {r.doc_id for r in after.collect()} for name, (_, after) in kept.items() if name != "packing"}
    toxic = {d for d, t in texts.items() if t and "vilest" in t}
    assert ids["toxicity"] == texts.keys() - toxic
    assert ids["toxicity"] - ids["language"] == {500, 501, 502}
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.production_categories())
    assert {r.doc_id for r in toxicity.predict(docs, chain).where(F.col("p_toxic") < toxicity.THRESHOLD).collect()} == ids["toxicity"]
    model = langid.fit(kept["toxicity"][1])
    assert {r.doc_id for r in langid.predict(kept["toxicity"][1], model).where("lang_pred <> 'und'").collect()} == ids["language"]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d in ids["language"] for w in [texts[d].lower().split()]}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) > 20
    group = {d: d for d in sets}
    while moved := [(a, b) for a, b in links if group[a] != group[b]]:
        for a, b in moved:
            group[a] = group[b] = min(group[a], group[b])
    assert ids["near_duplicates"] == set(group.values())
    clean = {r.doc_id: r for r in kept["pii"][1].collect()}
    assert clean.keys() == ids["near_duplicates"]
    for d, r in clean.items():
        assert r.text == re.sub(r"p\d+@mail\.example\.com", "[EMAIL]", texts[d]) and r.n_chars == len(r.text)
    ranks = bpe.load(queries.rank_file(), public_tokenizers.PATTERN)
    bins = kept["packing"][1].collect()
    check(bins, [(d, struct.unpack(f"<{len(x) // 4}I", x)) for d, r in clean.items() for x in [ranks.encode(r.text)]], packing.CAPACITIES, 4, corpus_pipeline.END)
    assert max(ranks.ranks.values()) < corpus_pipeline.END
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(bins)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_stay_once(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 2 + [(2, "h i j k l m n", "en", "s", 1), (None, "x", "en", "s", 1)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, DOCUMENTS), "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]


def test_a_repeated_id_with_other_texts_loses_near_copies_only(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(1, texts[0]), (7, texts[0] + " end"), (7, texts[1]), (7, texts[1]), (7, texts[1].upper()), (7, texts[2]), (9, texts[2] + " end"), (9, texts[3]), (7, ""), (7, None), (None, texts[1])]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCUMENTS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    lower = sorted((d or 0, (t or "").lower()) for d, t in kept)
    assert lower == sorted([(1, texts[0]), (7, texts[1]), (7, texts[2]), (9, texts[3]), (7, ""), (7, ""), (0, texts[1])])


def test_a_worker_keeps_the_tables_of_one_operator_and_gets_few_rows_at_once(spark, tmp_path):
    from tidemill.llm import held, langid

    bpe.load(queries.rank_file(), public_tokenizers.PATTERN)
    langid.features("word")
    assert list(held._HELD) == ["langid"]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        docs = spark.range(5_000).selectExpr("id as doc_id", "'a b' as text", "'aa' as lang", "'s' as source", "3L as n_chars")
        spark.range(2).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
        kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r.n for r in kept.collect()) <= corpus_pipeline.ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
