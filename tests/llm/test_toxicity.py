import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, p_toxic int, quality int"


def corpus(count, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(count):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vilest", "scumbag", "quxor" + rng.choice(words)])
        if junk:
            text += ["clickhere"] * 2
        rows.append((i, " ".join(text), None, 7, 0))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_the_stage(spark):
    rows, labels = corpus(900, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, marks.where("doc_id < 600"), toxicity.production_categories())
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    held = [x for x in labels if x[0] >= 600]
    assert sum((got[i].p_toxic >= toxicity.THRESHOLD) == bool(t) for i, _, t in held) >= 0.97 * len(held)
    assert sum((got[i].p_low_quality >= 0.5) == (q == 0) for i, q, _ in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(docs, chain)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].p_toxic < toxicity.THRESHOLD}


def test_links_use_earlier_categories():
    rng = np.random.default_rng(0)
    first = rng.random(400) < 0.5
    texts = [toxicity.text_features("alpha" if a else "beta") for a in first]
    chain = toxicity.fit_chain(texts, {"a": first.astype(int), "b": first.astype(int)})
    assert len(chain.links["a"].earlier) == 0 and len(chain.links["b"].earlier) == 1
    assert chain.links["b"].earlier[0] > 0
    assert chain.predict("alpha")[1] > 0.5 > chain.predict("beta")[1]


def test_nulls_long_texts_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, None, 1, 1), (2, "", None, None, 1), (3, "bad " * 50_000, "x", 1, 1), (3, "bad " * 50_000, "x", 1, 1), (None, "good", None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([(9, 1, 1), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (none, none.limit(0)):
        chain = toxicity.fit(docs, marks, {"toxic": F.col("toxic") == 1})
        got = toxicity.predict(docs, chain).collect()
        assert len(got) == 5 and all(r.p_toxic < 1e-6 for r in got)
    assert toxicity.predict(docs.limit(0), chain).collect() == []


def plain_fit(x, dense, y):
    """The stated steps over a dense table."""
    every = np.column_stack([x, dense, np.ones(len(y))])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, speed = np.zeros(every.shape[1]), np.full(every.shape[1], 1e-8)
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(150):
        slope = every.T @ ((1 / (1 + np.exp(-every @ w)) - y) / len(y))
        slope[:-1] += 2e-4 * w[:-1] / max(1, x.shape[1]) ** 0.5
        speed += slope**2
        w -= 0.5 * slope / np.sqrt(speed)
    return w


def plain_chain(texts, labels, asked):
    """Out-of-fold chains by definition: probabilities of the categories for ``asked``."""
    own = [set(toxicity.text_features(t).tolist()) for t in texts]
    names = sorted({h for s in own for h in s})
    table = np.array([[h in s for h in names] for s in own], float)
    other = np.array([[h in set(toxicity.text_features(t).tolist()) for h in names] for t in asked], float)
    earlier, later = np.empty((len(texts), 0)), np.empty((len(asked), 0))
    for y in labels:
        held = np.zeros(len(texts))
        for part in [*range(toxicity.FOLDS), -1]:
            use = np.arange(len(texts)) % toxicity.FOLDS != part
            a, b = table[use & (y == 1)].sum(axis=0), table[use & (y == 0)].sum(axis=0)
            odds = np.log((a + 0.5) / (max(1, (y[use] == 1).sum()) + 1)) - np.log((b + 0.5) / (max(1, (y[use] == 0).sum()) + 1))
            score = np.where(a + b < 3, 0, np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
            best = sorted(np.flatnonzero(score > 2.5), key=lambda k: (-score[k], k))[: toxicity.FEATURES]
            w = plain_fit(table[use][:, best], earlier[use], y[use])
            chance = lambda x, e, w=w, best=best: 1 / (1 + np.exp(-(np.column_stack([x[:, best], e, np.ones(len(x))]) @ w)))
            if part >= 0:
                held[~use] = chance(table, earlier)[~use]
        later = np.column_stack([later, chance(other, later)])
        earlier = np.column_stack([earlier, held])
    return later


def test_chain_against_its_definition(spark):
    rng = random.Random(3)
    words = {"bad": ["vile", "scum", "filthy"], "poor": ["lorem", "ipsum", "click"], "plain": ["river", "table", "green", "seven", "lamp", "stone"]}
    rows = []
    for i in range(120):
        bad, poor = rng.random() < 0.4, rng.random() < 0.4
        text = " ".join(rng.choice(words["bad"] if bad and rng.random() < 0.4 else words["poor"] if poor and rng.random() < 0.4 else words["plain"]) for _ in range(12))
        rows.append((i, text, int(not poor), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, toxicity.production_categories())
    y = [np.array([1.0 - q for _, _, q, _ in rows]), np.array([float(t) for *_, t in rows]), np.array([float(t and not q) for _, _, q, t in rows])]
    asked = [t for _, t, _, _ in rows[:20]] + ["vile river", "", "lorem click stone"]
    expected = plain_chain([t for _, t, _, _ in rows], y, asked)
    assert np.allclose([chain.predict(t) for t in asked], expected, atol=1e-5)


def test_the_driver_takes_the_sample_in_small_parts(spark, monkeypatch):
    rows, labels = corpus(300, 5)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    taken, plain = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: taken.append(plain(self)) or taken[-1])
    chain = toxicity.fit(docs, marks, toxicity.production_categories())
    features = [toxicity.text_features(r[1]) for r in rows]
    assert max(t.nbytes for t in taken) < sum(f.nbytes for f in features) / 4
    lists = [[x for t in taken[1:] for x in t.column(0)[i].as_py()] for i in range(len(rows))]
    assert sorted(map(sorted, lists)) == sorted(f.view(np.int64).tolist() for f in map(np.sort, (f.view(np.int64) for f in features)))
    assert set(chain.links) == set(toxicity.production_categories())
