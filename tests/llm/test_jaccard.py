import random
import re

import pytest

from tidemill.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, f1 int, key string"


def brute(rows, words, num, den):
    """Set sizes, components and link counts by comparing every pair."""
    sets = {}
    for doc, text in rows:
        found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(words, len(found))
        sets[doc] = {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()
    near = {d: set() for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    near[a].add(b)
                    near[b].add(a)
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[d] = (len(sets[d]), min(seen), len(near[d]))
    return out


def corpus(seed, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n ", "one", "One", "two words", "two  words", "one two three", "É x y", "é x y"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 12, 40, 120, 400]))] + passage * rng.randint(0, 1)
        for _ in range(copies):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 25])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(near[: len(near) - rng.choice([0, 0, 1, 3])]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "num", "den", "hot"), [(3, 90, 100, 24), (5, 80, 100, 24), (2, 60, 100, 3)])
def test_against_all_pairs(spark, monkeypatch, words, num, den, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 5)
    monkeypatch.setattr(jaccard, "SKETCH_DOCS", 4)
    monkeypatch.setattr(jaccard, "MAP_BITS", 128)
    rows = corpus(words)
    docs = spark.createDataFrame([(d, t, None, 1, "x") for d, t in rows], SCHEMA).repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(docs, jaccard.Rule(words, num, den)).collect()}
    assert found == brute(rows, words, num, den)


def test_bounds_hold_for_every_pair_of_sizes():
    rule = jaccard.Rule(3, 80, 100)
    tops, dealt = jaccard.bands(rule)
    for small in range(1, 300):
        for large in range(small, small * 100 // 80 + 1):
            band = int(tops.searchsorted(small))
            assert rule.most_apart(small + large) <= dealt[band][0]
            assert int(tops.searchsorted(large)) in (band, band + 1) or small < 3


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None), (3, None)]
    docs = spark.createDataFrame([(d, t, None, 1, "x") for d, t in rows], SCHEMA)
    found = sorted(jaccard.join(docs).collect(), key=str)
    assert sorted(tuple(r) for r in found if r.doc_id) == [(1, 2, 1, 2), (1, 2, 1, 2), (3, 0, 3, 0), (7, 2, 1, 2)]
    assert sorted((tuple(r)[1:] for r in found if r.doc_id is None), key=str) == [(0, None, 0), (1, None, 0), (2, 1, 0)]
    assert jaccard.join(docs.limit(0)).collect() == []


def test_folded_sketches_never_exceed_the_symmetric_difference():
    rng = random.Random(4)
    rule = jaccard.Rule(3, 80, 100)
    for _ in range(200):
        words = [str(rng.randrange(400)) for _ in range(rng.randint(1, 600))]
        other = [w if rng.random() > 0.1 else "x" for w in words] + ["y"] * rng.choice([0, 3, 400])
        a, b = (jaccard.shingles(" ".join(w), 3) for w in (words, other))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert jaccard.sketches_apart(jaccard.sketch(a, rule), jaccard.sketch(b, rule)) <= apart
    assert jaccard.sketches_apart(jaccard.sketch(a, rule), jaccard.sketch(a, rule)) == 0
