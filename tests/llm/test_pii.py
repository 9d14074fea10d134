import hashlib
import math
import random
import re
import time

from tidemill.llm import pii, queries

SCHEMA = "doc_id long, text string, row string, more int, kind string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """The base patterns as stated, failing matches dropped."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}", m[0]) for i, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return sorted(found)


TEXTS = [
    None,
    "",
    "é😀 a.b@c.de, x@y @z.com a@b.c_d@e.f a@b.c-d@e.f k%+@m-1.n.o.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3 9999999999.1.2.3 12.34.56.78901",
    "4111 1111 1111 1111 4111111111111112 5500-0000-0000-0004 12 34 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 " + "1234567890" * 30,
    "+1 (555) 123-4567 +12 +1+2345678901 call +49.30.1234567. +123456789012345678 +1 (2",
    "a" * 50_000 + "@" + "b" * 100 + " " + "1" * 50_000 + " " + "a@" * 3000,
    "mail a@b.co from 10.0.0.1 or +33 1 23 45 67 89 " * 200,
]


def test_query_against_the_stated_patterns(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op8_pii_disclosure(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for doc, text in enumerate(TEXTS):
        expected = [x for _, _, x, _ in base(text or "")]
        spans = got[doc].spans.split(",") if got[doc].spans else []
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == expected, doc
        assert got[doc].base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert (got[doc].n_email, got[doc].n_ip, got[doc].n_card, got[doc].n_phone) == tuple(sum(s.startswith(k) for s in expected) for k in pii.BASE)


def disclosure():
    """Documents of which some tell, beside an address, a word that stands nowhere else, or seldom."""
    fill = ["plain words without meaning number " + w for w in "one two three four five six seven eight nine ten".split()]
    rows = [(i, f"{fill[i]} ann@x.io works as zoologist today {i}a") for i in range(4)]
    rows += [(10 + i, f"{fill[i]} hidden") for i in range(10)] * 12
    rows += [(200 + i, f"{fill[i]} bob@x.io keeps a harpsichord in {i}b") for i in range(4)]
    rows += [(300, "a harpsichord alone"), (301, "his harpsichord again")]
    rows += [(400, "copy cleo@x.io knows sesquipedalian")] * 9
    return rows


def expected_terms(rows):
    texts = [t for _, t in rows]
    words = lambda t: set(re.findall(r"[^\W\d_]{2,}", t.lower()))
    contexts = {}
    having = {}
    for row in rows:
        for start, _, _, value in base(row[1]):
            end = start + len(value)
            contexts.setdefault(value, set()).add(row[1][max(0, start - pii.CONTEXT) : start] + " " + row[1][end : end + pii.CONTEXT])
            having.setdefault(value, set()).add(row)
    out = {}
    for entity, found in contexts.items():
        for term in set().union(*map(words, found)):
            both = sum(term in words(c) for c in found)
            if both >= pii.SUPPORT:
                pmi = math.log(both / len(found) / (sum(term in words(t) for t in texts) / len(texts)))
                information = -math.log(len(having[entity]) / len(texts))
                if pmi >= pii.DISCLOSURE * information:
                    out[entity, term] = "gone" if pmi >= information else "term"
    return out


def test_disclosing_terms_and_the_stage(spark, monkeypatch):
    rows = disclosure()
    docs = spark.createDataFrame([(d, t, "a", 1, None) for d, t in rows], SCHEMA)
    expected = expected_terms(rows)
    assert expected["ann@x.io", "zoologist"] == "gone" and expected["bob@x.io", "harpsichord"] == "term" and not any(e == "cleo@x.io" for e, _ in expected)
    results = []
    for most in (pii.BROADCAST, 0):
        monkeypatch.setattr(pii, "BROADCAST", most)
        results.append(sorted((r.doc_id, tuple(map(tuple, r.spans))) for r in pii.find(docs).collect()))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    by_doc = dict(results[0])
    for doc, text in dict(rows).items():
        own = {e for _, _, _, e in base(text)}
        marks = {m.span(): expected[e, m[0].lower()] for m in re.finditer(r"[^\W\d_]{2,}", text) for e in own if (e, m[0].lower()) in expected}
        assert sorted((a, b, k) for k, a, b in by_doc[doc] if k in ("term", "gone")) == sorted((a, b, k) for (a, b), k in marks.items())
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.count() == len(rows)
    assert "zoologist" not in texts[0] and "[EMAIL]" in texts[0] and "harpsichord" not in texts[201] and "[TERM]" in texts[201]
    assert texts[300] == "a harpsichord alone" and texts[400] == "copy [EMAIL] knows sesquipedalian" and texts[12] == dict(rows)[12]


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, "x", 1, None), (None, "a@b.co", None, 1, "k"), (2, "a@b.co", "x", None, "k"), (2, "a@b.co", "x", None, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or 0, len(r.spans)) for r in pii.find(docs).collect()) == [(0, 1), (1, 0), (2, 1), (2, 1)]
    assert sorted((r.doc_id or 0, r.text or "") for r in pii.sanitise(docs).collect()) == [(0, "[EMAIL]"), (1, ""), (2, "[EMAIL]"), (2, "[EMAIL]")]
    assert pii.find(docs.limit(0)).collect() == [] and pii.sanitise(docs.limit(0)).collect() == []


def test_terms_far_from_the_mention_disclose(spark):
    far = "plain words without meaning " * 20
    rows = [(i, f"the ombudsman {far} dee@x.io or fay@y.org {i}a") for i in range(4)]
    rows += [(10 + i, f"{far} {i} gus@x.io dee") for i in range(30)]
    docs = spark.createDataFrame([(d, t, "a", 1, None) for d, t in rows], SCHEMA)
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("ombudsman" not in texts[i] and "[EMAIL]" in texts[i] and "plain words" in texts[i] for i in range(4))
    terms = {(r.entity, r.term): r.kind for r in pii.disclosing(docs, pii._spotted(docs, "doc_id", "text").where("size(spans) > 0")).collect()}
    assert terms["dee@x.io", "ombudsman"] == terms["fay@y.org", "ombudsman"] == "gone"
    assert terms["dee@x.io", "fay"] == "gone" and ("dee@x.io", "dee") not in terms and ("fay@y.org", "fay") not in terms


def test_very_long_texts_take_linear_time(spark):
    words = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(20_000))
    rows = [(i, f"ann@x.io zoologist {words} {i} zoologist at 10.0.0.{i}") for i in range(4)] + [(10 + i, f"other text {i}") for i in range(60)]
    docs = spark.createDataFrame([(d, t, "a", 1, None) for d, t in rows], SCHEMA)
    pii.find(docs.where("doc_id >= 10")).collect()  # start
    start = time.time()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs).collect()}
    assert time.time() - start < 25
    assert ("gone", 9, 18) in got[0] and len(got[0]) > 20_000  # words that stand with the address alone disclose it, too
    spans = pii.F.col("spans")
    many = docs.where("doc_id < 4").select("doc_id", "text", pii._base(pii.F.col("text")).alias("spans"))
    assert [r.n for r in many.select(pii.F.size(spans).alias("n")).collect()] == [2] * 4


def test_masks_of_many_overlapping_spans(spark):
    rng = random.Random(1)
    alphabet = "aé😀﻿漢 "
    rows, expected = [], []
    for _ in range(30):
        text = "".join(rng.choice(alphabet) for _ in range(40))
        own = sorted({(a, min(40, a + rng.randint(1, 9))) for a in (rng.randrange(40) for _ in range(rng.randint(0, 12)))})
        rows.append((text, [("term", a, b) for a, b in own]))
        out, at = "", 0
        for a, b in own:
            if a >= at:
                out += text[at:a] + "[TERM]"
            at = max(at, b)
        expected.append(out + text[at:])
    df = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:bigint,end:bigint>>").repartition(1)
    got = {r.text: r.out for r in df.select("text", pii.masked(pii.F.col("text"), pii.F.col("spans")).alias("out")).collect()}
    assert got == dict(zip([t for t, _ in rows], expected, strict=True))
