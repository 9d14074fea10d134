import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import queries, wordbpe

PATH = public_tokenizers.path(queries.WORDS)
SCHEMA = "doc_id long, text string, ids int, key string, block int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def own_ids(text):
    bpe = wordbpe.load(PATH)
    return [i for c in bpe.chunks(text) for w in bpe.words(c) for i in bpe.encode(w)]


def library_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=80) | st.text("aAÉéΣσς' \x1ć <|endoftext>1.’s", max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_as_the_library_does(library, text):
    assert own_ids(text) == library_ids(library, text)


def test_every_code_point_as_the_library_does(library):
    bpe = wordbpe.load(PATH)
    words = lambda text: [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1{chr(code)}é"
            own = [w for c in bpe.chunks(text) for w in bpe.words(c)]
            assert ["".join(wordbpe.LETTERS[b] for b in w.encode()) for w in own] == words(text), hex(code)


def test_long_words(library):
    rng = random.Random(5)
    texts = ["a" * 5000, "$" * 3000, "ab" * 2000, "漢字" * 500, "é" * 900, "ΑΣ ΣΑΣ", "it's I'LL", "<|startoftext|>Hi<|endoftext|>", "x<|endoftext|", "İI"]
    texts += ["".join(rng.choice("aabcehhlnorst") for _ in range(3000)) for _ in range(5)]
    for text in texts:
        assert own_ids(text) == library_ids(library, text)


def test_packed_places():
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28 + 5, 0]
    assert wordbpe._numbers(b"".join(map(wordbpe._number, numbers))).tolist() == numbers
    assert wordbpe._numbers(b"").tolist() == []
    again = wordbpe._repacked(wordbpe.np.array(numbers), [3, 0, 7])
    assert b"".join(again) == b"".join(map(wordbpe._number, numbers)) and again[1] == b"" and wordbpe._numbers(again[0]).tolist() == numbers[:3]


ROWS = [(1, None), (2, ""), (3, "The idea, the IDEA; it's 12 café́s"), (3, "The idea, the IDEA; it's 12 café́s"), (None, "ΣΑΣ x\x1cy <|endoftext|> z"), (5, " \n\t "), (6, "word " * 5000 + "q" * 3000)]


@pytest.mark.parametrize("block", [1, 60, 16 << 20])
def test_registered_query(spark, tmp_path, monkeypatch, library, block):
    monkeypatch.setattr(wordbpe, "BLOCK", block)
    monkeypatch.setattr(wordbpe, "STEP", 2)
    monkeypatch.setattr(wordbpe, "PAGE", 3)
    spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_word_bpe(spark, str(tmp_path)).collect())
    expected = []
    for doc, text in ROWS:
        ids = library_ids(library, text or "")
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((str(doc), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(expected)


def test_ids_from_elsewhere(spark, library):
    rows = [(1, [3306, 568, 49407, 7]), (2, []), (3, None), (4, [99999, -1]), (5, [49406] * 3), (None, [0, 1, 2, 99999, 600])]
    got = {r.doc_id: r.decoded for r in wordbpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {k: library.decode([i for i in ids or [] if i >= 0], skip_special_tokens=False) for k, ids in rows}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert wordbpe.encode(docs, PATH).collect() == []
    assert wordbpe.decode(docs.selectExpr("doc_id", "array(ids) AS ids"), PATH).collect() == []


def test_places_of_a_block_take_little_more_than_its_texts():
    rng = np.random.default_rng(2)
    numbers = [rng.integers(0, 1 << rng.integers(1, 15), size=300) for _ in range(6_000)]
    packed = [b"".join(map(wordbpe._number, own.tolist())) for own in numbers]
    tracemalloc.start()
    order, steps = wordbpe._by_frequency(packed, 1 << 14, wordbpe.STEP)
    texts, most = 0, tracemalloc.get_traced_memory()[1]
    for step in steps:
        for x in step:
            assert np.array_equal(order[wordbpe._numbers(x)], numbers[texts])
            texts += 1
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert texts == len(numbers) and most < 16 << 20  # the places as numbers alone: 14 MB, and several such arrays before
    times = np.bincount(np.concatenate(numbers), minlength=1 << 14)[order]
    assert (np.diff(times) <= 0).all()
