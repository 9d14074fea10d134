import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids int, decoded string"


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.fixture(scope="module")
def expected():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_library_does(expected, text):
    own = bpe.load(PATH, PATTERN)
    packed = own.encode(text)
    assert ids(packed) == expected(text)
    assert own.decode(packed) == text.encode()


def test_long_pieces_and_odd_runs(expected):
    rng = random.Random(5)
    texts = ["a" * 3000, " " * 2000, "ab" * 900, "é" * 500, "\n" * 400, "<|endoftext|> x", "漢字" * 300]
    texts += ["".join(rng.choice("aabcehhlnorst") for _ in range(800)) for _ in range(20)]
    own = bpe.load(PATH, PATTERN)
    for text in texts:
        assert ids(own.encode(text)) == expected(text)
        assert all(own.merged(p.encode()) == own.piece_ids(p.encode()) for p in own.pieces(text) if len(p) < 900 and p.encode() not in own.ranks)


def test_frames_nulls_repeats_and_empty_tables(spark, expected):
    rows = [(1, None, 1, "x"), (2, "", None, "x"), (3, "Un café 12\n", 1, None), (3, "Un café 12\n", 1, None), (None, "z", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).select("*", bpe.unpack().alias("list")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.list, bytes(r.decoded)) for r in got) == sorted((d or 0, len(expected(t or "")), expected(t or ""), (t or "").encode()) for d, t, _, _ in rows)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []


def test_registered_query(spark, tmp_path, expected):
    rows = [(1, None), (2, "the idea of it"), (3, "x" * 400 + " ñ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        found = expected(text or "")
        assert got[doc].n_tokens == len(found)
        assert got[doc].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
