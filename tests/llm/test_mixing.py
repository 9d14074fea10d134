import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing, queries

SCHEMA = "doc_id long, text string, word string, n int, block long"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(count, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["the", "ing", "o", "an", "st", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return [(i, rng.choice([" ", "\n\t"]).join(rng.choice(vocabulary[: rng.choice([20, 300])]) for _ in range(rng.randint(1, 80))).capitalize()) for i in range(count)]


def test_counts_and_base_score_against_plain_counting(spark, tmp_path):
    rows = [*corpus(150, 2), (900, None), (901, ""), (902, "  x\x0by"), (903, "unseen" * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_context_mixing(spark, str(tmp_path)).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and any(held.values())
    for doc, text in rows:
        tokens = [*words(text), None]
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[doc], len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens), rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0
    others = [d for d, t in rows if held[d] and t and d < 900]
    assert sum(got[d].score for d in others) > sum(len(t.encode()) for d, t in rows if d in others) * -0.9  # under 3 bits a byte


# ---- the model, bit by bit -------------------------------------------------------------------------------------------


def token(word):
    return bytes([64 + int(mixing.shapes([word])[0])]) + word + b" "


def plain_final(mixer, x, gate, context):
    """The mix of one bit's inputs, and its refinement, in plain floats."""
    mixed = sum(float(w) * v for w, v in zip(mixer.weights[:-1, gate], x, strict=True)) + float(mixer.weights[-1, gate])
    mixed = min(max(mixed, -7.99), 7.99)
    low = int((mixed + 8) * 2)
    share = (mixed + 8) * 2 - low
    refined = float(mixer.refined[context, low]) * (1 - share) + float(mixer.refined[context, low + 1]) * share
    return min(max((1 / (1 + math.exp(-mixed)) + refined) / 2, 1e-5), 1 - 1e-5)


def known(total):
    return sum(total > x for x in (0.5, 3.5, 30.5))


def odds(zeros, ones):
    return math.log((ones + 0.02) / (zeros + 0.02))


class Plain:
    """The whole model with dictionaries, one bit at a time; weights and maps come from the model under test."""

    def __init__(self, docs, held):
        self.hashed, self.begin, self.shape, self.pairs = Counter(), Counter(), Counter(), Counter()
        self.docs, self.held = docs, held
        for d, ws in docs.items():
            if held[d]:
                continue
            for w in ws:
                t = token(w)
                for j in range(1, len(t)):
                    for bit in range(8):
                        part, value = t[j] >> (8 - bit), t[j] >> (7 - bit) & 1
                        for k, c in enumerate(self.slots(t, j, bit)):
                            self.hashed[k, c, value] += 1
                        self.begin[t[:j], bit, part, value] += 1
            for *context, own in self.shapes_of(ws):
                self.shape[(*context, own)] += 1
            before = 1
            for p in self.passages_of(ws):
                self.pairs[before] += 1
                self.pairs[before, p] += 1
                before = p

    @staticmethod
    @functools.lru_cache(maxsize=None)
    def slots(t, j, bit):
        """Names of the hashed contexts of one bit: those of a token that has nothing but what they may depend on."""
        start = max(1, j - 3)
        cut = (t[:1] if start == 1 else b"?") + t[start : j + 1]
        flat, _, hashes = mixing.contexts([cut])
        partial, _ = mixing.partial_bytes(flat, bit)
        one = mixing.contexts([t[:1] + t[1 : j + 1]])[2][:1]
        return [int(mixing.slots(h, partial)[-1]) for h in (one[0][-1:], *hashes[1:])]

    @staticmethod
    def shapes_of(ws):
        own = [int(x) for x in mixing.shapes(ws)] + [mixing.END]
        for i, x in enumerate(own):
            recent = sum(y >= 32 for y in own[max(0, i - 8) : i])
            yield sum(recent >= b for b in (1, 2, 4)), (own[i - 2] if i > 1 else mixing.END), (own[i - 1] if i else mixing.END), x

    @staticmethod
    def passages_of(ws):
        out, own = [], []
        for w, h in zip([*ws, None], mixing.word_hashes(ws).tolist(), strict=True):
            own.append(w)
            if (h >> 7) % mixing.CUTS == 0 or w is None:
                out.append(tuple(own))
                own = []
        return out

    def price(self, model, word, own):
        """log10 of a word's bytes, with ``own`` occurrences taken out."""
        t, total = token(word), 0.0
        for j in range(1, len(t)):
            for bit in range(8):
                part, value = t[j] >> (8 - bit), t[j] >> (7 - bit) & 1
                seen = [[self.hashed[k, c, v] for v in (0, 1)] for k, c in enumerate(self.slots(t, j, bit))] + [[self.begin[t[:j], bit, part, v] for v in (0, 1)]]
                for row in seen:
                    row[value] = max(0, row[value] - own)
                p = plain_final(model.mixer, [odds(*row) for row in seen], known(sum(seen[3])) * 4 + known(sum(seen[2])), (1 << bit) | part)
                total += math.log10(p if value else 1 - p)
        return total

    def told(self, model, shape_price, d):
        """What a document costs apart from its repeat bits, and those bits."""
        own, ws, flags, total = int(not self.held[d]), self.docs[d], [], 0.0
        costs, at = list(self.shapes_of(ws)), 0
        before, status = 1, None
        for p in self.passages_of(ws):
            seen, both = self.pairs[before] - own, self.pairs[before, p] - own
            history = 0 if status is None else 1 if status == "none" else 2 if status == "miss" else 2 + min(3, status)
            if seen > 0:
                flags.append(((sum(seen >= b for b in (2, 3, 5, 9))) * 6 + history, both > 0))
            if both > 0:
                total += math.log10(both / seen)
            else:
                for w, (state, two, one, x) in zip(p, costs[at : at + len(p)], strict=True):
                    total += shape_price[((state * 64 + two) * 64 + one) * 64 + x] + (self.price(model, w, own) if w is not None else 0.0)
            status = "none" if seen <= 0 else "miss" if both <= 0 else (status if isinstance(status, int) else 0) + 1
            at += len(p)
            before = p
        return total, flags


@pytest.mark.parametrize("seed", [3, 4])
def test_scores_against_the_model_bit_by_bit(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RANGE", 60)  # several ranges, so that beginnings cross borders
    monkeypatch.setattr(mixing, "UNIT", 50)
    monkeypatch.setattr(mixing, "BLOCK", 900)
    monkeypatch.setattr(mixing, "KEYS", 40)
    kept = {}
    fit, shape, repeat = mixing.fit_bytes, mixing.shape_prices, mixing.repeat_prices
    monkeypatch.setattr(mixing, "fit_bytes", lambda r: kept.setdefault("bytes", fit(r)))
    monkeypatch.setattr(mixing, "shape_prices", lambda c: kept.setdefault("shapes", (shape(c), c))[0])
    monkeypatch.setattr(mixing, "repeat_prices", lambda c: kept.setdefault("repeats", (repeat(c), c))[0])
    rows = [(d, t) for d, t in corpus(45, seed) if len(t) < 400]
    rows += [(d + 500, t) for d, t in rows[:6]] + [(800, rows[0][1] + " " + rows[1][1]), (801, None)]
    held = {d: d % 5 == 1 for d, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in mixing.score(docs, F.col("doc_id") % 5 == 1).collect()}
    plain = Plain({d: [w.encode() for w in words(t)] for d, t in rows}, held)
    assert Counter({k: v for k, v in enumerate(kept["shapes"][1].astype(int).tolist()) if v}) == Counter({((s * 64 + two) * 64 + one) * 64 + x: n for (s, two, one, x), n in plain.shape.items()})
    flags = np.zeros(60)
    for d, _ in rows:
        told, bits = plain.told(kept["bytes"], kept["shapes"][0], d)
        expected = told + sum(kept["repeats"][0][2 * c + hit] for c, hit in bits)
        assert got[d].score == pytest.approx(expected, rel=2e-4), d
        for c, hit in bits if not held[d] else ():
            flags[2 * c + hit] += 1
    assert np.array_equal(flags, kept["repeats"][1]) and flags[1::2].sum() > 0


def test_order_repeats_and_places_count(spark):
    rng = random.Random(8)
    rows = corpus(300, 5)
    whole = [t for d, t in rows if d % 5 != 1 and len(t.split()) > 40]
    mixed = whole[0].split()
    rng.shuffle(mixed)
    rows += [(1001, whole[0]), (1002, " ".join(mixed)), (1003, whole[1]), (1003, whole[1])]
    rows += [(2000 + 5 * i, "the cat, sat on. mat, old. of") for i in range(40)]
    rows += [(3001, "the cat, sat on. mat, old. of it"), (3006, "mat, of cat, old. the sat on. it")]
    got = {}
    for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 1).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1001][0].score > 0.4 * got[1002][0].score  # a repeated text is told by its repeats, its words alone are not
    assert got[1003][0].score == got[1003][1].score and got[1003][0].bits_per_byte < 1.5
    assert got[3001][0].base_score == pytest.approx(got[3006][0].base_score) and got[3001][0].score > got[3006][0].score


def test_prices_are_probabilities_and_follow_the_counts():
    counts = [(b"the", 60), (b"then", 20), (b"ox", 5), (b"or", 1)]
    tokens = sorted(token(w) for w, _ in counts)
    times = np.array([dict((token(w), n) for w, n in counts)[t] for t in tokens])
    table = np.zeros((mixing.ORDERS, 1 << mixing.SLOTS, 2), np.float32)
    flat, starts, hashes = mixing.contexts(tokens)
    weight = np.repeat(times, np.diff(np.append(starts, len(flat))))
    for bit in range(8):
        partial, value = mixing.partial_bytes(flat, bit)
        for k in range(mixing.ORDERS):
            np.add.at(table[k], (mixing.slots(hashes[k], partial), value), weight)
    model = mixing.Bytes.new(table)
    for _ in range(30):
        model.learn(tokens, times, mixing.counted_beginnings(tokens, times))
    some = sorted([*(bytes([tokens[0][0], b]) for b in range(256))])  # all first bytes after one shape
    first = model.price(some, np.zeros((8, 2, 256), np.float32), np.zeros(256, bool))[0]
    assert np.sum(10.0**first) == pytest.approx(1, abs=1e-4)
    both = sorted([*tokens, token(b"zqz")])
    n = np.array([dict(zip(tokens, times.tolist(), strict=True)).get(t, 0) for t in both])
    price, again = model.price(both, mixing.counted_beginnings(both, n), n > 0)
    found = dict(zip(both, price, strict=True))
    assert found[token(b"the")] > found[token(b"ox")] > found[token(b"zqz")]
    assert again[both.index(token(b"zqz"))] == found[token(b"zqz")] and again[both.index(token(b"or"))] < found[token(b"or")] - 0.5


def test_shape_prices_are_probabilities():
    counts = np.random.default_rng(3).poisson(0.01, mixing.STATES * mixing.SHAPES**3).astype(float)
    assert np.allclose((10 ** mixing.shape_prices(counts)).reshape(-1, mixing.SHAPES).sum(axis=1), 1, atol=1e-3)


def test_beginnings_against_plain_counting_whole_and_in_ranges():
    rng = random.Random(1)
    tokens = sorted({bytes([64 + rng.randrange(3)]) + "".join(rng.choice(["a", "b", "the", "é"]) for _ in range(rng.randint(1, 5))).encode() + b" " for _ in range(200)} | {b"A" + b"ab" * 700 + b" "})
    n = np.array([rng.randint(0, 9) for _ in tokens])
    found = mixing.counted_beginnings(tokens, n)
    at = 0
    for t in tokens:
        for j in range(1, min(len(t), 12)):
            for bit in range(8):
                alike = [(v[j] >> (7 - bit) & 1, k) for v, k in zip(tokens, n, strict=True) if v[:j] == t[:j] and v[j] >> (8 - bit) == t[j] >> (8 - bit)]
                assert found[bit, :, at + j - 1].tolist() == [sum(k for o, k in alike if o == v) for v in (0, 1)]
        at += len(t) - 1
    for cuts in ([len(tokens) // 2], [1, 2, 60, len(tokens) - 1]):
        parts = list(zip([0, *cuts], [*cuts, len(tokens)], strict=True))
        wide = {}
        for a, b in parts:
            for name, follows in mixing.border_counts(tokens[a:b], n[a:b]).items():
                for byte, times in follows.items():
                    wide.setdefault(name, {}).setdefault(byte, 0)
                    wide[name][byte] += times
        assert np.array_equal(np.concatenate([mixing.counted_beginnings(tokens[a:b], n[a:b], wide) for a, b in parts], axis=2), found)


def test_nulls_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", 1, 2), (2, "a a", None, None, 3), (2, "a a", None, 1, 3), (None, "b", "a", 1, 4)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in mixing.score(docs, F.col("doc_id") == 9).collect())
    assert got == [(0, 2, 2, 9), (1, 1, 1, 9), (2, 3, 3, 9), (2, 3, 3, 9)]
    none = mixing.score(docs.where("doc_id = 1"), F.lit(True)).first()
    assert (none.n_tokens, none.n_known, none.train_tokens) == (1, 0, 0) and math.isfinite(none.score)
    assert mixing.score(docs.limit(0), F.lit(False)).collect() == []


def test_scores_do_not_depend_on_tasks_and_files(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 60)
    monkeypatch.setattr(mixing, "UNIT", 40)
    monkeypatch.setattr(mixing, "KEPT", 50)
    rows = corpus(120, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    found = []
    for parts in (1, 2, 7):
        own = docs.repartition(parts) if parts > 1 else docs.coalesce(1).orderBy(F.desc("doc_id"))
        found.append(sorted((r.doc_id, r.base_score, r.score) for r in mixing.score(own, held).collect()))
    assert found[0] == found[1] == found[2]


def test_tokens_are_ordered_as_bytes_with_their_space():
    tokens = [b"@a\x01", b"@a", b"@a\xff", b"@a!", b"@", b"A", b"@a\xc3\xa9"]
    assert [tokens[i] for i in mixing._in_order(tokens)] == sorted(tokens, key=lambda t: t + b" ")
    assert mixing._in_order([]) == []


def test_whole_numbers_are_added_as_fast_as_floats():
    import time

    rng = np.random.default_rng(0)
    at, times = rng.integers(0, 1 << 20, 1_000_000), rng.integers(1, 9, 1_000_000)

    def took(add, values):
        total, found = np.zeros(1 << 20), []
        for _ in range(3):
            total[:] = 0
            start = time.perf_counter()
            add(total, at, values)
            found.append(time.perf_counter() - start)
        return min(found), total

    plain, expected = took(np.add.at, times.astype(float))
    own, got = took(mixing._added, times)
    assert own < 3 * plain and (got == expected).all()
