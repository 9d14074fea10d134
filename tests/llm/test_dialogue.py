import hashlib
import random
import zlib

import pytest

from tidemill.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies string, d int"
BLANKS = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or rest != "" and rest == "ua" * (len(rest) // 2)


def edits(rows, most, audit="", cost=0, left=()):
    """All ways to edit the rows for ``most`` at most: (cost, audit, rows that are left)."""
    if not rows:
        if legal("".join(r[:1] or "-" for r, _ in left)):
            yield cost, audit, left
    else:
        (role, text, forced, extra), rest = rows[0], rows[1:]
        if cost + 4 <= most:
            yield from edits(rest, most, audit + "D", cost + 4, left)
        if not forced:
            if cost + extra <= most:
                yield from edits(rest, most, audit + "K", cost + extra, (*left, (role, text)))
            if cost + extra + 3 <= most:
                for given in ("user", "assistant"):
                    yield from edits(rest, most, audit + "R", cost + extra + 3, (*left, (given, text)))
    if cost + 3 <= most:
        for given in ("user", "assistant"):
            yield from edits(rows, most, audit + "I", cost + 3, (*left, (given, "")))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.rstrip(BLANKS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), 3 if fault == 2 else 0))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = {r[1] for r in own} - {None}
        cost, audit, left = min(edits(marked, 4 * len(marked)))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, digest)
    return out


def found(spark, rows, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}


def random_rows(seed, talks, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so", "", " \t", None, "Why? ", "é.\n", "x" * 50 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sys"]
    return [(conv, rng.choice([*range(most), None]), rng.choice(roles), rng.choice(texts)) for conv in [*range(talks), None] for _ in range(rng.randint(1, most))]


@pytest.mark.parametrize("block", [1, 2, 512])
def test_against_all_edits(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rows = random_rows(block, 60, 4)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_one_conversation_over_many_tasks_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "Yes."])) for t in range(400)]
    split = found(spark, rows, tmp_path)
    monkeypatch.setattr(dialogue, "BLOCK", 10_000)
    assert found(spark, rows, tmp_path) == split
    assert len(split[5][6]) >= len(hurt(rows))


def test_what_is_left_follows_the_grammar_and_the_audit(spark):
    rows = spark.createDataFrame([(*r, 1) for r in random_rows(9, 40, 9)], "conv long, turn long, role string, text string, copies int")
    rows = dialogue.rows_of(rows, "conv")
    whole = dialogue.repairs(rows)
    audits = {r.conv: r.audit for r in whole.collect()}
    left = {}
    for r in sorted(dialogue.repaired(rows, whole).collect(), key=lambda r: (r.conv is None, r.conv or 0, r.place)):
        left.setdefault(r.conv, []).append(r)
    for conv, audit in audits.items():
        own = left.get(conv, [])
        assert [r.place for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == audit.replace("D", "")
        assert legal("".join(r.role[:1] for r in own))


def test_dropped_wholly_repeats_and_empty_tables(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    calm = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "Hi."), *[(calm, 0, "user", "Hi.")] * 5]
    got = found(spark, rows, tmp_path)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert got[calm][:7] == (0, 0, 4, 0, 4, 19, "KDDDDI") and got == brute(rows)
    assert found(spark, [], tmp_path) == {}


def test_very_long_texts(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t}" + " ab" * 200_000 + " " * 100_000 + ("." if t % 3 else "")) for t in range(3)]
    assert found(spark, rows, tmp_path) == brute(rows)
