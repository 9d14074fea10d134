"""The learning of codebooks as SQL: rounds written out one after the other, every entry against every part."""

from __future__ import annotations

PARTS, SIZE, ROUNDS = 4, 256, 4


def _assigned(books: str) -> str:
    away = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    return f"SELECT r, part, min(struct_pack(d := CAST({away} AS BIGINT), entry := entry)) AS best FROM p JOIN {books} b USING (part) GROUP BY r, part"


def sql() -> str:
    """Rows of the registered query."""
    rounds = ""
    for i in range(1, ROUNDS + 1):
        rounds += f"""
a{i} AS MATERIALIZED ({_assigned(f'b{i - 1}')}),
m{i} AS (SELECT part, entry, list(mean ORDER BY j) AS v FROM (SELECT part, a.best.entry AS entry, j, CAST(floor(CAST(sum(p.v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
  FROM p JOIN a{i} a USING (r, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS j) GROUP BY part, a.best.entry, j) GROUP BY part, entry),
b{i} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i - 1} b LEFT JOIN m{i} m USING (part, entry)),"""
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] AS v FROM k, range({PARTS}) t(part)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS entry FROM k ORDER BY entry LIMIT {SIZE}),
b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN s USING (r)),{rounds}
f AS MATERIALIZED ({_assigned(f'b{ROUNDS}')}),
c AS (SELECT r, string_agg(printf('%02x', f.best.entry), '' ORDER BY part) AS code, CAST(sum(f.best.d) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM b{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.digest AS codebooks_sha256 FROM k JOIN c USING (r), h
"""
