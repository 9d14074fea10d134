"""The repair of conversations as SQL: checksums by a table, the chart as a recursion over rows with its four items in columns."""

from __future__ import annotations

_NEVER = 1_000_000_000
_ITEMS = ("e", "s", "u", "a")


def _moved(item: str, edit: str, cost: str, line: str | None = None, when: str = "true") -> str:
    """The item's value behind an edit: cost and audit grow, and the repaired lines if the edit leaves one."""
    lines = f"{item}.t" if line is None else f"list_append({item}.t, {line})"
    return f"CASE WHEN {when} THEN {{'c': {item}.c + {cost}, 'a': {item}.a || {edit}, 't': {lines}}} ELSE {{'c': {_NEVER}, 'a': '', 't': {item}.t}} END"


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _inserted(item: str, *roles: str) -> str:
    lines = f"list_concat({item}.t, [{', '.join(repr(r + ':') for r in roles)}])"
    return f"{{'c': {item}.c + {3 * len(roles)}, 'a': {item}.a || '{'I' * len(roles)}', 't': {lines}}}"


def _completed() -> str:
    u = _least("u", _inserted("e", "user"), _inserted("s", "user"), _inserted("a", "user"))
    a = _least("a", _inserted("u", "assistant"), _inserted("e", "user", "assistant"), _inserted("s", "user", "assistant"))
    return f"e, s, {u} AS u, {a} AS a"


def _scanned() -> str:
    stays, extra = "NOT x.gone", "CASE WHEN x.fault = 't' THEN 3 ELSE 0 END"

    def read(item: str, role: str, name: str) -> str:
        own = f"x.ini = '{role}'"
        return _moved(item, f"CASE WHEN {own} THEN 'K' ELSE 'R' END", f"CASE WHEN {own} THEN 0 ELSE 3 END + {extra}", f"CASE WHEN {own} THEN x.role ELSE '{name}' END || ':' || x.text", stays)

    gone = {i: _moved(i, "'D'", "4") for i in _ITEMS}
    s = _least(gone["s"], _moved("e", "'K'", extra, "x.role || ':' || x.text", f"{stays} AND x.ini = 's'"))
    u = _least(gone["u"], read("e", "u", "user"), read("s", "u", "user"), read("a", "u", "user"))
    a = _least(gone["a"], read("u", "a", "assistant"))
    return f"{gone['e']} AS e, {s} AS s, {u} AS u, {a} AS a"


_START = f"{{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS e, {', '.join(f'''{{'c': {_NEVER}, 'a': '', 't': []::VARCHAR[]}} AS {i}''' for i in _ITEMS[1:])}"
_BARE = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM named, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
faulty AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN {_BARE} = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right({_BARE}, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM placed),
rows_ AS (SELECT *, fault IN ('b', 'd') AS gone, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AND i > 1 AS odd FROM faulty),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, CAST(count(*) FILTER (fault = 'b') AS BIGINT) AS blank, CAST(count(*) FILTER (fault = 'd') AS BIGINT) AS duplicate,
  CAST(count(*) FILTER (fault = 't') AS BIGINT) AS truncated, CAST(count(*) FILTER (odd) AS BIGINT) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
chart AS (SELECT conv_id, 0 AS i, {_completed()} FROM (SELECT conv_id, {_START} FROM counts)
  UNION ALL SELECT conv_id, i, {_completed()} FROM (SELECT c.conv_id, CAST(x.i AS INTEGER) AS i, {_scanned()} FROM chart c JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.i = c.i + 1)),
best AS (SELECT c.conv_id, {_least("c.e", "c.a")} AS b FROM chart c JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.n = c.i)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  CAST(coalesce(b.b.c, 0) AS BIGINT) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(array_to_string(b.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
