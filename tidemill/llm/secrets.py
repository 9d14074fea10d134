"""Secret scans over whole texts: fixed patterns, and candidates that are decoded and parsed before they are reported.

Pattern kinds: ``assign`` (a name such as password or token, and a value), ``access`` (access key ids) and ``hex``.
Structural kinds, each confirmed by its decoded content:

* ``der``: base64 or hex (with or without 0x) of an ASN.1 private key (PKCS#1, PKCS#8, SEC 1) whose nested lengths fit
  exactly; it may run over several lines, with PEM armour or without;
* ``ssh``: base64 of an OpenSSH private key whose length-prefixed fields fit, over several lines as well;
* ``jwt``: three base64url parts, the first a JSON object that names an algorithm, the second a JSON object.

Spans are ``kind, start, end`` in code points, the end exclusive, ordered by start and then by kind as listed in
``KINDS``.  Defined results: a null text counts as empty (no spans); null keys stay; repeated rows give repeated rows; very
long texts take time linear in their length; empty tables give empty frames; only the key is carried, so other columns cannot
clash.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE = KINDS[:3]

# The base patterns.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s\\]+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])()([A-Za-z0-9+/_-]{40,}={0,2})")
LONG_HEX = re.compile(r"(?<![0-9A-Za-z])(0[xX])?((?:[0-9a-fA-F]{2}){32,})(?![0-9A-Za-z])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})")

# Keys wrapped over lines without armour: how they begin, what a line holds, and what stands between lines.
WRAPPED64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=M[C-I]|b3Bl)")
WRAPPED_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?(?=30(?:[2-7]|8[1-4]))")
LINE64, LINE_HEX = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9a-fA-F]+")
GAP = re.compile(r"[ \t]*(?:\\[nr]|[\r\n])+[ \t]*")
DER_HEAD = re.compile(rb"0(?:([\x20-\x7f])|\x81(.)|\x82(..)|\x83(...)|\x84(....))\x02\x01[\0\1]", re.DOTALL)
SSH_HEAD = b"openssh-key-v1\0"
#: Digits that tell whether a key begins.
HEAD = 24
#: Bytes of the longest key that is looked for over lines without armour; an RSA key of 16,384 bits takes 9,300.
LONGEST = 1 << 15

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def unbase64(text: str) -> bytes:
    """Bytes of base64 in either alphabet, padded or not; empty if it is none."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the items that fill ``data`` exactly; None if they don't."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is one ASN.1 sequence with the fields of a private key."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    fields = der_items(outer[0][1])
    if not fields or len(fields) < 2 or fields[0][0] != 0x02 or fields[0][1] not in (b"\0", b"\1"):
        return False
    if fields[1][0] == 0x30 and len(fields) >= 3 and fields[2][0] == 0x04:  # PKCS#8: algorithm, then the key
        algorithm = der_items(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if fields[1][0] == 0x04:  # SEC 1: the scalar
        return fields[0][1] == b"\1" and 16 <= len(fields[1][1]) <= 66
    return len(fields) >= 6 and all(tag == 0x02 for tag, _ in fields)  # PKCS#1 and DSA: integers


def ssh_size(data: bytes) -> int | None:
    """Size of the OpenSSH private key that ``data`` begins with: cipher, KDF, options, count, public keys and the private part."""
    if not data.startswith(SSH_HEAD):
        return None
    at = len(SSH_HEAD)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        at += size
        return data[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(field() for _ in range(keys)) and field() else None


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key."""
    return ssh_size(data) == len(data)


def is_token(header: str, payload: str) -> bool:
    """Whether the first two parts of a signed token are JSON objects and the first names an algorithm."""
    try:
        head, body = json.loads(unbase64(header)), json.loads(unbase64(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def key_kind(data: bytes) -> str | None:
    """``der``, ``ssh`` or nothing."""
    return "ssh" if is_ssh_key(data) else "der" if is_private_der(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class _Lines:
    """Runs of consecutive lines of digits, each read once: where lines begin and end, and the digits before each."""

    def __init__(self, text: str, line: re.Pattern) -> None:
        self.text, self.line, self.runs = text, line, {}

    def run(self, at: int) -> tuple[int, tuple[list[int], list[int], list[int]]] | None:
        """The place of the line that begins at ``at`` in its run, and the run; none if no digits are there."""
        if at not in self.runs:
            starts, ends, digits, here = [], [], [0], at
            while here not in self.runs and (m := self.line.match(self.text, here)):
                self.runs[here] = (len(starts), (starts, ends, digits))
                starts.append(here)
                ends.append(m.end())
                digits.append(digits[-1] + m.end() - here)
                if not (gap := GAP.match(self.text, m.end())):
                    break
                here = gap.end()
        return self.runs.get(at)


def wrapped_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys whose digits run over several lines; the key's own lengths tell where it ends, which must be the end of a line's digits.

    A key's size stands in its first bytes, so that no more is decoded than the size asks for, and nothing where it asks for
    more than the text holds, than its run of lines holds, or than ``LONGEST``.
    """
    for begin, line, bits in ((WRAPPED64, LINE64, 6), (WRAPPED_HEX, LINE_HEX, 4)):
        decoded = (lambda x: unbase64(x + "A" * (-len(x) % 4))) if bits == 6 else lambda x: bytes.fromhex(x[: len(x) // 2 * 2])
        lines = _Lines(text, line)
        for m in begin.finditer(text):
            first = line.match(text, m.end())
            gap = first and GAP.match(text, first.end())
            found = lines.run(gap.end()) if gap else None  # the lines behind the first are the same for all that begin among them
            if not first or not found:
                continue
            place, (starts, ends, digits) = found
            held = len(first[0])

            def taken(size: int, first: str = first[0], held: int = held, place: int = place, starts: list = starts, ends: list = ends, digits: list = digits) -> str:
                last = min(bisect.bisect_left(digits, digits[place] + size - held), len(starts))
                return first + "".join(text[a:b] for a, b in zip(starts[place:last], ends[place:last], strict=True))

            head = decoded(taken(HEAD)[:HEAD])
            if own := DER_HEAD.match(head):
                length = own[own.lastindex]
                size = int.from_bytes(length, "big") + 2 + (len(length) if own.lastindex > 1 else 0)
            elif head.startswith(SSH_HEAD):
                size = ssh_size(decoded(taken(-(-8 * LONGEST // bits)))) or 0
            else:
                continue
            wanted = -(-8 * size // bits)
            if not 0 < size <= LONGEST or wanted > held + digits[-1] - digits[place]:
                continue
            last = bisect.bisect_left(digits, digits[place] + wanted - held)
            if last <= place or digits[last] - digits[place] + held != wanted:  # within the first line, or not at the end of one
                continue
            if kind := key_kind(decoded(taken(wanted))[:size]):
                end = ends[last - 1]
                yield kind, m.start(), end + (0 if bits == 4 else len(text[end : end + 2]) - len(text[end : end + 2].lstrip("=")))


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans confirmed by decoding and parsing."""
    found: set[tuple[str, int, int]] = set()
    covered: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if kind := key_kind(unbase64(re.sub(r"\\[nr]|\s", "", m[1]))):
                found.add((kind, m.start(), m.end()))
                covered.append(m.span())
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if is_token(m[1], m[2]):
                found.add(("jwt", m.start(), m.end()))
                covered.append(m.span())
    for pattern, decoded in ((BASE64, unbase64), (LONG_HEX, bytes.fromhex)):
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in covered) and (kind := key_kind(decoded(m[2]))):
                found.add((kind, m.start(), m.end()))
                covered.append(m.span())
    if "\n" in text or "\r" in text or "\\" in text:
        found.update(s for s in wrapped_spans(text) if not any(a < s[2] and s[1] < b for a, b in covered))
    return sorted(found)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    return sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans`` (array of kind, start, end) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN)], [key, "spans"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("spans", SPAN)]))


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with its spans masked, overlapping spans as one."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
