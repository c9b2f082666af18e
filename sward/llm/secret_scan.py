"""Secrets in texts: base patterns, and encoded keys and tokens that are reported once their structure is confirmed.

A run of base64 or hex is only a candidate. It is decoded, and what it decodes to has to parse: a private key as nested
tag-length-value fields that fill each other exactly, an OpenSSH key as its magic and length-prefixed fields, a signed
token as a JSON header naming an algorithm, a JSON body and a signature of that algorithm's length. Base64 of readable
text is searched for the same things. One pass over the rows; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "key", "ssh_key")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_JOSE = re.compile(r"(?<![A-Za-z0-9_-])e[w-z][A-Za-z0-9_-]{6,}+(?:\.[A-Za-z0-9_-]*+){2,4}")
#: Starts of base64 runs: the first characters are enough to see what the bytes begin with.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}+")
#: A wrapped run: characters of the alphabet with line breaks, plain or escaped, between them.
_BREAK = re.compile(r"(?:[\r\n\t ]|\\[nr])+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")

_SSH_MAGIC = b"openssh-key-v1\x00"
_DEPTH = 3
#: Bytes of the largest key that is looked for, so that a length that only looks like one costs little.
_LARGEST = 1 << 16
#: Bytes of a signature by algorithm of a signed token (None: any length above 127).
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
               "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base matches, by start and then kind, as (kind, start, end) in code points."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def unbase64(chars: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it has a length that no bytes have."""
    chars = chars.rstrip("=")
    if len(chars) % 4 == 1:
        return None
    try:
        return base64.b64decode(chars.replace("-", "+").replace("_", "/") + "=" * (-len(chars) % 4), validate=True)
    except binascii.Error:
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value of the field at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        size = n - 128
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= end else None


def fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The fields that fill ``start`` to ``end`` exactly, or None."""
    out = []
    while start < end:
        f = tlv(data, start, end)
        if f is None:
            return None
        out.append(f)
        start = f[2]
    return out


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one of the private key encodings, from the first byte to the last: RSA and DSA (a version and
    whole numbers), elliptic curve (version 1 and an octet string), wrapped keys (version, algorithm, octet string),
    encrypted wrapped keys (algorithm, octet string), key stores (version 3 and content with its type)."""
    outer = fields(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = fields(data, *outer[0][1:]) or []
    tags = [f[0] for f in inner]

    def algorithm(f: tuple[int, int, int]) -> bool:
        own = fields(data, *f[1:]) if f[0] == 0x30 else None
        return bool(own) and own[0][0] == 0x06

    if tags[:1] == [0x02]:
        version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big")
        if set(tags) == {0x02}:
            return version == 0 and len(tags) in (6, 9) and inner[1][2] - inner[1][1] >= 32
        if tags[1] == 0x04:
            return version == 1 and inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
        if tags[1:3] == [0x30, 0x04]:
            return version in (0, 1) and algorithm(inner[1]) and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
        return version == 3 and tags[1] == 0x30 and algorithm(inner[1]) and all(t == 0x30 for t in tags[2:])
    return tags == [0x30, 0x04] and algorithm(inner[0]) and inner[1][2] - inner[1][1] >= 16


def ssh_key_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` begins with, by its length-prefixed fields, or None."""

    def string(at: int) -> int | None:
        n = int.from_bytes(data[at : at + 4], "big")
        return at + 4 + n if at + 4 <= len(data) and at + 4 + n <= len(data) else None

    if not data.startswith(_SSH_MAGIC):
        return None
    at: int | None = len(_SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        at = string(at)
        if at is None:
            return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return None
    for _ in range(count + 1):  # public keys, then the private part
        at = string(at)
        if at is None:
            return None
    return at


def is_token(parts: list[str]) -> bool:
    """Whether dot-separated parts are a signed token (three) or an encrypted one (five)."""
    decoded = [unbase64(p) for p in parts]
    try:
        header = json.loads(decoded[0]) if decoded[0] else None
        body = json.loads(decoded[1]) if len(parts) == 3 and decoded[1] else None
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str) and all(d is not None for d in decoded) and bool(decoded[3]) and bool(decoded[4])
    if not isinstance(body, dict) or header["alg"] not in _SIGNATURES or not decoded[2]:
        return False
    size = _SIGNATURES[header["alg"]]
    return len(decoded[2]) == size if size else len(decoded[2]) >= 128


def _wrapped(text: str, start: int, need: int) -> tuple[str, int]:
    """At most ``need`` base64 characters from ``start`` on, over line breaks, and where the last one ends."""
    got, total, at, end = [], 0, start, start
    while m := _LINE.match(text, at, at + need - total):
        got.append(m[0])
        total, end = total + len(m[0]), m.end()
        if total >= need or not (b := _BREAK.match(text, end)):
            break
        at = b.end()
    return "".join(got), end


def _encoded(text: str, start: int, run: str) -> Iterator[Span]:
    head = unbase64(run[:24]) or b""
    if head[:1] == b"\x30" and 0 < (size := _declared(head) or 0) <= _LARGEST:
        chars, end = _wrapped(text, start, need := -(-size * 8 // 6))
        if len(chars) == need and not _LINE.match(text, end) and is_private_key(unbase64(chars) or b""):
            yield "key", start, end + len(_pad(text, end))
    elif head.startswith(_SSH_MAGIC):
        size = ssh_key_size(unbase64(_even(_wrapped(text, start, _LARGEST)[0])) or b"")
        if size:
            end = _wrapped(text, start, -(-size * 8 // 6))[1]
            yield "ssh_key", start, end + len(_pad(text, end))


def _declared(head: bytes) -> int | None:
    """Bytes that the first field says it has, with its own tag and length."""
    n = head[1]
    if n < 128:
        return n + 2
    size = n - 128
    return int.from_bytes(head[2 : 2 + size], "big") + 2 + size if 1 <= size <= 4 else None


def _even(chars: str) -> str:
    return chars[: len(chars) - (len(chars) % 4 == 1)]


def _pad(text: str, at: int) -> str:
    return text[at : at + 2] if text[at : at + 2] == "==" else text[at : at + 1] if text[at : at + 1] == "=" else ""


def structured(text: str, depth: int = 0) -> Iterator[Span]:
    """Confirmed keys and tokens of a text. Base64 of readable text is searched too, a few levels deep; what it holds is
    reported at the outer run, once for each kind."""
    for m in _JOSE.finditer(text):
        parts = m[0].split(".")
        if len(parts) == 5 and is_token(parts):
            yield "token", *m.span()
        elif is_token(parts[:3]):
            yield "token", m.start(), m.start() + len(".".join(parts[:3]))
    for m in _RUN.finditer(text):
        yield from _encoded(text, m.start(), m[0])
        if depth < _DEPTH and (head := unbase64(m[0][:24])) and head.isascii():
            inner = unbase64(_even(m[0].rstrip("=")))
            if inner and inner.isascii():
                yield from {(kind, *m.span()) for kind, _, _ in structured(inner.decode("ascii"), depth + 1)}
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and _declared(bytes.fromhex(m[0][:12])) == len(m[0]) // 2 and is_private_key(bytes.fromhex(m[0])):
            yield "key", *m.span()


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches):
    for batch in batches:
        base, more = [], []
        for text in batch.column("_text").to_pylist():
            own = base_spans(text) if text else []
            found = sorted({*own, *structured(text)}, key=_order) if text else []
            base.append([{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in own])
            more.append([{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in found])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_SPAN))], names=["key", "base", "spans"])


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every row: ``key``, ``base`` and ``spans`` (base and confirmed), arrays of (kind number, start, end) in code
    points, end exclusive, by start and then kind.

    Null and empty texts have no spans. Every row gives one row: repeated rows and rows with a null key too. Spans of
    different kinds may overlap or be equal, each is reported. A text of any length is read whole, in time that grows with
    it; keys are looked for up to 64 KB each. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = "array<struct<kind int, start int, end int>>"
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col("text").alias("_text"))
    return rows.mapInArrow(_scan, f"key {kind}, base {span}, spans {span}").withColumnRenamed("key", key)


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def _is_kind(k: int):
    return lambda s: s["kind"] == k


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and hash of the base spans of :func:`find`, and the list of all spans."""
    count = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select(key, *count, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def masked(text: str, spans: list[tuple[int, int]], mask: str = "<SECRET>") -> str:
    """The text with every span replaced; overlapping spans are replaced together."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])
