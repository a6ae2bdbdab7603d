"""Secrets in texts: patterns, and candidates confirmed by their structure.

Base kinds are patterns alone: ``assign`` (a name that promises a secret, with a value), ``access`` (access key ids)
and ``hex`` (long runs of hex digits). Structural kinds are reported only after decoding: ``pem`` (an armoured block
whose body decodes to nested lengths that add up), ``key`` (base64 or hex that holds such an encoding by itself),
``ssh`` (base64 of length-prefixed public-key-type fields) and ``signed`` (a signed token with a JSON header that
names its algorithm and a JSON payload).

Positions are code points, ends exclusive. Null texts are empty and have no spans. Overlapping spans of different
kinds are all kept, ordered by start and then by kind as listed in ``KINDS``. Rows are never merged, other columns
stay, and a column named like the result is replaced.
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

from tertulia.llm.common import slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "ssh", "signed")
SPAN = "struct<kind:string,start:int,end:int>"

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: shorter ones fail
_MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,64})-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{48,}")
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
#: Deepest nesting that is followed.
DEPTH = 12


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it is neither."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the tag-length-value element at ``at``; None if it does not fit."""
    if end - at < 2:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size == 0x80:
        return None
    if size > 0x80:
        n = size & 0x7F
        if n > 4 or start + n > end:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (tag, start, start + size) if start + size <= end else None


def elements(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """Number of elements that fill ``data[at:end]`` exactly, nested ones included; None if lengths do not add up."""
    count = 0
    while at < end:
        found = element(data, at, end)
        if found is None or depth > DEPTH:
            return None
        tag, start, stop = found
        count += 1
        if tag & 0x20:
            inner = elements(data, start, stop, depth + 1)
            if inner is None:
                return None
            count += inner
        at = stop
    return count


def is_key_encoding(data: bytes) -> bool:
    """A sequence that spans all bytes, whose nested lengths add up, and that begins as keys do: with a version
    number, or with an algorithm that is itself a sequence led by an object identifier."""
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data) or (elements(data, 0, len(data)) or 0) < 3:
        return False
    first = element(data, outer[1], outer[2])
    if first is None:
        return False
    tag, start, stop = first
    if tag == 0x02:
        return True
    if tag == 0x30:
        inner = element(data, start, stop)
        return inner is not None and inner[0] in (0x06, 0x02, 0x30, 0xA0)
    return False


def is_ssh_encoding(data: bytes) -> bool:
    """Fields with 32-bit lengths that fill the bytes, the first a key type; or the magic of a private key file."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or (fields == 0 and not data[4 : 4 + size].startswith(_SSH_TYPES)):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 2


def is_signed_token(token: str) -> bool:
    """Header and payload decode to JSON objects, and the header names an algorithm."""
    parts = []
    for part in token.split(".")[:2]:
        data = decode_base64(part)
        try:
            parts.append(json.loads(data.decode()) if data else None)
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
    header, payload = parts
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _armoured(text: str) -> list[tuple[int, int, int, int]]:
    """Start, inside and end of armoured blocks, leftmost first and apart: a beginning and the next end of its label.

    One pass over the text and one over its markers from behind, however many have no end.
    """
    markers = list(_MARKER.finditer(text))
    ends: dict[str, re.Match] = {}
    pairs: list[tuple[re.Match, re.Match | None]] = []
    for m in reversed(markers):
        if m[1] == "END":
            ends[m[2]] = m
        else:
            pairs.append((m, ends.get(m[2])))
    found, free = [], 0
    for begin, end in reversed(pairs):
        if end is not None and begin.start() >= free:
            found.append((begin.start(), begin.end(), end.start(), end.end()))
            free = end.end()
    return found


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for start, inside, outside, end in _armoured(text) if "-----BEGIN " in text else ():
        body = "".join(line for line in text[inside:outside].split() if ":" not in line)
        data = decode_base64(body)
        if data and (is_key_encoding(data) or is_ssh_encoding(data)):
            found.append(("pem", start, end))
    for m in _BASE64.finditer(text):
        data = decode_base64(m[0])
        if data:
            if is_key_encoding(data):
                found.append(("key", *m.span()))
            elif is_ssh_encoding(data):
                found.append(("ssh", *m.span()))
    for m in _HEX_ANY.finditer(text):
        if len(m[0]) % 2 == 0 and is_key_encoding(bytes.fromhex(m[0])):
            found.append(("key", *m.span()))
    if text.count(".") >= 2:
        found += [("signed", *m.span()) for m in _SIGNED.finditer(text) if is_signed_token(m[0])]
    return found


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    spans = {*base_spans(text), *structural_spans(text)}
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def with_secret_spans(df: DataFrame, text: str = "text", name: str = "secret_spans") -> DataFrame:
    """``df`` with the secrets of each text as an array of (kind, start, end)."""

    @F.arrow_udf(f"array<{SPAN}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t)] for t in batch.to_pylist()]
            yield pa.array(rows, kind)

    return df.withColumn(name, scan(F.col(text)))


def with_redacted(
    df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]"
) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``; overlapping or touching spans become one mark."""

    @F.arrow_udf("string")
    def redact(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in slices(batches):
            out = []
            for t, own in zip(texts.to_pylist(), found.to_pylist(), strict=True):
                if t and own:
                    parts, at = [], 0
                    for start, end in merged((s["start"], s["end"]) for s in own):
                        parts += [t[at:start], mark]
                        at = end
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.array(out, pa.string())

    return df.withColumn(text, redact(F.col(text), F.col(spans)))


def merged(spans) -> list[tuple[int, int]]:
    """Unions of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
