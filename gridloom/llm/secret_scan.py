"""Secret scans: patterns find candidates, their structure is confirmed before they are reported.

Base kinds are patterns with a length condition. A confirmed kind needs more than a pattern:

* ``jwt``: two base64url parts and a signature after dots, the first of which decodes to a JSON
  object that names an algorithm, the second to a JSON object; the signature is empty only for
  the algorithm "none".
* ``pem``: a private-key block whose base64 body decodes to a DER key or to an OpenSSH key. Line ends
  may be escaped, as they are in JSON and environment files.
* ``der``: base64 or hex text that decodes to a DER sequence whose length covers the value to its
  last byte, whose members nest without overrun, and which is laid out as a private or public key.
* ``ssh``: base64 text that decodes to length-prefixed fields, the first of which names a key type.

Base64 that is wrapped over lines is joined before it is decoded.

Defined results: a null or empty text has no spans. Spans are in code points, end exclusive.
Overlapping spans of different kinds are all reported. Every row gives one row; nulls and repeats
in other columns change nothing. A candidate is decoded in time linear in its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, table

#: Fixed by the contract of the query.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Maximal runs of [0-9a-f] of at least 24: the same spans, found without visiting each short run.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

#: Three parts by dots; whether they are JSON is seen after decoding. The shortest header names an algorithm.
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----"
)
ESCAPED = re.compile(r"\\[nr]|\s+")
#: Lines of base64 with another one below, and what may be the last, shorter one.
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])((?:[A-Za-z0-9+/_-]{40,}(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n))+)([A-Za-z0-9+/_-]*={0,2})"
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}(?![0-9A-Fa-f])")
#: Names of key types and the head of OpenSSH private keys (fixed by their formats).
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256",
             b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH_HEAD = b"openssh-key-v1\0"
INTEGER, BITS, OCTETS, OBJECT, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x06, 0x30, 0x31


def decoded(text: str) -> bytes | None:
    """Bytes of base64 or base64url text, with or without padding."""
    body = text.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(part: str) -> dict | None:
    raw = decoded(part)
    try:
        value = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(head: str, body: str, signature: str) -> bool:
    header = json_object(head)
    if not header or not isinstance(header.get("alg"), str) or json_object(body) is None:
        return False
    return header["alg"].lower() == "none" if not signature else decoded(signature) is not None


def der_members(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly."""
    members = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + length > end:
            return None
        members.append((tag, at, at + length))
        start = at + length
    return members


def is_der_key(data: bytes) -> bool:
    """A private key (PKCS 1, SEC 1, PKCS 8, encrypted PKCS 8) or a public key, to the last byte."""
    outer = der_members(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    members = der_members(data, *outer[0][1:])
    if not members:
        return False
    for tag, start, end in members:
        if tag in (SEQUENCE, SET) and der_members(data, start, end) is None:
            return False
    tags = [m[0] for m in members]
    if tags[0] == INTEGER and members[0][2] - members[0][1] == 1:
        small = data[members[0][1]]
        if tags[1:2] == [INTEGER]:
            return len(tags) >= 9 and set(tags[:9]) == {INTEGER} and small <= 1
        if tags[1:2] == [OCTETS]:
            return small == 1
        if tags[1:3] == [SEQUENCE, OCTETS]:
            return small <= 1 and _starts_with_object(data, members[1])
        return False
    if tags == [SEQUENCE, OCTETS] or tags == [SEQUENCE, BITS]:
        return _starts_with_object(data, members[0])
    return tags == [INTEGER, INTEGER] and members[0][2] - members[0][1] >= 64


def _starts_with_object(data: bytes, member: tuple[int, int, int]) -> bool:
    inner = der_members(data, *member[1:])
    return bool(inner) and inner[0][0] == OBJECT


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(OPENSSH_HEAD):
        return True
    at, fields = 0, []
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return False
        fields.append(data[at + 4 : end])
        at = end
    return len(fields) >= 2 and fields[0] in SSH_TYPES


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [
        (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= MIN_ASSIGN
    ]
    if "AKIA" in text:
        found += [
            (m.start(), m.end(), "access") for m in ACCESS.finditer(text)
            if m.end() - m.start() >= MIN_ACCESS
        ]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(*m.groups())]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            body = decoded(ESCAPED.sub("", m[2]))
            if body is not None and (is_der_key(body) or is_ssh_key(body)):
                found.append((m.start(), m.end(), "pem"))
    for pattern, decode in ((BASE64, decoded), (ANY_HEX, _from_hex)):
        for m in pattern.finditer(text):
            kind = key_kind(decode(m[0]))
            if kind:
                found.append((m.start(), m.end(), kind))
    for m in WRAPPED.finditer(text):
        body = ESCAPED.sub("", m[1])
        # The last line is shorter, or what follows the key.
        kind = key_kind(decoded(body + m[2]))
        if kind:
            found.append((m.start(), m.end(), kind))
        elif m[2] and key_kind(decoded(body)):
            # The last whole line alone was looked at already; a key of one line is not wrapped.
            kept = m[1].rstrip(" \t\r\n")
            if ESCAPED.search(kept):
                found.append((m.start(), m.start() + len(kept), key_kind(decoded(body))))
    return found


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    if data[:1] == b"\x30" and is_der_key(data):
        return "der"
    return "ssh" if is_ssh_key(data) else None


def _from_hex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by pattern) and spans (with the confirmed ones), and counts by kind."""

    def scan(columns: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": columns["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base": [], "spans": []}
        for text in columns["text"]:
            base = base_spans(text or "")
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base"].append(joined(base))
            out["spans"].append(joined(base + confirmed_spans(text or "")))
        return out

    return map_batches(
        docs.select("doc_id", "text"), scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string",
    )


def op6_secrets(spark, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans",
    )
