"""Secret scan with structural confirmation of decoded candidates."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import chunks, text_or_empty, tidy

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run is found whole, so short ones need no later filter
# line ends may be escaped, as in JSON; headers such as Proc-Type and DEK-Info come before an empty line
_EOL = r"(?:\r?\n|\\r?\\n|\\r|\\n)"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY)-----((?:\s|\\[rn])*(?:[A-Za-z][A-Za-z0-9-]{{0,60}}:[^\n\\]{{0,400}}{_EOL})*(?:[A-Za-z0-9+/=\s]|\\[rn]){{16,}}?)-----END \1-----")
_HEADER = re.compile(rf"[A-Za-z][A-Za-z0-9-]{{0,60}}:[^\n\\]{{0,400}}{_EOL}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{4,}(?![A-Za-z0-9_.-])")
# a key's outer SEQUENCE is 0x30: base64 begins with M, hex with 30; the ssh container with its magic
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{39,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]{20,})={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:M[A-Za-z0-9+/]{39,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{20,})(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]{1,100})+={0,2}(?![A-Za-z0-9+/=])")
HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb])[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
SSH_MAGIC = b"openssh-key-v1\0"  # fixed value of the container format


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value of the DER element at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        x = der(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def private_key(data: bytes) -> bool:
    """A whole private key: PKCS#1 or DSA (integers), SEC1 or PKCS#8 (octets in a SEQUENCE), plain or encrypted."""
    top = der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = children(data, top[1], top[2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02:
        version = inner[0][2] - inner[0][1] == 1 and data[inner[0][1]] in (0, 1)
        if version and len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):
            return True
        if version and tags[1] == 0x04:  # SEC1: the secret number, then parameters and the public key
            return inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
        return version and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and _has_oid(data, inner[1]) and _key_inside(data, inner[2])
    return tags == [0x30, 0x04] and _has_oid(data, inner[0])


def _key_inside(data: bytes, octets: tuple[int, int, int]) -> bool:
    """What PKCS#8 wraps: a whole key again, an integer, or octets."""
    _, at, end = octets
    if private_key(data[at:end]):
        return True
    inside = der(data, at, end)
    return inside is not None and inside[2] == end and inside[0] in (0x02, 0x04) and inside[2] - inside[1] >= 16


def _has_oid(data: bytes, element: tuple[int, int, int]) -> bool:
    inner = children(data, element[1], element[2])
    return bool(inner) and inner[0][0] == 0x06


def ssh_key(data: bytes) -> bool:
    """The container's magic, then cipher, kdf and options as strings with lengths, then a count of keys."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def signed_token(text: str) -> bool:
    """Header and payload decode to JSON objects, the header names an algorithm other than none, and a signature follows."""
    head, body, signature = text.split(".", 2)
    raw = unbase64(head[:4])
    if raw is None or raw.lstrip()[:1] not in (b"{", b""):  # cheap: most dotted words end here
        return False
    try:
        a, b = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(a, dict) and isinstance(a.get("alg"), str) and a["alg"].lower() not in ("", "none") and isinstance(b, dict) and bool(unbase64(signature))


def _pem_key(body: str) -> bool:
    """An armoured body: a plain key, or with headers that name a cipher, whole blocks of ciphertext."""
    headers = _HEADER.findall(body)
    text = _HEADER.sub("", body).replace("\\r", "").replace("\\n", "")
    data = unbase64(text)
    if not data:
        return False
    if any(h.lower().startswith("dek-info:") for h in headers):
        return len(data) >= 32 and len(data) % 8 == 0
    return ssh_key(data) or private_key(data)


def _ends(blob: str) -> list[int]:
    """Where wrapped base64 may end: after the lines as wide as the first, with or without a shorter one that follows."""
    lines = list(re.finditer(r"[A-Za-z0-9+/=_-]+", blob))
    width = len(lines[0][0])
    full = next((i for i, x in enumerate(lines) if len(x[0]) != width), len(lines))
    last = full < len(lines) and len(lines[full][0]) < width
    return [*([lines[full].end()] if last else []), lines[full - 1].end()]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; positions are code points, end exclusive."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    inside: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if _pem_key(m[2]):
                out.append(("pem", *m.span()))
                inside.append(m.span())
    covered = lambda m: any(a <= m.start() < b for a, b in inside)
    wrapped = WRAPPED.finditer(text) if "\n" in text else ()
    for m in chain(wrapped, BLOB.finditer(text)):
        for end in () if covered(m) else _ends(m[0]):
            data = unbase64(m[0][:end])
            kind = data and ("ssh" if ssh_key(data) else "der" if private_key(data) else None)
            if kind:
                out.append((kind, m.start(), m.start() + end))
                inside.append((m.start(), m.start() + end))
                break
    for m in HEX_BLOB.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if ssh_key(data):
                out.append(("ssh", *m.span()))
            elif private_key(data):
                out.append(("der", *m.span()))
    if text.count(".") > 1:
        out += [("jwt", *m.span()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end, secret).

    Kinds: assign, access, hex (patterns), and those confirmed by structure:
    pem, der, ssh (private keys whose decoded lengths nest), jwt (signed tokens).
    A null or empty text has none and gives an empty array; repeated rows and ids
    are scanned each for itself; a text is held whole, a few at a time. An empty
    table gives no rows; other columns are not read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])

    def scanned(batches):
        for b in chunks(batches):
            found = []
            for x in b.column("text"):
                text = x.as_py()
                found.append([{"kind": k, "start": i, "end": j, "secret": text[i:j]} for k, i, j in find_secrets(text)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        tidy(scanned), "doc_id long, spans array<struct<kind string, start long, end long, secret string>>"
    )


def span_digest(spans, base_only: bool):
    """kind:start:end of each span, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex")) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_digest(text: str) -> str:
    """The digest of the base spans of one text, for checks."""
    return hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in find_secrets(text) if k in KINDS[:3]).encode()).hexdigest()
