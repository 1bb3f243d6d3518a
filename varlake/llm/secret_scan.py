"""Secrets in texts: patterns first, then structural confirmation of what their encodings hold."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text

# The base patterns, the least size of their group, and the order of kinds in a digest.
BASE = (
    ("assign", re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), 1, 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 20),
    ("hex", re.compile(r"([0-9a-f]{24,})"), 1, 24),
)
STRUCTURAL = ("jwt", "pem_key", "der_key", "ssh_key", "nested")
KINDS = (*(k for k, *_ in BASE), *STRUCTURAL)
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
# Line ends may be escaped, as in JSON; a key may have header lines.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s|\\+[rn])*+(?:[A-Za-z][A-Za-z0-9-]*+: [^\r\n\\]*+(?:\s|\\+[rn])++)*+)((?:[A-Za-z0-9+/=\s]|\\+[rn])++)-----END \1-----")
_ENDS = re.compile(r"\s|\\+[rn]")
_CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}")
_NEXT = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_WORDS = re.compile(r"(?i)passw|secret|token|api")


def from_base64(s: str) -> bytes | None:
    """The bytes of a base64 string of either alphabet, padded or not; None if it is none."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the elements that fill data[at:end] exactly; None if lengths don't nest."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key as PKCS#1, PKCS#8 or SEC1: one sequence that starts with a small version and whose lengths nest."""
    top = der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der(data, *top[0][1:])
    if not parts or len(parts) < 2 or parts[0][0] != 2 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    tags = [t for t, _, _ in parts]
    if len(tags) == 2:
        return tags[1] == 4 and data[parts[0][1]] == 1 and parts[1][2] - parts[1][1] >= 16
    if tags[1] == 0x30 and tags[2] == 4:
        inner = der(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 6
    return tags[1] == 4 or len(tags) >= 6 and set(tags) == {2}


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its magic, then length-prefixed names."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at <= len(data)


def is_jwt(header: str) -> bool:
    """A header that decodes to a JSON object naming its algorithm."""
    raw = from_base64(header)
    if not raw or raw[:1] != b"{":
        return False
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def key_structure(data: bytes) -> str | None:
    """The kind of key that decoded bytes are, or None."""
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")


def as_text(data: bytes) -> str | None:
    """The bytes as UTF-8 of 16 bytes or more without control characters other than white space; None if they are none."""
    if len(data) < 16:
        return None
    try:
        out = data.decode()
    except UnicodeDecodeError:
        return None
    return None if _CONTROLS.search(out) else out


def base_spans(t: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(start, kind, end) of the base matches and the count of each kind."""
    spans, counts = [], []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        if kind == 0 and not _WORDS.search(t) or kind == 1 and "AKIA" not in t:
            counts.append(0)
            continue
        own = [(m.start(), kind, m.end()) for m in pattern.finditer(t) if m.end(group) - m.start(group) >= least]
        spans += own
        counts.append(len(own))
    return sorted(spans), counts


def wrapped(t: str, m: re.Match) -> list[tuple[str, int]]:
    """The run and its end, after the same joined with the lines of its width that only line ends part from it, with and without a shorter last one."""
    out = [(m[0], m.end())]
    while not out[-1][0].endswith("=") and (n := _NEXT.match(t, out[-1][1])) and len(n[1]) <= len(m[0]):
        out.append((n[1], n.end()))
        if len(n[1]) < len(m[0]):
            break
    lines = [line for line, _ in out]
    return [("".join(lines[:k]), out[k - 1][1]) for k in sorted({len(out), max(1, len(out) - 1), 1}, reverse=True)]


def decodings(s: str) -> list[bytes | None]:
    digits = s[2:] if s[:2] in ("0x", "0X") else s
    return [from_base64(s)] + ([bytes.fromhex(digits)] if len(digits) % 2 == 0 and _HEX.fullmatch(digits) else [])


def structural_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that decoding and parsing confirm.

    A candidate that decodes to text is "nested" if that text holds a secret, at any depth. Only the first decoding that
    gives text is searched, and it is a quarter shorter at least, so all levels together take a few times the text's length."""
    found, base = [], len(BASE)
    if "." in t:
        found += [(m.start(), base, m.end()) for m in _JWT.finditer(t) if is_jwt(m[1])]
    if "-----BEGIN " in t:
        for m in _PEM.finditer(t):
            raw = from_base64(_ENDS.sub("", m[3]))
            if raw and (is_der_key(raw) or is_ssh_key(raw) or m[1].startswith("ENCRYPTED") and der(raw, 0, len(raw)) or _CIPHER.search(m[2]) and len(raw) >= 32 and len(raw) % 8 == 0):
                found.append((m.start(), base + 1, m.end()))
    # Candidates come in order, so it is enough to know where the hits that begin before one end at the latest.
    tried, held, covered = 0, sorted(found), 0
    at = 0
    for m in _RUN.finditer(t):
        while at < len(held) and held[at][0] <= m.start():
            covered = max(covered, held[at][2])
            at += 1
        if m.start() >= covered:
            # Lines that an earlier run was joined with aren't joined again, so the time stays linear.
            joined = wrapped(t, m) if m.start() >= tried else [(m[0], m.end())]
            tried = max(tried, joined[0][1])
            made = [(d, end) for s, end in joined for d in decodings(s) if d]
            hit = next(((k, end) for d, end in made if (k := key_structure(d))), None)
            if not hit and (inner := next(((t_, end) for d, end in made if (t_ := as_text(d)) is not None), None)) and (base_spans(inner[0])[0] or structural_spans(inner[0])):
                hit = "nested", inner[1]
            if hit:
                found.append((m.start(), KINDS.index(hit[0]), hit[1]))
                covered = max(covered, hit[1])
    return sorted(found)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, base and spans, arrays of struct(kind, start, end) in code points with the end exclusive, by start and then kind as listed in KINDS.

    base holds the pattern matches; spans has the structurally confirmed candidates besides, nested ones at any depth; of
    equal starts the order of KINDS decides. Null and empty texts have no spans; repeated rows stay; other columns aren't read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in text.chunks(batches, "text_"):
            base, spans = [], []
            for t in batch.column("text_").to_pylist():
                own, _ = base_spans(t or "")
                more = structural_spans(t or "")
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own + more)])
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(base, pa.list_(kind)), pa.array(spans, pa.list_(kind))], ["doc_id", "base", "spans"])

    cols = docs.select(F.col(f"`{id_column}`").cast("long").alias("id_"), F.col(f"`{text_column}`").alias("text_"))
    span = "array<struct<kind: string, start: int, end: int>>"
    return text.mapped(cols, run, f"doc_id long, base {span}, spans {span}")
