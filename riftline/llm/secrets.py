"""Secret scan with structural confirmation.

Three base patterns are reported as they match. Further candidates - runs of
base64, hex and dotted token text - are reported only after their structure
holds: a DER key whose nested lengths fill the decoded bytes, an OpenSSH key
whose length-prefixed fields parse, a signed token whose header is JSON that
names an algorithm, or a PEM block that holds one of these.

A text is first mapped to character classes with two byte translations and
searched for runs long enough to matter, so texts without candidates cost a few
memory scans. Every text is scanned whole.

Defined results: a null text is an empty text (no spans; the digest of the
empty string); positions are code points, ends exclusive; rows are independent,
so repeated rows repeat results; an empty table gives no rows; other columns may
have any names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")

#: Shortest decoded structure looked at: 24 base64 characters or 48 hex digits.
RUN64, RUNHEX = 24, 48
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})")
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?:\s|\\[rn])*+(?:[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+(?:\\r)?(?:\n|\\n))++)?)([A-Za-z0-9+/=\s\\]{32,})-----END \1-----"
)
#: Headers of a PEM body that is enciphered as a whole.
ENCIPHERED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED.*DEK-Info:\s*[A-Za-z0-9-]+,\s*[0-9A-Fa-f]{16,32}(?![0-9A-Fa-f])", re.DOTALL)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN64)
#: Base64 over several lines, whose breaks may be written as escapes.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:[\x20\t]*+(?:\\r)?\r?(?:\n|\\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}" % RUN64)
LINE = re.compile(r"(?:\\r)?\\n|[A-Za-z0-9+/_-]+")
LONGHEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{%d,}" % RUNHEX)


def _classes(chars: bytes) -> bytes:
    return bytes(120 if c in chars else 32 for c in range(256))


_HEX_CLASS = _classes(b"0123456789abcdefABCDEF")
_B64_CLASS = _classes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents if ``data`` is a run of DER items whose lengths fill it exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, SEC1 or PKCS#8 private keys, enciphered ones and SubjectPublicKeyInfo, by nested lengths."""
    outer = der_fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[:2] == [0x02, 0x30] and 0x04 in tags:  # PKCS#8: version, algorithm, key
        return bool((alg := der_fields(inner[1][1])) and alg[0][0] == 0x06)
    if tags[:2] == [0x02, 0x04]:  # SEC1: version 1, private scalar
        return inner[0][1] == b"\x01" and len(inner[1][1]) >= 16
    if tags == [0x30, 0x04]:  # EncryptedPrivateKeyInfo: algorithm, enciphered key
        return bool((alg := der_fields(inner[0][1])) and alg[0][0] == 0x06)
    if tags[:2] == [0x30, 0x03]:  # public key: algorithm, bit string
        return bool((alg := der_fields(inner[0][1])) and alg[0][0] == 0x06)
    return len(inner) >= 6 and set(tags) == {0x02}  # PKCS#1 and DSA: integers only


def ssh_fields(data: bytes) -> list[bytes] | None:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH public key blob, or the container of private keys, by its length-prefixed fields."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        head, at = [], len(magic)
        for _ in range(3):  # cipher, KDF, KDF options
            size = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + size > len(data):
                return False
            head.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        return head[0].isascii() and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64
    fields = ssh_fields(data)
    return bool(fields and len(fields) >= 2 and re.match(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-)", fields[0]))


def decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def kind_of(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def ssh_sizes(text: str, start: int) -> list[int]:
    """Bytes after which an OpenSSH key that starts at this place of base64 may end."""
    magic, head = b"openssh-key-v1\0", decode64(text[start : start + 64]) or b""
    if not head.startswith(magic) and not re.match(rb"\0\0\0.(ssh-(rsa|dss|ed25519)|ecdsa-sha2-)", head, re.DOTALL):
        return []
    # one character over is no byte
    stop = len(text) - ((len(text) - start) % 4 == 1)
    data, ends = decode64(text[start:stop]) or b"", []
    at, left = (len(magic), 3) if head.startswith(magic) else (0, len(data))
    while left and at + 4 <= len(data):
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        if at > len(data):
            break
        ends.append(at)
        if len(ends) == 3 and head.startswith(magic):  # so many public keys and one private part
            left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
    return ends[-1:] if head.startswith(magic) and not left and len(ends) > 4 else [] if head.startswith(magic) else ends


def wrapped_keys(m: re.Match) -> list[tuple[str, int, int]]:
    """Keys that start with a line of a ``WRAPPED`` match and end with a later one."""
    lines = [x for x in LINE.finditer(m.string, m.start(), m.end()) if x[0][0] != "\\"]
    text = "".join(x[0] for x in lines)
    ends, at = [], 0
    for x in lines:
        at += len(x[0])
        ends.append(at)
    line_at, out, done = {e: k for k, e in enumerate(ends)}, [], -1
    for k, x in enumerate(lines[:-1]):
        start = ends[k] - len(x[0])
        if k <= done or not x[0].startswith(("M", "AAAA", "b3BlbnNzaC1r")):
            continue
        if x[0][0] == "M":  # the length is in the first bytes
            head = decode64(text[start : start + 8]) or b""
            if len(head) < 6:
                continue
            width = head[1] & 0x7F if head[1] & 0x80 else 0
            size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
            sizes = [size] if width <= 4 else []
        else:
            sizes = ssh_sizes(text, start)
        for last in (line_at.get(start - (-size * 4 // 3)) for size in reversed(sizes)):
            if last is not None and last > k and (kind := kind_of(decode64(text[start : ends[last]]))):
                end = lines[last].end()
                while end < len(m.string) and m.string[end] == "=":
                    end += 1
                out.append((kind, x.start(), end))
                done = last
                break
    return out


def is_token(header: str, payload: str) -> bool:
    try:
        head = json.loads(decode64(header) or b"")
        body = json.loads(decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and confirmed spans, each as (kind, start, end) in order."""
    if not text:
        return [], []
    base, more = [], []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    raw = text.encode("utf-8", "replace")
    classes = raw.translate(_HEX_CLASS)
    if b"x" * 32 in classes:
        base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        if b"x" * RUNHEX in classes:
            for m in LONGHEX.finditer(text):
                if len(m[0]) % 2 == 0 and (kind := kind_of(bytes.fromhex(m[0]))):
                    more.append((kind, m.start(), m.end()))
    if b"x" * RUN64 in raw.translate(_B64_CLASS):
        for m in BASE64.finditer(text):
            if kind := kind_of(decode64(m[0])):
                more.append((kind, m.start(), m.end()))
        for m in WRAPPED.finditer(text):
            more += wrapped_keys(m)
    if "eyJ" in text:
        more += [("jwt", m.start(), m.end()) for m in TOKEN.finditer(text) if is_token(m[1], m[2])]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = decode64(re.sub(r"\s|\\[rn]", "", m[3]))
            # what is enciphered has no structure but whole blocks
            if kind_of(body) or (body and len(body) % 8 == 0 and ENCIPHERED.search(m[2])):
                more.append(("pem", m.start(), m.end()))
    rank = {k: i for i, k in enumerate(BASE_KINDS)}
    base.sort(key=lambda s: (s[1], rank[s[0]]))
    more.sort(key=lambda s: (s[1], s[0], s[2]))
    return base, more


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, merged where they overlap, replaced by ``mark``."""
    spans = sorted((a, b) for found in scan(text) for _, a, b in found)
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by base kind, the digest of its base spans, and all spans."""

    def batches(it):
        for batch in it:
            ids, cols = batch.column(0), ([], [], [], [], [])
            for text in batch.column(1):
                base, more = scan(text.as_py())
                kinds = [k for k, _, _ in base]
                rank = {k: i for i, k in enumerate((*BASE_KINDS, "der", "jwt", "pem", "ssh"))}
                every = sorted(base + more, key=lambda s: (s[1], rank[s[0]], s[2]))
                for col, value in zip(cols, (*map(kinds.count, BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(batches, SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its secrets blanked out, its columns as they were; ``chars_col`` follows the new text."""
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def batches(it):
        for batch in it:
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [redact(t) for t in old]
            if any(a is not b for a, b in zip(old, new)):
                if chars is not None:
                    counts = [n if a is b else len(b) for a, b, n in zip(old, new, cols[chars].to_pylist())]
                    cols[chars] = pa.array(counts, cols[chars].type)
                cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(batches, docs.schema)


QUERY = "op8_confirmed_secrets"
ORACLE = None


def query(spark, sf_dir):
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
