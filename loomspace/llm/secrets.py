"""Secret scans with structural confirmation.

Candidates are base64 or hex runs. Each is decoded and reported only if it is private key material by its structure: DER by
nested tags and lengths and the fields of PKCS#1, PKCS#8 (plain and encrypted), SEC1 and DSA private keys, OpenSSH
private keys by their length-prefixed fields, OpenPGP secret keys by their packets, signed tokens by a JSON header that names an algorithm.
Armour counts with line breaks escaped as in JSON, quoted or commented lines, and bare base64 in either alphabet. Public keys,
certificates and other DER are no secrets and aren't reported. An armoured body with encryption headers is ciphertext:
its headers and its whole blocks are checked. Beside these, base kinds are reported as they match: assign, access and hex.

A linear-time automaton (RE2) over whole Arrow columns selects the texts that can hold a kind at all; only those are
searched for spans.

Defined results: null is an empty text; spans are in code points, end exclusive; repeated rows each get their own
result; texts of any length are scanned whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._shared import id_text

# The base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
# Candidates of the structural kinds.
# a JSON object begins with a brace and a quote or white space: eyJ, eyA, ew0, ewo, ewk
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
# line breaks may be escaped, as in JSON, and lines may be quoted, commented out or concatenated
BREAK = r"(?:\\r|\\n|[\s>#*|\"',+\\])"
ARMOUR = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----({BREAK}*+(?:[A-Za-z][A-Za-z0-9-]*:(?:(?!\\r|\\n)[^\r\n])*+(?:\\r|\\n|[\r\n])++{BREAK}*+)*+)((?:[A-Za-z0-9+/=_]|{BREAK})++)-----END \1-----")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P][A-Za-z0-9+/]|b3B)[A-Za-z0-9+/]{37,}={0,2}")
ENCODED_URL = re.compile(r"(?<![A-Za-z0-9_-])(?:M[A-P][A-Za-z0-9_-]|b3B)[A-Za-z0-9_-]{37,}={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
#: kind -> what a text must hold, as one RE2 pattern each
MAY = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "signed": r"e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.",
    "armour": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----",
    "encoded": r"(?:M[A-P][A-Za-z0-9+/]|b3B)[A-Za-z0-9+/]{37}",
    "encoded_url": r"(?:M[A-P][A-Za-z0-9_-]|b3B)[A-Za-z0-9_-]{37}",
    "hex_der": r"30[0-9A-Fa-f]{38}",
}
# Object identifiers of the encryptions of private keys (PBES2, and the arcs of PBES1 and PKCS#12).
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
# Bytes of the private keys of the standard curves.
CURVES = (20, 24, 28, 32, 48, 64, 66)
#: the longest DER that is parsed; private keys are far below
LONGEST = 1 << 16
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at ``at``, if its length is in the shortest form and fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def fields(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The elements from ``start`` to ``end``, if they fill it and all lengths nested in them hold; else None."""
    out = []
    while start < end:
        one = element(data, start, end)
        if one is None or depth > 16 or one[0] & 0x20 and fields(data, one[1], one[2], depth + 1) is None:
            return None
        if one[0] == 0x02 and one[1] == one[2]:
            return None
        out.append(one)
        start = one[2]
    return out


def private_key(data: bytes) -> bool:
    """Whether ``data`` is one DER sequence with the fields of a private key.

    PKCS#1: version 0 or 1 and eight integers, at least; DSA: version 0 and five integers; PKCS#8: version 0 or 1, an
    algorithm, an octet string; encrypted PKCS#8: an encryption algorithm and an octet string; SEC1: version 1, an octet string of a curve's size, and the
    curve or the public point.
    """
    whole = element(data, 0, len(data)) if 16 <= len(data) <= LONGEST else None
    if whole is None or whole[0] != 0x30 or whole[2] != len(data) or not (own := fields(data, whole[1], whole[2])):
        return False
    tags = [t for t, _, _ in own]
    content = lambda k: data[own[k][1] : own[k][2]]
    if tags[0] == 0x30:  # an algorithm
        inner = fields(data, own[0][1], own[0][2])
        return tags == [0x30, 0x04] and bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(ENCRYPTIONS) and len(content(1)) >= 16
    if tags[0] != 0x02 or content(0) not in (b"\0", b"\1"):
        return False
    if set(tags) == {0x02} or tags == [0x02] * 9 + [0x30]:
        return len(tags) == 6 and content(0) == b"\0" and len(content(1)) >= 32 or len(tags) >= 9 and len(content(1)) >= 32
    if tags[1:2] == [0x04]:
        return content(0) == b"\1" and len(content(1)) in CURVES and tags[2:] in ([0xA0], [0xA1], [0xA0, 0xA1])
    if tags[1:3] == [0x30, 0x04]:
        inner = fields(data, own[1][1], own[1][2])
        return bool(inner) and inner[0][0] == 0x06 and len(content(2)) >= 16 and set(tags[3:]) <= {0xA0, 0x81, 0xA1}
    return False


def ssh_private(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: magic, cipher, kdf, options, count and as many public keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for k in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(count + 1):
        if count > 16 or at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return count > 0 and at <= len(data)


def decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed(header: str) -> bool:
    """Whether ``header`` decodes to a JSON object that names an algorithm."""
    try:
        x = json.loads(decoded(header, True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if private_key(data) else "openssh" if ssh_private(data) else None


def ciphered(headers: str, body: bytes | None) -> bool:
    """Whether an armoured body is the ciphertext that its headers announce, in whole blocks of the cipher."""
    named = dict(x.split(":", 1) for x in headers.splitlines() if ":" in x)
    kind, info = named.get("Proc-Type", "").replace(" ", ""), named.get("DEK-Info", "").strip()
    block = 8 if "DES" in info else 16
    salt = info.partition(",")[2].strip()
    return kind == "4,ENCRYPTED" and bool(re.fullmatch(r"[0-9A-Fa-f]{16,64}", salt)) and bool(body) and len(body) >= 32 and len(body) % block == 0


def packets(data: bytes) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of OpenPGP packets, if they fill ``data``; lengths of unknown extent don't count."""
    out, at = [], 0
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80 or at >= len(data):
            return None
        if head & 0x40:
            tag, size, n = head & 0x3F, data[at], 1
            if 192 <= size < 224 and at + 1 < len(data):
                size, n = (size - 192 << 8) + data[at + 1] + 192, 2
            elif size == 255:
                size, n = int.from_bytes(data[at + 1 : at + 5], "big"), 5
            elif size >= 224:
                return None
        else:
            tag, n = head >> 2 & 0xF, (1, 2, 4, 0)[head & 3]
            if not n:
                return None
            size = int.from_bytes(data[at : at + n], "big")
        at += n
        if at + size > len(data):
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def pgp_private(body: str) -> bool:
    """Whether an armoured body is a block of OpenPGP packets that begins with a secret key: its version, and a public-key algorithm; a
    checksum of 24 bits, where there is one, holds."""
    main, mark, check = body.rstrip("=").rpartition("=") if re.search(r"=[A-Za-z0-9+/]{4}$", body) else (body, "", "")
    data = decoded(main.rstrip("="))
    if not data or not (own := packets(data)):
        return False
    if mark:
        crc = 0xB704CE
        for byte in data:
            crc ^= byte << 16
            for _ in range(8):
                crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
        if decoded(check) != crc.to_bytes(3, "big"):
            return False
    tag, start, end = own[0]
    known = end - start > 6 and data[start] in (3, 4, 5, 6)
    algorithm = data[start + (7 if known and data[start] == 3 else 5)] if known and end - start > 7 else 0
    return tag == 5 and known and algorithm in (1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28)


def structures(text: str, may: set[str]) -> Iterator[tuple[int, int, str]]:
    """Confirmed spans (start, end, kind) of one text."""
    if "signed" in may:
        yield from ((*m.span(), "signed_token") for m in SIGNED.finditer(text) if signed(m[1]) and decoded(m[2], True) is not None)
    if "armour" in may:
        for m in ARMOUR.finditer(text):
            text_body = re.sub(BREAK, "", m[3])
            if m[1].endswith("BLOCK"):
                if pgp_private(text_body):
                    yield *m.span(), "pgp_private"
                continue
            body = decoded(text_body, "_" in text_body)
            headers = re.sub(r"\\r|\\n", "\n", m[2])
            if kind := key_kind(body) or ("encrypted" if ":" in headers and ciphered(re.sub(rf"(?m)^{BREAK}+", "", headers), body) else None):
                yield *m.span(), f"pem_{kind}"
    if "encoded" in may:
        for m in ENCODED.finditer(text):
            if kind := key_kind(decoded(m[0])):
                yield *m.span(), f"base64_{kind}"
    if "encoded_url" in may:
        for m in ENCODED_URL.finditer(text):
            if ("-" in m[0] or "_" in m[0]) and (kind := key_kind(decoded(m[0], True))):
                yield *m.span(), f"base64_{kind}"
    if "hex_der" in may:
        for m in HEX_DER.finditer(text):
            data = bytes.fromhex(m[0][: min(len(m[0]), 2 * LONGEST) // 2 * 2])
            one = element(data, 0, len(data))  # the run may go on after it
            if one and private_key(data[: one[2]]):
                yield m.start(), m.start() + 2 * one[2], "hex_der"


def spans(text: str, may: set[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and those confirmed by structure, each (start, end, kind)."""
    base = []
    if "assign" in may:
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in may:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    if "hex" in may:
        base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return base, list(structures(text, may))


def scan_column(texts: pa.Array) -> Iterator[tuple[int, list, list]]:
    """Row, base spans and structural spans, for every text of a column."""
    texts = pc.fill_null(texts, "")
    may = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in MAY.items()}
    for i in range(len(texts)):
        own = {k for k in may if may[k][i]}
        yield (i, *spans(texts[i].as_py(), own)) if own else (i, [], [])


def render(found: list[tuple[int, int, str]], order: tuple[str, ...] = KINDS) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {k: n for n, k in enumerate(order)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], rank.get(x[2], len(rank)), x[2], x[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, base, more in scan_column(batch.column(1)):
                n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((ids[i], *n, hashlib.sha256(render(base).encode()).hexdigest(), render(base + more)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_text(docs).mapInArrow(run, RESULT)


def redact(texts: pa.Array, mark: str = "[SECRET]") -> list[str | None]:
    """Texts with every span replaced; overlapping spans are one, null stays null."""
    out = []
    for i, base, more in scan_column(texts):
        text, parts, at = texts[i].as_py(), [], 0
        if base or more:
            for s, e, _ in sorted(base + more):
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            text = "".join([*parts, text[at:]])
        out.append(text)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
