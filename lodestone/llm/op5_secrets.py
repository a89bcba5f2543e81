"""Secret scan: fixed candidate patterns, then structural confirmation of what they might hold.

Base spans (assign, access, hex) are reported as the patterns give them. Confirmation adds spans of its own kinds:

- ``jwt``: a signed token; three base64url parts, whose first decodes to a JSON object with a string ``alg``
  and whose second decodes to a JSON object;
- ``der``: base64, base64url or hex that decodes to an ASN.1 SEQUENCE whose nested lengths add up to the whole, holding an
  INTEGER or OBJECT IDENTIFIER (key encodings and certificates);
- ``pem``: a BEGIN/END block with matching labels whose body decodes to such a structure, or to whole cipher blocks under
  headers that say so; line ends may be escaped;
- ``sshkey``: base64, base64url or hex that decodes to length-prefixed fields, the first being an algorithm name.

Base64 may go on over line breaks: the lengths inside say where it ends.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import forget, small_batches

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:(?!-----)[\s\S])+)-----END \1-----")
#: Every run of an alphabet that is long enough for a structure; what is before it does not matter.
RUNS = (re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{22,}={0,2}"), re.compile(r"(?<![A-Za-z0-9_-])[_-]*([A-Za-z0-9][A-Za-z0-9_-]{21,}={0,2})"))
#: Runs over line breaks, of either alphabet; the structure says how many of their characters belong to it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])")
HEADER = re.compile(r"[A-Za-z0-9-]+:[^\n]*(?:\n[ \t][^\n]*)*\n")


def _b64(s: str, url: bool = False) -> bytes | None:
    s = re.sub(r"\s+", "", s).rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(raw: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the well-formed elements that fill raw[at:end] exactly, nested ones included; None if they don't."""
    tags: list[int] = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        tags.append(tag)
        if tag & 0x20:
            inner = der_fields(raw, at, at + size, depth + 1) if depth < 16 else None
            if inner is None:
                return None
            tags += inner
        at += size
    return tags


def is_der_key(raw: bytes | None) -> bool:
    if not raw or raw[0] != 0x30 or len(raw) < 16:
        return False
    tags = der_fields(raw, 0, len(raw))
    return tags is not None and len(tags) >= 3 and any(t in (0x02, 0x06) for t in tags)


def is_ssh_key(raw: bytes | None) -> bool:
    if not raw or len(raw) < 20:
        return False
    at, fields = 0, []
    while at + 4 <= len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        if n == 0 or at + 4 + n > len(raw):
            return False
        fields.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(raw) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def is_signed_token(head: str, body: str) -> bool:
    raw, rest = _b64(head, True), _b64(body, True)
    try:
        h, b = json.loads(raw or b""), json.loads(rest or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def is_pem(label: str, body: str) -> bool:
    """Line ends may be escaped and header lines may come first; under Proc-Type ENCRYPTED the body is whole cipher blocks."""
    body = re.sub(r"(?:\\+r)?\\+n|\r\n?", "\n", body).lstrip()
    head = ""
    while m := HEADER.match(body):
        head, body = head + m[0], body[m.end() :]
    raw = _b64(body)
    if "ENCRYPTED" in head and "DEK-Info:" in head and label.endswith("PRIVATE KEY"):
        return raw is not None and len(raw) >= 16 and len(raw) % 8 == 0
    return is_der_key(raw) or raw is not None and raw.startswith(b"openssh-key-v1\0")


def der_size(start: str) -> int | None:
    """Bytes of the SEQUENCE that begins with this base64, by its header."""
    raw = _b64(start[:8].ljust(8, "A"))
    if not raw or raw[0] != 0x30:
        return None
    n = raw[1] & 0x7F if raw[1] >= 0x80 else 0
    return 2 + raw[1] if raw[1] < 0x80 else 2 + n + int.from_bytes(raw[2 : 2 + n], "big") if 1 <= n <= 4 else None


def ssh_size(run: str, at: int = 0) -> int | None:
    """Bytes of the length-prefixed fields that begin at a place in base64, as many as are whole; None without an algorithm name."""
    first = _b64(run[at : at + 24].ljust(24, "A"))
    if first is None or not 0 < int.from_bytes(first[:4], "big") <= 64 or re.match(rb"(ssh|ecdsa|sk)-", first[4:]) is None:
        return None
    part = run[at:]
    raw, to, last = _b64(part[: len(part) - (len(part) % 4 == 1)]) or b"", 0, None
    while to + 4 <= len(raw) and 0 < (n := int.from_bytes(raw[to : to + 4], "big")) and to + 4 + n <= len(raw):
        to = last = to + 4 + n
    return last


def wrapped_spans(text: str) -> set[tuple[int, int, int]]:
    """Keys that begin on a line's first run and end on a later line."""
    out = set()
    for block in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE.finditer(text, *block.span())]
        run = "".join(text[a:z] for a, z in lines).replace("-", "+").replace("_", "/")
        starts, begin = [], 0
        for a, z in lines:
            starts.append(begin)
            begin += z - a
        for i, (a, z) in enumerate(lines):
            at = starts[i]
            ssh = run.startswith("AAAA", at)
            size = ssh_size(run, at) if ssh else der_size(run[at : at + 8]) if run[at] == "M" else None
            many = size and -(-size * 4 // 3)
            if not many or not z - a < many <= len(run) - at:
                continue
            raw = _b64(run[at : at + many])
            if not (is_ssh_key(raw) if ssh else is_der_key(raw)):
                continue
            j = bisect.bisect_left(starts, at + many) - 1
            end = lines[j][0] + at + many - starts[j]
            out.add((a, 6 if ssh else 5, end + len(re.match("={0,2}", text[end : end + 2])[0])))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns; every match counts where it is found, failing ones are dropped after."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "eyJ" in text:
        found += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        found += [(m.start(), 4, m.end()) for m in PEM.finditer(text) if is_pem(m[1], m[2])]
    keys = set()  # a run can be one of both alphabets
    for url, pattern in enumerate(RUNS):
        for m in pattern.finditer(text):
            run = m[url]
            # A DER SEQUENCE begins with M in base64, the length of a key's first field with AAAA.
            if run[0] == "M" and is_der_key(_b64(run, bool(url))):
                keys.add((m.start(url), 5, m.end()))
            elif run.startswith("AAAA") and is_ssh_key(_b64(run, bool(url))):
                keys.add((m.start(url), 6, m.end()))
    if "\n" in text:
        keys |= wrapped_spans(text)
    for m in HEXKEY.finditer(text):
        if len(m[0]) % 2 == 0 and m[0].startswith(("30", "000000")):
            raw = bytes.fromhex(m[0])
            if is_der_key(raw) or is_ssh_key(raw):
                keys.add((m.start(), 5 if raw[0] == 0x30 else 6, m.end()))
    found += sorted(keys)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty: no spans, and the hash of the empty string. Offsets are code points, end exclusive.
    Null ids and repeated rows pass through; other columns are not read. No shuffle; whole texts are searched.
    """
    small_batches(df.sparkSession)
    src = df.select(df[id_col].alias(id_col), df[text_col].alias("text__"))
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    schema = T.StructType([src.schema[0], *fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                for k in range(3):
                    cols[k].append(sum(1 for s in base if s[1] == k))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(base + confirmed_spans(text or "")))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=schema.names)

    return src.mapInArrow(each, schema)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by [kind]; overlapping spans are merged under the first one's kind."""
    if not text:
        return text
    spans = sorted(base_spans(text) + confirmed_spans(text))
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, z in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], z)
        else:
            merged.append([a, k, z])
    for a, k, z in merged:
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = z
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the secrets in text_col replaced; all rows and columns stay."""
    small_batches(df.sparkSession)
    schema, at = df.schema, df.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([redact(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(each, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
