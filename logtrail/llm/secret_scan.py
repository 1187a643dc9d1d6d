"""Secret scans: keyword automaton, anchored patterns near its hits, checksum validation.

A text is scanned once by an Aho-Corasick automaton of lower-cased keywords. Only where a
keyword begins is the pattern of its kind tried, anchored at that place; a run of hexadecimal
digits has no keyword and is found by one linear pattern. Tokens that carry a checksum of their
own are reported only if it agrees.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logtrail.llm.common import map_batches, table

#: In the order in which spans that start at one place are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "pem")
#: kind: (keywords, pattern tried at the keyword).
ANCHORED = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+")),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "pem": (
        ("-----begin ",),
        re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----\s((?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n(?:[\x20\t]+[^\s][^\n]*+\n)*+)*+)([A-Za-z0-9+/=\s]+)-----END \1-----"),
    ),
}
HEX = re.compile(r"[0-9a-f]{24,}")
#: The cipher and first vector of an encrypted traditional key; ciphers of 16-byte blocks, the rest have 8.
DEK = re.compile(r"^\s*DEK-Info:\s*([A-Z0-9-]+),\s*([0-9A-Fa-f]+)\s*$", re.M)
WIDE = ("AES", "ARIA", "CAMELLIA", "SEED", "SM4")
OPENSSH = b"openssh-key-v1\0"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def checksum_holds(kind: str, match: re.Match) -> bool:
    """Whether what the pattern found is long enough and, for kinds with a checksum or length inside, agrees with it."""
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return match.end() - match.start() >= 20
    if kind in ("github", "npm"):  # the last six digits: CRC-32 of the thirty before them
        return base62(zlib.crc32(match[1].encode())) == match[2]
    try:
        body = base64.b64decode("".join(match[3].split()), validate=True)
    except binascii.Error:
        return False
    if match[1].startswith("OPENSSH "):
        return openssh_holds(body)
    if dek := DEK.search(match[2]):  # encrypted whole blocks, no DER
        block = 16 if dek[1].startswith(WIDE) else 8
        return len(dek[2]) == 2 * block and len(body) > 0 and len(body) % block == 0
    return der_holds(body)


def der_holds(der: bytes) -> bool:
    if len(der) < 4 or der[0] != 0x30:  # a DER sequence states its own length
        return False
    if der[1] < 0x80:
        return der[1] + 2 == len(der)
    n = der[1] & 0x7F
    return n <= 4 and int.from_bytes(der[2 : 2 + n], "big") + 2 + n == len(der)


def openssh_holds(body: bytes) -> bool:
    """Whether magic and length-prefixed fields fill the body: cipher, kdf, its options, public keys, private part."""
    if not body.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        begin = at + 4
        at = begin + int.from_bytes(body[at:begin], "big")
        return body[begin:at] if begin <= at <= len(body) else None

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or at + 4 > len(body):
        return False
    n, at = int.from_bytes(body[at : at + 4], "big"), at + 4
    if not 1 <= n <= len(body) // 4 or any(field() is None for _ in range(n)):
        return False
    private = field()
    if not private or len(private) % 8 or (cipher == b"none" and private[:4] != private[4:8]):  # two equal check numbers
        return False
    return len(body) - at == (16 if b"gcm" in cipher or b"poly1305" in cipher else 0)  # the tag of such ciphers


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (words, _) in ANCHORED.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then kind; code points, end exclusive."""
    if not text:
        return []
    found, ends = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)], dict.fromkeys(ANCHORED, 0)
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    starts = sorted({(last + 1 - n, kind) for last, (kind, n) in automaton().iter(folded)})
    for start, kind in starts:
        if start >= ends[kind] and (m := ANCHORED[kind][1].match(text, start)):
            ends[kind] = m.end()  # a match that fails its check still takes its place
            if checksum_holds(kind, m):
                found.append((start, kind, m.end()))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        spans = find(text)
        base = [x for x in spans if x[1] in KINDS[:3]]
        counts = [sum(x[1] == kind for x in base) for kind in KINDS[:3]]
        rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs, with the spans of its secrets.

    Narrow: one pass over id and text, no shuffle. Null and empty texts have no spans and still give a
    row; repeated rows and null ids stay as they are; other columns are not read, so their names cannot clash.
    """
    return map_batches(docs.select(docs[id_column], docs[text_column]), scan_batch, SCHEMA)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets, base ones and those that the checksums bear out; see scan."""
    return scan(table(spark, sf_dir, "documents"))
