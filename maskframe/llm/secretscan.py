"""Secret scans: Aho-Corasick keywords first, anchored expressions only at their hits, then embedded checksums.

One pass over each text finds the keywords. An expression is tried at the place of a
hit and nowhere else. Long hexadecimal runs have no keyword, so they have their own
expression. Tokens of the kinds ``crc`` and ``bech32`` carry a checksum inside and
count only when it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crc long, n_bech32 long"

# The public formats of the tokens that are looked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CRC = re.compile(r"(?:gh[opusr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BECH32 = re.compile(r"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![0-9A-Za-z])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "gho_": "crc", "ghp_": "crc", "ghu_": "crc", "ghs_": "crc", "ghr_": "crc", "npm_": "crc", "age-secret-key-1": "bech32",
}
KINDS = ("assign", "access", "hex", "crc", "bech32")
BASE = 3
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32_CHARS = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_is_right(body: str, check: str) -> bool:
    """The six last characters are the CRC-32 of the thirty before them, in base 62."""
    value = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == check


def bech32_is_right(prefix: str, data: str) -> bool:
    """The polynomial checksum of the bech32 coding over prefix and data."""
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32_CHARS.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check == 1


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def ascii_lower(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_secrets(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed."""
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    upto = dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in automaton.iter(ascii_lower(text)))
    for at, kind in hits:
        if at < upto[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                upto[kind] = m.end()
                if len(m[2]) >= 6:
                    spans.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                upto[kind] = m.end()
                if m.end() - at >= 20:
                    spans.append((at, m.end(), kind))
        elif kind == "crc":
            if (m := CRC.match(text, at)) and crc_is_right(m[1], m[2]):
                upto[kind] = m.end()
                spans.append((at, m.end(), kind))
        elif (m := BECH32.match(text, at)) and bech32_is_right("age-secret-key-", m[1].lower()):
            upto[kind] = m.end()
            spans.append((at, m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text of ``docs`` (doc_id, text), offsets in code points, end exclusive.

    A null or empty text has none. Rows are independent: repeated rows give repeated
    results, an empty table gives an empty one, further columns are ignored.
    """

    def rows(batch: dict, automaton: ahocorasick.Automaton) -> dict:
        out = {"doc_id": batch["doc_id"], "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in KINDS}
        for text in batch["text"]:
            spans = find_secrets(text or "", automaton)
            kinds = [s[2] for s in spans]
            for k in KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            base = listed([s for s in spans if s[2] in KINDS[:BASE]])
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(listed(spans))
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, RESULT, keyword_automaton)
