"""Masks of single values as column expressions: templates, hashes, keyed digests, stand-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Syllables of stand-in names: a consonant and what follows it, 16 each, so that a hex digit picks one. Each begins with a
#: consonant and has one only there or at its end before another, so a row of syllables can be read in one way.
ONSETS = "b c d f g h j k l m n p r s t v".split()
RIMES = "a e i o u ai au ea ei ie oa oi ou ua ue ui".split()
STREETS = "Road Lane Street Court Avenue Drive Way Place Close Row Hill Square Terrace Walk Crescent Gardens".split()
#: Rounds of the permutation.
ROUNDS = 4
BLOCK = 64


def segments(template: str) -> list[tuple[str, bool]]:
    """A template as literal texts and token names (True); doubled braces are literal ones."""
    out: list[tuple[str, bool]] = []
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}|[^{}]+|[{}]", template):
        out.append((m[1], True) if m[1] is not None else (m[0][0] if m[0] in ("{{", "}}") else m[0], False))
    return out


def render(template: str, tokens: dict[str, Column]) -> Column:
    """The template with its tokens put in; unknown ones stay as they stand. Values are never searched for tokens."""
    parts = [tokens[x] if is_token and x in tokens else F.lit("{" + x + "}" if is_token else x) for x, is_token in segments(template)]
    return F.concat(*parts) if parts else F.lit("")


def hmac_sha256(value: Column, key: str) -> Column:
    """HMAC-SHA-256 as lower-case hex, from two plain digests with padded keys."""
    raw = key.encode()
    if not raw:
        raise ValueError("a key is needed")
    if len(raw) > BLOCK:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def permuted(value: Column, key: str) -> Column:
    """The first 64 bits of a value's SHA-256 under a keyed Feistel permutation, as 16 hex digits.

    As each round can be undone, different digests stay different: two values share a
    result only if the first 64 bits of their digests are equal.
    """
    number = lambda x: F.conv(x, 16, 10).cast("long")

    def swapped(bits: Column, k: Column) -> Column:
        left, right = F.substring(bits, 1, 8), F.substring(bits, 9, 8)
        mixed = F.substring(hmac_sha256(F.concat(k.cast("string"), F.lit(":"), right), key), 1, 8)
        return F.concat(right, F.lower(F.lpad(F.hex(number(left).bitwiseXOR(number(mixed))), 8, "0")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.substring(F.sha2(F.encode(value, "UTF-8"), 256), 1, 16), swapped)


def _digit(bits: Column, k: int, items: list[str]) -> Column:
    """The item that hex digit ``k`` of ``bits`` picks of sixteen."""
    return F.element_at(F.array(*map(F.lit, items)), F.conv(F.substring(bits, k + 1, 1), 16, 10).cast("int") + 1)


def syllables(bits: Column, first: int, n: int) -> Column:
    """``n`` syllables from the hex digits of ``bits`` from ``first`` on, two a syllable."""
    return F.concat(*[x for k in range(first, first + 2 * n, 2) for x in (_digit(bits, k, ONSETS), _digit(bits, k + 1, RIMES))])


def stand_ins(bits: Column) -> dict[str, Column]:
    """Stand-in values from 64 permuted bits. Names, addresses, cities, companies and mail hold all of them, a phone number twelve digits' worth."""
    name = lambda b, first, n: F.initcap(syllables(b, first, n))
    number = lambda b, n: F.conv(F.substring(b, 1, n), 16, 10).cast("long")
    made = {
        "fake_name": lambda b: F.concat_ws(" ", name(b, 0, 2), name(b, 4, 2), name(b, 8, 4)),
        "fake_address": lambda b: F.concat_ws(" ", (number(b, 3) + 1).cast("string"), name(b, 3, 6), _digit(b, 15, STREETS)),
        "fake_city": lambda b: F.concat_ws(" ", name(b, 0, 4), name(b, 8, 4)),
        "fake_company": lambda b: F.concat(name(b, 0, 4), F.lit(" "), name(b, 8, 4), F.lit(" Ltd")),
        "fake_email": lambda b: F.concat(syllables(b, 0, 4), F.lit("."), syllables(b, 8, 4), F.lit("@example.com")),
        # fixed value: country code 999 is not assigned
        "fake_phone": lambda b: F.concat(F.lit("+999"), F.lpad(F.pmod(number(b, 15), F.lit(10**12)).cast("string"), 12, "0")),
    }
    # an array of one, so that the bits are worked out once for all digits
    return {token: F.get(F.transform(F.array(bits), put), F.lit(0)) for token, put in made.items()}


def token_columns(entity: str, value: Column, n: Column, strategy: str, key: str | None) -> dict[str, Column]:
    """The tokens that a template of ``strategy`` knows."""
    digest = F.sha2(F.encode(value, "UTF-8"), 256)
    tokens = {"label": F.lit(entity.upper()), "n": n.cast("string"), "hash8": F.left(digest, F.lit(8)), "hash4": F.left(digest, F.lit(4)), "last4": F.right(value, F.lit(4))}
    if strategy in ("substitute", "encrypt"):
        if key is None:
            raise ValueError(f"strategy {strategy} needs a key")
        tokens |= stand_ins(permuted(value, key))
        if strategy == "encrypt":
            tokens["encrypted"] = hmac_sha256(value, key)
    return tokens


def mask_value(entity: str, strategy: str, template: str, value: Column, n: Column, key: str | None = None) -> Column:
    """The mask of a value. ``key`` is a secret of the job; there is none by default and it is never logged."""
    if strategy not in ("redact", "substitute", "hash", "encrypt", "partial_redact"):
        raise ValueError(f"unknown strategy {strategy}")
    return render(template, token_columns(entity, value, n, strategy, key))
