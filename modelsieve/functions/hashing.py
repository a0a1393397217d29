"""Keyed digests from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


HEX_DIGITS = "0123456789ABCDEF"


def _xor_pad(key_hex: Column, pad: int) -> Column:
    """Every byte of a hex string combined with ``pad``, as binary: high and low
    digits are translated apart and put together again."""
    def combined(pattern: str, nibble: int) -> Column:
        swapped = "".join(HEX_DIGITS[d ^ nibble] for d in range(16))
        return F.split(F.translate(F.regexp_replace(key_hex, pattern, "$1"), HEX_DIGITS, swapped), "")

    pairs = F.zip_with(combined("(.).", pad >> 4), combined(".(.)", pad & 15), lambda high, low: F.concat(high, low))
    return F.unhex(F.array_join(pairs, ""))


def hmac_pads(key: Column) -> Column:
    """Struct (inner, outer) of the two padded keys of RFC 2104.

    They depend on the key alone, so compute them once per key, ahead of any
    join that repeats the key.
    """
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    key_hex = F.rpad(F.hex(short), 128, "0")
    return F.struct(_xor_pad(key_hex, 0x36).alias("inner"), _xor_pad(key_hex, 0x5C).alias("outer"))


def hmac_sha256(pads: Column, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary message under a key given by its pads."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], message), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)
