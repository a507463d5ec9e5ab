"""Internet addresses as 128 bits: IPv4, IPv6 with groups left out, and IPv4 inside IPv6."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not asked: loopback, link-local, private and unique-local.
BLOCKED_V4 = [("127.0.0.0", 8), ("169.254.0.0", 16), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)]
BLOCKED_V6 = [("::1", 128), ("fc00::", 7), ("fe80::", 10)]

_MAPPED = "0" * 20 + "ffff"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def _dotted_hex(text: Column) -> Column:
    """8 hex digits of a dotted address."""
    return F.array_join(F.transform(F.split(text, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("long"))), 2, "0")), "")


def address_hex(host: Column) -> Column:
    """32 hex digits of an address, an IPv4 one as the IPv6 address that stands for it; null for what is no address."""
    text = F.lower(F.regexp_replace(host, r"^\[(.*)\]$", "$1"))
    tail = F.regexp_extract(text, f"^.*:({_DOTTED})$", 1)
    tail_hex = _dotted_hex(tail)
    groups = F.when(tail != "", F.concat(F.regexp_replace(text, f"{_DOTTED}$", ""), F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4))).otherwise(text)
    halves = F.transform(F.split(groups, "::"), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":")))
    whole = F.flatten(halves)
    n = F.size(whole)
    fits = F.when(F.size(halves) == 1, n == 8).when(F.size(halves) == 2, n <= 7).otherwise(F.lit(False))
    valid = fits & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    hexed = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
    gap = F.repeat(F.lit("0000"), 8 - n)
    v6 = F.when(valid, F.concat(hexed(halves[0]), gap, hexed(F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>")))))
    v4 = F.when(text.rlike(f"^{_DOTTED}$"), F.concat(F.lit(_MAPPED), _dotted_hex(text)))
    return F.when(text.contains(":"), v6).otherwise(v4)


def inside(hexed: Column, base: Column, bits: int) -> Column:
    """Whether 32 hex digits begin with the first bits of others."""
    whole, rest = bits // 4, bits % 4
    same = F.substring(hexed, 1, whole) == F.substring(base, 1, whole) if whole else F.lit(True)
    if rest:
        nibble = lambda h: F.shiftright(F.conv(F.substring(h, whole + 1, 1), 16, 10).cast("int"), 4 - rest)
        same = same & (nibble(hexed) == nibble(base))
    return same


def blocked_host(host: Column) -> Column:
    """Whether a host is an address in a blocked network, or looks like an address and is none. Names pass."""
    networks = [(base, bits + 96) for base, bits in BLOCKED_V4] + BLOCKED_V6

    def judged(hexed: Column) -> Column:
        hit = F.lit(False)
        for base, bits in networks:
            hit = hit | inside(hexed, address_hex(F.lit(base)), bits)
        like_address = host.contains(":") | host.rlike(r"^[0-9.]+$")
        return F.coalesce(F.when(hexed.isNull(), like_address).otherwise(hit), F.lit(False))

    # A variable: the address is worked out once, not for each network.
    return F.get(F.transform(F.array(address_hex(host)), judged), F.lit(0))
