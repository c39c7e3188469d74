"""IPv4 helpers. Addresses are compared as integers, never as text."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4_SHAPE = r"^[0-9]+(\.[0-9]+){3}$"
_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4_IN_RANGE = rf"^({_OCTET}\.){{3}}{_OCTET}$"


def is_ipv4(c: Column) -> Column:
    """Shape test only (four dotted numbers), NULL stays NULL."""
    return c.rlike(IPV4_SHAPE)


def ipv4_to_long(c: Column) -> Column:
    """Dotted IPv4 to its integer; NULL when the text is not four octets in range."""
    # the sum is evaluated on every row, so the shared split is computed once; a NULL term voids the rest
    parts = F.split(c, "\\.")
    number = F.when(c.rlike(IPV4_IN_RANGE), F.lit(0).cast("bigint"))
    for i in range(4):
        number = number + F.get(parts, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)).cast("bigint")
    return number


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a CIDR block as integers."""
    block = ipaddress.ip_network(cidr, strict=False)
    return int(block.network_address), int(block.broadcast_address)


def cidr_match(ip_num: Column, cidr: str) -> Column:
    """Membership of an integer address column, as a range that Parquet statistics can prune."""
    low, high = cidr_bounds(cidr)
    return ip_num.between(F.lit(low), F.lit(high))


def prefix_network(ip_num: Column, length: int) -> Column:
    """The network address of ``ip_num`` at one prefix length."""
    shift = 32 - length
    return F.shiftleft(F.shiftright(ip_num, shift), shift)
