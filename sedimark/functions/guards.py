"""URL and path guards as columns: each gives the reason of a rejection, null where it accepts."""

from __future__ import annotations

import ipaddress
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ports that a URL to this machine must not have.
DANGEROUS_PORTS = (22, 23, 25, 53, 110, 143, 993, 995, 1433, 3306, 3389, 5432, 5984, 6379, 7000, 7001, 8086, 9042, 9160, 9200, 9300, 11211, 27017, 27018, 27019)
# Hosts allowed by default. Those of a deployment's own are added by the caller.
DEFAULT_HOSTS = (
    "aws.amazon.com",
    "marketplace.amazonaws.com",
    "api.openai.com",
    "api.together.xyz",
    "api.anthropic.com",
    "api.groq.com",
    "huggingface.co",
    "hf-mirror.com",
    "localhost",
    "127.0.0.1",
    "0.0.0.0",
)
# Private ranges of IPv4: the last two are rejected by their first number alone.
PRIVATE = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("0.0.0.0", 8), ("169.254.0.0", 16), ("224.0.0.0", 8), ("240.0.0.0", 8))
LOCALHOSTS = ("localhost", "127.0.0.1", "::1")
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


@dataclass(frozen=True)
class UrlRules:
    hosts: tuple[str, ...] = DEFAULT_HOSTS
    cidrs: tuple[str, ...] = ()
    allow_localhost: bool = False
    allow_private: bool = False


def ipv4_number(host: Column) -> Column:
    """An IPv4 address as an integer; null for anything else."""
    parts = F.split(host, r"\.")
    part = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << (24 - 8 * i))
    return F.when(host.rlike(IPV4), part(0) + part(1) + part(2) + part(3))


def _python_number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


def in_cidr(number: Column, cidr: str) -> Column:
    """Whether an IPv4 number is in a range; false for malformed ranges and for those of IPv6, which same_ipv6() is for."""
    network, _, bits = cidr.partition("/")
    if network.count(".") != 3 or not bits.isdigit() or int(bits) > 32:
        return F.lit(False)
    mask = (0xFFFFFFFF << (32 - int(bits))) & 0xFFFFFFFF
    return number.bitwiseAND(F.lit(mask)) == (_python_number(network) & mask)


def same_ipv6(host: Column, cidr: str) -> Column:
    """Whether a host is the very address of an IPv6 range, whatever its length; false for malformed ranges."""
    network, _, bits = cidr.partition("/")
    try:
        address = ipaddress.IPv6Address(network)
    except ValueError:
        return F.lit(False)
    if not bits.isdigit() or int(bits) > 255:
        return F.lit(False)
    return F.lower(F.btrim(host, F.lit("[]"))).isin(address.compressed, address.exploded)


def is_private(number: Column) -> Column:
    found = F.lit(False)
    for network, bits in PRIVATE:
        found = found | in_cidr(number, f"{network}/{bits}")
    return found


def host_listed(host: Column, hosts: tuple[str, ...]) -> Column:
    """A host of the list, or below one."""
    low, found = F.lower(host), F.lit(False)
    for h in hosts:
        found = found | (low == h.lower()) | F.endswith(low, F.lit("." + h.lower()))
    return found


def ip_allowed(number: Column, rules: UrlRules) -> Column:
    listed = F.lit(False)
    for cidr in rules.cidrs:
        listed = listed | in_cidr(number, cidr)
    loopback = in_cidr(number, "127.0.0.0/8")
    return F.when(listed, True).when(loopback, rules.allow_localhost).when(is_private(number), rules.allow_private).otherwise(False)


def url_rejection(url: Column, rules: UrlRules = UrlRules()) -> Column:
    """Reason why a URL must not be called, in the order of the rules; null if it may."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme, host, user, fragment = F.lower(part("PROTOCOL")), F.lower(part("HOST")), part("USERINFO"), part("REF")
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]+)$", 1).try_cast("int")
    number = ipv4_number(host)
    local = host.isin(*LOCALHOSTS)
    return (
        F.when(scheme.isNull() | (F.length(url) == 0), "invalid_url")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(F.coalesce(user, F.lit("")) != "", "credentials")
        .when(fragment.rlike("[@%]"), "fragment")
        .when(host.isNull() | (host == ""), "no_host")
        .when(number.isNotNull() & ~ip_allowed(number, rules), "ip")
        .when(number.isNull() & ~host_listed(host, rules.hosts), "host")
        .when(F.lit(not rules.allow_localhost) & local, "localhost")
        .when(local & port.isin(*DANGEROUS_PORTS), "port")
    )


def path_rejection(path: Column, strip_at: bool = False) -> Column:
    """Reason why a path must not be opened, by its text alone; null if it may.

    With strip_at one leading @ is dropped, as upload arguments have it. Whether the path
    exists and is a regular file is the reader's to find.
    """
    plain = F.when(F.lit(strip_at), F.regexp_replace(path, "^@", "")).otherwise(path)
    return F.when(plain.isNull() | (plain == ""), "empty").when(F.contains(plain, F.lit("..")), "path_traversal").when(F.startswith(plain, F.lit("/")), "absolute_path")


def file_rejection(path: str, below: str | None = None, limit: int = 100 << 20) -> str | None:
    """Reason why a command must not read a file of this machine; null if it may.

    One leading @ is dropped. Unlike path_rejection() this follows the path: what counts is where it leads.
    """
    plain = path.removeprefix("@")
    if not os.path.exists(plain):
        return "not_found"
    real, top = os.path.realpath(plain), os.path.realpath(below or os.getcwd())
    if os.path.commonpath([real, top]) != top:
        return "outside"
    if os.path.getsize(real) > limit:
        return "too_large"
    return None if os.path.isfile(real) else "not_regular"


def oversized(files: DataFrame, most: int, length: str = "length") -> DataFrame:
    """Files beyond a size, without reading them."""
    return files.where(F.col(length) > most)
