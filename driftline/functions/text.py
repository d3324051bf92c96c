"""Names, URLs, codes and other short texts."""

from __future__ import annotations

import json as J
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_domain(raw: Column) -> Column:
    x = F.lower(F.trim(raw))
    for pattern in (r"^https?://", r"^www\.", r"(?s)/.*$"):
        x = F.regexp_replace(x, pattern, "")
    return x


def normalized_url(raw: Column) -> Column:
    """``host/path`` of an http URL for exact matching: no scheme, ``www.``, query, fragment or single trailing slash; percent escapes decoded where they are valid. Null for anything else."""
    url = F.trim(raw)
    ok = url.rlike(r"(?i)^https?://[^/?#\s]+")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, 1, F.length(path) - 1)).otherwise(path)
    return F.when(ok & (host != ""), F.concat(host, path))


def product_url(domain: Column, handle: Column) -> Column:
    return F.concat(F.lit("https://"), domain, F.lit("/products/"), handle)


def normalized_tags(tags: Column) -> Column:
    """Sorted lower-case tags of a comma-separated list."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t)))
    return F.array_sort(F.filter(parts, lambda t: t != ""))


def csv_field(x: Column) -> Column:
    """A CSV field that no spreadsheet takes for a formula."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    formula = text.rlike(r"^[=+\-@\t\r]")
    guarded = F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(formula | text.rlike(r'[",\n\r]'), quoted).otherwise(text)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])


def promo_code(raw: Column) -> Column:
    """A code as it is stored: upper case, without white space and hyphens."""
    return F.regexp_replace(F.upper(raw), r"[\s-]", "")


def is_vanity_code(code: Column) -> Column:
    return code.rlike(r"^[A-Z0-9]{4,32}$")


def plan_label(plan: Column) -> Column:
    from driftline.config import PLAN_LABELS

    known = F.create_map(*[F.lit(x) for pair in PLAN_LABELS.items() for x in pair])
    return F.coalesce(known[plan], plan)


def format_limit(limit: Column) -> Column:
    """A null limit has no bound."""
    return F.coalesce(limit.cast("string"), F.lit("Unlimited"))


IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
IPV6 = r"^(?=.*:)[0-9A-Fa-f:.]{2,45}$"


def client_ip(forwarded_for: Column, trusted_hops: int = 1) -> Column:
    """The address that the outermost of our own proxies saw, ``unknown`` if the header can't tell; what isn't an address is no hop."""
    hops = F.filter(F.transform(F.split(forwarded_for, ","), lambda x: F.trim(x)), lambda x: x.rlike(IPV4) | x.rlike(IPV6))
    if trusted_hops < 1:
        return F.lit("unknown")
    return F.coalesce(F.when(F.size(hops) >= trusted_hops, F.element_at(hops, -trusted_hops)), F.lit("unknown"))


def region_names(metadata: Column) -> Column:
    """Names of the regions in an ad's JSON; null if there are none."""
    regions = F.from_json(metadata, "regions array<struct<name string>>")["regions"]
    names = F.filter(F.transform(regions, lambda r: r["name"]), lambda n: n.isNotNull() & (n != ""))
    return F.when(F.size(names) > 0, names)


def holds_email_leaf(json: Column) -> Column:
    """Whether a string value anywhere in the JSON, keys aside, is an e-mail address and nothing else."""
    return F.coalesce(json.rlike(r'"[^"\s@]+@[^"\s@]+\.[^"\s@]+"(?!\s*:)'), F.lit(False))


def scrubbed(json: Column, keys: tuple[str, ...]) -> Column:
    """A flat JSON object without some of its keys."""
    entries = F.from_json(json, "map<string,string>")
    return F.to_json(F.map_filter(entries, lambda k, v: ~k.isin(*keys)))


def changed_json(json: Column, remove: tuple[str, ...] = (), put: dict[str, str | None] | None = None, anywhere: tuple[str, ...] = ()) -> Column:
    """A JSON text without the values at the paths ``remove`` and with other ones at the paths ``put`` (JSON texts; None is null).

    A path is keys parted by dots; ``*`` stands for all entries of an array. ``anywhere``:
    keys that go at any depth, in arrays too. A path that isn't there
    changes nothing, but the last key of a put is added to an object that is there. Other values,
    their order and nesting stay; numbers are written in their shortest form. Null and
    broken texts give null. One Arrow batch is read at a time.
    """
    gone, new, names = [p.split(".") for p in remove], {tuple(p.split(".")): v for p, v in (put or {}).items()}, frozenset(anywhere)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values = {p: None if v is None else J.loads(v) for p, v in new.items()}

        def holders(node, path):
            if not path:
                yield node
            elif path[0] == "*" and isinstance(node, list):
                for x in node:
                    yield from holders(x, path[1:])
            elif isinstance(node, dict) and path[0] in node:
                yield from holders(node[path[0]], path[1:])

        def stripped(node):
            if isinstance(node, dict):
                return {k: stripped(v) for k, v in node.items() if k not in names}
            return [stripped(x) for x in node] if isinstance(node, list) else node

        def change(text):
            try:
                node = J.loads(text)
            except (TypeError, ValueError, RecursionError):
                return None
            for path in gone:
                for holder in holders(node, path[:-1]):
                    if isinstance(holder, dict):
                        holder.pop(path[-1], None)
            for path, value in values.items():
                for holder in holders(node, path[:-1]):
                    if isinstance(holder, dict):
                        holder[path[-1]] = value
            return J.dumps(stripped(node) if names else node, ensure_ascii=False, separators=(",", ":"))

        return texts.map(change)

    return run(json)


# Ranges of addresses that aren't public hosts: private, local, shared, test, multicast, tunnels, reserved.
CLOSED_IPV4 = """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"""
CLOSED_IPV6 = """::/128 ::1/128 ::ffff:0:0:0/96 64:ff9b::/96 100::/64 2001::/32 2001:2::/48 2001:3::/32 2001:4:112::/48 2001:10::/28 2001:20::/28 2001:30::/28 2001:db8::/32 2002::/16 fc00::/7 fe80::/10 ff00::/8"""


def _ranges(four: str, six: str) -> list[tuple[str, str]]:
    """First and last address of networks as 32 hexadecimal digits, IPv4 as it is mapped to IPv6."""
    import ipaddress

    found = [(int(n[0]) + (0xFFFF << 32), int(n[-1]) + (0xFFFF << 32)) for n in map(ipaddress.ip_network, four.split())]
    found += [(int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, six.split())]
    return [(f"{low:032x}", f"{high:032x}") for low, high in sorted(found)]


def _ipv4_hex(ip: Column) -> Column:
    """Eight hexadecimal digits; null if it isn't four numbers up to 255."""
    parts = F.split(ip, r"\.")
    digits = F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x.try_cast("bigint"))), 2, "0"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x.try_cast("int") <= 255), F.array_join(digits, ""))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address_hex(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hexadecimal digits, which order as addresses do; null if it is none.

    IPv4 is taken as the IPv6 address that it is mapped to. An IPv6 address may leave
    out one run of zeros, and end in an IPv4 address.
    """
    none = F.array().cast("array<string>")

    def written_out(ip: Column) -> Column:
        """An IPv4 address at the end as two groups; null if it is broken."""
        tail = F.regexp_extract(ip, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        groups = _once(_ipv4_hex(tail), lambda h: F.concat(F.regexp_extract(ip, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(tail == "", ip).otherwise(groups)

    def of_sides(sides: Column) -> Column:
        side = lambda i: F.when(F.get(sides, F.lit(i)) != "", F.split(F.get(sides, F.lit(i)), ":")).otherwise(none)
        return _once(F.struct(side(0).alias("left"), side(1).alias("right"), F.size(sides).alias("n")), of_groups)

    def of_groups(s: Column) -> Column:
        missing = 8 - F.size(s["left"]) - F.size(s["right"])
        shaped = ((s["n"] == 2) & (missing >= 1)) | ((s["n"] == 1) & (missing == 0))
        groups = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"])
        padded = F.transform(groups, lambda g: F.when(g.rlike("^[0-9A-Fa-f]{1,4}$"), F.lpad(F.lower(g), 4, "0")))
        return F.when(shaped, _once(padded, lambda p: F.when(~F.exists(p, lambda g: g.isNull()), F.array_join(p, ""))))

    def any_family(ip: Column) -> Column:
        six = F.when(ip.contains(":"), _once(F.split(written_out(ip), "::"), of_sides))
        return F.coalesce(F.concat(F.lit("0" * 20 + "ffff"), _ipv4_hex(ip)), six)

    return _once(ip, any_family)


def is_public_unicast(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is routable: in none of the closed ranges, also if it is an IPv4 one mapped to IPv6. What is no address isn't."""
    ranges = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in _ranges(CLOSED_IPV4, CLOSED_IPV6)])
    closed = _once(address_hex(ip), lambda h: F.when(h.isNotNull(), F.exists(ranges, lambda r: (h >= r["low"]) & (h <= r["high"]))))
    return F.coalesce(~closed, F.lit(False))
