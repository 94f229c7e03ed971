"""Globs and policy conditions as column expressions over a context map<string, array<string>>."""

from __future__ import annotations

import re
import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that mean something in a regular expression, besides * and ?.
_SPECIAL = re.compile(r"([.\\+^$|(){}\[\]])")


def glob_regex(pattern: str, question: bool = True) -> str:
    """`*` for any run, `?` for one character (if question), all else as it is; anchored."""
    out = _SPECIAL.sub(r"\\\1", pattern).replace("*", ".*")
    return "(?s)^" + (out.replace("?", ".") if question else out.replace("?", r"\?")) + "$"


def glob(value: Column, pattern: str) -> Column:
    """IAM wildcards: an empty pattern matches only the empty text."""
    return F.rlike(value, F.lit(glob_regex(pattern)))


def key_glob(value: Column, pattern: str) -> Column:
    """Notification patterns: only * is special; an empty pattern matches nothing."""
    return F.lit(False) if not pattern else F.rlike(value, F.lit(glob_regex(pattern, question=False)))


def key_pattern(prefix: str = "", suffix: str = "") -> str:
    """Prefix and suffix as one pattern, without doubled stars."""
    left = prefix if not prefix or prefix.endswith("*") else prefix + "*"
    right = suffix if not suffix or suffix.startswith("*") else "*" + suffix
    return re.sub(r"\*+", "*", left + right) if left or right else ""


def _values(context: Column, key: str) -> Column:
    return F.coalesce(F.element_at(context, F.lit(key)), F.array().cast("array<string>"))


def _one(op: str, v: Column, wanted: list[str]) -> Column:
    base = op.replace("Not", "", 1) if "Not" in op else op
    if base in ("StringEquals", "ArnEquals") and base == "StringEquals":
        hit = v.isin(*wanted)
    elif base == "StringEqualsIgnoreCase":
        hit = F.lower(v).isin(*[w.lower() for w in wanted])
    else:  # Like, and the Arn forms
        hit = reduce(lambda a, b: a | b, [glob(v, w) for w in wanted])
    return hit


def string_condition(context: Column, op: str, key: str, wanted: list[str], quantifier: str | None = None) -> Column:
    """quantifier: None, ForAnyValue (false without the key) or ForAllValues (true without it).

    With a quantifier a negation holds for each value; without one it negates the whole.
    """
    values, negative = _values(context, key), "Not" in op
    test = (lambda v: ~_one(op, v, wanted)) if negative else (lambda v: _one(op, v, wanted))
    if quantifier == "ForAnyValue":
        return F.exists(values, test)
    if quantifier == "ForAllValues":
        return F.forall(values, test)
    hit = F.exists(values, lambda v: _one(op, v, wanted))
    return ~hit if negative else hit


_COMPARE = {"Equals": lambda a, b: a == b, "NotEquals": lambda a, b: a != b, "LessThan": lambda a, b: a < b, "LessThanEquals": lambda a, b: a <= b, "GreaterThan": lambda a, b: a > b, "GreaterThanEquals": lambda a, b: a >= b}


def numeric_condition(context: Column, op: str, key: str, wanted: int) -> Column:
    """Over the first value; a missing or unreadable one is false. GreaterThanIfExists compares with >= and is true if missing."""
    values = _values(context, key)
    v = F.get(values, F.lit(0)).try_cast("bigint")
    if op == "GreaterThanIfExists":
        return F.when(F.size(values) == 0, True).otherwise(F.coalesce(v >= wanted, F.lit(False)))
    return F.coalesce(_COMPARE[op](v, F.lit(wanted)), F.lit(False))


def date_condition(context: Column, op: str, key: str, wanted: str) -> Column:
    v = F.try_to_timestamp(F.get(_values(context, key), F.lit(0)))
    return F.coalesce(_COMPARE[op](v, F.to_timestamp(F.lit(wanted))), F.lit(False))


def bool_condition(context: Column, key: str, wanted: bool) -> Column:
    return F.coalesce(F.get(_values(context, key), F.lit(0)) == str(wanted).lower(), F.lit(False))


def null_condition(context: Column, key: str, absent: bool) -> Column:
    return (F.size(_values(context, key)) == 0) == F.lit(absent)


def ipv4_number(v: Column) -> Column:
    part = lambda i: F.regexp_extract(v, r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$", i).try_cast("bigint")
    ok = reduce(lambda a, b: a & b, [part(i) <= 255 for i in (1, 2, 3, 4)])
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ipv6_hex(v: Column) -> Column:
    """An IPv6 address as 32 hex digits, which sort as the addresses do; null if it is none. `::` stands for one group or more."""
    tail = F.regexp_extract(v, r"^.*:([0-9.]*\.[0-9.]*)$", 1)
    n = ipv4_number(tail)
    groups4 = F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(tail)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n % 65536)))
    text = F.lower(F.when(tail == "", v).otherwise(groups4))
    halves = F.split(text, "::")
    groups = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    count = F.size(left) + F.size(right)
    ok = ((F.size(halves) == 1) & (count == 8)) | ((F.size(halves) == 2) & (count <= 7))
    ok = ok & F.forall(F.concat(left, right), lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
    wide = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(ok, F.concat(wide(left), F.repeat(F.lit("0000"), 8 - count), wide(right)))


def ip_condition(context: Column, key: str, networks: list[str], negate: bool = False) -> Column:
    """Any value in any network, in order: an unreadable value before the first hit makes it false. A bare address is a /32.

    IPv4 and IPv6 addresses are only in networks of their own kind.
    """
    four, six = [], []
    for n in networks:
        net = ipaddress.ip_network(n if "/" in n else f"{n}/32", strict=False)
        (four if net.version == 4 else six).append((int(net.network_address), int(net.broadcast_address)))
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    in4 = lambda v: some([ipv4_number(v).between(lo, hi) for lo, hi in four])
    in6 = lambda v: some([ipv6_hex(v).between(f"{lo:032x}", f"{hi:032x}") for lo, hi in six])
    state = lambda v: F.when(ipv4_number(v).isNotNull(), F.when(in4(v), "hit").otherwise("miss")).when(ipv6_hex(v).isNull(), "bad").when(in6(v), "hit").otherwise("miss")
    first = F.get(F.filter(F.transform(_values(context, key), state), lambda x: x != "miss"), F.lit(0))
    hit = F.coalesce(first == "hit", F.lit(False))
    return ~hit if negate else hit


def binary_condition(context: Column, wanted: dict[str, list[str]]) -> Column:
    """Base64 equality: all keys, any value of each; unreadable base64 is false."""
    plain = lambda v: F.try_to_binary(v, F.lit("base64"))
    one = lambda k, vs: F.exists(_values(context, k), lambda v: F.coalesce(reduce(lambda a, b: a | b, [plain(v) == plain(F.lit(w)) for w in vs]), F.lit(False)))
    return reduce(lambda a, b: a & b, [one(k, vs) for k, vs in wanted.items()])


def if_exists(context: Column, keys: list[str], condition: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [~F.coalesce(F.map_contains_key(context, F.lit(k)), F.lit(False)) for k in keys]), True).otherwise(condition)


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def statement(action: Column, resource: Column, s: dict) -> Column:
    """Whether a statement applies: any action pattern, any resource pattern, all conditions."""
    some = lambda c, ps: reduce(lambda a, b: a | b, [glob(c, p) for p in ps])
    return some(action, s["action"]) & some(resource, s["resource"]) & every(s.get("conditions", []))


def allowed(action: Column, resource: Column, statements: list[dict]) -> Column:
    """Deny wins; nothing is allowed by default."""
    either = lambda effect: reduce(lambda a, b: a | b, [statement(action, resource, s) for s in statements if s["effect"] == effect], F.lit(False))
    return ~either("Deny") & either("Allow")
