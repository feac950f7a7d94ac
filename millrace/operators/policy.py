"""Access decisions: statements compiled into the plan, one predicate each, so requests are neither joined nor shuffled.

A statement is {effect, principals | not_principals, actions | not_actions, resources | not_resources, conditions} with
wildcards; conditions is {operator: {key: values}}. A request's context is map<string, array<string>>; a key that is not
in it is absent. A null principal is anonymous: only "*" matches it.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operators without IfExists and without a set qualifier.
OPERATORS = {
    "StringEquals", "StringNotEquals", "StringEqualsIgnoreCase", "StringNotEqualsIgnoreCase", "StringLike", "StringNotLike",
    "NumericEquals", "NumericNotEquals", "NumericLessThan", "NumericLessThanEquals", "NumericGreaterThan", "NumericGreaterThanEquals",
    "DateEquals", "DateNotEquals", "DateLessThan", "DateLessThanEquals", "DateGreaterThan", "DateGreaterThanEquals",
    "Bool", "BinaryEquals", "IpAddress", "NotIpAddress", "ArnEquals", "ArnLike", "ArnNotEquals", "ArnNotLike", "Null",
}


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def wildcard(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """* and ? are wild, all else literal."""
    body = "".join({"*": ".*", "?": "."}.get(ch) or re.escape(ch) for ch in pattern)
    return text.rlike(f"(?{'i' if ignore_case else ''}s)\\A{body}\\z")


def _v4(text: Column) -> Column:
    """An address as a number, also where it is written inside a v6 one; null where it is no v4 address."""
    bare = F.regexp_replace(text, "(?i)^::ffff:", "")
    parts = F.split(bare, "\\.")
    sound = bare.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(sound, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long")))


def in_network(ip: Column, network: str) -> Column:
    """Whether an address lies in a network (or is the one address named); never null."""
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        low = int(net.network_address)
        return F.coalesce(_v4(ip).between(low, low + net.num_addresses - 1), F.lit(False))

    @F.pandas_udf("boolean")
    def inside(ips: pd.Series) -> pd.Series:
        def one(x):
            try:
                return ipaddress.ip_address(x) in net
            except ValueError:
                return False

        return ips.map(one)

    return F.coalesce(inside(ip), F.lit(False))


def _date(x: Column) -> Column:
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.when(x.rlike("^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$"), x))), F.trim(x).try_cast("long"))


def _holds(base: str, value: Column, expected: str) -> Column:
    """Whether one value meets one expected one, by the positive form of the operator; never null."""
    want = F.lit(expected)
    plain = base.replace("Not", "")
    if plain in ("StringEquals", "ArnEquals", "BinaryEquals"):
        found = value == want
    elif plain in ("StringEqualsIgnoreCase", "Bool"):
        found = F.lower(value) == expected.lower()
    elif plain in ("StringLike", "ArnLike"):
        found = wildcard(value, expected)
    elif plain == "IpAddress":
        found = in_network(value, expected)
    else:
        kind = "Numeric" if plain.startswith("Numeric") else "Date"
        a, b = (F.trim(x).try_cast("double") if kind == "Numeric" else _date(x) for x in (value, want))
        found = {"Equals": a == b, "LessThan": a < b, "LessThanEquals": a <= b, "GreaterThan": a > b, "GreaterThanEquals": a >= b}[plain.removeprefix(kind)]
    return F.coalesce(found, F.lit(False))


def condition(operator: str, key: str, expected: Sequence[str], context: Column) -> Column:
    """One operator and key: any expected value will do; an absent key fails but for negated, IfExists and ForAllValues forms."""
    set_all, name = operator.startswith("ForAllValues:"), operator.split(":")[-1]
    if_exists, base = name.endswith("IfExists"), name.removesuffix("IfExists")
    if base not in OPERATORS:
        return F.lit(False)
    values = F.coalesce(F.element_at(context, key), F.array().cast("array<string>"))
    absent = F.size(values) == 0
    if base == "Null":
        return absent == F.lit(any(x.lower() == "true" for x in expected))
    negated = "Not" in base
    if base in ("IpAddress", "NotIpAddress") and any(":" in x for x in expected):  # v6 takes a UDF, which lambdas can't hold: a request has one address
        hit = any_of([_holds(base, F.get(values, F.lit(0)), x) for x in expected])
        met = ~hit if negated else hit
    else:
        one = lambda v: any_of([_holds(base, v, x) for x in expected])
        if negated:
            met = F.forall(values, lambda v: ~one(v)) if set_all else ~F.exists(values, one)
        else:
            met = F.forall(values, one) if set_all else F.exists(values, one)
    return F.when(absent, F.lit(if_exists or negated or set_all)).otherwise(met)


def _matches(s: Mapping, principal: Column, action: Column, resource: Column, context: Column | None) -> Column:
    def named(x: Column, kind: str, ignore_case: bool = False, default: Sequence[str] = ("*",)) -> Column:
        hit = lambda ps: F.coalesce(any_of([F.lit(True) if p == "*" else wildcard(x, p, ignore_case) for p in ps]), F.lit(False))
        return ~hit(s[f"not_{kind}"]) if f"not_{kind}" in s else hit(s.get(kind, default))

    met = named(principal, "principals") & named(action, "actions", True) & named(resource, "resources")
    held = F.create_map().cast("map<string,array<string>>") if context is None else context
    return met & all_of([condition(op, key, [v] if isinstance(v, str) else v, held) for op, keys in s.get("conditions", {}).items() for key, v in keys.items()])


def decide(statements: Sequence[Mapping], principal: Column, action: Column, resource: Column, context: Column | None = None) -> Column:
    """Deny, Allow or ImplicitDeny of each request: any matching deny wins, then any matching allow."""
    deny, allow = (any_of([_matches(s, principal, action, resource, context) for s in statements if s["effect"] == e]) for e in ("Deny", "Allow"))
    return F.when(deny, "Deny").when(allow, "Allow").otherwise("ImplicitDeny")


def folded(levels: Sequence[Column]) -> Column:
    """One decision from those of the catalog, its namespaces and the table, outermost first: a deny at any level refuses, else any allow allows."""
    return F.when(any_of([x == "Deny" for x in levels]), "Deny").when(any_of([x == "Allow" for x in levels]), "Allow").otherwise("ImplicitDeny")


def post_allowed(conditions: Sequence[Sequence], fields: Column, size: Column) -> Column:
    """Whether a form upload (map of fields, bytes) meets all conditions: (eq, field, value), (starts-with, field, value), (content-length-range, low, high)."""
    met = []
    for kind, a, b in conditions:
        value = F.coalesce(F.element_at(fields, str(a).removeprefix("$").lower()), F.lit(""))
        met.append({"eq": lambda v, b=b: v == b, "starts-with": lambda v, b=b: v.startswith(b)}[kind](value) if kind != "content-length-range" else size.between(int(a), int(b)))
    return all_of(met)
