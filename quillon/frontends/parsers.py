"""Texts to query objects: the filters and sets of the command line, and the query strings of REST."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl

from quillon.errors import ValidationError

#: Operators of the command line, in the order in which they are looked for.
SIGNS = ((">=", "$gte"), ("<=", "$lte"), ("!=", "$ne"), (">", "$gt"), ("<", "$lt"), ("=", "$eq"))
WORDS = (("contains", "$contains"), ("startsWith", "$startsWith"), ("endsWith", "$endsWith"))
REST_OPERATORS = ("$eq", "$ne", "$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$startsWith", "$endsWith", "$contains", "$all", "$size", "$search")


class ParseError(ValidationError):
    tag = "ParseError"


def cli_value(text: str):
    """Quoted texts as they are; true, false, null and whatever reads as a number; else text."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text == "null":
        return None
    try:
        n = float(text)
    except ValueError:
        return text
    return int(n) if n.is_integer() and re.fullmatch(r"[+-]?\d+", text) else n


def cli_filter(text: str) -> dict:
    """"field op value"."""
    for sign, name in SIGNS:
        at = text.find(sign)
        if at > 0:
            return _condition(text, text[:at], name, text[at + len(sign) :])
    for word, name in WORDS:
        if m := re.search(rf"\s{word}\s", text, re.I):
            return _condition(text, text[: m.start()], name, text[m.end() :])
    raise ParseError(f"no operator in {text!r}", issues=[{"field": "where", "message": "no operator"}])


def _condition(text: str, field: str, name: str, value: str) -> dict:
    field = field.strip()
    if not field or not value.strip():
        raise ParseError(f"{text!r} needs a field and a value", issues=[{"field": "where", "message": "incomplete"}])
    return {field: cli_value(value)} if name == "$eq" else {field: {name: cli_value(value)}}


def cli_filters(texts: list[str]) -> dict:
    """All of them hold; several on one field are merged."""
    out: dict = {}
    for t in texts:
        for k, v in cli_filter(t).items():
            if k not in out:
                out[k] = v
            else:
                a, b = ({"$eq": x} if not isinstance(x, dict) else x for x in (out[k], v))
                out[k] = {**a, **b}
    return out


def cli_sets(texts: list[str] | str) -> dict:
    """"k=v,k2='a,b'"; commas in quotes don't part."""
    out = {}
    for text in [texts] if isinstance(texts, str) else texts:
        for part in re.findall(r"""(?:[^,'"]|'[^']*'|"[^"]*")+""", text):
            key, sign, value = part.partition("=")
            if not sign or not key.strip():
                raise ParseError(f"{part!r} is no assignment", issues=[{"field": "set", "message": "no assignment"}])
            out[key.strip()] = cli_value(value)
    return out


def cli_sort(text: str) -> dict[str, str]:
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        field, _, direction = part.partition(":")
        if direction not in ("", "asc", "desc"):
            raise ParseError(f"{direction!r} is no direction", issues=[{"field": "sort", "message": "asc or desc"}])
        out[field] = direction or "asc"
    return out


def rest_value(text: str):
    """true, false, and numbers that print as they are written; else text."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?(?:0|[1-9]\d*)", text) and text != "-0":
        return int(text)
    if re.fullmatch(r"-?(?:0|[1-9]\d*)\.\d*[1-9]", text):
        return float(text)
    return text


def _pairs(query: str | dict) -> list[tuple[str, str]]:
    return parse_qsl(query.lstrip("?"), keep_blank_values=True) if isinstance(query, str) else [(k, x) for k, v in query.items() for x in (v if isinstance(v, list) else [v])]


def _where(pairs: list[tuple[str, str]], reserved: tuple[str, ...]) -> dict:
    out: dict = {}
    for k, v in pairs:
        m = re.fullmatch(r"([^\[\]]+)\[(\$\w+)\]", k)
        if m and m[2] in REST_OPERATORS:
            x = [rest_value(p.strip()) for p in v.split(",")] if m[2] in ("$in", "$nin", "$all") else v if m[2] in ("$search", "$startsWith", "$endsWith") else rest_value(v)
            held = out.get(m[1])
            out[m[1]] = {**(held if isinstance(held, dict) else {} if held is None else {"$eq": held}), m[2]: x}
        elif k not in reserved and "[" not in k:
            out[k] = rest_value(v)
    return out


def rest_query(query: str | dict) -> dict:
    """where, sort, limit, offset and select of a query string."""
    pairs = _pairs(query)
    flat, out = dict(pairs), {}
    if where := _where(pairs, ("sort", "limit", "offset", "select")):
        out["where"] = where
    if flat.get("sort"):
        out["sort"] = {f: d if d == "desc" else "asc" for f, _, d in (p.strip().partition(":") for p in flat["sort"].split(",")) if f}
    for k in ("limit", "offset"):
        if re.fullmatch(r"\d+", flat.get(k, "")):
            out[k] = int(flat[k])
    if flat.get("select"):
        out["select"] = [p.strip() for p in flat["select"].split(",") if p.strip()]
    return out


def rest_aggregate(query: str | dict) -> dict:
    """count=true&sum=a,b&groupBy=c; without any aggregate, the count."""
    pairs = _pairs(query)
    flat, out = dict(pairs), {}
    if where := _where(pairs, ("count", "sum", "avg", "min", "max", "groupBy")):
        out["where"] = where
    if flat.get("count") == "true":
        out["count"] = True
    for k in ("sum", "avg", "min", "max", "groupBy"):
        if fields := [p.strip() for p in flat.get(k, "").split(",") if p.strip()]:
            out[k] = fields[0] if len(fields) == 1 else fields
    if not any(k in out for k in ("count", "sum", "avg", "min", "max")):
        out["count"] = True
    return out
