"""Relaxed notations: JSON with comments, JSON5, Hjson and TOON (an indented notation with tables)."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|\ufeff)*", re.S)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_NAME = re.compile(r"[\w$]+")
_STRING = re.compile(r"""'((?:[^'\\\n]|\\(?:\r\n|.|\n))*)'|"((?:[^"\\\n]|\\(?:\r\n|.|\n))*)\"""", re.S)
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "ux" and len(x) > 1 else _ESCAPES.get(x, x)

    out = re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.|\n)", one, s, flags=re.S)
    return out.encode("utf-16", "surrogatepass").decode("utf-16")


def jsonc_decode(text: str):
    """JSON with comments and trailing commas."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', lambda m: m[1] or "", out))


def json5_decode(text: str):
    value, at = _json5(text, _skip(text, 0))
    if _skip(text, at) != len(text):
        raise ValueError(f"text after the value at {at}")
    return value


def _skip(s: str, at: int) -> int:
    return _SPACE.match(s, at).end()


def _json5(s: str, at: int):
    c = s[at : at + 1]
    if c in ("{", "["):
        close, out = ("}", {}) if c == "{" else ("]", [])
        at = _skip(s, at + 1)
        while s[at : at + 1] != close:
            if c == "{":
                if m := _STRING.match(s, at):
                    key = _unescape(m[1] if m[1] is not None else m[2])
                elif m := _NAME.match(s, at):
                    key = m[0]
                else:
                    raise ValueError(f"a key is missing at {at}")
                at = _skip(s, m.end())
                if s[at : at + 1] != ":":
                    raise ValueError(f"a colon is missing at {at}")
                out[key], at = _json5(s, _skip(s, at + 1))
            else:
                value, at = _json5(s, at)
                out.append(value)
            at = _skip(s, at)
            if s[at : at + 1] == ",":
                at = _skip(s, at + 1)
            elif s[at : at + 1] != close:
                raise ValueError(f"{close} is missing at {at}")
        return out, at + 1
    if m := _STRING.match(s, at):
        return _unescape(m[1] if m[1] is not None else m[2]), m.end()
    for word, value in (("true", True), ("false", False), ("null", None)):
        if s.startswith(word, at):
            return value, at + len(word)
    if m := _NUMBER.match(s, at):
        return _number(m[0]), m.end()
    raise ValueError(f"a value is missing at {at}")


def _number(x: str):
    body, sign = x.lstrip("+-"), -1 if x.startswith("-") else 1
    if body[:2] in ("0x", "0X"):
        return sign * int(body, 16)
    if body in ("Infinity", "NaN"):
        return sign * float(body.replace("Infinity", "inf"))
    return sign * (int(body) if body.isdigit() else float(body))


def json5_encode(value, indent: str = "") -> str:
    inner = indent + "  "
    if isinstance(value, Mapping):
        body = "".join(f"{inner}{k if re.fullmatch(r'[A-Za-z_$][A-Za-z0-9_$]*', k) else json.dumps(k)}: {json5_encode(v, inner)},\n" for k, v in value.items())
        return f"{{\n{body}{indent}}}" if body else "{}"
    if isinstance(value, (list, tuple)):
        body = "".join(f"{inner}{json5_encode(v, inner)},\n" for v in value)
        return f"[\n{body}{indent}]" if body else "[]"
    if isinstance(value, str):
        return "'" + json.dumps(value, ensure_ascii=False)[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    return json.dumps(value)


# Hjson: one member a line without commas; texts need no quotes up to the end of the line, and ''' holds several lines

_H_SPACE = re.compile(r"(?:[\s,]|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_H_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?=\s*(?:[,\]}#\n]|//|/\*|$))")


def hjson_decode(text: str):
    at = _H_SPACE.match(text, 0).end()
    if text[at : at + 1] in ("{", "["):
        return _hjson(text, at)[0]
    return _hjson_members(text, at, "")[0]  # without braces


def _hjson_members(s: str, at: int, close: str):
    out: dict = {}
    while True:
        at = _H_SPACE.match(s, at).end()
        if at >= len(s) or (close and s[at] == close):
            if close and at >= len(s):
                raise ValueError("} is missing")
            return out, at + len(close)
        if m := _STRING.match(s, at):
            key = _unescape(m[1] if m[1] is not None else m[2])
        elif m := re.compile(r"[^\s,:\[\]{}]+").match(s, at):
            key = m[0]
        else:
            raise ValueError(f"a key is missing at {at}")
        at = _H_SPACE.match(s, m.end()).end()
        if s[at : at + 1] != ":":
            raise ValueError(f"a colon is missing at {at}")
        m = re.compile(r"[ \t]*").match(s, at + 1)
        at = m.end()
        if s[at : at + 1] in ("\n", "\r", "#", "/"):
            at = _H_SPACE.match(s, at).end()
        out[key], at = _hjson(s, at)


def _hjson(s: str, at: int):
    c = s[at : at + 1]
    if c == "{":
        return _hjson_members(s, at + 1, "}")
    if c == "[":
        out = []
        while True:
            at = _H_SPACE.match(s, at + 1 if not out and s[at] == "[" else at).end()
            if at >= len(s):
                raise ValueError("] is missing")
            if s[at] == "]":
                return out, at + 1
            value, at = _hjson(s, at)
            out.append(value)
            if s[at : at + 1] == "]":
                return out, at + 1
    if s.startswith("'''", at):
        end = s.index("'''", at + 3)
        body = s[at + 3 : end]
        column = at - (s.rfind("\n", 0, at) + 1)
        lines = body.split("\n")
        if len(lines) > 1:
            lines = [x[column:] if not x[:column].strip() else x for x in (lines[1:] if not lines[0].strip() else lines)]
            if not lines[-1].strip():
                lines.pop()
        return "\n".join(lines), end + 3
    if m := _STRING.match(s, at):
        return _unescape(m[1] if m[1] is not None else m[2]), m.end()
    if m := re.compile(r"(true|false|null)(?=\s*(?:[,\]}#\n]|//|/\*|$))").match(s, at):
        return {"true": True, "false": False, "null": None}[m[1]], m.end()
    if m := _H_NUMBER.match(s, at):
        return _number(m[0]), m.end()
    end = s.find("\n", at)
    end = len(s) if end < 0 else end
    return s[at:end].strip(), end


def hjson_encode(value, indent: str = "") -> str:
    inner = indent + "  "
    if isinstance(value, Mapping):
        body = "".join(f"{inner}{k if re.fullmatch(r'[A-Za-z_][A-Za-z0-9_]*', k) else json.dumps(k)}: {hjson_encode(v, inner)}\n" for k, v in value.items())
        return f"{{\n{body}{indent}}}" if body else "{}"
    if isinstance(value, (list, tuple)):
        body = "".join(f"{inner}{hjson_encode(v, inner)}\n" for v in value)
        return f"[\n{body}{indent}]" if body else "[]"
    return json.dumps(value, ensure_ascii=False)


# TOON: "key: value" by indentation; [n] counts a list, {a,b} names the columns of a table

_PLAIN = re.compile(r"[A-Za-z_][\w.]*")
_HEAD = re.compile(r'^(?:("(?:[^"\\]|\\.)*")|([^\s:\[\]{}"]+))?(?:\[(\d+)\](?:\{([^}]*)\})?)?:(?: (.*))?$')


def _toon_scalar(v, extra: str = "") -> str:
    if isinstance(v, str):
        odd = not v or v != v.strip() or v in ("true", "false", "null") or re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|0\d+", v) or re.search(r'[:"\\\[\]{}\n\r\t,]', v) or v.startswith("-")
        return json.dumps(v, ensure_ascii=False) if odd else v
    return json.dumps(v)


def _toon_key(k: str) -> str:
    return k if _PLAIN.fullmatch(k) else json.dumps(k, ensure_ascii=False)


def _scalar(v) -> bool:
    return not isinstance(v, (Mapping, list, tuple))


def toon_encode(value) -> str:
    return "\n".join(_toon_members(value, "") if isinstance(value, Mapping) else _toon_list("", value, "") if isinstance(value, (list, tuple)) else [_toon_scalar(value)])


def _toon_members(value: Mapping, pad: str) -> list[str]:
    out = []
    for k, v in value.items():
        key = pad + _toon_key(k)
        if isinstance(v, Mapping):
            out.append(f"{key}:")
            out += _toon_members(v, pad + "  ")
        elif isinstance(v, (list, tuple)):
            out += _toon_list(key, v, pad)
        else:
            out.append(f"{key}: {_toon_scalar(v)}")
    return out


def _toon_list(key: str, v, pad: str) -> list[str]:
    head = f"{key}[{len(v)}]"
    if all(map(_scalar, v)):
        return [f"{head}: {','.join(map(_toon_scalar, v))}".rstrip() if v else f"{head}:"]
    if all(isinstance(x, Mapping) and x and list(x) == list(v[0]) and all(map(_scalar, x.values())) for x in v):
        return [f"{head}{{{','.join(map(_toon_key, v[0]))}}}:", *[pad + "  " + ",".join(map(_toon_scalar, x.values())) for x in v]]
    out = [f"{head}:"]
    for x in v:
        if _scalar(x):
            out.append(f"{pad}  - {_toon_scalar(x)}")
        else:
            lines = _toon_members(x, pad + "    ") if isinstance(x, Mapping) else _toon_list("", x, pad + "  ")
            out.append(f"{pad}  -" + (" " + lines[0].strip() if lines else ""))
            out += lines[1:]
    return out


def _toon_value(x: str):
    x = x.strip()
    if x.startswith('"'):
        return json.loads(x)
    if x in ("true", "false", "null"):
        return json.loads(x)
    return _number(x) if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", x) else x


def _toon_split(x: str) -> list:
    return [_toon_value(m[0]) for m in re.finditer(r'\s*"(?:[^"\\]|\\.)*"\s*|[^,]+|(?<=,)(?=,|$)', x)] if x.strip() else []


def toon_decode(text: str):
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip()]
    if not lines:
        return {}
    if len(lines) == 1 and not _HEAD.match(lines[0][1]):
        return _toon_value(lines[0][1])
    m = _HEAD.match(lines[0][1])
    if m and m[3] is not None and not (m[1] or m[2]):
        return _toon_body(lines, 0, m)[0]
    return _toon_object(lines, 0, lines[0][0])[0]


def _toon_body(lines, at: int, m: re.Match):
    """The value after a head with a count, whose line is at ``at``."""
    pad, n = lines[at][0], int(m[3])
    at += 1
    if m[4] is not None:
        names, rows = _toon_split(m[4]), []
        while len(rows) < n:
            rows.append(dict(zip(map(str, names), _toon_split(lines[at][1]), strict=True)))
            at += 1
        return rows, at
    if m[5] is not None or n == 0:
        return _toon_split(m[5] or ""), at
    out = []
    while at < len(lines) and lines[at][0] > pad and lines[at][1].startswith("-"):
        indent, rest = lines[at][0], lines[at][1][1:].strip()
        if not rest:
            out.append({})
            at += 1
        elif (h := _HEAD.match(rest)) and not rest.startswith('"') or (h and h[1]):
            lines[at] = indent + 2, rest
            if h[3] is not None and not (h[1] or h[2]):
                lines[at] = indent, rest
                value, at = _toon_body(lines, at, h)
            else:
                value, at = _toon_object(lines, at, indent + 2)
            out.append(value)
        else:
            out.append(_toon_value(rest))
            at += 1
    return out, at


def _toon_object(lines, at: int, pad: int):
    out: dict = {}
    while at < len(lines) and lines[at][0] == pad:
        m = _HEAD.match(lines[at][1])
        if m is None:
            raise ValueError(f"line {lines[at][1]!r} has no key")
        key = json.loads(m[1]) if m[1] else m[2]
        if m[3] is not None:
            out[key], at = _toon_body(lines, at, m)
        elif m[5] is not None:
            out[key] = _toon_value(m[5])
            at += 1
        elif at + 1 < len(lines) and lines[at + 1][0] > pad:
            out[key], at = _toon_object(lines, at + 1, lines[at + 1][0])
        else:
            out[key] = {}
            at += 1
    return out, at
