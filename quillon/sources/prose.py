"""Prose: a text whose records are sentences by a template.

``@prose`` and the headline template stand in one line, at the left edge; indented lines after it are overflow templates.
A template has fields in braces, with text between any two of them. A line that fits the headline is a record; indented
lines below it are values of the overflow templates, and deeper ones go on with the value above. Other lines are left alone.

Values: ``~`` is null; true and false; decimal numbers; ``[a, b]`` lists; all else is text. A text that would read as
something else, or that holds the text that ends its field, is put in quotes, with ``\\"`` for a quote in it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from quillon.errors import SerializationError

_FIELD = re.compile(r"\{([^{}]+)\}")
_NUMBER = re.compile(r"-?\d+(\.\d+)?")


class Template:
    def __init__(self, text: str):
        parts = _FIELD.split(text)
        self.text, self.literals, self.fields = text, parts[0::2], parts[1::2]
        if not self.fields or any(not x for x in self.literals[1:-1]):
            raise SerializationError(f"fields of {text!r} need text between them", format="prose")

    def fill(self, row: Mapping) -> str:
        out = self.literals[0]
        for i, f in enumerate(self.fields):
            after = self.literals[i + 1]
            out += write(row.get(f), after) + after
        return out

    def read(self, line: str) -> dict | None:
        if not line.startswith(self.literals[0]):
            return None
        at, out = len(self.literals[0]), {}
        for i, f in enumerate(self.fields):
            after, last = self.literals[i + 1], i == len(self.fields) - 1
            if m := re.compile(r'"((?:[^"\\]|\\.)*)"').match(line, at):
                if line.startswith(after, m.end()) and (not last or m.end() + len(after) == len(line)):
                    out[f] = re.sub(r"\\(.)", r"\1", m[1])
                    at = m.end() + len(after)
                    continue
            if last:
                if not line.endswith(after) or len(line) - len(after) < at:
                    return None
                end = len(line) - len(after)
            elif (end := line.find(after, at)) < 0:
                return None
            out[f] = read(line[at:end])
            at = end + len(after)
        return out if at == len(line) else None


def read(text: str):
    if text == "~":
        return None
    if text in ("true", "false"):
        return text == "true"
    if m := _NUMBER.fullmatch(text):
        return float(text) if m[1] else int(text)
    if text.startswith("[") and text.endswith("]"):
        return [read(x.strip()) for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    return text


def write(value, after: str = "") -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(write(v) for v in value) + "]"
    text = str(value)
    if isinstance(value, str) and (not isinstance(read(text), str) or (after and after in text) or text.startswith('"') or "\n" in text):
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return text


def encode(rows, template: str, overflow: Sequence[str] = ()) -> str:
    rows = list(rows.values()) if isinstance(rows, Mapping) else rows
    head, more = Template(template), [Template(t) for t in overflow]
    out = [f"@prose {template}", *[f"  {t}" for t in overflow], ""]
    for row in rows:
        out.append(head.fill(row))
        for t in more:
            if any(row.get(f) is not None for f in t.fields):
                first, *rest = t.fill(row).split("\n")
                out.append(f"  {first}")
                out += [f"    {x}" for x in rest]
    return "\n".join(out) + "\n"


def decode(text: str) -> list[dict]:
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.startswith("@prose ")]
    if len(at) != 1:
        raise SerializationError(f"@prose must occur once, not {len(at)} times", format="prose")
    i = at[0] + 1
    head, more = Template(lines[at[0]][7:].strip()), []
    while i < len(lines) and lines[i][:1] in (" ", "\t") and lines[i].strip():
        more.append(Template(lines[i].strip()))
        i += 1
    rows: list[dict] = []
    held: tuple[int, list[str]] | None = None

    def done() -> None:
        nonlocal held
        if held is not None and rows:
            for t in more:
                if (got := t.read("\n".join(held[1]))) is not None:
                    rows[-1].update(got)
                    break
        held = None

    inside = False
    for line in lines[i:]:
        indent = len(line) - len(line.lstrip())
        if line.strip() and indent == 0:
            done()
            got = head.read(line)
            inside = got is not None
            if inside:
                rows.append({**{f: None for t in more for f in t.fields}, **got})
        elif line.strip() and inside:
            if held is not None and indent > held[0]:
                held[1].append(line.strip())
            else:
                done()
                held = indent, [line.strip()]
    done()
    return rows
