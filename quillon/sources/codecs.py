"""Text formats: each codec turns a text into Python values and back. Files of rows are read and written by ``files``."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from quillon.errors import SerializationError, UnsupportedFormatError
from quillon.sources import prose, relaxed


@dataclass(frozen=True)
class Codec:
    name: str
    extensions: tuple[str, ...]
    encode: Callable[[object], str]
    decode: Callable[[str], object]


def _yaml_encode(value) -> str:
    import yaml

    return yaml.safe_dump(value, indent=2, width=80, sort_keys=False, allow_unicode=True)


def _yaml_decode(text: str):
    import yaml

    return yaml.safe_load(text)


def _jsonl_encode(value) -> str:
    rows = list(value.values()) if isinstance(value, Mapping) else value
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def _jsonl_decode(text: str) -> list:
    return [json.loads(line) for line in text.split("\n") if line.strip()]


def without_nulls(value):
    """TOML has no null: it is left out of tables and lists."""
    if isinstance(value, Mapping):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [without_nulls(v) for v in value if v is not None]
    return value


def _toml_value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(v, Mapping):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    return _toml_value(str(v))


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)


def _toml_table(table: Mapping, path: str = "") -> str:
    plain = [f"{_toml_key(k)} = {_toml_value(v)}\n" for k, v in table.items() if not isinstance(v, Mapping)]
    out = "".join(plain)
    for k, v in table.items():
        if isinstance(v, Mapping):
            name = f"{path}.{_toml_key(k)}" if path else _toml_key(k)
            out += f"\n[{name}]\n" + _toml_table(v, name)
    return out


def _toml_encode(value) -> str:
    if not isinstance(value, Mapping):
        value = {"items": value}
    return _toml_table(without_nulls(value)).lstrip("\n")


def _toml_decode(text: str):
    import tomllib

    return tomllib.loads(text)


JSON = Codec("json", ("json",), lambda v: json.dumps(v, indent=2, ensure_ascii=False), json.loads)
JSONL = Codec("jsonl", ("jsonl", "ndjson"), _jsonl_encode, _jsonl_decode)
YAML = Codec("yaml", ("yaml", "yml"), _yaml_encode, _yaml_decode)
TOML = Codec("toml", ("toml",), _toml_encode, _toml_decode)
JSON5 = Codec("json5", ("json5",), relaxed.json5_encode, relaxed.json5_decode)
JSONC = Codec("jsonc", ("jsonc",), lambda v: json.dumps(v, indent=2, ensure_ascii=False), relaxed.jsonc_decode)
HJSON = Codec("hjson", ("hjson",), relaxed.hjson_encode, relaxed.hjson_decode)
TOON = Codec("toon", ("toon",), relaxed.toon_encode, relaxed.toon_decode)
ALL = (JSON, JSONL, YAML, TOML, JSON5, JSONC, HJSON, TOON)
DEFAULT = (JSON, YAML)


class Codecs:
    """Codecs by extension; of two for one extension the later one, which is noted in ``replaced``."""

    def __init__(self, codecs=ALL):
        self.by_extension: dict[str, Codec] = {}
        self.replaced: list[str] = []
        for c in codecs:
            for e in c.extensions:
                if e in self.by_extension:
                    self.replaced.append(e)
                self.by_extension[e] = c

    def of(self, name: str) -> Codec:
        ext = name.rsplit(".", 1)[-1].lower()
        if ext not in self.by_extension:
            raise UnsupportedFormatError(f"no codec for {name}", format=ext, available=sorted(self.by_extension))
        return self.by_extension[ext]

    def encode(self, value, name: str) -> str:
        codec = self.of(name)
        try:
            return codec.encode(value)
        except Exception as e:
            raise SerializationError(f"{codec.name}: {e}", format=codec.name) from e

    def decode(self, text: str, name: str):
        codec = self.of(name)
        try:
            return codec.decode(text)
        except Exception as e:
            raise SerializationError(f"{codec.name}: {e}", format=codec.name) from e


def prose_codec(template: str, overflow=()) -> Codec:
    """Sentences by a template; see ``prose``."""
    return Codec("prose", ("prose",), lambda rows: prose.encode(rows, template, overflow), prose.decode)
