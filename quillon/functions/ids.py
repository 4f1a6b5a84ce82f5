"""Id generators: Python values for single rows, columns for many."""

from __future__ import annotations

import re
import secrets
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets of the id formats.
NANO = "useandom-26T198340PX75pxJACKVERYMINDBUSHWOLF_GQZbfghjklqvwyzrict"
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def timestamp_id() -> str:
    return f"{int(time.time() * 1000)}-{secrets.token_hex(4)}"


def nano_id(size: int = 21) -> str:
    return "".join(NANO[b & 63] for b in secrets.token_bytes(size))


def uuid_id() -> str:
    return str(uuid.uuid4())


def ulid() -> str:
    n = int(time.time() * 1000) << 80 | secrets.randbits(80)
    return "".join(BASE32[n >> 5 * i & 31] for i in reversed(range(26)))


def prefixed(prefix: str, size: int = 21) -> str:
    return f"{prefix}_{nano_id(size)}"


def typed(kind: str) -> str:
    return f"{kind}_{int(time.time() * 1000)}_{nano_id(8)}"


GENERATORS = {"timestamp": timestamp_id, "nano": nano_id, "uuid": uuid_id, "ulid": ulid}
FORMATS = {
    "uuid": re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I),
    "ulid": re.compile(rf"[{BASE32}]{{26}}"),
    "nano": re.compile(r"[A-Za-z0-9_-]{21}"),
    "timestamp": re.compile(r"\d{13}-[0-9a-f]{8}"),
}


def is_valid(value, kind: str | None = None) -> bool:
    return isinstance(value, str) and bool(value.strip()) and (kind is None or bool(FORMATS[kind].fullmatch(value)))


def extract_timestamp(value: str) -> int | None:
    """Milliseconds in a timestamp, typed or ULID id."""
    if FORMATS["ulid"].fullmatch(value):
        n = 0
        for c in value[:10]:
            n = n * 32 + BASE32.index(c)
        return n
    m = re.search(r"(?:^|_)(\d{13})(?=[-_])", value)
    return int(m[1]) if m else None


def extract_type(value: str) -> str | None:
    return value.split("_")[0] if "_" in value else None


def column(kind: str = "uuid", prefix: str | None = None) -> Column:
    """An id for each row; write the rows before they are used twice, as it is made anew each time."""
    raw = F.uuid() if kind == "uuid" else F.concat(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return F.concat(F.lit(f"{prefix}_"), raw) if prefix else raw
