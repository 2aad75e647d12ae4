"""JSON texts checked strictly: repeated keys, depth and size are faults, and faulty rows are told apart from good ones.

Spark's own reader takes the last of repeated keys or refuses the row without saying why. Here a scan goes over each
text with a stack of the open objects and arrays; what passes is then parsed by Spark as a VARIANT.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: codes of faults, the deepest nesting and the largest text in bytes of UTF-8
SYNTAX, REPEATED, DEEP, LARGE = "DICTIONARY_JSON_SYNTAX_INVALID", "DICTIONARY_JSON_DUPLICATE_KEY", "DICTIONARY_MAX_NESTING_DEPTH_EXCEEDED", "DICTIONARY_JSON_TOO_LARGE"
DEPTH, BYTES = 6, 2097152
# fixed values: what a read of pages may hold
PAGE_LIMITS = {"pages": 2000, "items": 2_000_000, "characters": 5_000_000, "statements": 50_000}
_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([{}\[\],:]))')
_END = re.compile(r"[ \t\n\r]*\Z")


def fault(text: str, depth: int = DEPTH) -> str | None:
    """The first fault of a JSON text, or null. Keys are compared as they read, not as they are written."""
    at, open_, wants = 0, [], "value"  # of open objects the keys, of open arrays null
    while wants != "end":
        m = _TOKEN.match(text, at)
        if m is None:
            return SYNTAX
        at, (string, scalar, mark) = m.end(), m.groups()
        if wants in ("key", "key or }"):
            if string is not None:
                key = json.loads(string)
                if key in open_[-1]:
                    return REPEATED
                open_[-1].add(key)
                wants = ":"
                continue
            if mark != "}" or wants == "key":
                return SYNTAX
            open_.pop()
        elif wants == ":":
            if mark != ":":
                return SYNTAX
            wants = "value"
            continue
        elif wants in ("value", "value or ]"):
            if mark in ("{", "["):
                if len(open_) > depth:
                    return DEEP
                open_.append(set() if mark == "{" else None)
                wants = "key or }" if mark == "{" else "value or ]"
                continue
            if mark == "]" and wants == "value or ]":
                open_.pop()
            elif mark is not None:
                return SYNTAX
        else:  # after a value inside of something
            if mark == ",":
                wants = "value" if open_[-1] is None else "key"
                continue
            if mark != ("]" if open_[-1] is None else "}"):
                return SYNTAX
            open_.pop()
        wants = "more" if open_ else "end"
    return None if _END.match(text, at) else SYNTAX


def checked(rows: DataFrame, text: str, depth: int = DEPTH, most_bytes: int = BYTES) -> DataFrame:
    """``rows`` with json_fault and json (a VARIANT; null where there is a fault). A null text is a syntax fault.

    Size comes first and is told by Spark; larger texts aren't scanned. Columns of these names are replaced."""
    kept = [c for c in rows.columns if c not in ("json_fault", "json")]
    sized = rows.select(*kept, (F.octet_length(text) > most_bytes).alias("_large"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, large = batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [SYNTAX if t is None else LARGE if far else fault(t, depth) for t, far in zip(texts, large)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "json_fault"])

    out = sized.mapInArrow(run, f"{spec}, json_fault string")
    return out.select(*kept, "json_fault", F.when(F.col("json_fault").isNull(), F.try_parse_json(text)).alias("json"))


def limited(rows: DataFrame, limits: dict[str, int], measures: dict[str, Column] | None = None) -> tuple[DataFrame, "Limits"]:
    """``rows`` with metrics that are gathered while they are read, and the limits that a run must keep."""
    from pyspark.sql import Observation

    seen = Observation()
    found = {name: F.sum(column) for name, column in (measures or {}).items()} | {"rows": F.count(F.lit(1))}
    return rows.observe(seen, *(c.cast("long").alias(n) for n, c in found.items())), Limits(seen, limits)


class Limits:
    """Limits of a run (name of a metric -> the most). ``check`` refuses it after its action, without another pass."""

    def __init__(self, seen, limits: dict[str, int]):
        self.seen, self.limits = seen, limits

    def check(self) -> dict[str, int]:
        found = {k: v or 0 for k, v in self.seen.get.items()}
        over = sorted(f"{k}: {found[k]} > {most}" for k, most in self.limits.items() if found.get(k, 0) > most)
        if over:
            raise ValueError("limits exceeded: " + ", ".join(over))
        return found
