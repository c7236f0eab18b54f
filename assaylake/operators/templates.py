"""Mapping templates: tables of fields that are compiled to one projection over JSON, with errors where they are compiled.

A template is a list of rows (target, path, cast, default, filter). ``path`` is a JSON path from ``$``. A row whose cast is
``list`` takes an array; its elements that pass ``filter`` are mapped by the rows whose target begins with its own and
``[].``, whose paths start at the element. Everything becomes ``select`` expressions of Spark over a variant, so a body is
parsed once, and nothing runs but what the expressions say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTS = {"string", "boolean", "int", "bigint", "double", "date", "timestamp"}
#: What a declared type may be read as.
READ_AS = {"string": CASTS, "boolean": {"boolean", "string"}, "number": {"string", "int", "bigint", "double"}}
PATH = re.compile(r"\$((\.[A-Za-z_][A-Za-z0-9_]*)|(\[[0-9]+\]))*")
TARGET = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
FILTER = re.compile(r"(?P<path>\$\S*)\s*(?P<op>=|<>|<=|>=|<|>)\s*(?P<value>'[^']*'|-?[0-9]+(\.[0-9]+)?|true|false)")


class TemplateError(ValueError):
    """A template that cannot be compiled; it names the target."""


@dataclass(frozen=True)
class Row:
    target: str
    path: str
    cast: str = "string"
    default: str | None = None
    filter: str | None = None


def _at(path: str, shape: T.DataType | None, target: str) -> T.DataType | None:
    """The declared type where the path ends; None where nothing is declared."""
    if not PATH.fullmatch(path):
        raise TemplateError(f"{target}: no path: {path}")
    for step in re.findall(r"\.(\w+)|\[([0-9]+)\]", path):
        if shape is None:
            return None
        name, index = step
        if name and isinstance(shape, T.StructType) and name in shape.names:
            shape = shape[name].dataType
        elif index and isinstance(shape, T.ArrayType):
            shape = shape.elementType
        else:
            raise TemplateError(f"{target}: {path} is not in the input")
    return shape


def _readable(shape: T.DataType | None, cast: str, target: str) -> None:
    if shape is None:
        return
    kind = "string" if isinstance(shape, T.StringType) else "boolean" if isinstance(shape, T.BooleanType) else "number" if isinstance(shape, T.NumericType) else None
    if kind is None or cast not in READ_AS[kind]:
        raise TemplateError(f"{target}: {shape.simpleString()} cannot be read as {cast}")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scalar(row: Row, source: str, shape: T.DataType | None) -> str:
    if row.cast not in CASTS:
        raise TemplateError(f"{row.target}: no type: {row.cast}")
    if row.filter is not None:
        raise TemplateError(f"{row.target}: only lists have a filter")
    _readable(_at(row.path, shape, row.target), row.cast, row.target)
    value = f"try_variant_get({source}, '{row.path}', '{row.cast}')"
    return value if row.default is None else f"coalesce({value}, cast({_quoted(row.default)} as {row.cast}))"


def _condition(row: Row, shape: T.DataType | None) -> str:
    found = FILTER.fullmatch(row.filter.strip())
    if not found:
        raise TemplateError(f"{row.target}: no filter: {row.filter}")
    value = found["value"]
    cast = "string" if value[0] == "'" else "boolean" if value in ("true", "false") else "double"
    _readable(_at(found["path"], shape, row.target), cast, row.target)
    literal = _quoted(value[1:-1]) if cast == "string" else value if cast == "boolean" else f"{float(value)!r}D"
    return f"coalesce(try_variant_get(x, '{found['path']}', '{cast}') {found['op']} {literal}, false)"


def compiled(rows: list[Row], shape: str | None = None, source: str = "body") -> list[str]:
    """Select expressions of the template's targets over a variant column. ``shape`` is the input's declared type (DDL); paths
    and casts are held against it where it is given."""
    declared = T.StructType.fromDDL(shape) if shape else None
    heads = [r for r in rows if "[]." not in r.target]
    names = [r.target for r in rows]
    if len(set(names)) < len(names):
        raise TemplateError(f"{next(n for n in names if names.count(n) > 1)}: named twice")
    inner: dict[str, list[Row]] = {}
    for r in rows:
        if "[]." in r.target:
            inner.setdefault(r.target.split("[].")[0], []).append(r)
    lists = {r.target for r in heads if r.cast == "list"}
    if orphan := sorted(set(inner) - lists):
        raise TemplateError(f"{orphan[0]}: no list of that name")
    out = []
    for r in heads:
        if not TARGET.fullmatch(r.target):
            raise TemplateError(f"{r.target}: no name")
        if r.cast != "list":
            out.append(f"{_scalar(r, source, declared)} as {r.target}")
            continue
        kind = _at(r.path, declared, r.target)
        if kind is not None and not isinstance(kind, T.ArrayType):
            raise TemplateError(f"{r.target}: {r.path} is no list")
        element = kind.elementType if kind is not None else None
        if not inner.get(r.target):
            raise TemplateError(f"{r.target}: a list without fields")
        each = f"coalesce(try_variant_get({source}, '{r.path}', 'array<variant>'), array())"
        if r.filter is not None:
            each = f"filter({each}, x -> {_condition(r, element)})"
        fields = []
        for f in inner[r.target]:
            name = f.target.split("[].", 1)[1]
            if not TARGET.fullmatch(name):
                raise TemplateError(f"{f.target}: no name")
            fields.append(f"'{name}', {_scalar(f, 'x', element)}")
        out.append(f"transform({each}, x -> named_struct({', '.join(fields)})) as {r.target}")
    return out


def apply(records: DataFrame, body: str, rows: list[Row], shape: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, ``parsed`` (false where the body is no JSON) and the template's targets, null there."""
    exprs = compiled(rows, shape, "_variant")
    read = records.select(*keep, F.try_parse_json(F.col(body)).alias("_variant"))
    return read.selectExpr(*keep, "_variant is not null as parsed", *exprs)


def from_table(table: DataFrame) -> dict[str, list[Row]]:
    """Templates by name from a table (template, place, target, path, cast, default, filter); the table is as small as what people write."""
    out: dict[str, list[Row]] = {}
    for r in table.orderBy("template", "place").collect():
        out.setdefault(r["template"], []).append(Row(r["target"], r["path"], r["cast"] or "string", r["default"], r["filter"]))
    return out


def verdicts(mapped: DataFrame, required: list[str]) -> DataFrame:
    """``observed``: null where the body is no JSON, BLOCK where a required target is null, else PASS."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    return mapped.withColumn("observed", F.when(F.col("parsed"), F.when(lacking, "BLOCK").otherwise("PASS")))
