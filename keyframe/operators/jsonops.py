"""JSON documents (key, doc as text): reads with built-in path functions, writes with one Arrow function."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(doc: Column, path: str) -> Column:
    """JSON.GET of one path: the value's text, null if there is none."""
    return F.get_json_object(doc, path)


def get_many(store: DataFrame, keys: DataFrame, path: str, key: str = "key", doc: str = "doc") -> DataFrame:
    """JSON.MGET."""
    return keys.join(store, key, "left").select(*keys.columns, get(F.col(doc), path).alias("value"))


def kind(doc: Column, path: str) -> Column:
    """JSON.TYPE of the value at a path."""
    found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    return (
        F.when(found.startswith("OBJECT"), "object")
        .when(found.startswith("ARRAY"), "array")
        .when(found == "STRING", "string")
        .when(found == "BOOLEAN", "boolean")
        .when(found.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(found.isin("DOUBLE", "FLOAT") | found.startswith("DECIMAL"), "number")
        .when(found == "VOID", "null")
    )


def array_length(doc: Column, path: str) -> Column:
    """JSON.ARRLEN."""
    return F.json_array_length(get(doc, path))


def object_keys(doc: Column, path: str = "$") -> Column:
    """JSON.OBJKEYS, in order."""
    return F.array_sort(F.json_object_keys(get(doc, path)))


def string_length(doc: Column, path: str) -> Column:
    """JSON.STRLEN, in bytes."""
    return F.octet_length(get(doc, path))


FIND = re.compile(r"\.(\*|[A-Za-z_]\w*)|\[(\*|-?\d+|-?\d*:-?\d*)\]|\[\"([^\"]+)\"\]")


def find(path: str):
    """An Arrow function doc -> array of the JSON texts of all values at a path of .name, ["name"], [i], [-i], .*, [*] and [a:b]; null if the document isn't JSON."""
    steps = [m[0] or m[1] if m[0] or m[1] else m[2] for m in FIND.findall(path)]

    def step(value, s: str) -> list:
        if s == "*":
            return list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
        if isinstance(value, dict):
            return [value[s]] if s in value else []
        if isinstance(value, list) and ":" in s:
            a, b = (int(x) if x else None for x in s.split(":"))
            return value[a:b]
        if isinstance(value, list) and s.lstrip("-").isdigit() and -len(value) <= int(s) < len(value):
            return [value[int(s)]]
        return []

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def apply(docs: pa.Array) -> pa.Array:
        out = []
        for doc in docs.to_pylist():
            try:
                found = [json.loads(doc)] if doc is not None else None
            except ValueError:
                found = None
            for s in steps if found is not None else ():
                found = [v for x in found for v in step(x, s)]
            out.append(None if found is None else [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in found])
        return pa.array(out, pa.list_(pa.string()))

    return apply


STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(-?\d+)\]|\[\"([^\"]+)\"\]")


def edit(operation: str, path: str, result: str = "string"):
    """An Arrow function (doc, argument as JSON text) -> doc for one write at a plain path ($, .name, [i], ["name"]).

    operation: set, del, numincrby, nummultby, strappend, arrappend, arrpop, toggle, clear.
    A document without the path, or of the wrong type there, stays as it is; set makes missing objects.
    """
    steps = [m[0] or m[2] or int(m[1]) for m in STEP.findall(path)]

    def change(value, arg):
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if operation == "set":
            return arg
        if operation == "numincrby" and number:
            return value + arg
        if operation == "nummultby" and number:
            return value * arg
        if operation == "strappend" and isinstance(value, str):
            return value + arg
        if operation == "arrappend" and isinstance(value, list):
            return [*value, arg]
        if operation == "arrpop" and isinstance(value, list):
            return value[:-1]
        if operation == "toggle" and isinstance(value, bool):
            return not value
        if operation == "clear":
            return {} if isinstance(value, dict) else [] if isinstance(value, list) else 0 if number else value
        return value

    def write(doc, arg):
        if not steps:
            return None if operation == "del" else change(doc, arg)
        at = doc
        for s in steps[:-1]:
            if isinstance(at, dict) and isinstance(s, str):
                if s not in at and operation == "set":
                    at[s] = {}
                at = at.get(s)
            elif isinstance(at, list) and isinstance(s, int) and -len(at) <= s < len(at):
                at = at[s]
            else:
                return doc
        s = steps[-1]
        there = isinstance(at, dict) and isinstance(s, str) and s in at or isinstance(at, list) and isinstance(s, int) and -len(at) <= s < len(at)
        if operation == "del" and there:
            del at[s]
        elif there or operation == "set" and isinstance(at, dict) and isinstance(s, str):
            at[s] = change(at[s] if there else None, arg)
        return doc

    @F.arrow_udf(T.StringType())
    def apply(docs: pa.Array, args: pa.Array) -> pa.Array:
        out = []
        for doc, arg in zip(docs.to_pylist(), args.to_pylist(), strict=True):
            try:
                made = None if doc is None else write(json.loads(doc), None if arg is None else json.loads(arg))
                out.append(None if made is None else json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(doc)
        return pa.array(out, pa.string())

    return apply
