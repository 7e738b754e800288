"""Strings of nested JSON documents, at any depth and of any length, in document order.

A document is read once from left to right, token by token: depth is a number, and what stands between a skipped key and
the next comma or closing bracket on its level goes. So neither the depth of a document nor the length of a string meets a
recursive pattern or a parser's tree, the strings of a document stay in its row, and nothing is sorted or shuffled.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse

#: Keys whose values the article services repeat (fixed values).
SKIPPED_KEYS = ("coredata", "link")
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]', re.DOTALL)


def _string(token: Column) -> Column:
    """The string that a token writes."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))).otherwise(plain)


def _named(token: str, names: tuple[str, ...]) -> bool:
    if "\\" in token:
        try:
            return json.loads(token, strict=False) in names
        except ValueError:
            return False
    return token[1:-1] in names


def string_tokens(document: str, skipped: tuple[str, ...] = SKIPPED_KEYS):
    """(number, token) of the strings of a document as they are written, keys and the values of skipped keys left out."""
    depth, quiet, held = 0, None, None  # quiet: the level of the skipped key
    for at, m in enumerate(_TOKEN.finditer(document)):
        token = m.group()
        kind = token[0]
        if held is not None:
            if kind != ":":
                if quiet is None:
                    yield held
            elif quiet is None and _named(held[1], skipped):
                quiet = depth
            held = None
        if kind == '"':
            held = at, token
        elif kind in "[{":
            depth += 1
        elif kind in ",]}":
            if quiet == depth:
                quiet = None
            depth -= kind != ","
    if held is not None and quiet is None:
        yield held


def _strings(payload: Column, skipped: tuple[str, ...]) -> Column:
    """The strings of a document as array<struct<at, text>>, white space collapsed and blank ones gone; null for a broken one."""

    @F.arrow_udf("array<struct<at:int,token:string>>")
    def run(documents: pa.Array) -> pa.Array:
        upto, places, tokens, known = [0], [], [], []
        for x in documents:
            if x.is_valid:
                for at, token in string_tokens(x.as_py(), skipped):
                    places.append(at)
                    tokens.append(token)
            known.append(x.is_valid)
            upto.append(len(tokens))
        fields = [pa.field("at", pa.int32()), pa.field("token", pa.string())]
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(tokens, pa.string())], fields=fields), mask=pa.array([not k for k in known], pa.bool_()))

    found = run(F.when(F.get_json_object(payload, "$").isNotNull(), payload))
    told = F.transform(found, lambda t: F.struct(t["at"].alias("at"), collapse(_string(t["token"])).alias("text")))
    return F.filter(told, lambda t: t["text"] != "")


def json_strings(rows: DataFrame, id_col: str, payload_col: str, skipped: tuple[str, ...] = SKIPPED_KEYS) -> DataFrame:
    """(id, at, text): the strings of each document, keys and the values of skipped keys left out; white space collapsed, blank ones gone.

    Cases: null and broken documents have no strings; a document may be a lone string; a repeated key counts each time;
    numbers, truth values and nulls are no strings; ids name one document each; an empty table gives no rows.
    """
    each = rows.select(F.col(id_col), F.explode(_strings(F.col(payload_col), skipped)).alias("_s"))
    return each.select(id_col, "_s.at", "_s.text")


def json_text(rows: DataFrame, id_col: str, payload_col: str, skipped: tuple[str, ...] = SKIPPED_KEYS) -> DataFrame:
    """(id, text): the strings of each document joined by spaces; '' for a document without strings, null for a broken one."""
    return rows.select(id_col, F.array_join(F.transform(_strings(F.col(payload_col), skipped), lambda t: t["text"]), " ").alias("text"))
