"""Plain text of rich-text documents (JSON trees of ``type`` / ``text`` / ``content`` nodes).

The tree is walked by one Column expression to a fixed depth. The rare document
that is deeper is recognised by the same walk and handed to a small helper with
a stack of its own, so no text is lost.

Both read a tree alike: a text node gives its text, any other node its children
joined, by line breaks in blocks and by blanks elsewhere. What is no object, has
no type or no list of children is an empty node; texts that are numbers or truth
values count as they are written. JSON nested deeper than a parser takes (1000
levels) is no document and gives an empty text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T
from . import values as V

DEPTH = 8


def _children(node: Column) -> Column:
    return F.try_variant_get(node, "$.content", "array<variant>")


def _type(node: Column) -> Column:
    return F.try_variant_get(node, "$.type", "string")


def _text(node: Column, depth: int) -> Column:
    nested = F.coalesce(
        F.try_variant_get(node, "$.text", "array<variant>").isNotNull() | F.try_variant_get(node, "$.text", "map<string,variant>").isNotNull(), F.lit(False)
    )
    own = F.when(~nested, F.coalesce(F.try_variant_get(node, "$.text", "string"), F.lit(""))).otherwise("")
    if depth == 0:
        return F.when(_type(node) == "text", own).otherwise("")
    parts = F.coalesce(F.transform(_children(node), lambda c: _text(c, depth - 1)), F.array().cast("array<string>"))
    separator = F.when(_type(node).isin(V.BLOCK_NODES), "\n").otherwise(" ")
    # The children are mentioned once per level, otherwise the expression doubles with each level.
    return F.when(_type(node) == "text", own).otherwise(F.call_function("array_join", parts, separator))


def _deeper(node: Column, depth: int) -> Column:
    if depth == 0:
        return F.coalesce(F.size(_children(node)) > 0, F.lit(False))
    return F.coalesce(F.exists(_children(node), lambda c: _deeper(c, depth - 1)), F.lit(False))


def _written(value) -> str:
    """A text as a variant gives it: no text for null, lists and objects."""
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else ""


def _walked(tree) -> str:
    """The text of one tree. The stack holds for each open node its separator, the children left and the parts found."""
    stack: list[tuple[str, list, list[str]]] = [("", [tree], [])]
    while True:
        separator, left, parts = stack[-1]
        if not left:
            stack.pop()
            if not stack:
                return separator.join(parts)
            stack[-1][2].append(separator.join(parts))
            continue
        node = left.pop()
        if not isinstance(node, dict):
            parts.append("")
        elif node.get("type") == "text":
            parts.append(_written(node.get("text")))
        else:
            children = node.get("content")
            known = node.get("type") if isinstance(node.get("type"), str) else None
            stack.append(("\n" if known in V.BLOCK_NODES else " ", children[::-1] if isinstance(children, list) else [], []))


@F.pandas_udf(StringType())
def _deep_text(docs: pd.Series) -> pd.Series:
    return docs.map(lambda d: None if d is None else _walked(json.loads(d, parse_int=str, parse_float=str)))


def rich_text(doc: Column, depth: int = DEPTH) -> Column:
    """``doc``: JSON of a description field. NULL gives ``''``, a plain JSON string itself."""
    tree = F.try_parse_json(doc)
    plain = F.try_variant_get(tree, "$", "string")
    is_object = F.startswith(T.strip(doc), F.lit("{"))
    deep = is_object & _deeper(tree, depth)
    walked = T.strip(F.when(deep, _deep_text(F.when(deep, doc))).otherwise(_text(tree, depth)))
    return F.when(doc.isNull(), "").when(is_object, walked).otherwise(F.coalesce(plain, F.lit("")))
