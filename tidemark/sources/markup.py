"""Elements of XML records that need not be well formed.

A record's text becomes an array of its elements in document order, each with its local name, its attributes' texts, its own text and
the elements around it; fields are then looked up with DataFrame functions. Tags are closed as a recovering parser closes them: an end tag closes
its element and all that was opened within, one without an open element is passed over, and what is open at the end is closed there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENTS = "array<struct<name:string,space:string,text:string,attributes:map<string,string>,path:array<int>>>"
#: What a record's text is made of: comments, CDATA, declarations, end tags, start tags (a quoted value may hold >), text.
_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)|<![^>]*>|</\s*(?P<end>[^\s>]+)\s*>|<(?P<tag>[A-Za-z_][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|(?P<text>[^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|lt|gt|amp|quot|apos);")


def unescaped(text: str) -> str:
    """Numeric references and XML's five entities read; others stay as they are."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def elements(record: str | None) -> list[dict]:
    """The elements of a record in document order. text is what stands before an element's first child, trimmed; path holds the places of
    the elements around it, from the outermost."""
    found: list[dict] = []
    own: list[list[str]] = []
    parents: set[int] = set()
    spaces: list[dict[str, str]] = []
    stack: list[int] = []
    for m in _PIECE.finditer(record or ""):
        kind = m.lastgroup
        if kind == "rest" or m["tag"]:
            rest = m["rest"] or ""
            attributes = {k: unescaped(a or b) for k, a, b in _ATTRIBUTE.findall(rest)}
            declared = {k[6:] if k.startswith("xmlns:") else "": v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
            space = {**(spaces[stack[-1]] if stack else {}), **declared}
            prefix, _, name = m["tag"].rpartition(":")
            if stack:
                parents.add(stack[-1])
            found.append({"name": name, "space": space.get(prefix), "attributes": {k: v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}, "path": list(stack), "tag": m["tag"]})
            own.append([])
            spaces.append(space)
            if not rest.endswith("/"):
                stack.append(len(found) - 1)
        elif m["end"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if found[stack[i]]["tag"] == m["end"]), None)
            if at is not None:
                del stack[at:]
        elif stack and stack[-1] not in parents and kind in ("text", "cdata"):
            own[stack[-1]].append(m["cdata"] if kind == "cdata" else unescaped(m["text"]))
    for x, text in zip(found, own, strict=True):
        x["text"] = "".join(text).strip()
        del x["tag"]
    return found


def with_elements(df: DataFrame, column: str, name: str = "elements") -> DataFrame:
    """Add the elements of each record's text; null and text without tags have none. A column of the name is replaced."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T._parse_datatype_string(ELEMENTS))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [elements(x) for x in pdf[column]]})[schema.names]

    return df.mapInPandas(run, schema)


def named(found: Column, *names: str) -> Column:
    """The elements with one of the local names, in document order."""
    return F.filter(found, lambda x: x["name"].isin(*names))


def texts(found: Column, *names: str) -> Column:
    """The texts, not empty ones, of the elements with one of the names, in document order."""
    return F.filter(F.transform(named(found, *names), lambda x: x["text"]), lambda t: t != "")


def first_text(found: Column, names: tuple[str, ...]) -> Column:
    """The first text by the order of the names, then of the document; null if none."""
    return F.coalesce(*[F.get(texts(found, n), F.lit(0)) for n in names])


def inside(found: Column, *names: str) -> Column:
    """The first element with one of the names and all elements within it; none if there is none."""
    first = _place(found, names)
    return F.filter(found, lambda x, i: (i == first) | F.array_contains(x["path"], first))


def _place(found: Column, names: tuple[str, ...]) -> Column:
    """Where the first element with one of the names stands, from 0; null if there is none."""
    return F.get(F.filter(F.transform(found, lambda x, i: F.when(x["name"].isin(*names), i)), lambda i: i.isNotNull()), F.lit(0))
