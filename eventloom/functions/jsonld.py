"""JSON-LD of any depth: reading, walking and picking without recursion, so that no script can break a run.

Order: the objects of an object's ``@graph`` come first, then the object, then what its members hold in their own order,
the graph's objects once more. ``walk`` says how often: where only the first of something is wanted, or a page nests graphs
in graphs, the second visits are left out, since they bring nothing new and double with every level.

Defined cases: a script that is no JSON is passed over; depth has no limit; a number is kept as it is written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEEP = 24  # levels of a picked object that are handed on; readers look four levels down
NULLS = ("none", "null", "n/a", "na", "not available", "not specified", "not found")
TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null|NaN|-?Infinity))')
WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str):
    """The value of a JSON text; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """The same with a stack of its own."""
    root: list = []
    stack: list = [root]  # the open lists and objects
    keys: list = [None]  # the key that waits for its value, of each
    need = "value"  # what may come: value, first (value or an end), key, colon, next (comma or an end)
    at, end = 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = TOKEN.match(text, at)
        if not m or (len(stack) == 1 and root):
            raise ValueError("not JSON")
        at, (mark, quote, number, word) = m.end(), m.groups()
        top = stack[-1]
        if quote or number or word or mark in ("[", "{"):
            if quote:
                value, at = scanstring(text, at, True)
                if isinstance(top, dict) and need in ("key", "first"):
                    keys[-1], need = value, "colon"
                    continue
            elif number:
                value = float(number) if set(number) & set(".eE") else int(number)
            else:
                value = WORDS[word] if word else [] if mark == "[" else {}
            if need != "value" and not (need == "first" and isinstance(top, list)):
                raise ValueError("not JSON")
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            need = "next"
            if mark:
                stack.append(value)
                keys.append(None)
                need = "first"
        elif mark in ("]", "}"):
            if len(stack) == 1 or need not in ("first", "next") or isinstance(top, dict) != (mark == "}"):
                raise ValueError("not JSON")
            stack.pop()
            keys.pop()
            need = "next"
        elif mark == ",":
            if len(stack) == 1 or need != "next":
                raise ValueError("not JSON")
            need = "key" if isinstance(top, dict) else "value"
        else:
            if need != "colon":
                raise ValueError("not JSON")
            need = "value"
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("not JSON")
    return root[0]


def walk(value, again: bool = True) -> Iterator[dict]:
    """Every object of a value in order; those of a graph a second time in their place if ``again``."""
    stack = [(value, True)]  # what is to be visited, and whether an object is still to be opened
    while stack:
        now, closed = stack.pop()
        if isinstance(now, list):
            stack += [(v, True) for v in reversed(now) if isinstance(v, (dict, list))]
        elif closed:
            stack += [(v, True) for k, v in reversed(now.items()) if isinstance(v, (dict, list)) and (again or k != "@graph")]
            stack.append((now, False))
            if isinstance(now.get("@graph"), (dict, list)):
                stack.append((now["@graph"], True))
        else:
            yield now


def is_event(kind) -> bool:
    """Whether a type, or one of a list of types, is an event."""
    stack = [kind]
    while stack:
        now = stack.pop()
        if isinstance(now, list):
            stack += now
        elif isinstance(now, str) and (name := " ".join(now.split()).lower()) not in NULLS and name.endswith("event"):
            return True
    return False


def pruned(value, depth: int = DEEP):
    """A copy without what lies more than ``depth`` levels down."""
    if isinstance(value, dict):
        return {k: pruned(v, depth - 1) for k, v in value.items()} if depth else None
    if isinstance(value, list):
        return [pruned(v, depth - 1) for v in value] if depth else None
    return value


def first_event(scripts: list[str]) -> str | None:
    """The first event object of a page's scripts as JSON text."""
    for text in scripts:
        try:
            value = loads(text)
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            for x in walk(value, again=False):
                if is_event(x.get("@type")):
                    return json.dumps(pruned(x), ensure_ascii=False)
    return None


def typed_members(text: str | None) -> list[dict[str, str]] | None:
    """The plain members of every object with a type, in order; null if the text is no JSON."""
    try:
        value = loads(text or "")
    except ValueError:
        return None
    if not isinstance(value, (dict, list)):
        return []
    plain = lambda v: v if isinstance(v, str) else json.dumps(v)
    return [{k: plain(v) for k, v in x.items() if not isinstance(v, (dict, list))} for x in walk(value, again=False) if "@type" in x]


def _typed(texts: pd.Series) -> pd.Series:
    return pd.Series([typed_members(t) for t in texts], dtype=object)


def typed_objects(text: Column | str) -> Column:
    """Array of the plain members (a map) of every typed object in a JSON-LD text, in the order of ``walk``, each once."""
    return F.pandas_udf(_typed, "array<map<string,string>>")(text)
