"""Cells of notebook documents in their three layouts."""

from __future__ import annotations

import json
import re

PERCENT = re.compile(r"^# %%[^\n]*$", re.M)
FENCE = re.compile(r"^```[^\n]*$", re.M)


def _text(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, list):
        return "".join(e for e in x if isinstance(e, str))
    return ""


def _json_cells(text: str) -> list[str]:
    try:
        book = json.loads(text, strict=False)
        cells = book["cells"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return [text]
    out = []
    for cell in cells if isinstance(cells, list) else []:
        if not isinstance(cell, dict):
            continue
        out.append(_text(cell.get("source")))
        for o in cell.get("outputs") or []:
            if not isinstance(o, dict):
                continue
            out.append(_text(o.get("text")))
            for kind, value in (o.get("data") or {}).items() if isinstance(o.get("data"), dict) else ():
                if not kind.startswith("image/"):
                    out.append(_text(value))
            trace = o.get("traceback")
            if isinstance(trace, list):
                out.append("\n".join(e for e in trace if isinstance(e, str)))
            out.append(_text(o.get("evalue")))
    return [x for x in out if x]


def cells(text: str | None, layout: str | None) -> list[str]:
    """The sources and outputs of a document's cells, decoded, in order.

    An unknown layout, or JSON that cannot be read, is one cell.
    """
    if not text:
        return []
    if layout == "json":
        return _json_cells(text)
    if layout == "percent":
        return [x for x in PERCENT.split(text) if x.strip()]
    if layout == "fenced":
        return [x for x in FENCE.split(text) if x.strip()]
    return [text]
