"""Sinks of items: JSON arrays, JSON lines, and plain files by their ending."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from weftline.functions import tree
from weftline.functions.css import select_values


def write_jsonl(items: DataFrame, path: str) -> None:
    """A folder of JSON lines files, written by the executors."""
    items.select(F.to_json(F.struct(*items.columns)).alias("value")).write.mode("overwrite").text(path)


def write_json(items: DataFrame, path: str, indent: int | None = None) -> None:
    """One JSON array in one local file, a row at a time through the driver; folders are made. For results that one file can hold."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(items.select(F.to_json(F.struct(*items.columns))).toLocalIterator()):
            text = json.dumps(json.loads(row[0]), ensure_ascii=False, indent=indent) if indent else row[0]
            out.write(("," if i else "") + ("\n" if indent else "") + text)
        out.write("\n]" if indent else "]")


def file_format(path: str) -> str:
    """What a file of this name holds: ``text``, ``json`` or the raw ``body``."""
    return {".txt": "text", ".json": "json", ".md": "markdown"}.get(Path(path).suffix.lower(), "body")


def write_page(source: str, path: str) -> None:
    """One page into one local file: ``.txt`` gets the root's direct text, ``.json`` the list of the body's direct texts, others the source."""
    root = tree.parse(source)
    kind = file_format(path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if kind == "json":
        content = json.dumps([value for _, value in select_values(root, "body::text")], ensure_ascii=False)
    else:
        content = "".join(root.texts()) if kind == "text" else source
    Path(path).write_text(content, encoding="utf-8")
