"""Configuration and calibration files as nested values and one-row tables."""

from __future__ import annotations

import json
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _scalar(text: str) -> Any:
    text = text.split(" #")[0].strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in _items(text[1:-1])]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _items(text: str) -> list[str]:
    out, depth, last = [], 0, ""
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append(last)
            last = ""
        else:
            last += c
    return [*out, last] if last.strip() else out


def parse_simple_yaml(text: str) -> Any:
    """The part of YAML that configurations use: nested maps and lists by indentation, flow lists, scalars, comments.

    Directive lines (``%YAML:1.0``) and document marks are skipped. What lies outside this part isn't understood.
    """
    lines = []
    for raw in text.splitlines():
        body = raw.rstrip()
        if body.strip() and not body.lstrip().startswith("#") and body.strip() not in ("---", "...") and not body.startswith("%"):
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(i: int, indent: int) -> tuple[Any, int]:
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            seq: list = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if ":" in rest and rest[:1] not in "\"'[" and (rest.endswith(":") or ": " in rest):
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 2)
                elif rest:
                    value, i = _scalar(rest), i + 1
                else:
                    value, i = block(i + 1, lines[i + 1][0])
                seq.append(value)
            return seq, i
        out: dict = {}
        while i < len(lines) and lines[i][0] == indent:
            key, _, rest = lines[i][1].partition(":")
            if rest.strip() and not rest.strip().startswith("#"):
                out[_scalar(key)], i = _scalar(rest), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1].startswith("-")):
                out[_scalar(key)], i = block(i + 1, lines[i + 1][0])
            else:
                out[_scalar(key)], i = None, i + 1
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def namespace(tree: Any) -> Any:
    """Nested maps as attributes."""
    if isinstance(tree, dict):
        return SimpleNamespace(**{str(k): namespace(v) for k, v in tree.items()})
    return [namespace(x) for x in tree] if isinstance(tree, list) else tree


def config_row(spark: SparkSession, text: str) -> DataFrame:
    """A configuration as one row of JSON by top-level key: ``key, js``; small, so Spark may broadcast it."""
    return spark.createDataFrame([(str(k), json.dumps(v)) for k, v in parse_simple_yaml(text).items()], "key string, js string")
