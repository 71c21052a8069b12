"""Reading of almost-JSON: one tolerant pass that always moves forward."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORD = re.compile(r"[^\s,:{}\[\]\"'`]+")
_LITERALS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_DONE = object()


class _Reader:
    """Reads values; brackets left open are closed at the end of the text, quotes of any kind count."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> None:
        while self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text.startswith("//", self.at):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif self.text.startswith("/*", self.at):
                end = self.text.find("*/", self.at)
                self.at = len(self.text) if end < 0 else end + 2
            else:
                return

    def string(self, quote: str) -> str:
        out = []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                break
            if c == "\\" and self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                if c == "u" and re.match(r"[0-9A-Fa-f]{4}", self.text[self.at : self.at + 4]):
                    c = chr(int(self.text[self.at : self.at + 4], 16))
                    self.at += 4
                else:
                    c = _ESCAPES.get(c, c if c in "\"'`\\/\n" else "\\" + c)
            out.append(c)
        return "".join(out)

    def scalar(self):
        c = self.text[self.at]
        if c in "\"'`":
            return self.string(c)
        m = _WORD.match(self.text, self.at)
        if not m:
            self.at += 1
            return _DONE
        self.at = m.end()
        word = m.group()
        if word in _LITERALS:
            return _LITERALS[word]
        if _NUMBER.fullmatch(word):
            return json.loads(word) if not re.match(r"-?0\d", word) else word
        return word

    def value(self):
        """The next value. Containers stand on a stack of their own, so depth is not limited."""
        stack: list[tuple[object, list]] = []  # container, pending key
        while True:
            self.blank()
            if self.at >= len(self.text):
                break
            c = self.text[self.at]
            if c in "{[":
                self.at += 1
                stack.append(({} if c == "{" else [], []))
                continue
            if c in "}]":
                self.at += 1
                done = self._close(stack)
                if not stack:
                    return done
                self._put(stack[-1], done)
                continue
            if c in ",:":
                self.at += 1
                if c == "," and stack and isinstance(stack[-1][0], dict) and stack[-1][1]:
                    self._put(stack[-1], None)
                continue
            found = self.scalar()
            if found is _DONE:
                continue
            if not stack:
                return found
            box, key = stack[-1]
            if isinstance(box, dict) and not key:
                self.blank()
                if self.text.startswith(":", self.at):
                    self.at += 1
                    key.append(str(found))
                continue
            self._put(stack[-1], found)
        done = None
        while stack:
            done = self._close(stack)
            if stack:
                self._put(stack[-1], done)
        return done

    @staticmethod
    def _close(stack):
        box, key = stack.pop()
        if isinstance(box, dict) and key:
            box[key[0]] = None
        return box

    @staticmethod
    def _put(entry, value) -> None:
        box, key = entry
        if isinstance(box, list):
            box.append(value)
        elif key:
            box[key.pop()] = value


def repaired(text: str | None) -> tuple[str | None, str]:
    """The text as valid JSON and its state: valid, repaired or lost.

    Prose and fences around the first object or list are left out, single and back quotes, bare
    words, comments, trailing commas and control characters are read, what is cut off is closed.
    Texts with neither object nor list are lost, as are null and empty ones.
    """
    if not text or not text.strip():
        return None, "lost"
    try:
        json.loads(text)
        return text, "valid"
    except (ValueError, RecursionError):
        pass
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None, "lost"
    try:
        return json.dumps(_Reader(text[start:]).value(), ensure_ascii=False), "repaired"
    except RecursionError:  # deeper than the writer can go
        return None, "lost"


def with_repair(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, json, state`` for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [repaired(t) for t in batch[column]]
            yield pd.DataFrame({key: batch[key], "json": [x[0] for x in out], "state": [x[1] for x in out]})

    return rows.select(key, column).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, json string, state string")
