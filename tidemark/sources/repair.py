"""Visible repair of broken JSON and CSV texts: each fix is listed with its place in bytes, and what could only be guessed at is
an error with a place instead. Texts are repaired by the batch, next to each other on the executors; a text that is sound
comes back as it is."""

from __future__ import annotations

import csv
import io
import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 128
_REPAIRS = T.ArrayType(T.StructType([T.StructField("position", T.LongType()), T.StructField("what", T.StringType())]))


def _result(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()), T.StructField("repairs", _REPAIRS), T.StructField("error", T.StringType())])


_SKIP = re.compile(r"[ \t\n\r]+|(?P<comment>//[^\n]*|/\*(?:.*?\*/|.*\Z))", re.S)
_PLAIN = re.compile(r"[^\"'\\\x00-\x1f]+")
_WORD = re.compile(r"[A-Za-z0-9_$.-]+")
_NUMERIC = re.compile(r"[0-9+.eE-]*")
_STRICT = re.compile(r"-?(?:0|[1-9][0-9]*)(?P<real>\.[0-9]+)?(?P<power>[eE][+-]?[0-9]+)?")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: literal -> value, and what is noted of it
_LITERALS: dict[str, tuple[Any, str | None]] = {
    "true": (True, None), "false": (False, None), "null": (None, None), "True": (True, "boolean in lower case"), "False": (False, "boolean in lower case"),
    "None": (None, "null for another word"), "undefined": (None, "null for another word"), "NaN": (None, "null for a number that is not finite"), "Infinity": (None, "null for a number that is not finite"),
}


class Hopeless(ValueError):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


class _Text:
    """One broken JSON text. Containers stay on a stack with the key that waits for its value; the text is walked once."""

    def __init__(self, text: str):
        self.text, self.at, self.notes = text, 0, []

    def note(self, at: int, what: str) -> None:
        self.notes.append((at, what))

    def next(self) -> str:
        """The character after white space and comments; none at the end."""
        while m := _SKIP.match(self.text, self.at):
            if m["comment"] is not None:
                self.note(self.at, "comment removed")
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def value(self) -> Any:
        if self.text.startswith("﻿"):
            self.note(0, "byte order mark removed")
            self.at = 1
        if not self.next():
            raise Hopeless(self.at, "nothing to repair")
        stack: list[list] = []  # container, key, where the key stood
        done, result = False, None
        while not done:
            if stack and not self._entry(stack[-1]):
                result = stack.pop()[0]
            else:
                c = self.next()
                if c and c in "{[":
                    if len(stack) > DEPTH:
                        raise Hopeless(self.at, f"nested more than {DEPTH} deep")
                    self.at += 1
                    stack.append([{} if c == "{" else [], None, 0])
                    continue
                result = self._scalar(c)
            if stack:
                self._put(stack[-1], result)
            else:
                done = True
        if self.next():
            raise Hopeless(self.at, "more text after the end of the value")
        return result

    def _entry(self, frame: list) -> bool:
        """Steps to the next entry of a container, past its key; false where it ends."""
        held = frame[0]
        kind, closing = ("object", "}") if isinstance(held, dict) else ("array", "]")
        while (c := self.next()) == ",":  # the one that belongs to an entry went with it
            self.note(self.at, f"{'stray' if held else 'leading'} comma removed from {kind}")
            self.at += 1
        if c in ("", closing):
            if not c:
                self.note(self.at, f"{kind} closed at the end")
            self.at += len(c)
            return False
        if kind == "object":
            frame[2] = self.at
            if c in "\"'":
                frame[1] = self._string()
            elif m := _WORD.match(self.text, self.at):
                self.note(self.at, "key put in quotes")
                frame[1], self.at = m[0], m.end()
            else:
                raise Hopeless(self.at, f"no key: {c!r}")
            c = self.next()
            if c != ":":
                self.note(self.at, "colon for an equals sign" if c == "=" else "colon added")
            self.at += c in (":", "=")
        return True

    def _put(self, frame: list, value: Any) -> None:
        held, key, at = frame
        if isinstance(held, list):
            held.append(value)
        else:
            if key in held:
                self.note(at, "a later value of the same key taken")
            held[key] = value
        c, closing = self.next(), "}" if isinstance(held, dict) else "]"
        if c == ",":
            comma, self.at = self.at, self.at + 1
            if self.next() in ("", closing):
                self.note(comma, f"trailing comma removed from {'object' if isinstance(held, dict) else 'array'}")
        elif c not in ("", closing):
            self.note(self.at, "comma added")

    def _scalar(self, c: str) -> Any:
        if not c:
            raise Hopeless(self.at, "the text ends where a value is due")
        if c in "\"'":
            return self._string()
        return self._number() if c in "+-.0123456789" else self._literal()

    def _string(self) -> str:
        quote, out = self.text[self.at], []
        if quote == "'":
            self.note(self.at, "double quotes for single ones")
        self.at += 1
        while True:
            if m := _PLAIN.match(self.text, self.at):
                out.append(m[0])
                self.at = m.end()
            c = self.text[self.at : self.at + 1]
            if c == "\\":
                if not self._escape(out):
                    return "".join(out)
                continue
            if c in ("", "\n"):
                self.note(self.at, "string closed at the end" + " of its line" * bool(c))
                return "".join(out)
            self.at += 1
            if c == quote:
                return "".join(out)
            if c < " ":
                self.note(self.at - 1, "control character escaped")
            out.append(c)

    def _escape(self, out: list[str]) -> bool:
        """Steps over an escape; false where the text ends in it."""
        c = self.text[self.at + 1 : self.at + 2]
        self.at += 1 + len(c)
        if c == "u":
            code = self._code(self.at)
            self.at += 4
            if 0xD800 <= code < 0xDC00 and self.text.startswith("\\u", self.at) and 0xDC00 <= (low := self._code(self.at + 2)) < 0xE000:
                code, self.at = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00, self.at + 6
            if 0xD800 <= code < 0xE000:
                raise Hopeless(self.at - 4, "half a surrogate pair")
            out.append(chr(code))
        elif c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif c:
            self.note(self.at - 1, "escape of a plain character dropped")
            out.append(c)
        else:
            self.note(self.at, "backslash at the end dropped")
        return bool(c)

    def _code(self, at: int) -> int:
        if not re.fullmatch("[0-9A-Fa-f]{4}", digits := self.text[at : at + 4]):
            raise Hopeless(at, f"no character code: {digits!r}")
        return int(digits, 16)

    def _number(self) -> Any:
        at = self.at
        if self.text[at] == "+":
            self.note(at, "plus sign removed")
            self.at += 1
        begin, m = self.at, _NUMERIC.match(self.text, self.at)
        self.at = m.end()
        if m[0] == "-" and self.text.startswith("Infinity", self.at):
            self.at += len("Infinity")
            self.note(at, "null for a number that is not finite")
            return None
        strict = _STRICT.fullmatch(m[0])
        if strict and not strict["real"] and not strict["power"]:
            return int(m[0])
        try:
            number = float(m[0])
        except ValueError:
            raise Hopeless(begin, f"no number: {m[0]!r}") from None
        if not math.isfinite(number):
            raise Hopeless(begin, f"too large a number: {m[0]!r}")
        if not strict:
            self.note(begin, "number written as usual")
        return number

    def _literal(self) -> Any:
        m = _WORD.match(self.text, self.at)
        if not m or m[0] not in _LITERALS:
            raise Hopeless(self.at, f"unknown word: {m[0] if m else self.text[self.at]!r}")
        value, what = _LITERALS[m[0]]
        if what:
            self.note(self.at, what)
        self.at = m.end()
        return value


def _placed(text: str, notes: list[tuple[int, str]]) -> list[dict]:
    """Notes with places in bytes."""
    if text.isascii():
        return [{"position": at, "what": what} for at, what in notes]
    where, done, size = {}, 0, 0
    for at in sorted({at for at, _ in notes}):
        size += len(text[done:at].encode("utf-8", "surrogatepass"))
        where[at] = done = at
        where[at] = size
    return [{"position": where[at], "what": what} for at, what in notes]


def repaired(text: str) -> tuple[str | None, list[dict], str | None]:
    """(JSON, repairs, error) of one text."""
    reader = _Text(text)
    try:
        value = reader.value()
    except Hopeless as e:
        return None, [], f"INVALID_INPUT: {e.why} at byte {_placed(text, [(e.at, '')])[0]['position']}"
    if not reader.notes:
        try:
            json.loads(text)
            return text, [], None
        except ValueError:
            reader.note(0, "written anew")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), _placed(text, reader.notes), None


def _frame(name: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[name, "repairs", "error"], dtype=object)


@F.pandas_udf(_result("json"))
def _repair_json(texts: pd.Series) -> pd.DataFrame:
    return _frame("json", [(None, None, None) if t is None else repaired(t) for t in texts])


def repair_json(text: Column) -> Column:
    """Struct (json, repairs, error): sound JSON, with the repairs (position in bytes, what) that made it so, in order; or an
    error that names a place. A sound text comes back unchanged and without repairs; of a null all three are null."""
    return _repair_json(text)


def repaired_csv(text: str) -> tuple[str | None, list[dict], str | None]:
    """(CSV, repairs, error) of one document: rows shorter than the header are filled up, longer ones are an error."""
    notes, body = [], text
    if text.startswith("﻿"):
        notes.append({"position": 0, "what": "byte order mark removed"})
        body = text[1:]
    starts = [len(text.encode()) - len(body.encode())]
    for line in io.StringIO(body, newline=""):
        starts.append(starts[-1] + len(line.encode()))
    out = io.StringIO()
    writer, reader = csv.writer(out, lineterminator="\n"), csv.reader(io.StringIO(body, newline=""))
    width, number, line = 0, 0, 0
    try:
        for row in reader:
            at, line = starts[min(line, len(starts) - 1)], reader.line_num
            if not row:
                continue
            number += 1
            if not width:
                width = len(row)
            elif len(row) > width:
                return None, [], f"INVALID_INPUT: row {number} has {len(row)} fields, the header {width}"
            elif len(row) < width:
                notes.append({"position": at, "what": f"row {number} filled up from {len(row)} to {width} fields"})
                row = row + [""] * (width - len(row))
            writer.writerow(row)
    except csv.Error as e:
        return None, [], f"INVALID_INPUT: row {number + 1}: {e}"
    if not width:
        return None, [], "INVALID_INPUT: no header row"
    return out.getvalue(), notes, None


@F.pandas_udf(_result("csv"))
def _repair_csv(texts: pd.Series) -> pd.DataFrame:
    return _frame("csv", [(None, None, None) if t is None else repaired_csv(t) for t in texts])


def repair_csv(text: Column) -> Column:
    """Struct (csv, repairs, error) of whole CSV documents, header first: a byte order mark goes, short rows are filled up, blank
    lines go, quotes are as needed. Rows are numbered from the header, 1."""
    return _repair_csv(text)


def repair_row(fields: Column, width: int, number: Column) -> Column:
    """A CSV row's fields padded to ``width``; a row that is too long fails with its number (the header is row 1)."""
    padded = F.slice(F.concat(fields, F.array_repeat(F.lit(""), width)), 1, width)
    return F.when(F.size(fields) > width, F.raise_error(F.concat(F.lit("INVALID_INPUT: too many fields in row "), number.cast("string")))).otherwise(padded)
