"""Nested records into linked flat rows (problem 7).

The text of a payload is indexed as whole arrays of bytes. A bitmap of quotes (without escaped ones) gives, by a running
parity, what lies inside strings; bitmaps of brackets, colons and commas outside strings give, by a running sum of +1 and -1,
the nesting depth of every mark. The rest follows from depths: brackets of one depth pair off in their order, so each object
and array is a span; a token belongs to the span that was last opened one depth above it; and the tokens of a span must
alternate as values and commas, or as keys, colons, values and commas, which is checked for all spans at once. Python looks
only at the few members that become rows; what lies in other parts, such as samples, stays a span of bytes.

Defined results: a null, empty, cut-off or otherwise malformed payload gives no rows; a payload whose top is no object
gives none; repeated rows count once; of a repeated key the last counts; null and empty parts give no children; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import need

CHILD_SCHEMA = "record_id string, child string, parent_key string, child_key string"
CHILDREN = ("lead", "lead_annotation", "measurement", "annotation", "metadata")

_QUOTE, _BACK, _COLON, _COMMA = 0x22, 0x5C, 0x3A, 0x2C
_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY = 0x7B, 0x7D, 0x5B, 0x5D
_WORD = 0x77  # stands for numbers, true, false and null
_SCALAR = re.compile(rb"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")

# what a byte may be outside of strings: 1 opens, 2 closes, 3 is a colon or comma, 4 is white space, 0 anything else
_KIND = np.zeros(256, np.int8)
_KIND[[_OPEN_OBJECT, _OPEN_ARRAY]] = 1
_KIND[[_CLOSE_OBJECT, _CLOSE_ARRAY]] = 2
_KIND[[_COLON, _COMMA]] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 4


class Unreadable(ValueError):
    """The text is no complete JSON value."""


def _inside_strings(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of quotes that open or close a string, bitmap of bytes inside strings with their opening quotes)."""
    quote = b == _QUOTE
    back = b == _BACK
    if back.any():
        # a quote is escaped if the run of backslashes before it is odd
        at = np.arange(len(b))
        last = np.maximum.accumulate(np.where(back, -1, at))  # last byte that is no backslash
        run = np.zeros(len(b), np.int64)
        run[1:] = at[:-1] - last[:-1]
        quote &= run % 2 == 0
    return quote, np.cumsum(quote, dtype=np.int64) % 2 == 1


class Index:
    """The tokens of a JSON text (brackets, strings, words, colons, commas) with their spans, depths and holders."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            raise Unreadable("empty")
        quote, inside = _inside_strings(b)
        if inside[-1]:
            raise Unreadable("an open string")
        kind = np.where(inside | quote, 5, _KIND[b])
        bare = kind == 0
        starts = bare.copy()
        starts[1:] &= ~bare[:-1]
        opening = quote & inside
        token = (kind >= 1) & (kind <= 3) | opening | starts
        self.at = np.flatnonzero(token)
        step = (kind == 1).astype(np.int32) - (kind == 2)
        after = np.cumsum(step)[self.at]
        self.code = np.where(starts[self.at], _WORD, b[self.at])
        kinds = kind[self.at]
        # where each token ends: strings at their closing quotes, words at the last byte of their run
        self.end = self.at + 1
        ends = bare.copy()
        ends[:-1] &= ~bare[1:]
        self.end[self.code == _WORD] = np.flatnonzero(ends) + 1
        self.end[self.code == _QUOTE] = np.flatnonzero(quote & ~inside) + 1
        if after[-1] != 0 or after.min() < 0:
            raise Unreadable("brackets do not close")
        self._pair(kinds, after)
        self._check()

    def _pair(self, kinds: np.ndarray, after: np.ndarray) -> None:
        """Spans of containers by depth, and the holder of every token: the container last opened above it, -1 at the top."""
        opens, closes = kinds == 1, kinds == 2
        level = np.where(opens, after - 1, np.where(closes, after, after))  # the depth a token stands at
        brackets = np.flatnonzero(opens | closes)
        inner = np.where(opens, after, after + 1)[brackets]
        paired = brackets[np.argsort(inner, kind="stable")]
        first, second = paired[::2], paired[1::2]
        # a closing bracket has the code of its opening one plus two
        if not (opens[first].all() and closes[second].all() and (self.code[second] == self.code[first] + 2).all()):
            raise Unreadable("brackets do not match")
        self.end[first] = self.end[second]
        # what may hold: opening brackets, at the depth below them; sorted by depth, the last one before a token is its holder
        self.kept = np.flatnonzero(~closes)
        depth = np.concatenate([after[first], level[self.kept]])
        place = np.concatenate([first, self.kept])
        holds = np.concatenate([np.ones(len(first), bool), np.zeros(len(self.kept), bool)])
        order = np.lexsort((~holds, place, depth))
        last = np.maximum.accumulate(np.where(holds[order], np.arange(len(order)), -1))
        found = np.where(last >= 0, place[order][last], -1)
        holder = np.full(len(self.at), -1)
        holder[place[order][~holds[order]]] = found[~holds[order]]
        holder[level == 0] = -1
        self.holder = holder

    def _check(self) -> None:
        """The order of tokens in all containers at once, the spelling of words and the escapes of strings."""
        kept = self.kept
        order = kept[np.argsort(self.holder[kept], kind="stable")]
        holder, code = self.holder[order], self.code[order]
        new = np.ones(len(order), bool)
        new[1:] = holder[1:] != holder[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = np.arange(len(order)) - begin
        last = np.append(new[1:], True)
        value = (code != _COLON) & (code != _COMMA)
        within = np.where(holder >= 0, self.code[holder], 0)
        fits = np.select(
            [within == _OPEN_OBJECT, within == _OPEN_ARRAY],
            [
                np.select([rank % 4 == 0, rank % 4 == 1, rank % 4 == 2], [code == _QUOTE, code == _COLON, value], code == _COMMA) & (~last | (rank % 4 == 2)),
                np.where(rank % 2 == 0, value, code == _COMMA) & (~last | (rank % 2 == 0)),
            ],
            value & (rank == 0),
        )
        if not fits.all() or not (holder < 0).any():
            raise Unreadable("a token out of place")
        words = self.code == _WORD
        for word in {self.raw[a:z] for a, z in zip(self.at[words].tolist(), self.end[words].tolist(), strict=True)}:
            if not _SCALAR.fullmatch(word):
                raise Unreadable(f"unexpected {word[:20]!r}")
        values = order[value & ~((within == _OPEN_OBJECT) & (rank % 4 == 0))]
        # single tokens are looked up from here on
        self._at, self._end, self._code = self.at.tolist(), self.end.tolist(), self.code.tolist()
        self._values, self._holders = values.tolist(), self.holder[values].tolist()
        if b"\\" in self.raw:
            for t in np.flatnonzero(self.code == _QUOTE).tolist():
                self.string(t)

    def string(self, t: int) -> str:
        """The text of a string token."""
        piece = self.raw[self._at[t] + 1 : self._end[t] - 1]
        if b"\\" not in piece:
            return piece.decode("utf-8", "surrogatepass")
        try:
            return json.loads(f'"{piece.decode("utf-8", "surrogatepass")}"', strict=False)
        except ValueError as e:
            raise Unreadable(str(e)) from e

    def text(self, t: int) -> str:
        """The span of a token as it stands."""
        return self.raw[self._at[t] : self._end[t]].decode("utf-8", "surrogatepass")

    def is_object(self, t: int | None) -> bool:
        return t is not None and self._code[t] == _OPEN_OBJECT

    def is_array(self, t: int | None) -> bool:
        return t is not None and self._code[t] == _OPEN_ARRAY

    def is_string(self, t: int | None) -> bool:
        return t is not None and self._code[t] == _QUOTE

    def is_null(self, t: int | None) -> bool:
        return t is None or (self._code[t] == _WORD and self.raw[self._at[t]] == 0x6E)

    def items(self, holder: int) -> list[int]:
        """The values in a container, in order."""
        a = bisect.bisect_left(self._holders, holder)
        return self._values[a : bisect.bisect_right(self._holders, holder, a)]

    def members(self, holder: int) -> dict[str, int]:
        """The members of an object; key and colon are the two tokens before the first of a value."""
        return {self.string(t - 2): t for t in self.items(holder)}

    def scalar(self, t: int) -> str | None:
        """A leaf's value as text; null for null."""
        return self.string(t) if self._code[t] == _QUOTE else None if self.is_null(t) else self.text(t)


def _named(index: Index, t: int | None) -> Iterator[tuple[str, int | None]]:
    """Names and values of an object, or of a list of objects with a name and a value."""
    if index.is_object(t):
        yield from index.members(t).items()
    elif index.is_array(t):
        for item in index.items(t):
            if index.is_object(item):
                pair = index.members(item)
                name = pair.get("name")
                if index.is_string(name):
                    yield index.string(name), pair.get("value")


def _value(index: Index, t: int | None, wanted: bool) -> str | None:
    return None if t is None or not wanted else index.text(t) if index.is_object(t) or index.is_array(t) else index.scalar(t)


def _leaves(index: Index, top: int, values: bool) -> Iterator[tuple[str, str, str | None]]:
    """(path of the holder, path, value) of all leaves under a container, without recursion, so depth is unbounded."""
    todo = [(top, "", True)]
    while todo:
        holder, path, at_top = todo.pop()
        steps = index.members(holder).items() if index.is_object(holder) else ((str(k), t) for k, t in enumerate(index.items(holder)))
        for step, t in steps:
            own = step if at_top else f"{path}/{step}"
            if index.is_object(t) or index.is_array(t):
                todo.append((t, own, False))
            else:
                yield path, own, index.scalar(t) if values else None


def children(text: str | None, values: bool = True) -> list[tuple[str, str, str, str | None]]:
    """(child, parent_key, child_key, value) of one payload; all values are null where they are not wanted."""
    if not text:
        return []
    try:
        index = Index(text.encode("utf-8", "surrogatepass"))
    except Unreadable:
        return []
    top = index.items(-1)[0]
    if not index.is_object(top):
        return []
    parts = index.members(top)
    out: list[tuple[str, str, str, str | None]] = []
    leads = parts.get("leads")
    rows = [leads] if index.is_object(leads) else index.items(leads) if index.is_array(leads) else []
    for k, lead in enumerate(rows):
        out.append(("lead", "", str(k), _value(index, lead, values)))
        if index.is_object(lead):
            out += [("lead_annotation", str(k), name, _value(index, t, values)) for name, t in _named(index, index.members(lead).get("annotations"))]
    out += [("measurement", "", name, _value(index, t, values)) for name, t in _named(index, parts.get("measurements")) if not index.is_null(t)]
    out += [("annotation", "", name, _value(index, t, values)) for name, t in _named(index, parts.get("annotations"))]
    meta = parts.get("raw_metadata")
    if index.is_string(meta):
        try:
            index = Index(index.string(meta).encode("utf-8", "surrogatepass"))
            meta = index.items(-1)[0]
        except Unreadable:
            meta = None
    if index.is_object(meta) or index.is_array(meta):
        out += [("metadata", *leaf) for leaf in _leaves(index, meta, values)]
    return list({row[:3]: row for row in out}.values())


def flatten_payloads(payloads: DataFrame, values: bool = False) -> DataFrame:
    """(record_id, child, parent_key, child_key): the children of all readable payloads, distinct; with ``values``, also ``value``.

    A value is the text of a scalar, null for null, and JSON text of anything else, such as a lead. One narrow pass over the
    payloads, whose texts are never shuffled; the distinct at the end takes out what re-sent payloads repeat, after a partial
    one in each task.
    """
    columns = ["record_id", "child", "parent_key", "child_key", *(["value"] if values else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, *c[: len(columns) - 1]) for r, p in zip(batch.record_id, batch.payload, strict=True) for c in children(p, values)]
            yield pd.DataFrame(rows, columns=columns)

    schema = CHILD_SCHEMA + (", value string" if values else "")
    return need(payloads, "record_id", "payload").where("payload IS NOT NULL").mapInPandas(run, schema).distinct()


def related_tables(payloads: DataFrame) -> dict[str, DataFrame]:
    """The children as one flat table each, with a key of its own and the key of its parent.

    ``lead`` (record_id, lead_no, body: JSON text), ``lead_annotation`` (record_id, lead_no, name, value), ``measurement`` and
    ``annotation`` (record_id, name, value), ``metadata`` (record_id, parent_path, path, value).
    """
    rows = flatten_payloads(payloads, True)
    part = lambda child, **names: rows.where(F.col("child") == child).select("record_id", *[F.col(c).cast("int" if n == "lead_no" else "string").alias(n) for n, c in names.items()])
    return {
        "lead": part("lead", lead_no="child_key", body="value"), "lead_annotation": part("lead_annotation", lead_no="parent_key", name="child_key", value="value"),
        "measurement": part("measurement", name="child_key", value="value"), "annotation": part("annotation", name="child_key", value="value"), "metadata": part("metadata", parent_path="parent_key", path="child_key", value="value"),
    }
