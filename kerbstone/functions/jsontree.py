"""JSON texts of an Arrow array as flat arrays of their values, without recursion and without a Python step per value.

The bytes of all texts are classified by table lookups. Tokens are sorted by nesting level, which puts each array or
object together with its direct members, so the grammar is a check of neighbours, and parents, ordinals and names fall out of the
same order. Texts may be nested to any depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer text is looked at alone, whole.
PIECE_BYTES = 1 << 19

OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL = range(6)
KINDS = np.array(["object", "array", "string", "number", "boolean", "null"])

_SCALAR, _LBRACE, _RBRACE, _LBRACKET, _RBRACKET, _COMMA, _COLON, _QUOTED = range(1, 9)
_CLASS = np.full(256, _SCALAR, np.uint8)
_CLASS[np.frombuffer(b' \t\r\n"', np.uint8)] = 0
_CLASS[np.frombuffer(b"{}[],:", np.uint8)] = [_LBRACE, _RBRACE, _LBRACKET, _RBRACKET, _COMMA, _COLON]
_ESCAPES = np.isin(np.arange(256), np.frombuffer(b'"\\/bfnrtu', np.uint8))
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefABCDEF", np.uint8))
_LITERAL = r"^(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)$"

# what an entry of a container may be, and which may follow which in an array and in an object
_START, _CLOSE, _SEPARATOR, _PAIR, _VALUE, _NAME = range(6)
_FOLLOWS = np.zeros((2, 6, 6), bool)
for _p, _c in ((_START, _VALUE), (_START, _CLOSE), (_VALUE, _SEPARATOR), (_VALUE, _CLOSE), (_SEPARATOR, _VALUE)):
    _FOLLOWS[0, _p, _c] = True
for _p, _c in ((_START, _NAME), (_START, _CLOSE), (_NAME, _PAIR), (_PAIR, _VALUE), (_VALUE, _SEPARATOR), (_VALUE, _CLOSE), (_SEPARATOR, _NAME)):
    _FOLLOWS[1, _p, _c] = True


@dataclass(frozen=True)
class Forest:
    """The values of the valid texts in document order. ``parent`` is a row, -1 for a root; ``name`` an index into ``names``,
    -1 for roots and array elements; ``start`` and ``end`` are bytes of ``data``."""

    valid: np.ndarray
    text: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    ordinal: np.ndarray
    kind: np.ndarray
    name: np.ndarray
    names: list[str]
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.text)

    def members(self, kind: int | None = None) -> np.ndarray:
        """How many members, of a kind, each value has."""
        own = self.parent >= 0 if kind is None else (self.parent >= 0) & (self.kind == kind)
        return np.bincount(self.parent[own], minlength=len(self))

    def spelled(self, rows: np.ndarray) -> pa.Array:
        """The bytes of scalars as stored; strings without their quotes, escapes resolved."""
        quoted = (self.kind[rows] == STRING).astype(np.int64)
        raw = gather(self.data, self.start[rows] + quoted, self.end[rows] - quoted)
        escaped = pc.and_(pc.match_substring(raw, "\\"), pa.array(quoted.astype(bool)))
        if not pc.any(escaped).as_py():
            return raw
        values = raw.to_pylist()
        for i in np.nonzero(escaped.to_numpy(zero_copy_only=False))[0].tolist():
            values[i] = unescape(values[i])
        return pa.array(values, pa.string())

    def levels(self) -> Iterator[np.ndarray]:
        """The rows of each level, from the roots down, in document order."""
        if len(self):
            order = np.argsort(self.level, kind="stable")
            yield from np.split(order, np.nonzero(np.diff(self.level[order]))[0] + 1)

    def take(self, keep: np.ndarray) -> Forest:
        """The forest without the other rows, of which no kept one may be a descendant."""
        at = np.cumsum(keep) - 1
        parent = self.parent[keep]
        return replace(self, text=self.text[keep], parent=np.where(parent >= 0, at[parent], -1), level=self.level[keep], ordinal=self.ordinal[keep], kind=self.kind[keep], name=self.name[keep], start=self.start[keep], end=self.end[keep])


def unescape(body: str) -> str:
    """A string from what stands between its quotes; half a surrogate pair, which has no UTF-8 form, becomes a question mark."""
    return json.loads(f'"{body}"').encode("utf-8", "replace").decode()


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of bytes as an Arrow array of strings."""
    size = end - start
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    body = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(body)]).cast(pa.string())


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of bounded size."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + PIECE_BYTES, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def parse(texts: pa.Array) -> Forest:
    """All values of all texts that are valid JSON. Null and empty texts are not. Of members with the same name the last counts."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    n = len(texts)
    bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    bad = np.zeros(n, bool)
    text_of = lambda at: np.searchsorted(bounds, at, side="right") - 1

    # strings lie between quotes that no odd run of backslashes leads to
    slash = np.nonzero(data == 0x5C)[0]
    first = np.diff(slash, prepend=-2) != 1
    escaped = slash[(slash - np.maximum.accumulate(np.where(first, slash, 0))) % 2 == 0] + 1
    quote = data == 0x22
    quote[escaped] = False
    quote = np.nonzero(quote)[0]
    bad |= np.bincount(text_of(quote), minlength=n)[:n] % 2 == 1 if len(quote) else False
    quote = quote[~bad[text_of(quote)]]
    opening, closing = quote[::2], quote[1::2]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[opening] = 1
    edge[closing] = -1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    bad[text_of(np.nonzero(inside & (data < 0x20))[0])] = True
    escaped = escaped[inside[np.minimum(escaped, len(data) - 1)]] if len(data) else escaped
    bad[text_of(escaped[~_ESCAPES[data[escaped]]])] = True
    unicode = escaped[data[escaped] == 0x75]
    for k in range(1, 5):
        bad[text_of(unicode[~_HEX[data[np.minimum(unicode + k, len(data) - 1)]]])] = True

    kind = _CLASS[data]
    kind[inside] = 0
    kind[opening] = _QUOTED
    scalar = kind == _SCALAR
    before = np.concatenate([[False], scalar[:-1]]) if len(data) else scalar
    kind[scalar & before] = 0
    token = np.nonzero(kind)[0]
    kind = kind[token]
    end = token + 1
    end[kind == _QUOTED] = closing + 1
    end[kind == _SCALAR] = np.nonzero(scalar & ~np.concatenate([scalar[1:], [False]]))[0] + 1 if len(data) else 0
    text = text_of(token)

    # nesting, counted within each text
    step = ((kind == _LBRACE) | (kind == _LBRACKET)).astype(np.int64) - ((kind == _RBRACE) | (kind == _RBRACKET))
    depth = np.cumsum(step)
    head = np.nonzero(np.diff(text, prepend=-1))[0]
    depth -= np.repeat(depth[head] - step[head], np.diff(head, append=len(text)))
    if len(head):
        owner = text[head]
        bad[owner[np.minimum.reduceat(depth, head) < 0]] = True
        bad[owner[depth[np.append(head[1:], len(text)) - 1] != 0]] = True
    keep = ~bad[text]
    token, kind, end, text, depth, step = token[keep], kind[keep], end[keep], text[keep], depth[keep], step[keep]

    # every token once, an opening bracket also as a value of what it stands in; then level by level
    opens = step > 0
    entry = np.repeat(np.arange(len(token)), 1 + opens)
    twin = np.concatenate([[False], entry[1:] == entry[:-1]]) if len(entry) else np.zeros(0, bool)
    level = depth[entry] - (opens[entry] & ~twin) + (step[entry] < 0)
    code = np.select([twin, step[entry] < 0, kind[entry] == _COMMA, kind[entry] == _COLON], [_START, _CLOSE, _SEPARATOR, _PAIR], _VALUE)
    root = level == 0
    wrong = np.bincount(text[entry[root]], weights=np.where(code[root] == _VALUE, 1, 2), minlength=n) != 1
    order = np.argsort(level.astype(np.int16) if len(level) == 0 or level.max() < 1 << 15 else level, kind="stable")
    order = order[np.searchsorted(level[order], 1) :]
    e, c = entry[order], code[order]
    start_at = np.maximum.accumulate(np.where(c == _START, np.arange(len(c)), 0))
    container = e[start_at] if len(e) else e
    braces = (kind[container] == _LBRACE).astype(np.int64)
    previous = np.concatenate([[_START], c[:-1]]) if len(c) else c
    names = (c == _VALUE) & (kind[e] == _QUOTED) & (braces == 1) & ((previous == _START) | (previous == _SEPARATOR))
    c = np.where(names, _NAME, c)
    previous = np.concatenate([[_START], c[:-1]]) if len(c) else c
    broken = (c != _START) & ~_FOLLOWS[braces, previous, c] | (c == _CLOSE) & (kind[e] != kind[container] + 1)
    wrong[text[e[broken]]] = True
    wrong |= bad

    # scalars that are no literal
    plain = np.nonzero(kind == _SCALAR)[0]
    spelled = gather(data, token[plain], end[plain]).dictionary_encode()
    right = pc.match_substring_regex(spelled.dictionary, _LITERAL).to_numpy(zero_copy_only=False)
    codes = spelled.indices.to_numpy()
    wrong[text[plain[~right[codes]]]] = True

    good = ~wrong[text[e]]
    commas = np.cumsum(c == _SEPARATOR)
    value = np.nonzero((c == _VALUE) & good)[0]
    where_ = np.concatenate([e[value], (roots := entry[root & ~wrong[text[entry]]])])
    parent = np.concatenate([container[value], np.full(len(roots), -1)])
    ordinal = np.concatenate([commas[value] - commas[start_at[value]] if len(value) else value, np.zeros(len(roots), np.int64)])
    named = np.concatenate([np.where(braces[value] == 1, e[value - 2], -1) if len(value) else value, np.full(len(roots), -1)])
    closes = np.nonzero((c == _CLOSE) & good)[0]
    end[container[closes]] = token[e[closes]] + 1
    nested = np.concatenate([level[order][value], np.zeros(len(roots), np.int64)])
    sort = np.argsort(where_, kind="stable")
    where_, parent, ordinal, named, nested = where_[sort], parent[sort], ordinal[sort], named[sort], nested[sort]
    row = np.full(len(token) + 1, -1)
    row[where_] = np.arange(len(where_))
    lead = data[token[where_]] if len(where_) else np.zeros(0, np.uint8)
    k = np.select([kind[where_] == _LBRACE, kind[where_] == _LBRACKET, kind[where_] == _QUOTED, np.isin(lead, (0x74, 0x66)), lead == 0x6E], [OBJECT, ARRAY, STRING, BOOLEAN, NULL], NUMBER)
    key = named[named >= 0]
    own = gather(data, token[key] + 1, end[key] - 1).dictionary_encode()
    distinct: dict[str, int] = {}
    numbers = np.array([distinct.setdefault(unescape(s) if "\\" in s else s, len(distinct)) for s in own.dictionary.to_pylist()], np.int64)
    name = np.full(len(where_), -1)
    if len(key):
        name[named >= 0] = numbers[own.indices.to_numpy()]
    forest = Forest(~wrong, text[where_], np.where(parent >= 0, row[parent], -1), nested, ordinal, k, name, list(distinct), token[where_], end[where_], data)
    return _without_repeats(forest)


def _without_repeats(f: Forest) -> Forest:
    """Of members of one object with the same name only the last stays, with its ordinal."""
    rows = np.nonzero(f.name >= 0)[0]
    same = f.parent[rows] * len(f.names) + f.name[rows]
    order = np.argsort(same, kind="stable")
    earlier = rows[order[:-1][same[order][:-1] == same[order][1:]]]
    if not len(earlier):
        return f
    gone = np.zeros(len(f), bool)
    gone[earlier] = True
    for level in f.levels():
        up = f.parent[level]
        gone[level] |= (up >= 0) & gone[np.maximum(up, 0)]
    return f.take(~gone)
