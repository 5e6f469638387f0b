"""JSON by value: strict parsing and a canonical digest that ignores blanks, escapes and member order."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa

from kerbstone.functions import jsontree

_INFINITE = float("inf")


def figures(literal: str) -> tuple[bool, str, int | str]:
    """(negative, digits, exponent) of a number without leading and trailing zeros, so that equal values are equal. Exponents
    of over 4,000 digits are compared as they are spelled."""
    mantissa, _, power = literal.lower().partition("e")
    negative = mantissa.startswith("-")
    whole, _, fraction = mantissa.lstrip("-").partition(".")
    digits = (whole + fraction).lstrip("0")
    if not digits:
        return False, "", 0
    short = digits.rstrip("0")
    if len(power) > 4_000:
        return negative, short, f"{power.lstrip('+')}+{len(digits) - len(short) - len(fraction)}"
    return negative, short, int(power or 0) + len(digits) - len(short) - len(fraction)


def number(literal: str) -> int | float | list:
    """The value of a number: an int or a float where these are exact, else its figures. No JSON text has an infinite number, so the
    list of infinity and figures is nothing else's value."""
    plain = literal.lstrip("-")
    if len(plain) <= 15 and plain.isdecimal():
        return int(literal)
    value = float(literal)
    own = figures(literal)
    if abs(value) != _INFINITE and (len(plain) <= 16 and "e" not in plain and "E" not in plain or figures(repr(value)) == own):
        return int(value) if value.is_integer() and abs(value) < 1e15 else value
    return [_INFINITE, f"{'-' * own[0]}{own[1]}e{own[2]}"]


def _reject(name: str):
    raise ValueError(f"{name} is not a JSON value")


def _planted(text: str):
    """The value of a text nested too deeply for the interpreter, and its canonical form, both without recursion."""
    f = jsontree.parse(pa.array([text], pa.string()))
    if not f.valid[0]:
        raise ValueError("no JSON value")
    values: list = []
    for i, (kind, parent, start, end) in enumerate(zip(f.kind.tolist(), f.parent.tolist(), f.start.tolist(), f.end.tolist(), strict=True)):
        v = {} if kind == jsontree.OBJECT else [] if kind == jsontree.ARRAY else json.loads(f.data[start:end].tobytes(), parse_float=number, parse_int=number)
        values.append(v)
        if parent >= 0:
            if f.kind[parent] == jsontree.OBJECT:
                values[parent][f.names[f.name[i]]] = v
            else:
                values[parent].append(v)
    return values[0]


def parse(text: str):
    """The value of a JSON text of any depth; ValueError for anything the grammar does not allow.

    Of members with the same name the last counts. Numbers compare by value (1, 1.0 and 1e0 are one).
    """
    try:
        return json.loads(text, parse_float=number, parse_int=number, parse_constant=_reject)
    except RecursionError:
        return _planted(text)


def canonical(value) -> str:
    """One spelling for equal values, whatever their depth."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]  # (is already spelled, what)
    while stack:
        spelled, v = stack.pop()
        if spelled:
            out.append(v)
        elif isinstance(v, dict | list):
            members = [(json.dumps(k) + ":", x) for k, x in sorted(v.items())] if isinstance(v, dict) else [("", x) for x in v]
            stack.append((True, "}" if isinstance(v, dict) else "]"))
            for i in range(len(members) - 1, -1, -1):
                stack += [(False, members[i][1]), (True, ("," if i else "") + members[i][0])]
            out.append("{" if isinstance(v, dict) else "[")
        else:
            out.append(json.dumps(v))
    return "".join(out)


def digest(text: str) -> bytes:
    """16 bytes, equal for JSON texts of equal value."""
    return hashlib.blake2b(canonical(parse(text)).encode(), digest_size=16).digest()
