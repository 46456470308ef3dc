"""Rendering of log messages: brace formats and printf formats over captured values.

Arguments are Python values: int, float, str, bytes, bool, None, or `Int` for an integer with a
captured width. What can't be rendered becomes `{?}`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

UNKNOWN = "{?}"
#: Largest width and precision.
LIMIT = 65536


@dataclass(frozen=True)
class Int:
    """An integer captured with a width in bits."""

    value: int
    bits: int = 64
    signed: bool = True


@dataclass(frozen=True)
class Locale:
    """Punctuation of the L option: group sizes from the right, the last repeating."""

    grouping: tuple[int, ...] = ()
    separator: str = ","
    point: str = "."
    true: str = "true"
    false: str = "false"


class Unsupported(Exception):
    pass


# --- shared ------------------------------------------------------------------------------------


# First and last of the ranges of characters that count as wide whatever Unicode says.
WIDE = ((0x4DC0, 0x4DFF), (0x1F300, 0x1F5FF), (0x1F900, 0x1F9FF))


def char_width(ch: str) -> int:
    """Estimated columns of a character: 2 for wide ones, else 1."""
    if any(a <= ord(ch) <= b for a, b in WIDE):
        return 2
    return 2 if unicodedata.east_asian_width(ch) in "WF" else 1


def clusters(text: str) -> list[str]:
    """Characters with the combining marks and joiners that follow them."""
    out: list[str] = []
    for ch in text:
        joins = unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Me", "Mc") or ch in "\u200d\ufe0f"
        if out and (joins or out[-1].endswith("\u200d")):
            out[-1] += ch
        else:
            out.append(ch)
    return out


def text_width(text: str) -> int:
    return len(text) if text.isascii() else sum(char_width(c[0]) for c in clusters(text))


def clip(text: str, columns: int) -> str:
    """As many leading clusters as fit into a number of columns."""
    used, out = 0, []
    for c in clusters(text):
        used += char_width(c[0])
        if used > columns:
            break
        out.append(c)
    return "".join(out)


def group_digits(digits: str, locale: Locale) -> str:
    """Thousands separators by the locale's group sizes; a size outside 1..126 ends grouping."""
    out, k, sizes = [], 0, locale.grouping
    while digits and sizes:
        size = sizes[min(k, len(sizes) - 1)]
        if not 0 < size < 127 or len(digits) <= size:
            break
        out.append(digits[-size:])
        digits, k = digits[:-size], k + 1
    return locale.separator.join([digits, *reversed(out)]) if out else digits


def shortest(x: float) -> str:
    """The shortest digits that read back as x, plain or with an exponent, whichever is shorter."""
    if math.isnan(x) or math.isinf(x):
        return "nan" if math.isnan(x) else "inf"
    sign, digits, exp = Decimal(repr(abs(x))).normalize().as_tuple()
    del sign
    d = "".join(map(str, digits)) or "0"
    if x == 0:
        return "0"
    point = len(d) + exp
    plain = d + "0" * exp if exp >= 0 else d[:point] + "." + d[point:] if point > 0 else "0." + "0" * -point + d
    e = point - 1
    scientific = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'-' if e < 0 else '+'}{abs(e):02d}"
    return plain if len(plain) <= len(scientific) else scientific


def hex_float(x: float, precision: int | None) -> str:
    """Hexadecimal digits of a finite value without sign and prefix, e.g. 1.4p+0."""
    if x == 0:
        return "0" + ("." + "0" * precision if precision else "") + "p+0"
    m, e = math.frexp(abs(x))
    n, e = int(m * (1 << 53)), e - 1
    frac = n - (1 << 52)
    digits = 13
    if precision is not None and precision < 13:
        drop = 4 * (13 - precision)
        whole, rest = divmod(n, 1 << drop)
        half = 1 << (drop - 1)
        whole += rest > half or rest == half and whole & 1
        lead, frac = divmod(whole, 1 << (4 * precision))
        digits = precision
    else:
        lead = 1
    body = f"{frac:0{digits}x}" if digits else ""
    body = body.rstrip("0") if precision is None else body.ljust(precision, "0")
    return f"{lead}{'.' + body if body else ''}p{e:+d}"


def float_digits(x: float, kind: str, precision: int | None, alternate: bool) -> str:
    """Digits of |x| in presentation kind (one of fFeEgGaA)."""
    if math.isnan(x) or math.isinf(x):
        out = "nan" if math.isnan(x) else "inf"
    elif kind in "aA":
        out = hex_float(x, precision)
    else:
        out = format(abs(x), f"{'#' if alternate else ''}.{6 if precision is None else precision}{kind.lower()}")
    return out.upper() if kind.isupper() else out


def is_negative(x: float) -> bool:
    return math.copysign(1.0, x) < 0


def padded(body: str, width: int, align: str, fill: str, columns: int | None = None) -> str:
    room = width - (text_width(body) if columns is None else columns)
    if room <= 0:
        return body
    left = {"<": 0, ">": room, "^": room // 2}[align]
    return fill * left + body + fill * (room - left)


# --- brace formats -----------------------------------------------------------------------------

_SPEC = re.compile(
    r"(?:(?P<fill>[^{}])?(?P<align>[<>^]))?(?P<sign>[-+ ])?(?P<alt>#)?(?P<zero>0)?(?P<width>[1-9]\d*)?(?:\.(?P<prec>\d+))?(?P<local>L)?(?P<kind>[a-zA-Z])?", re.DOTALL
)
_FIELD = re.compile(r"\{\{|\}\}|\{")


@lru_cache(maxsize=4096)
def _parse_brace(fmt: str) -> tuple:
    """Literal text, and places as (index or None, spec match fields) or None for a bad one."""
    out, at = [], 0
    for m in iter(lambda: _FIELD.search(fmt, at), None):
        out.append(fmt[at : m.start()])
        if m[0] != "{":
            out.append(m[0][0])
            at = m.end()
            continue
        close = fmt.find("}", m.end())
        if close < 0:
            out.append(fmt[m.start() :])
            return tuple(out)
        name, _, spec = fmt[m.end() : close].partition(":")
        s = _SPEC.fullmatch(spec)
        index = None if name == "" else int(name) if name.isdigit() and len(name) < 6 else -1
        out.append((index, tuple(sorted(s.groupdict().items()))) if s and index != -1 else None)
        at = close + 1
    out.append(fmt[at:])
    return tuple(out)


def _brace_value(v, s: dict, locale: Locale) -> str:
    width, prec = int(s["width"] or 0), None if s["prec"] is None else int(s["prec"])
    if width > LIMIT or (prec or 0) > LIMIT:
        raise Unsupported
    kind, fill = s["kind"], s["fill"] or " "
    punctuation = locale if s["local"] else Locale()
    if isinstance(v, Int):
        v = v.value
    if isinstance(v, bytes | bytearray):
        v = bytes(v).hex()
    if isinstance(v, bool):
        if kind in (None, "s"):
            v = (punctuation.true if v else punctuation.false) if s["local"] else str(v).lower()
        else:
            v = int(v)
    if v is None:
        raise Unsupported
    if isinstance(v, str):
        if kind not in (None, "s") or s["sign"] or s["alt"] or s["zero"]:
            raise Unsupported
        return padded(v if prec is None else clip(v, prec), width, s["align"] or "<", fill)
    prefix = ""
    if isinstance(v, int):
        if prec is not None:
            raise Unsupported
        if kind == "c":
            if s["sign"] or s["alt"] or s["zero"] or not -128 <= v <= 255:
                raise Unsupported
            return padded(bytes([v % 256]).decode("utf-8", "surrogateescape"), width, s["align"] or "<", fill)
        if kind not in (None, *"dxXobB"):
            if kind in tuple("eEfFgGaA"):
                raise Unsupported
            raise Unsupported
        negative = v < 0
        body = format(abs(v), {None: "d", "B": "b"}.get(kind, kind))
        if s["alt"]:
            prefix = {"x": "0x", "X": "0X", "b": "0b", "B": "0B"}.get(kind, "0" if kind == "o" and v else "")
        if s["local"]:
            body = group_digits(body, punctuation)
    elif isinstance(v, float):
        negative = is_negative(v)
        if kind is None and prec is None:
            body = shortest(v)
            if s["alt"] and body[0].isdigit() and "." not in body:
                head, e, tail = body.partition("e")
                body = f"{head}.{e}{tail}"
        elif kind in (None, *"eEfFgGaA"):
            body = float_digits(v, kind or "g", prec, bool(s["alt"]))
        else:
            raise Unsupported
        if s["local"] and body[0].isdigit():
            m = re.match(r"(\d+)(\.?)(.*)", body)
            body = group_digits(m[1], punctuation) + (punctuation.point if m[2] else "") + m[3]
        if not body[0].isdigit():
            s = {**s, "zero": None}
    else:
        raise Unsupported
    sign = "-" if negative else {"+": "+", " ": " "}.get(s["sign"], "")
    if s["zero"] and not s["align"]:
        return sign + prefix + body.rjust(width - len(sign) - len(prefix), "0")
    return padded(sign + prefix + body, width, s["align"] or ">", fill)


def format_brace(fmt: str | None, args: list, locale: Locale | None = None) -> str | None:
    """A message of a brace format: `{}` takes the next argument, `{2}` a given one, `{{` and `}}`
    are braces. Missing arguments and invalid specifications give `{?}`; an opening brace that
    isn't closed keeps the rest of the text. A NULL format gives NULL."""
    if fmt is None:
        return None
    out, auto = [], 0
    for part in _parse_brace(fmt):
        if isinstance(part, str):
            out.append(part)
            continue
        if part is None:
            out.append(UNKNOWN)
            continue
        index, spec = part
        if index is None:
            index, auto = auto, auto + 1
        try:
            if index >= len(args):
                raise Unsupported
            out.append(_brace_value(args[index], dict(spec), locale or Locale()))
        except Unsupported:
            out.append(UNKNOWN)
    return "".join(out)


# --- printf formats ----------------------------------------------------------------------------

_CONVERSION = re.compile(
    r"%(?:(?P<pos>\d+)\$)?(?P<flags>[-+ #0']*)(?P<width>\*(?:\d+\$)?|\d+)?(?:\.(?P<prec>\*(?:\d+\$)?|\d*))?(?P<len>hh|h|ll|l|j|z|t|L)?(?P<conv>[a-zA-Z%])"
)
# Bits of the integers that the length modifiers name (a 64-bit Unix).
_LENGTH_BITS = {"hh": 8, "h": 16, "l": 64, "ll": 64, "j": 64, "z": 64, "t": 64}


@lru_cache(maxsize=4096)
def _parse_printf(fmt: str) -> tuple | None:
    """Literal text and conversions; None where positions and plain conversions are mixed."""
    out, at, kinds = [], 0, set()
    while True:
        p = fmt.find("%", at)
        if p < 0:
            out.append(fmt[at:])
            break
        out.append(fmt[at:p])
        m = _CONVERSION.match(fmt, p)
        if m is None:
            out.append(None)
            at = p + 1
            continue
        at = m.end()
        if m["conv"] == "%":
            out.append("%" if m[0] == "%%" else None)
            continue
        for x in (m["width"], m["prec"]):
            if x and x[0] == "*":
                kinds.add(x.endswith("$"))
        kinds.add(m["pos"] is not None)
        out.append(m.groupdict())
    return None if len(kinds) > 1 else tuple(out)


def _printf_value(v, flags: set, width: int, prec: int | None, length: str | None, conv: str) -> bytes:
    minus, zero = "-" in flags, "0" in flags and "-" not in flags
    bits, signed = 64, True
    if isinstance(v, Int):
        v, bits, signed = v.value, v.bits, v.signed
    if isinstance(v, bool):
        v, bits, signed = int(v), 8, False
    prefix, body = "", ""
    if conv in "diouxXbB":
        if not isinstance(v, int):
            raise Unsupported
        bits = _LENGTH_BITS.get(length, bits)
        raw = v & ((1 << bits) - 1)
        if conv in "di":
            if length or signed:
                raw = raw - (1 << bits) if raw >> (bits - 1) and (length or v < 0) else raw
            prefix = "-" if raw < 0 else "+" if "+" in flags else " " if " " in flags else ""
            body = str(abs(raw))
        else:
            body = format(raw, {"u": "d", "B": "b"}.get(conv, conv))
            if "#" in flags and raw:
                prefix = {"x": "0x", "X": "0X", "b": "0b", "B": "0B"}.get(conv, "")
        if prec is not None:
            zero = False
            body = "" if prec == 0 and raw == 0 else body.rjust(prec, "0")
        if conv == "o" and "#" in flags and not body.startswith("0"):
            body = "0" + body
    elif conv in "fFeEgGaA":
        if not isinstance(v, float):
            raise Unsupported
        prefix = "-" if is_negative(v) else "+" if "+" in flags else " " if " " in flags else ""
        body = float_digits(v, conv, prec, "#" in flags)
        if math.isnan(v) or math.isinf(v):
            zero = False
        elif conv in "aA":
            prefix += "0X" if conv == "A" else "0x"
    elif conv == "c":
        if not isinstance(v, int):
            raise Unsupported
        raw = (chr(v).encode() if length == "l" and 0 <= v < 0x110000 and not 0xD800 <= v < 0xE000 else bytes([v % 256])) if length in (None, "l") else None
        if raw is None:
            raise Unsupported
        return raw.ljust(width) if minus else raw.rjust(width)
    elif conv == "s":
        if not isinstance(v, str):
            raise Unsupported
        data = v.encode().split(b"\0")[0]
        data = data if prec is None else data[:prec]
        return data.ljust(width) if minus else data.rjust(width)
    elif conv == "p":
        if not isinstance(v, int):
            raise Unsupported
        body, zero = f"0x{v & ((1 << 64) - 1):x}" if v else "(nil)", False
    else:
        raise Unsupported
    if zero:
        body = body.rjust(width - len(prefix), "0")
    out = prefix + body
    return (out.ljust(width) if minus else out.rjust(width)).encode()


def format_printf_bytes(fmt: str | None, args: list) -> bytes | None:
    """A message of a printf format as bytes; precision of text counts bytes. Positions (`%3$d`)
    and plain conversions can't be mixed: such a format is `{?}`. `%n` and whatever else can't
    be rendered is `{?}` at its place."""
    if fmt is None:
        return None
    parts = _parse_printf(fmt)
    if parts is None:
        return UNKNOWN.encode()
    out, auto = [], 0

    def take(position):
        nonlocal auto
        if position is None:
            i, auto = auto, auto + 1
        else:
            i = int(position) - 1
        if not 0 <= i < len(args):
            raise Unsupported
        return args[i]

    def number(x):
        if x[0] == "*":
            v = take(x[1:-1] or None if x.endswith("$") else None)
            v = v.value if isinstance(v, Int) else v
            if isinstance(v, bool) or not isinstance(v, int):
                raise Unsupported
            return v
        return int(x)

    for part in parts:
        if isinstance(part, str):
            out.append(part.encode())
            continue
        try:
            if part is None:
                raise Unsupported
            flags = set(part["flags"])
            width = number(part["width"]) if part["width"] else 0
            if width < 0:
                flags.add("-")
                width = -width
            prec = None if part["prec"] is None else number(part["prec"]) if part["prec"] else 0
            prec = None if prec is not None and prec < 0 else prec
            value = take(part["pos"])
            if width > LIMIT or (prec or 0) > LIMIT:
                raise Unsupported
            out.append(_printf_value(value, flags, width, prec, part["len"], part["conv"]))
        except Unsupported:
            out.append(UNKNOWN.encode())
    return b"".join(out)


def format_printf(fmt: str | None, args: list) -> str | None:
    data = format_printf_bytes(fmt, args)
    if data is None:
        return None
    try:
        return data.decode()
    except UnicodeDecodeError:
        return "[non-UTF-8 bytes] " + data.hex()


# --- values ------------------------------------------------------------------------------------


def format_value(v) -> str:
    """Debug text: quoted text, hex bytes, [lists], {key: value} maps."""
    if v is None:
        return "null"
    if isinstance(v, Int):
        return str(v.value)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, float):
        out = shortest(v)
        return ("-" if is_negative(v) and out != "nan" else "") + out
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}: {format_value(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(format_value, v)) + "]"
    return str(v)


def fixed_text(raw: int, scale: int) -> str:
    """A fixed-point value as its raw integer and scale."""
    return f"{raw}e{scale}"
