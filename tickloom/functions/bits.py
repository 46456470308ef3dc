"""Signal values as text, most significant state first: one of 0 1 x z u w l h - per bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.model import STATES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_ascii(text: Column | str, width: int | Column) -> Column:
    """`text` in lower case and of `width` states: longer text keeps its low states, shorter text
    is extended with its first state if that is neither 0 nor 1, else with 0. Characters that
    are no state become x; empty text becomes zeros, NULL stays NULL."""
    s = F.regexp_replace(F.lower(_c(text)), f"[^{STATES[:-1]}\\-]", "x")
    first = F.substring(s, 1, 1)
    fill = F.when(first.isin("0", "1", ""), "0").otherwise(first)
    w = F.lit(width) if isinstance(width, int) else width
    n = F.length(s)
    return F.when(n >= w, F.right(s, w)).otherwise(F.concat(F.repeat(fill, w - n), s))


def as_u64(text: Column | str) -> Column:
    """The unsigned value as decimal(20,0) of at most 64 states that are all 0 or 1, else NULL."""
    s = _c(text)
    return F.when(s.rlike("^[01]{1,64}$"), F.conv(s, 2, 10).cast("decimal(20,0)"))


def is_two_state(text: Column | str) -> Column:
    """True where every state is 0 or 1 (of empty text too); NULL stays NULL."""
    return ~_c(text).rlike("[^01]")


def narrow(text: Column | str) -> Column:
    """The text itself if it has two states only, else NULL."""
    s = _c(text)
    return F.when(is_two_state(s), s)


def state_at(text: Column | str, bit: int | Column) -> Column:
    """The state of bit `bit` (0 is the last character); NULL outside the width."""
    s = _c(text)
    i = F.lit(bit) if isinstance(bit, int) else bit
    at = F.length(s) - i
    return F.when((at >= 1) & (i >= 0), F.substring(s, at, F.lit(1)))


def state_code(ch: Column | str) -> Column:
    """The code of a state's character; that of x (2) for other characters."""
    at = F.instr(F.lit(STATES), F.substring(F.lower(_c(ch)), 1, 1)) - 1
    return F.when(_c(ch).isNotNull(), F.when(at < 0, 2).otherwise(at))


def default_value(encoding: Column | str, width: Column | str, states: Column | str) -> Column:
    """The value before the first change: zeros for two states, x for more, 0.0 for reals and
    the empty text for bytes."""
    e, w, n = _c(encoding), _c(width), _c(states)
    return (
        F.when(e == "bits", F.when(n == 2, F.repeat(F.lit("0"), w)).otherwise(F.repeat(F.lit("x"), w)))
        .when(e == "real", F.lit("0.0"))
        .when(e == "bytes", F.lit(""))
    )


def masked(value: Column | str, width: int) -> Column:
    """The low `width` bits of an integer (1 to 63)."""
    return _c(value).bitwiseAND(F.lit((1 << width) - 1))


def packed_length(width: Column | str, states: Column | str) -> Column:
    """Bytes of a packed value: 1, 2 or 4 bits a state for 2, up to 4 and up to 9 states."""
    per = F.when(_c(states) <= 2, 8).when(_c(states) <= 4, 4).otherwise(2)
    return F.ceil(_c(width) / per).cast("bigint")


def word32(value: Column | str, k: int) -> Column:
    """The k-th 32-bit word of a 64-bit integer, low word first."""
    return F.shiftrightunsigned(_c(value), 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def clock_edge(first: Column, period: Column, k: Column) -> Column:
    """The tick of edge k of a clock run."""
    return first + k * period


def stage_end(begin: Column | str, time: Column | str) -> Column:
    """The end that a stage gets when it is ended at `time`: never before its begin."""
    return F.greatest(_c(begin), _c(time))


def effective_end(begin: Column | str, end: Column | str, owner_end: Column | str) -> Column:
    """The end of an embedded stage; of an open one the larger of its begin and its owner's end."""
    return F.coalesce(_c(end), F.greatest(_c(begin), _c(owner_end)))


def vcd_id(n: Column | str) -> Column:
    """The identifier code number n of a VCD file: base 94 with digits from '!', low digit first
    (0 is '!', 93 is '~', 94 is '!"'). Codes up to 94^5 are supported, NULL stays NULL."""
    v = _c(n).cast("bigint")
    out, rest = F.char(F.lit(33) + F.pmod(v, F.lit(94))), F.floor(v / 94)
    for _ in range(4):
        out = F.concat(out, F.when(rest > 0, F.char(F.lit(33) + F.pmod(rest, F.lit(94)))).otherwise(""))
        rest = F.floor(rest / 94)
    return out


def timescale_text(exponent: Column | str) -> Column:
    """`1ns`, `10ps`, ... of a power of ten in seconds from -15 to 2, else NULL."""
    e = _c(exponent).cast("int")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("fs", "ps", "ns", "us", "ms", "s"))), F.floor((e + 15) / 3).cast("int") + 1)
    factor = F.element_at(F.array(F.lit("1"), F.lit("10"), F.lit("100")), F.pmod(e + 15, F.lit(3)).cast("int") + 1)
    return F.when((e >= -15) & (e <= 2), F.concat(factor, unit))


def bytes_text(n: Column | str) -> Column:
    """A number of bytes in the largest binary unit below it, with one decimal; plain bytes below 1024."""
    v = _c(n).cast("double")
    out = F.concat(_c(n).cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        out = F.when(v >= float(1024**k), F.concat(F.format_string("%.1f", F.bround(v / float(1024**k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def log_bytes_text(raw: Column | str) -> Column:
    """A rendered message as text; bytes that are no UTF-8 as hex behind a note."""
    b = _c(raw)
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.concat(F.lit("[non-UTF-8 bytes] "), F.lower(F.hex(b))))
