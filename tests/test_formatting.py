import math

import pytest

from tickloom.functions.formatting import Int, Locale, format_brace, format_printf, format_printf_bytes, format_value, hex_float, shortest

ARGS = [48, "naïve", 7.75, False]
PRINTF = [90, 6, 2.5, "naïve", Int(-3, 16)]


@pytest.mark.parametrize(
    ("fmt", "want"),
    [
        ("{{{0}}} {1}!", "{48} naïve!"),
        ("{2:.1f}|{1:-^9}|{1:.2}", "7.8|--naïve--|na"),
        ("{1:>8}/{0:<5}/{2:+09.2f}", "   naïve/48   /+00007.75"),
        ("{0} {zz} {7} {", "48 {?} {?} {"),
        ("{} {} {} {} {}", "48 naïve 7.75 false {?}"),
        ("{0:b}.{0:#o}.{0:X}.{0:+}.{0: }.{3:d}.{0:70000}", "110000.060.30.+48. 48.0.{?}"),
        ("{0:s};{1:x};{2:d};{0:.1}", "{?};{?};{?};{?}"),
        ("", ""),
        ("b } c }}", "b } c }"),
        ("{2:e}|{2:a}|{2:g}|{2:8}|{2:<8}|{2:G}", "7.750000e+00|1.fp+2|7.75|    7.75|7.75    |7.75"),
    ],
)
def test_brace(fmt, want):
    assert format_brace(fmt, ARGS) == want


def test_brace_wide_text_nulls_and_locale():
    assert format_brace("{:>6}|{:.2}", ["日本", "日本"]) == "  日本|日"
    assert format_brace("{}", [None]) == "{?}" and format_brace(None, []) is None
    lo = Locale((3,), ".", ",", "oui", "non")
    assert format_brace("{:L} {:L} {:L} {}", [1234567, 1234.5, True, 1234567], lo) == "1.234.567 1.234,5 oui 1234567"
    assert format_brace("{:L}", [123456789], Locale((3, 2), "'")) == "12'34'56'789"
    assert format_brace("{:c}{:.1f}{:f}{:F}", [65, float("nan"), float("-inf"), float("inf")]) == "Anan-infINF"
    assert format_brace("{}", [b"\x01\xff"]) == "01ff"


@pytest.mark.parametrize(
    ("fmt", "want"),
    [
        ("<%3$*2$.1f> %4$.2s %5$X", "<   2.5> na FFFD"),
        ("%2$d %d", "{?}"),
        ("%4$d|%1$n|%3$x", "{?}|{?}|{?}"),
        ("%5$hhu,%5$hhd", "253,-3"),
        ("%1$70000d", "{?}"),
        ("%%|%5$06x|%2$#o|%2$+d|%2$04d|%2$-4d|", "%|00fffd|06|+6|0006|6   |"),
        ("%3$e %3$G %3$a", "2.500000e+00 2.5 0x1.4p+1"),
        ("%2$p %2$b %2$#b %2$.3d %2$5.3d", "0x6 110 0b110 006   006"),
        ("%9$d", "{?}"),
        ("50%", "50{?}"),
    ],
)
def test_printf(fmt, want):
    assert format_printf(fmt, PRINTF) == want


def test_printf_odd_arguments():
    assert format_printf("%*d|%.*s|%-*d|", [5, 7, 2, "abc", 4, 1]) == "    7|ab|1   |"
    assert format_printf("%.*d", [-(2**31), 5]) == "5"
    assert format_printf("%d %u %x", [Int(-5, 16), Int(-5, 16), Int(2**64 - 1, 64, False)]) == "-5 65531 ffffffffffffffff"
    assert format_printf("%d", [Int(2**64 - 1, 64, False)]) == str(2**64 - 1)
    assert format_printf_bytes("%c%s", [0x141, "a\0b"]) == b"Aa"
    assert format_printf("%c", [255]) == "[non-UTF-8 bytes] ff"
    assert format_printf("%lc", [0x20AC]) == "€"
    assert format_printf("%d", []) == "{?}" and format_printf(None, []) is None


def test_shortest_reads_back():
    for x in (0.1, 1e22, 1e-7, 123456.0, 5e-324, 1.7976931348623157e308, 100000.0, 0.0001, 3.0):
        assert float(shortest(x)) == x
    assert [shortest(x) for x in (100000.0, 1234.5, 1e21, 0.0001)] == ["1e+05", "1234.5", "1e+21", "1e-04"]


def test_hex_float_and_values():
    for x in (1.0, 0.1, 5e-324, 1e300, 3.75):
        assert float.fromhex("0x" + hex_float(x, None)) == x
    assert hex_float(1.999, 1) == "2.0p+0"
    assert format_value({"a": [1, "x\n", b"\x01", None, True, -0.0], "b": 1.5}) == '{a: [1, "x\\n", 01, null, true, -0], b: 1.5}'
    assert math.isnan(float("nan")) and format_value(float("nan")) == "nan"
