"""Values as text in artifacts: shortest round-trip numbers, NaN for what is not available, 1 and 0, empty counters."""

from __future__ import annotations

from decimal import Decimal


def number(x: float | None) -> str:
    """The shortest text that reads back as `x`; from 1E+15 and below 1E-05 in scientific form. A missing measurement is NaN."""
    if x is None or x != x:
        return "NaN"
    text = repr(x)
    if "e" not in text and "n" not in text and -1e15 < x < 1e15:
        return text.removesuffix(".0")
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    sign, digits, exp = Decimal(repr(float(x))).normalize().as_tuple()
    text, at = "".join(map(str, digits)), len(digits) - 1 + exp
    if at >= 15 or at < -4:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"E{'+' if at >= 0 else '-'}{abs(at):02d}"
    elif at < 0:
        body = "0." + "0" * (-at - 1) + text
    else:
        body = text.ljust(at + 1, "0")
        body = body[: at + 1] + ("." + body[at + 1 :] if len(body) > at + 1 else "")
    return ("-" if sign else "") + body


def counter(x: int | None) -> str:
    return "" if x is None else str(int(x))


def flag(x: bool | None) -> str:
    return "1" if x else "0"
