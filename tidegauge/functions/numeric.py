"""Column functions: tail gains near a zero shape, Student t, counter random numbers, half-even rounding."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f or its own lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    c = col(c)
    c = c if lo is None else F.greatest(c, F.lit(float(lo)))
    return c if hi is None else F.least(c, F.lit(float(hi)))


def round_half_even(c: Column | str) -> Column:
    return F.rint(col(c))


def sigmoid(c: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def logit_loss(z: Column | str, y: Column | str) -> Column:
    """Binary cross-entropy of a logit."""
    z = col(z)
    return F.greatest(z, F.lit(0.0)) - z * col(y) + F.log1p(F.exp(-F.abs(z)))


def _series(x: Column, terms: list[float]) -> Column:
    out = F.lit(terms[-1])
    for t in reversed(terms[:-1]):
        out = out * x + F.lit(t)
    return out


def expm1_ratio(c: Column | str) -> Column:
    """(e^x - 1) / x, by its series below 0.01."""
    x = col(c)
    near = _series(x, [1 / math.factorial(k + 1) for k in range(7)])
    return F.when(F.abs(x) < 1e-2, near).otherwise(F.expm1(x) / F.when(x == 0, 1.0).otherwise(x))


def expm1_ratio_slope(c: Column | str) -> Column:
    """((x - 1) e^x + 1) / x^2, by its series below 0.01."""
    x = col(c)
    near = _series(x, [(k + 1) / math.factorial(k + 2) for k in range(7)])
    return F.when(F.abs(x) < 1e-2, near).otherwise(((x - 1.0) * F.exp(x) + 1.0) / F.when(x == 0, 1.0).otherwise(x * x))


def gain(shape: Column | str, log_ratio: float) -> Column:
    """(r^shape - 1) / shape for r = exp(log_ratio)."""
    return F.lit(log_ratio) * expm1_ratio(col(shape) * F.lit(log_ratio))


def gain_slope(shape: Column | str, log_ratio: float) -> Column:
    """Derivative of gain by the shape."""
    return F.lit(log_ratio * log_ratio) * expm1_ratio_slope(col(shape) * F.lit(log_ratio))


def t_cdf_value(t: float, df: int) -> float:
    """Student t distribution function for a whole number of degrees of freedom, by the finite trigonometric sums."""
    theta = math.atan2(t, math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        term, total = c, 0.0
        for k in range(1, df - 1, 2):
            total += term
            term *= c * c * (k + 1) / (k + 2)
        a = 2 / math.pi * (theta + s * total)
    else:
        term, total = 1.0, 0.0
        for k in range(0, df - 1, 2):
            total += term
            term *= c * c * (k + 1) / (k + 2)
        a = s * total
    return 0.5 * (1 + a)


def t_quantile_value(p: float, df: int) -> float:
    if df == 2:
        return (2 * p - 1) / math.sqrt(2 * p * (1 - p))
    lo, hi = -1e8, 1e8
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf_value(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


#: Degrees of freedom with exact entries; above, quantiles change by less than a thousandth and the last entry is used by its series.
T_TABLE = 200


def t_quantile(p: float, df: Column | str) -> Column:
    """Quantile by a literal table for df up to T_TABLE, then by the Cornish-Fisher series around the normal quantile."""
    df = col(df)
    table = F.array(*[F.lit(t_quantile_value(p, k)) for k in range(1, T_TABLE + 1)])
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    z, d = lo, df.cast("double")
    far = F.lit(z) + F.lit((z**3 + z) / 4) / d + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (d * d)
    return F.when(df < 1, F.lit(None)).when(df <= T_TABLE, F.get(table, df.cast("int") - 1)).otherwise(far)


def t_two_sided_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value of a t statistic for whole degrees of freedom, as an expression."""
    t, df = col(t), col(df)
    x = F.abs(t)
    theta = F.atan2(x, F.sqrt(df))
    c2 = F.cos(theta) * F.cos(theta)
    step = lambda a, k: F.struct((a["total"] + a["term"]).alias("total"), (a["term"] * c2 * (k + 1) / (k + 2)).alias("term"))
    start = lambda term: F.struct(F.lit(0.0).alias("total"), term.cast("double").alias("term"))
    seq = lambda first, last: F.when(F.lit(first) <= last, F.sequence(F.lit(first), last, F.lit(2))).otherwise(F.array().cast("array<int>"))
    odd = F.aggregate(seq(1, (df - 2).cast("int")), start(F.cos(theta)), step)["total"]
    even = F.aggregate(seq(0, (df - 2).cast("int")), start(F.lit(1.0)), step)["total"]
    inside = F.when(df % 2 == 1, F.lit(2 / math.pi) * (theta + F.sin(theta) * odd)).otherwise(F.sin(theta) * even)
    return F.greatest(F.lit(0.0), 1.0 - inside)


def draw(n: Column | str, *keys) -> Column:
    """A whole number from 0 to n-1 that depends on the keys only: 32 bits of their MD5, modulo n."""
    text = F.concat_ws("|", *[F.lit(k) if not isinstance(k, Column) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % col(n)


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_first(before: bytes, numbers: np.ndarray) -> np.ndarray:
    """The first four bytes, as a big-endian number, of the MD5 of `before` followed by each number in decimal, for whole numbers from 0 on."""
    if len(numbers) < 512:  # array operations cost more than they save
        return np.frombuffer(b"".join([hashlib.md5(before + b"%d" % k).digest()[:4] for k in numbers.tolist()]), ">u4").astype(np.uint32)
    out = np.empty(len(numbers), np.uint32)
    digits = np.ones(len(numbers), np.int64)
    for k in range(1, 19):
        digits += numbers >= 10**k
    for width in np.unique(digits).tolist():
        own = np.flatnonzero(digits == width)
        out[own] = _md5_one_width(before, numbers[own], width)
    return out


def _md5_one_width(before: bytes, numbers: np.ndarray, width: int) -> np.ndarray:
    """Words of a message that all numbers share are single values, the others arrays."""
    size = len(before) + width
    blocks = (size + 8) // 64 + 1
    frame = np.frombuffer((before + bytes(width) + b"\x80").ljust(64 * blocks - 8, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    message: list = [np.uint32(w) for w in frame]
    for k in range(width):
        digit = (numbers // 10 ** (width - 1 - k) % 10 + 48).astype(np.uint32)
        at = len(before) + k
        message[at // 4] = message[at // 4] | (digit << np.uint32(8 * (at % 4)))
    state = [np.full(len(numbers), v, np.uint32) for v in _START]
    for first in range(0, 16 * blocks, 16):
        a, b, c, d = state
        for k in range(64):
            if k < 16:
                f, g = d ^ (b & (c ^ d)), k
            elif k < 32:
                f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
            elif k < 48:
                f, g = b ^ c ^ d, (3 * k + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * k % 16
            f += a
            f += message[first + g]
            f += np.uint32(_SINES[k])
            turn = _TURNS[k // 16][k % 4]
            high = f >> np.uint32(32 - turn)
            f <<= np.uint32(turn)
            f |= high
            f += b
            a, b, c, d = d, f, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0].byteswap()
