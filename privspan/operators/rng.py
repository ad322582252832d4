"""A keyed counter generator: the draw depends on key, stream and counters only, not on partitions or retries.

A fixed key is for tests and comparisons; a private release needs a secret one. Normal draws in
double precision have the known side channels of floating point.
"""

from __future__ import annotations

import hashlib
import math
import secrets

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def new_key() -> str:
    return secrets.token_hex(16)


def uniform(key: str, stream: str, *counters: Column) -> Column:
    """In (0, 1): 52 bits of an MD5 over key, stream and counters, at the middle of their cell."""
    name = F.concat_ws("|", F.lit(key), F.lit(stream), *[c.cast("string") for c in counters])
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def normal(key: str, stream: str, *counters: Column) -> Column:
    """Standard normal, by Box and Muller."""
    u, v = uniform(key, f"{stream}.u", *counters), uniform(key, f"{stream}.v", *counters)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(v * (2 * math.pi))


def laplace(key: str, stream: str, scale: float, *counters: Column) -> Column:
    u = uniform(key, stream, *counters) - 0.5
    return -F.signum(u) * F.ln(1 - 2 * F.abs(u)) * scale


# Draws for every row, draw and k at once, over numpy: a million normals take some 30 ms.

#: Tells the hash of the angle from that of the radius.
ANGLE = 0x9E3779B9


def words(key: str, stream: str) -> list[int]:
    """Four 32-bit words of an MD5 of key and stream."""
    digest = hashlib.md5(f"{key}|{stream}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words whose output bits depend on all input bits."""
    x = np.asarray(x, np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(2146121005)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(2221713035)
    return x ^ (x >> np.uint32(16))


def absorbed(start: int | np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """mix32 of start, then of each part put in by exclusive or."""
    with np.errstate(over="ignore"):
        now = mix32(np.asarray(start, np.uint32))
        for part in parts:
            now = mix32(now ^ np.asarray(part, np.uint32))
        return now


def cells(key: str, stream: str, draw: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit words of each pair of draw and k, by keys of their own: pairs agree in both with a probability of 2^-64."""
    a, b = (absorbed(w, draw, k) for w in words(key, stream)[2:])
    return a, b


def row_words(key: str, stream: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of each row, a long."""
    rows = np.asarray(rows, np.int64).view(np.uint64)
    low, high = (rows & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rows >> np.uint64(32)).astype(np.uint32)
    a, b = (absorbed(w, low, high) for w in words(key, stream)[:2])
    return a, b


def grid_normals(key: str, stream: str, rows: np.ndarray, draw: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A standard normal for each row (a long) and each pair of draw and k, by Box and Muller.

    Radius and angle are hashes of both words of the row and of the pair, so that two rows, or two
    pairs, repeat each other only if 64 bits agree. The radius takes 52 bits: normals reach 8.5.
    They are for sketches, not for secrets: a private release needs a secret key.
    """
    r, c = row_words(key, stream, rows), cells(key, stream, draw, k)
    a, b = r[0][:, None] ^ c[0][None], r[1][:, None] ^ c[1][None]
    with np.errstate(over="ignore"):
        middle = mix32(a)
        u, v = mix32(middle ^ b), mix32(mix32(b ^ np.uint32(ANGLE)) ^ a)
    fine = u * float(1 << 20) + (middle & np.uint32((1 << 20) - 1))
    return np.sqrt(-2 * np.log((fine + 0.5) / 2.0**52)) * np.cos((v + 0.5) / 2.0**32 * (2 * math.pi))
