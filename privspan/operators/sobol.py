"""Sobol points with keyed scrambling, as bit operations on a counter column.

Scrambling multiplies the direction numbers of each coordinate by a random lower triangular matrix of bits with ones on
the diagonal and adds a random word, so that every point is uniform and the net stays one. All of it sits in the direction
numbers: a few thousand words for any number of points, which Spark computes row by row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 32

#: First direction numbers of coordinates 2 to 13 by S. Joe and F. Y. Kuo (2008); further ones are hashed.
FIRST = [[1], [1, 3], [1, 3, 1], [1, 1, 1], [1, 1, 3, 3], [1, 3, 5, 13], [1, 1, 5, 5, 17], [1, 1, 5, 5, 5], [1, 1, 7, 11, 19], [1, 1, 5, 1, 1], [1, 1, 1, 3, 11], [1, 3, 5, 5, 31]]


def _primitive(polynomial: int) -> bool:
    """Whether x takes all nonzero remainders: its first power that is 1 is the last possible one."""
    degree = polynomial.bit_length() - 1
    at, order = 1, 0
    while True:
        at <<= 1
        at ^= polynomial if at >> degree else 0
        order += 1
        if at == 1 or order >= 1 << degree:
            return at == 1 and order == (1 << degree) - 1


def primitive_polynomials(count: int) -> list[int]:
    """The first primitive polynomials over two elements, as bits, by degree and value."""
    found, candidate = [], 3
    while len(found) < count:
        if _primitive(candidate):
            found.append(candidate)
        candidate += 2
    return found


def word(key: str, *counters: int) -> int:
    """32 bits of an MD5."""
    return int(hashlib.md5("|".join([key, "sobol", *map(str, counters)]).encode()).hexdigest()[:8], 16)


def direction_numbers(dimensions: int) -> list[list[int]]:
    """BITS words for each coordinate; the first is the one that reverses bits."""
    out = [[1 << (BITS - 1 - k) for k in range(BITS)]]
    for index, polynomial in enumerate(primitive_polynomials(dimensions - 1)):
        degree = polynomial.bit_length() - 1
        numbers = list(FIRST[index]) if index < len(FIRST) else [(word("first", index, i) % (1 << i)) << 1 | 1 for i in range(degree)]
        while len(numbers) < BITS:
            new = numbers[-degree]
            for back in range(1, degree + 1):
                new ^= (numbers[-back] << back) if polynomial >> (degree - back) & 1 else 0
            numbers.append(new)
        out.append([m << (BITS - 1 - k) for k, m in enumerate(numbers)])
    return out[:dimensions]


def scrambled(numbers: list[int], key: str, scramble: int, dimension: int) -> tuple[list[int], int]:
    """Direction numbers of one coordinate times a matrix of bits, and the word to add; bit p counts from the highest."""
    rows = [1 << (BITS - 1 - p) | word(key, scramble, dimension, p) & ~((1 << (BITS - p)) - 1) for p in range(BITS)]
    mixed = [sum(((row & v).bit_count() & 1) << (BITS - 1 - p) for p, row in enumerate(rows)) for v in numbers]
    return mixed, word(key, scramble, dimension, BITS)


def coordinates(counter: str, scramble: str, bits: int, dimensions: int, scrambles: int, key: str) -> list[Column]:
    """Coordinates in (0, 1) of the points counter < 2^bits of each scramble < scrambles; both are names of columns."""
    out = []
    for j, numbers in enumerate(direction_numbers(dimensions)):
        mixed = [scrambled(numbers, key, s, j) for s in range(scrambles)]
        one = lambda values: "element_at(array(" + ", ".join(f"{v}L" for v in values) + f"), {scramble} + 1)"
        terms = [f"({one([m[0][k] for m in mixed])} & -(shiftright({counter}, {k}) & 1))" for k in range(bits)]
        # One text for each coordinate: thousands of literals would take seconds one by one.
        out.append((F.expr(" ^ ".join([one([m[1] for m in mixed]), *terms])).cast("double") + 0.5) / float(1 << BITS))
    return out


def points(spark: SparkSession, count: int, dimensions: int, scrambles: int, key: str) -> DataFrame:
    """scramble, i and u0, u1, ...: count points for each scramble; ValueError unless count is a power of two, at most 2^32.

    The counter comes from a range, so points lie on all executors and a lost part is made anew.
    """
    if count < 1 or count & (count - 1) or count > 1 << BITS:
        raise ValueError("the number of points must be a power of two, at most 2^32")
    rows = spark.range(count).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(scrambles - 1))).alias("scramble"))
    us = coordinates("i", "scramble", count.bit_length() - 1, dimensions, scrambles, key)
    return rows.select("scramble", "i", *[u.alias(f"u{j}") for j, u in enumerate(us)])
