"""Exact linear algebra inside one group: over the rationals, a prime field, or floats with a tolerance.

Matrices are lists of rows. ``field`` is None for the rationals, a prime, or "real".
"""

from __future__ import annotations

from fractions import Fraction

RTOL, ATOL = 1e-10, 1e-12


class Field:
    def __init__(self, field: int | str | None = None) -> None:
        self.p = field if isinstance(field, int) else None
        self.real = field == "real"
        if self.p is not None and (self.p < 2 or any(self.p % d == 0 for d in range(2, int(self.p**0.5) + 1))):
            raise ValueError("field must be a prime")

    def of(self, x):
        if self.p:
            if isinstance(x, Fraction):
                return x.numerator * pow(x.denominator, -1, self.p) % self.p
            return int(x) % self.p
        return float(x) if self.real else Fraction(x)

    def inverse(self, x):
        return pow(x, -1, self.p) if self.p else 1 / x

    def zero(self, x, scale=1.0) -> bool:
        return abs(x) <= max(ATOL, RTOL * scale) if self.real else x == 0

    def minus(self, a, f, b):
        """a - f * b"""
        return (a - f * b) % self.p if self.p else a - f * b


def rref(rows: list[list], field: int | str | None = None) -> tuple[list[list], list[int]]:
    """Reduced row echelon form and its pivot columns."""
    k = Field(field)
    m = [[k.of(x) for x in r] for r in rows]
    scale = max((abs(x) for r in m for x in r), default=1.0) if k.real else 1.0
    pivots, at = [], 0
    for c in range(len(m[0]) if m else 0):
        best = max(range(at, len(m)), key=lambda i: abs(m[i][c]), default=None) if k.real else next((i for i in range(at, len(m)) if m[i][c] != 0), None)
        if best is None or k.zero(m[best][c], scale):
            continue
        m[at], m[best] = m[best], m[at]
        inv = k.inverse(m[at][c])
        m[at] = [x * inv % k.p if k.p else x * inv for x in m[at]]
        for i in range(len(m)):
            if i != at and m[i][c] != 0:
                f = m[i][c]
                m[i] = [k.minus(a, f, b) for a, b in zip(m[i], m[at], strict=True)]
        pivots.append(c)
        at += 1
        if at == len(m):
            break
    return m, pivots


def rank(rows: list[list], field: int | str | None = None) -> int:
    return len(rref(rows, field)[1]) if rows and rows[0] else 0


def nullspace(rows: list[list], columns: int, field: int | str | None = None) -> list[list]:
    """Basis vectors x of rows * x = 0."""
    k = Field(field)
    m, pivots = rref(rows, field) if rows else ([], [])
    out = []
    for free in (c for c in range(columns) if c not in pivots):
        x = [k.of(0)] * columns
        x[free] = k.of(1)
        for i, c in enumerate(pivots):
            x[c] = k.minus(k.of(0), m[i][free], k.of(1))
        out.append(x)
    return out


def colspace(rows: list[list], field: int | str | None = None) -> list[int]:
    """Columns that form a basis of the column space."""
    return rref(rows, field)[1] if rows and rows[0] else []


def solve(rows: list[list], right: list[list], field: int | str | None = None) -> list[list]:
    """X with rows * X = right, for rows of full column rank; raises if there is none."""
    n = len(rows[0]) if rows else 0
    m, pivots = rref([a + b for a, b in zip(rows, right, strict=True)], field)
    if pivots[:n] != list(range(n)) or len(pivots) > n:
        raise ValueError("no solution, or columns are dependent")
    return [m[i][n:] for i in range(n)]


def restricted(rows: list[list], take_rows: list[int], take_columns: list[int]) -> list[list]:
    return [[rows[i][j] for j in take_columns] for i in take_rows]


def multiply(a: list[list], b: list[list], field: int | str | None = None) -> list[list]:
    k = Field(field)
    cols = list(zip(*b, strict=True)) if b else []
    out = [[sum((k.of(x) * k.of(y) for x, y in zip(r, c, strict=True)), k.of(0)) for c in cols] for r in a]
    return [[x % k.p for x in r] for r in out] if k.p else out
