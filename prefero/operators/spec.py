"""Specifications: which column, constant or nothing each coefficient meets in each alternative's utility.

A specification is compiled once on the driver to cells; the rows never become
a tensor.  Zero cells are left out of every expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cell = str | float | None
ZERO, ONE = "sero", "uno"


def given(name: str) -> Column:
    """A column of the model as a double."""
    return F.col(name).cast("double")


def unused(name: str, df: DataFrame) -> str:
    """``name``, made longer until the table has no such column in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def complete(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, stopping the job that meets a null in one of the columns, so that no row drops out of a mean unseen.

    One check a row, in the pass that reads it.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return df
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(f"`{c}`").isNotNull()
    names = F.concat_ws(", ", *[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in columns])
    return df.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("nulls in columns of the model: "), names)).cast("boolean")))


def known(name: str) -> Column:
    """A column of the model as a double; a null in it stops the job that meets it."""
    said = F.raise_error(F.lit(f"nulls in columns of the model: {name}")).cast("double")
    return F.when(F.col(f"`{name}`").isNull(), said).otherwise(F.col(f"`{name}`").cast("double"))


@dataclass(frozen=True)
class Design:
    """cells[j][v]: a column's name, a number, or None for zero."""

    names: tuple[str, ...]
    alternatives: tuple[str, ...]
    cells: tuple[tuple[Cell, ...], ...]

    def columns(self) -> list[str]:
        """The table's columns in use, each once."""
        return list(dict.fromkeys(c for row in self.cells for c in row if isinstance(c, str)))

    def value(self, j: int, v: int, read=given, lift=lambda x: F.lit(float(x))) -> object:
        """The value of a cell; None for zero."""
        cell = self.cells[j][v]
        return None if cell is None else read(cell) if isinstance(cell, str) else lift(cell)

    def utilities(self, beta: Sequence[float], read=given, lift=lambda x: F.lit(float(x))) -> list:
        """Each alternative's sum of coefficient times value."""
        out = []
        for j in range(len(self.alternatives)):
            terms = [x * (b if isinstance(b, Column) else float(b)) for v, b in enumerate(beta) if (x := self.value(j, v, read, lift)) is not None]
            total = terms[0] if terms else lift(0.0)
            for t in terms[1:]:
                total = total + t
            out.append(total)
        return out

    def with_cell(self, alternative: str, coefficient: str, value: float) -> Design:
        """The design with one cell held at a number."""
        j, v = self.alternatives.index(alternative), self.names.index(coefficient)
        cells = [list(row) for row in self.cells]
        cells[j][v] = float(value)
        return Design(self.names, self.alternatives, tuple(map(tuple, cells)))

    def packed(self) -> Column:
        """All cells of a row as one array, alternative by alternative."""
        return F.array(*[F.lit(0.0) if (x := self.value(j, v)) is None else x for j in range(len(self.alternatives)) for v in range(len(self.names))])


def _cell(value: object, columns: set[str], name: str) -> Cell:
    if isinstance(value, bool) or not isinstance(value, str | int | float):
        return None
    if not isinstance(value, str):
        return float(value) or None
    word = value.strip()
    if word.lower() in (ZERO, ONE):
        return 1.0 if word.lower() == ONE else None
    if word not in columns:
        raise ValueError(f"coefficient {name!r} asks for column {word!r}, which the table does not have")
    return word


def compile_spec(spec: Mapping[str, Mapping[str, object]], alternatives: Sequence[str], columns: Iterable[str], segments: int = 1) -> Design:
    """{coefficient: {alternative: column, "sero", "uno" or number}} to a Design.

    An alternative that a coefficient does not name is zero there; the key words are
    read in either case, columns exactly.  With ``segments`` the coefficients are
    repeated with the suffixes _s2, _s3 ...
    """
    known = set(columns)
    once = [[_cell(of.get(alt, ZERO), known, name) for name, of in spec.items()] for alt in alternatives]
    names = list(spec) + [f"{n}_s{s}" for s in range(2, segments + 1) for n in spec]
    return Design(tuple(names), tuple(alternatives), tuple(tuple(row * segments) for row in once))


def spec_of_matrix(matrix: Sequence[Sequence[object]], alternatives: Sequence[str], names: Sequence[str] | None = None) -> dict[str, dict[str, object]]:
    """A matrix with a row per alternative and a column per coefficient, as a specification."""
    if len(matrix) != len(alternatives):
        raise ValueError(f"{len(matrix)} rows for {len(alternatives)} alternatives")
    names = list(names) if names is not None else [f"x{v + 1}" for v in range(len(matrix[0]) if matrix else 0)]
    return {n: {alt: row[v] for alt, row in zip(alternatives, matrix, strict=True)} for v, n in enumerate(names)}


def choice_index(indicators: Sequence[str]) -> Column:
    """Number of the first of the greatest indicators, from 0; a row of zeros is 0."""
    values = F.array(*[given(c) for c in indicators])
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rebased(column: str, lowest: float) -> Column:
    """An ordinal outcome counted from its lowest category in the table that was fitted."""
    return (given(column) - F.lit(lowest)).cast("int")
