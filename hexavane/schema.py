"""Collections: typed columns, exactly one of them a vector, and the rules for rows and probes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

from . import errors as E
from .language.parser import to_f32

INT, FLOAT, TEXT, VECTOR = "INT", "FLOAT", "TEXT", "VECTOR"
#: Physical name of the row id. Stored columns are c0, c1, ..., so no user name can clash with it or differ only in case.
ROW_ID = "__id"
_SPARK = {INT: T.LongType(), FLOAT: T.DoubleType(), TEXT: T.StringType()}
_I64 = range(-(2**63), 2**63)


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    dim: int | None = None


@dataclass(frozen=True)
class Collection:
    """A named, immutable schema. ``capacity`` bounds the ids ever handed out, so deletes free no room."""

    id: int
    name: str
    capacity: int
    columns: tuple[Column, ...]
    index: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        self.index.update({c.name: i for i, c in enumerate(self.columns)})

    @property
    def vector(self) -> Column:
        return next(c for c in self.columns if c.kind == VECTOR)

    @property
    def scalars(self) -> list[Column]:
        return [c for c in self.columns if c.kind != VECTOR]

    def physical(self, name: str) -> str:
        return f"c{self.index[name]}"

    def column(self, name: str) -> Column:
        """The column of exactly this name."""
        if name not in self.index:
            raise E.UnknownColumn(f"collection {self.name!r} has no column {name!r}")
        return self.columns[self.index[name]]

    def scalar(self, name: str) -> Column:
        found = self.column(name)
        if found.kind == VECTOR:
            raise E.UnknownColumn(f"{name!r} is the vector column")
        return found

    def struct(self) -> T.StructType:
        """Stored row: the id and the columns under their physical names."""
        fields = [T.StructField(ROW_ID, T.LongType(), False)]
        for i, c in enumerate(self.columns):
            kind = T.ArrayType(T.FloatType(), False) if c.kind == VECTOR else _SPARK[c.kind]
            fields.append(T.StructField(f"c{i}", kind, False, {"vector_dim": c.dim} if c.kind == VECTOR else {}))
        return T.StructType(fields)

    def to_json(self) -> dict:
        return {"id": self.id, "name": self.name, "capacity": self.capacity, "columns": [[c.name, c.kind, c.dim] for c in self.columns]}

    @staticmethod
    def from_json(d: dict) -> Collection:
        return Collection(d["id"], d["name"], d["capacity"], tuple(Column(*c) for c in d["columns"]))


def check_definition(c: Collection) -> Collection:
    """One validator for SQL, API and configurations given at open."""
    if not c.name:
        raise E.InvalidCollectionName("the name is empty")
    if not isinstance(c.capacity, int) or c.capacity < 1:
        raise E.InvalidCapacity(f"capacity {c.capacity} is below 1")
    if c.capacity > 2**63 - 1:
        raise E.CapacityOverflow(f"capacity {c.capacity} is beyond what a row id can count")
    if sum(x.kind == VECTOR for x in c.columns) != 1:
        raise E.SchemaMismatch("a collection has exactly one vector column")
    if c.vector.dim is None or c.vector.dim < 1:
        raise E.ZeroDimension("the vector has no dimensions")
    if len({x.name for x in c.columns}) < len(c.columns):
        raise E.DuplicateColumn("a column name occurs twice")
    for x in c.scalars:
        if x.kind not in _SPARK:
            raise E.SchemaMismatch(f"no type {x.kind!r}")
        if x.name.lower() == "id":
            raise E.ReservedColumn("'id' names the row id")
    return c


def check_scalar(column: Column, value, *, widen: bool = False):
    """``value`` if it is of the column's type. ``widen`` lets an int stand for a FLOAT (SQL literals only)."""
    if column.kind == TEXT and isinstance(value, str):
        return value
    if column.kind == INT and isinstance(value, int) and not isinstance(value, bool) and value in _I64:
        return value
    if column.kind == FLOAT:
        if widen and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if isinstance(value, float):
            if math.isnan(value):
                raise E.NaNRejected(f"column {column.name!r} got NaN")
            return value
    raise E.TypeMismatch(f"column {column.name!r} is {column.kind}, got {value!r}")


def check_vector(c: Collection, vector) -> list[float]:
    """The vector rounded to 32 bits; its length must fit and its elements be finite."""
    got = [to_f32(float(x)) for x in vector]
    if len(got) != c.vector.dim:
        raise E.DimensionMismatch(f"expected {c.vector.dim} dimensions, got {len(got)}")
    if not all(map(math.isfinite, got)):
        raise E.NonFiniteVector("vector elements must be finite")
    return got


def check_row(c: Collection, vector, row) -> list:
    """Column values in declaration order, or an error. ``row``: mapping or pairs of column name and value."""
    pairs = list(row.items()) if hasattr(row, "items") else list(row)
    names = [k for k, _ in pairs]
    if len(set(names)) < len(names):
        raise E.DuplicateColumn("a column is given twice")
    for name in names:
        c.scalar(name)
    if len(names) != len(c.scalars):
        raise E.IncompleteRow(f"expected {len(c.scalars)} scalar values, got {len(names)}")
    given = dict(pairs)
    return [check_vector(c, vector) if x.kind == VECTOR else check_scalar(x, given[x.name]) for x in c.columns]
