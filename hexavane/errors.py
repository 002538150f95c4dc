"""Every error the engine raises, tagged with the stage that found it."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all engine errors. ``stage`` names the step that rejected the request."""

    stage = "engine"


class ParseError(QueryError):
    """Lexical or grammatical fault. ``kind`` is a short tag, ``span`` the [start, end) offsets in the text's UTF-8 bytes."""

    stage = "parse"

    def __init__(self, kind: str, span: tuple[int, int], message: str, text: str = ""):
        self.kind, self.span = kind, tuple(byte_offset(text, x) for x in span) if text else span
        self.line, self.column = line_col(text, span[0])
        super().__init__(f"{kind} at line {self.line}, column {self.column}: {message}")


def line_col(text: str, offset: int) -> tuple[int, int]:
    """1-based line, and column in UTF-8 bytes, of a character offset."""
    before = text[:offset]
    start = before.rfind("\n") + 1
    return before.count("\n") + 1, byte_offset(text, offset) - byte_offset(text, start) + 1


def byte_offset(text: str, offset: int) -> int:
    """Offset in UTF-8 bytes of an offset in characters; what lies beyond the text counts one each."""
    return len(text[:offset].encode("utf-8", "surrogatepass")) + max(0, offset - len(text))


class BindError(QueryError):
    """A well-formed statement that does not fit the catalog."""

    stage = "bind"


class CollectionNotFound(BindError):
    pass


class ColumnNotFound(BindError):
    pass


class BindCollectionExists(BindError):
    pass


class BindTypeMismatch(BindError):
    pass


class ArityMismatch(BindError):
    pass


class DuplicateInsertColumn(BindError):
    pass


class BindDimensionMismatch(BindError):
    pass


class VectorColumnCount(BindError):
    pass


class BindInvalidTopK(BindError):
    pass


class CompileError(QueryError):
    """A bound statement whose schema cannot be lowered."""

    stage = "compile"


class ZeroDimension(CompileError):
    pass


class CompileDuplicateColumn(CompileError):
    pass


class Unsupported(QueryError):
    """A statement the language accepts but the engine does not run."""

    stage = "unsupported"


class EngineError(QueryError):
    """A fault of the programmatic interface or of stored state."""


class DimensionMismatch(EngineError):
    pass


class InvalidTopK(EngineError):
    pass


class CapacityExceeded(EngineError):
    pass


class UnknownCollection(EngineError):
    pass


class CollectionConfigMismatch(EngineError):
    pass


class CollectionExists(EngineError):
    pass


class InvalidCollectionName(EngineError):
    pass


class InvalidCapacity(EngineError):
    pass


class ReservedColumn(EngineError):
    pass


class UnknownColumn(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class NaNRejected(EngineError):
    pass


class NonFiniteVector(EngineError):
    pass


class IncompleteRow(EngineError):
    pass


class DuplicateColumn(EngineError):
    pass


class SchemaMismatch(EngineError):
    pass


class CapacityOverflow(EngineError):
    """A capacity beyond what a row id can count."""


class CorruptCatalog(EngineError):
    pass


class CorruptSnapshot(EngineError):
    """Stored state that the catalog or a head names is missing or cannot be read."""


class UnsupportedVersion(EngineError):
    """Stored by another format."""


class WriterFenced(EngineError):
    """Another writer has taken over; the change does not count."""


class ReadOnlyDatabase(EngineError):
    """A change asked of a handle that was opened for reading."""


class DatabaseLocked(EngineError):
    pass


class ReadOnlyCollection(EngineError):
    pass
