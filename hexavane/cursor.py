"""A cursor: rows of a collection one after the other, in id order or in the order of a list of ids.

For programs that walk through rows; a DataFrame (``Database.scan``, ``scan_over``) is the way to work on many of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from .schema import ROW_ID

if TYPE_CHECKING:
    from .database import Database


class Cursor:
    """Parked before the first row until ``seek_first``, ``seek`` or ``next``, which tell whether there is a row.

    All rows are of the snapshot the cursor was opened on. Rows come ``page`` at a time; only the page at hand is in memory.
    ``fetched`` counts the rows it was parked on, ``skipped`` the ids it passed over because they were deleted or never given.
    """

    def __init__(self, db: Database, which: int | str, columns: Iterable[str] | None = None, ids: Iterable[int] | None = None, page: int = 1024):
        c = db.collection(which)
        self.columns = [c.scalar(n).name for n in columns] if columns is not None else [x.name for x in c.scalars]
        live = db.live(which)
        self._rows = live.select(F.col(ROW_ID), *[F.col(c.physical(n)).alias(f"v{i}") for i, n in enumerate(self.columns)])
        self._ids = None if ids is None else [int(i) for i in ids]
        self._page = page
        self.fetched = self.skipped = 0
        self._start(0)

    def _start(self, at: int) -> None:
        self._source: Iterator[tuple[int, tuple | None]] = self._scan(at) if self._ids is None else self._over(at)
        self._last = at - 1
        self.ordinal: int | None = None
        self.row: tuple | None = None

    def _scan(self, at: int) -> Iterator[tuple[int, tuple | None]]:
        while True:
            page = self._rows.where(F.col(ROW_ID) >= at).orderBy(ROW_ID).limit(self._page).collect()
            for r in page:
                yield r[0], tuple(r[1:])
            if len(page) < self._page:
                return
            at = page[-1][0] + 1

    def _over(self, at: int) -> Iterator[tuple[int, tuple | None]]:
        wanted = [i for i in self._ids if i >= at] if at else self._ids
        for k in range(0, len(wanted), self._page):
            some = wanted[k : k + self._page]
            found = {r[0]: tuple(r[1:]) for r in self._rows.where(F.col(ROW_ID).isin(sorted(set(some)))).collect()}
            yield from ((i, found.get(i)) for i in some)

    def next(self) -> bool:
        """On to the next row that is there."""
        for ordinal, row in self._source:
            if self._ids is None:
                self.skipped += ordinal - self._last - 1
                self._last = ordinal
            if row is None:
                self.skipped += 1
                continue
            self.ordinal, self.row = ordinal, row
            self.fetched += 1
            return True
        self.ordinal = self.row = None
        return False

    def seek_first(self) -> bool:
        """To the first row."""
        self._start(0)
        return self.next()

    def seek(self, row_id: int) -> bool:
        """To the first row of ``row_id`` or a larger id; over a list of ids, to the first such in the list's order."""
        self._start(row_id)
        return self.next()

    def column(self, i: int):
        """Value ``i`` of the row, by position among ``columns``; None off a row."""
        return None if self.row is None else self.row[i]

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.next():
            yield self.ordinal, self.row
