"""Packed unit keys: ``work * chapter_radix * ordinal_radix + chapter * ordinal_radix + ordinal``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyLayout:
    """Radices of the packed key. Ascending keys are reading order."""

    chapter_radix: int = 1_000
    ordinal_radix: int = 1_000

    @property
    def work_radix(self) -> int:
        return self.chapter_radix * self.ordinal_radix

    @property
    def work_limit(self) -> int:
        """Works from this number on would overflow the key."""
        return (2**63 - 1) // self.work_radix

    def checked(self, work: Column, chapter: Column, ordinal: Column) -> Column:
        """``pack`` that fails on parts that would collide or overflow."""
        fits = self.fits(chapter, ordinal) & (work >= 0) & (work < self.work_limit)
        return F.when(fits, self.pack(work, chapter, ordinal)).otherwise(
            F.raise_error(F.lit("a work, chapter or ordinal does not fit its packed key")).cast("long"))

    def pack(self, work: Column, chapter: Column, ordinal: Column) -> Column:
        return (
            work.cast("long") * self.work_radix
            + chapter.cast("long") * self.ordinal_radix
            + ordinal.cast("long")
        )

    def work(self, key: Column) -> Column:
        return _div(key, self.work_radix)

    def chapter(self, key: Column) -> Column:
        return _div(key % self.work_radix, self.ordinal_radix)

    def ordinal(self, key: Column) -> Column:
        return key % self.ordinal_radix

    def fits(self, chapter: Column, ordinal: Column) -> Column:
        """True where the parts survive a round trip through the packed key."""
        return (
            (chapter >= 0)
            & (chapter < self.chapter_radix)
            & (ordinal >= 0)
            & (ordinal < self.ordinal_radix)
        )


def _div(value: Column, by: int) -> Column:
    """Exact integer division (``/`` would go through double and lose large keys)."""
    return F.call_function("div", value, F.lit(by).cast("long"))


CLASSIC = KeyLayout()
WIDE = KeyLayout(chapter_radix=1_000_000_000, ordinal_radix=100_000)
