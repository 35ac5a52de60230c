"""Column functions on backslash-separated paths, prefixes and identifiers (F1-F6, P1, P2, U128 hex)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\\"


def path_key(path: Column | str) -> Column:
    """Case-insensitive key of a path: upper-casing also equates contextual letter forms, lower-casing does not."""
    return F.upper(path if isinstance(path, Column) else F.col(path))


def is_under(path: Column, prefix: Column) -> Column:
    """Strictly below prefix: a separator at the boundary and at least one character behind it."""
    return (F.length(path) > F.length(prefix) + 1) & F.startswith(F.upper(path), F.concat(F.upper(prefix), F.lit(SEP)))


def within(path: Column, prefix: Column) -> Column:
    return (F.upper(path) == F.upper(prefix)) | is_under(path, prefix)


def child_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit(SEP), name))


def rewrite_prefix(path: Column, old: Column, new: Column) -> Column:
    """path with its leading old replaced by new; meant for rows where within() holds."""
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def base_name(path: Column) -> Column:
    """The last segment; a separator at the end does not count."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\$", ""), r"\\"), -1)


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory of a path, so that prefix joins become equi-joins."""
    parts = F.split(path, r"\\")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEP))


def hex_id(col: Column) -> Column:
    """Canonical 128-bit identifier: lower-case hex without leading zeros; null if it is not hex of up to 32 digits."""
    low = F.lower(F.trim(col))
    return F.when(low.rlike("^0*[0-9a-f]{1,32}$"), F.regexp_replace(low, "^0+(?=.)", ""))


@dataclass(frozen=True)
class IgnoreRules:
    """Prefix lists for directory and file names; blank prefixes are dropped, others trimmed."""

    dirs: tuple[str, ...] = ()
    files: tuple[str, ...] = ()

    @staticmethod
    def of(dirs: Iterable[str] | None, files: Iterable[str] | None) -> IgnoreRules:
        clean = lambda xs: tuple(x.strip() for x in xs or () if x and x.strip())
        return IgnoreRules(clean(dirs), clean(files))

    @property
    def any(self) -> bool:
        return bool(self.dirs or self.files)

    @staticmethod
    def _hit(name: Column, prefixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | F.startswith(F.upper(name), F.upper(F.lit(p)))
        return out

    def dir_name(self, name: Column) -> Column:
        return self._hit(name, self.dirs)

    def file_name(self, name: Column) -> Column:
        return self._hit(name, self.files)

    def path(self, path: Column, is_dir: bool = False) -> Column:
        """Whether any parent segment, or the last segment by its own list, is ignored. The empty path never is."""
        if not self.any:
            return F.lit(False)
        parts = F.split(path, r"\\")
        parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
        last = F.element_at(parts, -1)
        inside = F.exists(parents, self.dir_name) if self.dirs else F.lit(False)
        return F.when(path == "", False).otherwise(inside | (self.dir_name(last) if is_dir else self.file_name(last)))
