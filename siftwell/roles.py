"""Which column of a table plays which part."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """Columns of one table by the part they play.

    ``extra`` maps further standard names to source columns.
    """

    id: str = "id"
    name: str | None = "name"
    status: str | None = None
    timestamps: tuple[str, ...] = ()
    numerics: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    extra: Mapping[str, str] = field(default_factory=dict)

    def standard_to_source(self) -> dict[str, str]:
        named = {"id": self.id, "name": self.name, "status": self.status}
        return {**{k: v for k, v in named.items() if v}, **self.extra}


def to_standard(df: DataFrame, roles: Roles) -> DataFrame:
    """Rename source columns to their standard names; other columns stay."""
    pairs = roles.standard_to_source().items()
    return df.withColumnsRenamed({src: std for std, src in pairs if src in df.columns})


def to_source(df: DataFrame, roles: Roles) -> DataFrame:
    """Undo :func:`to_standard`."""
    pairs = roles.standard_to_source().items()
    return df.withColumnsRenamed({std: src for std, src in pairs if std in df.columns})
