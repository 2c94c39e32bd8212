"""Named feature groups that can be switched on and off (ablation flags)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

Builder = Callable[[], list[Column]]


class FeatureRegistry:
    """Name -> builder of aliased columns, with the input columns a group makes superfluous.

    ``apply`` puts every enabled group in one projection, however many columns that gives, so the
    analysed plan stays one node. A group whose columns read those of another group names it in
    ``after``; there is then one projection per level.
    """

    def __init__(self) -> None:
        self._groups: dict[str, tuple[Builder, tuple[str, ...], tuple[str, ...]]] = {}

    def add(self, name: str, builder: Builder, drops: Iterable[str] = (), after: Iterable[str] = ()) -> "FeatureRegistry":
        if name in self._groups:
            raise ValueError(f"feature group {name!r} exists already")
        self._groups[name] = (builder, tuple(drops), tuple(after))
        return self

    @property
    def names(self) -> list[str]:
        return list(self._groups)

    def apply(self, df: DataFrame, enabled: Iterable[str] | None = None) -> DataFrame:
        wanted = self.names if enabled is None else list(enabled)
        unknown = [n for n in wanted if n not in self._groups]
        if unknown:
            raise KeyError(f"unknown feature groups: {unknown}")
        drops: list[str] = []
        for level in self._levels(wanted):
            new = {}
            for name in level:
                builder, superseded, _ = self._groups[name]
                for column in builder():
                    new[_alias(df, column)] = column
                drops += superseded
            df = df.withColumns(new)
        return df.drop(*drops)

    def _levels(self, wanted: list[str]) -> list[list[str]]:
        left, done, levels = list(wanted), set(), []
        while left:
            level = [n for n in left if all(d in done or d not in wanted for d in self._groups[n][2])]
            if not level:
                raise ValueError(f"feature groups depend on each other: {left}")
            levels.append(level)
            done.update(level)
            left = [n for n in left if n not in done]
        return levels


def _alias(df: DataFrame, column: Column) -> str:
    return df.select(column).columns[0]
