"""Extensions: functions that add evidence, each apart from the others' failures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from auditlake.operators.ordering import keep_first

Scanner = Callable[[DataFrame], DataFrame]


class Registry:
    """Scanners by id, in the order they came; the first of an id stays."""

    def __init__(self) -> None:
        self._scanners: dict[str, Scanner] = {}

    def register(self, id_: str, scanner: Scanner) -> bool:
        return self._scanners.setdefault(id_, scanner) is scanner

    def unregister(self, id_: str) -> bool:
        return self._scanners.pop(id_, None) is not None

    def ids(self) -> list[str]:
        return list(self._scanners)

    def clear(self) -> None:
        self._scanners.clear()

    def run(self, subjects: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
        """(the union of all evidence, the first of each key kept; errors by id). A scanner whose plan can't be made is left out."""
        parts, failed = [], {}
        for id_, scan in self._scanners.items():
            try:
                parts.append(scan(subjects))
                parts[-1].schema  # analysis happens here
            except (PySparkException, ValueError, KeyError, TypeError) as e:
                failed[id_] = str(e).split("\n")[0]
        if not parts:
            return None, failed
        return keep_first(reduce(lambda a, b: a.unionByName(b), parts), keys, order), failed
