"""Blocks in order, with their artifacts, errors and provenance as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Block = Callable[[DataFrame], DataFrame]


@dataclass
class ErrorLog:
    """What failed on the driver while plans were built; policy: raise, warn, collect or silent."""

    policy: str = "raise"
    rows: list[tuple[str, str, str]] = field(default_factory=list)

    def run(self, name: str, f: Callable[[], DataFrame], otherwise: DataFrame | None = None) -> DataFrame | None:
        try:
            return f()
        except Exception as e:
            if self.policy == "raise":
                raise
            if self.policy in ("warn", "collect"):
                self.rows.append((name, type(e).__name__, str(e)[:500]))
            return otherwise

    def table(self, spark: SparkSession, most: int = 50) -> DataFrame:
        """The first errors and a line that says how many more there are."""
        rows = self.rows[:most] + ([("", "more", f"{len(self.rows) - most} more")] if len(self.rows) > most else [])
        return spark.createDataFrame(rows, "block string, error string, message string")


def run_blocks(signal: DataFrame, blocks: Sequence[tuple[str, Block]], log: ErrorLog | None = None) -> tuple[DataFrame, list[tuple[int, str]]]:
    """The signal through all blocks (a block that fails under a lenient policy is passed over), and what was applied."""
    log, done = log or ErrorLog(), []
    for k, (name, block) in enumerate(blocks):
        out = log.run(name, lambda b=block, s=signal: b(s))
        if out is not None:
            signal = out
            done.append((k, name))
    return signal, done


def provenance(spark: SparkSession, done: Sequence[tuple[int, str]], settings: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(done), "step int, block string")
    return rows.withColumn("settings", F.to_json(F.create_map(*[F.lit(x) for kv in settings.items() for x in kv])) if settings else F.lit("{}"))


#: Views by preference, and their other names.
VIEW_ORDER = ("bipolar", "laplacian", "wm_ref", "car", "original")
VIEW_NAMES = {"car_global": "car", "car-by-shaft": "car", "car_by_shaft": "car", "common_average": "car", "avg": "car", "lap": "laplacian", "lapp": "laplacian", "bip": "bipolar", "wm": "wm_ref"}


def choose_view(available: Sequence[str], wanted: str | None = None) -> tuple[str, str | None]:
    """(view, warning): the wanted one (or what its alias means, in any case; original if none is wanted), else the first available in order of preference."""
    name = (wanted or "").strip().lower() or "original"
    name = VIEW_NAMES.get(name, name)
    if name in available:
        return name, None
    for v in VIEW_ORDER:
        if v in available:
            return v, f"view {wanted or name} is not available, {v} is used"
    raise ValueError("no view is available")


def stack_views(views: dict[str, DataFrame]) -> DataFrame:
    """All views in one table with a view column."""
    out = None
    for name, df in views.items():
        part = df.select("recording", "channel", "t", "x").withColumn("view", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
