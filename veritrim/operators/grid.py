"""The grid of samples, models and modes, and what the log already holds of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.schemas import CELL_KEY, Settings


def conditions(settings: Settings = Settings()) -> Column:
    """All ``(model_name, requested_mode)`` pairs of a run as one constant array."""
    return F.array(
        *[
            F.struct(F.lit(model).alias("model_name"), F.lit(mode).alias("requested_mode"))
            for model in settings.models
            for mode in settings.modes
        ]
    )


def condition_grid(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every sample under every condition; row-local, without a join."""
    return samples.select("*", F.inline(conditions(settings)))


def logged_cells(log: DataFrame) -> DataFrame:
    """Cells in the log, as often as it has them; a log without the requested mode is keyed by the applied one."""
    mode = F.col("requested_mode") if "requested_mode" in log.columns else F.col("compressed")
    return log.select("id", "dataset", "model_name", mode.cast("int").alias("requested_mode"))


def pending_cells(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Cells that are not in the log yet."""
    return grid.join(logged_cells(log), list(CELL_KEY), "left_anti")


def skipped_cells(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Cells that a run leaves out because the log has them."""
    return grid.join(logged_cells(log), list(CELL_KEY), "left_semi")
