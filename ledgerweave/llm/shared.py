"""Tables that later steps read again, in the folder all executors share, and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerweave.operators.joins import hot_safe_join
from ledgerweave.sources.shared_folder import ensure_checkpoint_dir, stored

__all__ = ["ensure_checkpoint_dir", "hot_safe_join", "stored", "written"]


def written(df: DataFrame) -> DataFrame:
    """Compute once, write to the checkpoint folder, and go on from the files: for tables of few columns."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
