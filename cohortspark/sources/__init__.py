"""Readers, writers and derived source tables."""

from cohortspark.sources.readers import load_dataframe, read_table, register_tables
from cohortspark.sources.trials_view import TRIALS_SQL, trials_view
from cohortspark.sources.writers import save_dataframe, save_table

__all__ = ["load_dataframe", "read_table", "register_tables", "TRIALS_SQL", "trials_view",
           "save_dataframe", "save_table"]
