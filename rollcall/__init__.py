"""Entity resolution and data quality over Spark DataFrames."""

from rollcall.session import checkpoint_dir, get_session, tune

__all__ = ["checkpoint_dir", "get_session", "tune"]
