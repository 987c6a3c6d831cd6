"""Helpers for pandas frames that go back to Spark."""

from __future__ import annotations

import pandas as pd


def plain_columns(df: pd.DataFrame) -> pd.DataFrame:
    """Texts and other values that are no numbers as objects, the kind that Arrow conversion takes in every case."""
    return df.astype({c: object for c in df.columns if not pd.api.types.is_numeric_dtype(df[c])})
