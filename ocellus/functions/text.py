"""Text for logs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.functions.scalars import ASCII_FORMS


@F.pandas_udf(T.StringType())  # a type object: this module is imported before any session exists
def ascii_log_text(text: pd.Series) -> pd.Series:
    """ASCII form: known symbols by table, others decomposed, the rest dropped; null gives an empty text."""
    table = str.maketrans(ASCII_FORMS)

    def one(x):
        if x is None:
            return ""
        return unicodedata.normalize("NFKD", x.translate(table)).encode("ascii", "ignore").decode()

    return text.map(one, na_action=None)
