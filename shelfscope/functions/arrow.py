"""The one vectorised Python function: Spark has no Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

# ASCII, kana, kanji and common Japanese punctuation are their own NFKC form.
_STABLE = r"^[ -~\n\tぁ-ゖァ-ヺ・ー一-鿿、。「」【】]*$"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form; only text that can change is sent to Python."""
    stable = text.rlike(_STABLE)
    return F.when(stable, text).otherwise(_compose(F.when(~stable, text)))


def nfkc_lower(text: Column) -> Column:
    return F.lower(nfkc(text))


def with_nfkc_lower(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add the NFKC lower-case forms of texts that cost something to make; each text is made once."""
    made = {f"_of_{name}": text for name, text in texts.items()}
    return df.withColumns(made).withColumns({n: nfkc_lower(F.col(f"_of_{n}")) for n in texts}).drop(*made)


def register(spark: SparkSession) -> None:
    """Make the function callable from SQL text."""
    spark.udf.register("nfkc", _compose)
