"""What the training-data operators share: scratch tables, ids and folds.

Every text operator works on whole rows. A null text counts as an empty one,
a null id stays null in the result, repeated rows give repeated result rows,
and columns other than the ones an operator names are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.sources.scratch import fresh


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a scratch table in the shared folder, in folders by column ``by`` if one is given, and read it back."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def unused(name: str, columns) -> str:
    """``name``, or with underscores behind it, so that no column of ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(lengths, budget: int):
    """Cut consecutive items into (start, stop) runs of about ``budget`` units, one item at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
