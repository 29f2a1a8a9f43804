"""Normalisation: strict casts, projection casts, newline removal, UTF-8
repair, category trim, complete-row filter, de-duplication.  All are
per-row expressions except ``drop_duplicates`` (one aggregation with
map-side combine)."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K


def _check(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the DataFrame: {missing}")


def cast_schema(df: DataFrame, dtypes: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns, keep the others; a missing column raises."""
    _check(df, list(dtypes))
    return df.withColumns({c: F.col(c).cast(t) for c, t in dtypes.items()})


def cast_project(df: DataFrame, dtypes: Mapping[str, str]) -> DataFrame:
    """Select only the listed columns, cast."""
    _check(df, list(dtypes))
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in dtypes.items()])


def drop_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; unlike ``DataFrame.drop`` an unknown name raises."""
    _check(df, columns)
    return df.drop(*columns)


def remove_newlines(c: Column) -> Column:
    """``\\n`` becomes a space; ``\\r`` stays."""
    return F.translate(c, "\n", " ")


def repair_utf8(c: Column) -> Column:
    """Drop invalid UTF-8 sequences (every row checked, no sampling); a
    replacement character that the text itself holds stays."""
    mark, held = F.lit("\ufffd"), F.lit("\ufdd0")  # a noncharacter stands in meanwhile
    dropped = F.replace(F.make_valid_utf8(F.replace(c, mark, held)), mark, F.lit(""))
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(dropped, held, mark))


def trim_category(df: DataFrame, excluded: str = K.EXCLUDED_CATEGORY, column: str = "category") -> DataFrame:
    """Drop rows of the excluded category; NULL categories are kept."""
    return df.where(~F.col(column).eqNullSafe(F.lit(excluded)))


def normalize(df: DataFrame, dtypes: Mapping[str, str] | None = None, text_column: str = "content",
              excluded: str = K.EXCLUDED_CATEGORY) -> DataFrame:
    out = df.withColumn(text_column, repair_utf8(remove_newlines(F.col(text_column))))
    if dtypes:
        out = cast_schema(out, dtypes)
    return trim_category(out, excluded)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset) if subset else None)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def counts_with_total(df: DataFrame, key: str = "category") -> DataFrame:
    """Row count per key plus a ``Total`` row, in one rollup aggregation."""
    g = df.rollup(key).agg(F.count(F.lit(1)).alias("count"), F.grouping(key).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col(key)).alias(key), "count")
