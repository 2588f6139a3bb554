"""What a registered query reads: the given tables and the visit cohort derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.operators.calculate import calculate_wide, to_long
from glucoframe.session import cut_lineage, tune
from glucoframe.sources import visits


class Source:
    """Tables of one folder. Sets the two runtime settings of session.tune on the session it is given; they change no
    result, and stay set."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return visits.table(self.spark, self.folder, name)

    def cohort(self) -> DataFrame:
        return visits.cohort(self.spark, self.folder)

    def fixed_cohort(self) -> DataFrame:
        """The cohort written once to the shared folder, for operators that read it more than once."""
        return cut_lineage(self.cohort())

    def computed(self, ids: list[str]) -> DataFrame:
        """Wide values of some indices with visit_id and sex, for operators that read them once."""
        return calculate_wide(self.cohort(), ids=ids, keep=["visit_id", "sex"])

    def values(self, ids: list[str]) -> DataFrame:
        """The same, written once to the shared folder."""
        return cut_lineage(self.computed(ids))

    def long_values(self, ids: list[str]) -> DataFrame:
        return to_long(self.values(ids), ids, ["visit_id", "sex"])


class PreparedSource(Source):
    """The same over a cohort that was written beforehand (used by the bench)."""

    def __init__(self, spark: SparkSession, folder: str, cohort_path: str):
        super().__init__(spark, folder)
        self.cohort_path = cohort_path

    def cohort(self) -> DataFrame:
        return self.spark.read.parquet(self.cohort_path)

    fixed_cohort = cohort


@dataclass(frozen=True)
class Query:
    run: Callable[[Source], DataFrame]
    sql: str | None = None


def rounded(value: Column | str, decimals: int = 6) -> Column:
    """Half-up on the scaled value: the one rounding that both engines do alike."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**decimals)
    return F.floor(value * scale + 0.5).cast("double") / scale


def rounded_sql(value: str, decimals: int = 6) -> str:
    scale = f"1E{decimals}"
    return f"CAST(floor(({value}) * {scale} + 5E-1) AS DOUBLE) / {scale}"
