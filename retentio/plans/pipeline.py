"""Raw → staging → star, built lazily for one input location.

Layers are persisted the way a warehouse persists them: the raw landing table
is written once together with the staging rules each row breaks (a Parquet
table in the shared checkpoint folder), and every report reads it instead of
re-deriving it.  Staging is a narrow projection of the rows that break none;
the star freezes its own numbered staging and dimensions.

``write_warehouse`` saves the layers under a path of the caller's as a whole:
until all of them are written, readers see the version before.
``open_warehouse`` reads them back in any later session.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.ordering import checkpointed
from ..session import scratch_path
from ..sources.subscribers import derive_raw
from .staging import accepted, check_raw, stg_clean, stg_quarantine
from .star import Star

WAREHOUSE_TABLES = ("raw", "quarantine", "staging", "dim_customer", "dim_contract", "dim_service_plan", "dim_tenure",
                    "fact_subscription", "cube_cells", "cube_charges")


#: bytecode beyond which HotSpot leaves a method to its interpreter; Spark's default lets whole stages grow past it
HUGE_METHOD = "8000"


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None, raw: DataFrame | None = None):
        if raw is None and sf_dir is None:
            raise ValueError("give sf_dir or a raw DataFrame")
        self.spark = spark
        # a stage of some dozen expressions a row (deriving and checking raw) is then run as several compiled methods;
        # the session keeps the setting, which plans are made by when a query runs
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
        self.sf_dir = sf_dir
        self._raw = raw

    @cached_property
    def checked(self) -> DataFrame:
        """Raw rows with the staging rules they break, frozen."""
        return checkpointed(check_raw(self._raw if self._raw is not None else derive_raw(self.spark, self.sf_dir)))

    @cached_property
    def raw(self) -> DataFrame:
        from ..sources.subscribers import RAW_COLUMNS

        return self.checked.select(*RAW_COLUMNS)

    @cached_property
    def raw_types(self) -> DataFrame:
        """Types of the raw columns by their values, frozen: one row a column."""
        from .inference import column_types

        return checkpointed(column_types(self.raw))

    @cached_property
    def quarantine(self) -> DataFrame:
        return stg_quarantine(self.checked)

    @cached_property
    def staging(self) -> DataFrame:
        return stg_clean(accepted(self.checked))

    @cached_property
    def star(self) -> Star:
        return Star(self.staging)

    def write_warehouse(self, path: str) -> None:
        """Raw, quarantine, staging, the star and its cube as a new version of the warehouse at ``path``."""
        from .warehouse import save_version

        layers = {"raw": self.raw, "quarantine": self.quarantine, "staging": self.staging, **self.star.tables(), **self.star.cube.tables()}
        save_version(self.spark, path, {name: layers[name] for name in WAREHOUSE_TABLES})

    @cached_property
    def saved(self) -> str:
        """A warehouse of this pipeline in the scratch folder."""
        path = scratch_path(self.spark, "retentio-warehouse")
        self.write_warehouse(path)
        return path


def open_warehouse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest complete version that ``write_warehouse`` saved under ``path``, by name."""
    from .warehouse import current_version

    folder = current_version(spark, path)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in WAREHOUSE_TABLES}
