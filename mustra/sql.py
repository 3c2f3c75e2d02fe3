"""An engine's data set for Spark SQL: views of its tables, cohorts by name, and table functions of who holds what."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mustra.engine import CohortEngine
from mustra.request import QueryRequest

_HOLDERS = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_attr STRING, of_value STRING, first INT DEFAULT NULL, last INT DEFAULT NULL)
RETURNS TABLE (person_id BIGINT)
RETURN SELECT DISTINCT f.person_id FROM {facts} AS f
  WHERE f.attr = of_attr AND CASE WHEN of_value LIKE '_%*' THEN startswith(f.value, left(of_value, length(of_value) - 1)) ELSE f.value = of_value END
    AND (first IS NULL OR last IS NULL OR f.yyyymm BETWEEN first AND last)
"""


class CohortSql:
    """Registers the views ``facts``, ``persons`` and ``words`` and the function ``holders(attr, value[, first, last])``, whose value may end in ``*``,
    under names with a prefix. What SQL then says of them is planned like any other query.
    """

    def __init__(self, engine: CohortEngine, prefix: str = ""):
        self.engine, self.prefix, self.spark = engine, prefix, engine.facts.sparkSession
        known = engine.facts.select("attr", "value").distinct() if engine.words is None else engine.words
        for name, table in (("facts", engine.facts), ("persons", engine.persons), ("words", known)):
            table.createOrReplaceTempView(prefix + name)
        self.spark.sql(_HOLDERS.format(name=f"{prefix}holders", facts=f"{prefix}facts"))

    def define(self, name: str, request: QueryRequest) -> DataFrame:
        """A view ``name`` (person_id) of a request's cohort, by the engine's own planner."""
        ids = self.engine.cohort(request)
        ids.createOrReplaceTempView(self.prefix + name)
        return ids

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def close(self) -> None:
        """Drops the views and the function."""
        for name in ("facts", "persons", "words"):
            self.spark.catalog.dropTempView(self.prefix + name)
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {self.prefix}holders")
