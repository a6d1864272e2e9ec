"""A facade of the engine: metadata, queries, placement."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans import placement
from .plans.analysis import PlanAnalysis, analyse
from .plans.scheduling import Scheduler, Slots
from .sources.catalog import Catalog


class Service:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, cluster_slots: int = 4, elastic_slots: int = 4):
        self.spark, self.catalog = spark, catalog or Catalog()
        self.scheduler = Scheduler(Slots(cluster_slots, elastic_slots))

    def schemas(self) -> list[str]:
        return sorted(self.catalog.schemas)

    def tables(self, schema: str) -> list[str]:
        return sorted(self.catalog.schemas[schema])

    def columns(self, schema: str, table: str) -> dict[str, str]:
        return self.catalog.table(schema, table).columns

    def views(self, schema: str) -> dict[str, str]:
        return self.catalog.views[schema]

    def use(self, schema: str) -> None:
        self.catalog.register(self.spark, schema)

    def submit(self, sql: str, hint: str = "IMMEDIATE", limit: int = 1000) -> int:
        """A token; what may start now is run at once."""
        token = self.scheduler.submit(sql, hint, limit)
        self.pump()
        return token

    def pump(self) -> None:
        for q in self.scheduler.step():
            self.scheduler.run(self.spark, q)

    def status(self, token: int) -> str:
        return self.scheduler.queries[token].status

    def result(self, token: int) -> tuple[list[str], list[list[str | None]]]:
        q = self.scheduler.queries[token]
        if q.status == "FAILED":
            raise RuntimeError(q.error)
        return q.columns, q.rows or []

    def analyse(self, sql: str) -> PlanAnalysis:
        return analyse(self.spark, sql)

    def place(self, sql: str) -> str:
        return placement.place(self.analyse(sql).tables, self.catalog.peers)

    def workload(self, statements: list[str], repeat: int = 1) -> list[tuple[str, float]]:
        """Runs each statement to its end and gives its seconds."""
        import time

        out = []
        for sql in statements * repeat:
            began = time.monotonic()
            self.spark.sql(sql).write.format("noop").mode("overwrite").save()
            out.append((sql, time.monotonic() - began))
        return out
