"""A registry of stages whose outputs are tables keyed by configuration.

A stage that has run with the same configuration is read, not run again; a
stage's table appears only when it is whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomvec.sources.sinks import config_digest, write_parquet


@dataclass
class Stage:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Runner:
    spark: SparkSession
    folder: str
    config: dict
    stages: dict[str, Stage] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    def add(self, name: str, run: Callable[..., DataFrame], *needs: str) -> None:
        missing = [n for n in needs if n not in self.stages]
        if missing:
            raise ValueError(f"{name} needs {missing}")
        self.stages[name] = Stage(name, run, needs)

    def path(self, name: str) -> str:
        stage = self.stages[name]
        lock = config_digest({"name": name, "config": self.config, "needs": [self.path(n) for n in stage.needs]})
        return f"{self.folder}/{name}-{lock[:16]}"

    def table(self, name: str, force: bool = False) -> DataFrame:
        stage, path = self.stages[name], self.path(name)
        jvm = self.spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if force or not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            write_parquet(stage.run(self.spark, self.config, *[self.table(n) for n in stage.needs]), path)
            self.ran.append(name)
        return self.spark.read.parquet(path)
