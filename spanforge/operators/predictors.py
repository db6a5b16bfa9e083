"""Named predictors, and results that grow by what they lack."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .normalize import keep_ontology

#: Documents to mentions, and relations or None.
Predictor = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def results(spark: SparkSession, folder: str, name: str, keys: list[str]) -> DataFrame | None:
    """Stored rows of one kind whose run was finished for their keys; null before the first run."""
    rows, done = _read(spark, f"{folder}/{name}"), _read(spark, f"{folder}/done")
    return None if rows is None or done is None else rows.join(done, [*keys, "run"], "left_semi").drop("run")


def append_missing(todo: DataFrame, keys: list[str], folder: str, work: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Works on the rows of ``todo`` whose keys have no result in ``folder`` yet, appends what
    comes out (name to rows with the keys) and returns all results.

    The list of finished keys is written last and names the run: what a run that was lost left
    behind is never read, and its keys are done again. One run at a time writes to a folder."""
    spark, run = todo.sparkSession, uuid.uuid4().hex
    done = _read(spark, f"{folder}/done")
    rest = todo if done is None else todo.join(done.select(*keys).distinct(), keys, "left_anti")
    made = work(rest)
    for name, rows in made.items():
        rows.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/{name}")
    rest.select(*keys).distinct().withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/done")
    return {name: results(spark, folder, name, keys) for name in made}


class Predictors:
    """Predictors by name, each a function of documents (doc_id, text).

    types and relation_types are the ontology: mentions of other types go from every prediction,
    and relations of other types or without both ends. A frozen predictor's stored results may be
    read, but not be added to."""

    def __init__(self, types: DataFrame, relation_types: DataFrame):
        self.types, self.relation_types = types, relation_types
        self._known: dict[str, Predictor] = {}
        self._frozen: set[str] = set()

    def register(self, name: str, predictor: Predictor, frozen: bool = False) -> None:
        """Adds a predictor; a name that is taken is an error."""
        if name in self._known:
            raise ValueError(f"predictor {name} is registered already")
        self._known[name] = predictor
        if frozen:
            self._frozen.add(name)

    def names(self) -> list[str]:
        return sorted(self._known)

    def predict(self, name: str, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mentions and relations of one predictor, with the column ``method``."""
        if name not in self._known:
            raise KeyError(f"no predictor {name}; there are {', '.join(self.names())}")
        mentions, relations = self._known[name](docs)
        none = relations is None
        if none:
            kind = docs.schema["doc_id"].dataType.simpleString()
            relations = docs.sparkSession.createDataFrame([], f"doc_id {kind}, id string, type string, head string, tail string, ev_start long, ev_end long")
        m, r = keep_ontology(mentions, relations, self.types, self.relation_types)
        r = relations if none else r  # without relations there are no ends to look up: the predictor need not run for them
        return m.withColumn("method", F.lit(name)), r.withColumn("method", F.lit(name))

    def predict_all(self, docs: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The union over predictors, as the scores take it (extra key ``method``)."""
        sides = [self.predict(n, docs) for n in (self.names() if names is None else names)]
        out = list(sides[0])
        for side in sides[1:]:
            out = [a.unionByName(b, allowMissingColumns=True) for a, b in zip(out, side)]
        return out[0], out[1]

    def run(self, name: str, docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        """Predicts the documents that the stored results of the method lack, and returns all."""
        if name in self._frozen:
            raise RuntimeError(f"predictor {name} is frozen: its results are not added to")

        def work(rest: DataFrame) -> dict[str, DataFrame]:
            m, r = self.predict(name, rest)
            return {"mentions": m, "relations": r}

        out = append_missing(docs, ["doc_id"], f"{folder}/{name}", work)
        return out["mentions"], out["relations"]
