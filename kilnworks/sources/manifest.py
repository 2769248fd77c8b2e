"""Pipeline specifications: strict JSON parsing and validation that reports every problem at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.functions.columns import path_problem
from kilnworks.operators import graph

ACTION = T.StructType(
    [T.StructField("name", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("deps", "inputs", "outputs", "command")), T.StructField("env", T.MapType(T.StringType(), T.StringType()))]
)
FIELDS = [f.name for f in ACTION]
INDEXED = T.StructType([T.StructField("idx", T.IntegerType()), *ACTION.fields])


class SpecError(ValueError):
    """problems: (action, rule, detail) of each, all at once."""

    def __init__(self, problems: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{a}: {r}: {d}" for a, r, d in problems))
        self.problems = problems


def parse(text: str) -> list[dict]:
    """The actions of the first JSON value in text. An unknown field or a wrong type is an error; what follows is not read."""
    value, _ = json.JSONDecoder().raw_decode(text.lstrip())
    if not isinstance(value, dict) or set(value) - {"actions"}:
        raise ValueError("a specification is an object with actions alone")
    out = []
    for a in value.get("actions") or []:
        if not isinstance(a, dict) or (extra := sorted(set(a) - set(FIELDS))):
            raise ValueError(f"unknown field {extra[0]!r}" if isinstance(a, dict) else "an action is an object")
        row = {"name": a.get("name", ""), "env": a.get("env") or {}, **{k: a.get(k) or [] for k in ("deps", "inputs", "outputs", "command")}}
        if not isinstance(row["name"], str) or not isinstance(row["env"], dict) or any(not isinstance(v, str) for v in row["env"].values()):
            raise ValueError("wrong type in name or env")
        if any(not isinstance(row[k], list) or any(not isinstance(x, str) for x in row[k]) for k in ("deps", "inputs", "outputs", "command")):
            raise ValueError("deps, inputs, outputs and command are lists of strings")
        out.append(row)
    return out


def actions(spark: SparkSession, specs: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, *(a[f] for f in FIELDS)) for i, a in enumerate(specs)], INDEXED)


def unknown_fields(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """rows with ``unknown``: the top-level keys of a JSON column beyond those allowed. from_json alone would drop them."""
    return rows.withColumn("unknown", F.array_sort(F.array_except(F.json_object_keys(column), F.array(*(F.lit(x) for x in allowed)))))


def repeated(rows: DataFrame, name: str, place: str) -> DataFrame:
    """The rows but the first, by ``place``, of each name. The first ones are found by an aggregate, before any shuffle."""
    first = rows.groupBy(F.col(name).alias("__name")).agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    return rows.join(first, F.col(name) == F.col("__name")).where(F.col(place) > F.col("__first")).drop("__name", "__first", "__n")


def problems(acts: DataFrame) -> DataFrame:
    """action, rule and detail of each problem of actions (idx, name, deps, ...); none if the specification is valid."""

    def rule(df: DataFrame, name: str, detail) -> DataFrame:
        return df.select(F.col("name").alias("action"), F.lit(name).alias("rule"), detail.cast("string").alias("detail"))

    empty = acts.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("action"), F.lit("no actions").alias("rule"), F.lit("").alias("detail"))
    nameless = F.coalesce(F.col("name"), F.lit("")) == ""
    named = acts.where(~nameless)
    deps = named.select("name", F.explode("deps").alias("dep"))
    repeats = repeated(named, "name", "idx")
    found = [
        empty,
        rule(acts.where(nameless), "no name", F.col("idx")),
        rule(repeats, "duplicate name", F.col("idx")),
        rule(named.where("coalesce(size(command), 0) <= 0"), "no command", F.lit("")),
        rule(named.where("coalesce(size(outputs), 0) <= 0"), "no outputs", F.lit("")),
        rule(deps.where("dep = name"), "depends on itself", F.col("dep")),
        rule(graph.unknown_deps(named, deps.where("dep <> name")), "unknown dependency", F.col("dep")),
        rule(named.where(F.exists(F.map_keys("env"), lambda k: F.trim(k) == "")), "blank variable", F.lit("")),
    ]
    for column in ("inputs", "outputs"):
        paths = named.select("name", F.explode(column).alias("path")).withColumn("problem", path_problem(F.col("path"))).where("problem is not null")
        found.append(paths.select(F.col("name").alias("action"), F.concat(F.lit(f"{column}: "), "problem").alias("rule"), F.col("path").alias("detail")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def load(spark: SparkSession, text: str) -> list[dict]:
    """Parse and validate; SpecError holds all problems."""
    specs = parse(text)
    if found := [tuple(r) for r in problems(actions(spark, specs)).orderBy("action", "rule", "detail").collect()]:
        raise SpecError(found)
    return specs


def load_file(spark: SparkSession, path: str) -> list[dict]:
    """load() of a file in any store that Spark reaches; the error tells the file."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        return load(spark, text)
    except SpecError as e:
        e.args = (f"{path}: {e}",)
        raise
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def edges_of(specs: list[dict]) -> dict[str, list[str]]:
    return {a["name"]: list(a["deps"]) for a in specs}
