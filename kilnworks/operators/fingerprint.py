"""Digests of tables and nodes: what decides whether a node must run."""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import importlib.util
import inspect
import platform
import sys
import types

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "2"
#: Settings that change what a query means and count with their defaults; any other of spark.sql that is set counts as well,
SETTINGS = ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.caseSensitive", "spark.sql.timestampType", "spark.sql.legacy.timeParserPolicy")
#: but for those that only say how it is run.
HOW = ("spark.sql.adaptive.", "spark.sql.shuffle.", "spark.sql.files.", "spark.sql.autoBroadcast", "spark.sql.warehouse.", "spark.sql.execution.", "spark.sql.ui.", "spark.sql.debug.", "spark.sql.artifact.", "spark.sql.codegen.", "spark.sql.sources.parallel", "spark.sql.runSQLOnFiles", "spark.sql.catalogImplementation", "spark.sql.streaming.", "spark.sql.hive.")
#: Libraries that a callable may use without naming them.
LIBRARIES = ("numpy", "pandas", "pyarrow")


def canonical(c: Column, kind: T.DataType) -> Column:
    """A form whose JSON is equal for equal values: one NaN, no -0.0, binary as hex, map entries in order."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit("NaN")).when(c == 0, F.lit("0")).otherwise(F.hex(c.cast("double").cast("string")))
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)  # JSON would keep milliseconds
    if isinstance(kind, T.AtomicType) and not isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
        return c.cast("string")  # dates, times and intervals, to the microsecond
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(canonical(e["key"], kind.keyType).alias("k"), canonical(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(canonical(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def row_digests(df: DataFrame) -> DataFrame:
    """One column ``h``: the SHA-256 of each row's canonical JSON, nulls written out."""
    names = sorted(df.columns)
    row = F.struct(*(canonical(F.col(f"`{n}`"), df.schema[n].dataType).alias(f"c{i}") for i, n in enumerate(names)))
    return df.select(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("h"))


def table_digest(df: DataFrame) -> str:
    """Of the rows as a bag and the schema; the order of rows, files and columns does not matter.

    Each row's SHA-256 gives four 64-bit numbers, and the table's digest is of their exact sums over all rows and the number of
    rows. Sums are taken before the shuffle, so whatever the table's size and its most common row, a task sends one row.
    """
    lanes = [F.xxhash64(F.lit(i), "h").cast("decimal(38,0)") for i in range(4)]
    r = row_digests(df).agg(F.count("*").alias("n"), *(F.sum(x).cast("string").alias(f"s{i}") for i, x in enumerate(lanes))).first()
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
    return hashlib.sha256("\n".join([schema, *map(str, r)]).encode()).hexdigest()


def code_facts(f, seen: set[int] | None = None) -> list[str]:
    """What a callable does: its code, defaults, closure and the globals that it names, and theirs.

    A value that cannot be told (an open file, an object of one's own) raises TypeError, for a key must hold all that counts.
    """
    seen = set() if seen is None else seen
    if id(f) in seen:
        return ["seen"]
    seen.add(id(f))

    def value(x) -> list[str]:
        if x is None or isinstance(x, (bool, int, float, complex, str, bytes)):
            return [f"{type(x).__name__}:{x!r}"]
        if isinstance(x, (list, tuple)):
            return [type(x).__name__, str(len(x)), *(v for y in x for v in value(y))]
        if isinstance(x, (set, frozenset)):
            return ["set", *sorted("|".join(value(y)) for y in x)]
        if isinstance(x, dict):
            return ["dict", *sorted("|".join([*value(k), *value(v)]) for k, v in x.items())]
        if isinstance(x, T.DataType):
            return [x.json()]
        if isinstance(x, types.CodeType):
            return [x.co_name, x.co_code.hex(), *value(x.co_consts), *map(str, (x.co_names, x.co_varnames, x.co_freevars, x.co_flags, x.co_argcount))]
        if isinstance(x, types.ModuleType):
            return [x.__name__, str(getattr(x, "__version__", ""))]
        return code_facts(x, seen)

    if isinstance(f, functools.partial):
        return ["partial", *code_facts(f.func, seen), *value(f.args), *value(f.keywords)]
    if isinstance(f, types.MethodType):
        return ["method", *code_facts(f.__func__, seen), *value(f.__self__)]
    if isinstance(f, type):
        own = f.__module__.split(".")[0]
        if own in sys.stdlib_module_names or own in ("pyspark", *LIBRARIES):
            return [f"{f.__module__}.{f.__qualname__}"]
        return ["class", inspect.getsource(f)]
    if not isinstance(f, types.FunctionType):
        if callable(f) and getattr(f, "__module__", None) and hasattr(f, "__qualname__"):
            return [f"{f.__module__}.{f.__qualname__}"]  # built in
        raise TypeError(f"a node's callable rests on {type(f).__name__}, which no key can tell: pass it as an input or in env")
    if f.__module__ and f.__module__.split(".")[0] in ("pyspark", *LIBRARIES, *sys.stdlib_module_names) and f.__module__ != "__main__":
        return [f"{f.__module__}.{f.__qualname__}"]
    out = ["function", *value(f.__code__), *value(f.__defaults__), *value(f.__kwdefaults__)]
    for name, cell in zip(f.__code__.co_freevars, f.__closure__ or (), strict=True):
        out += [name, *(value(cell.cell_contents) if _filled(cell) else ["empty"])]
    for name in sorted(_names(f.__code__)):
        if name in f.__globals__:
            out += [name, *value(f.__globals__[name])]
    return out


def _filled(cell) -> bool:
    try:
        cell.cell_contents
    except ValueError:
        return False
    return True


def _names(code: types.CodeType) -> set[str]:
    return set(code.co_names).union(*(_names(c) for c in code.co_consts if isinstance(c, types.CodeType)))


def engine_digest(spark: SparkSession, body) -> str:
    """What runs a node: versions, settings that change meaning, and what a callable body does."""
    facts = [VERSION, pyspark.__version__, spark.version, *(f"{k}={spark.conf.get(k)}" for k in SETTINGS)]
    facts += sorted(f"{k}={v}" for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and not k.startswith(HOW))
    if callable(body):
        facts += [sys.version.split()[0], *(f"{m}={importlib.metadata.version(m)}" for m in LIBRARIES if importlib.util.find_spec(m)), *code_facts(body)]
    return hashlib.sha256("\n".join(f"{len(x)} {x}" for x in facts).encode()).hexdigest()


def frame(tag: str, value: str) -> bytes:
    raw = value.encode()
    return f"{tag} {len(raw)}\n".encode() + raw + b"\n"


def node_key(command: list[str], env: dict[str, str], engine: str, inputs: dict[str, str], outputs: list[str]) -> str:
    """SHA-256 of framed records. The order of inputs, outputs and env does not count, that of the command does; a node's
    name and dependencies are no part of it."""
    stream = [frame("version", VERSION), frame("platform", f"{platform.system().lower()}/{platform.machine()}"), *(frame("arg", a) for a in command)]
    stream += [frame("env", f"{k}={env[k]}") for k in sorted(env)] + [frame("tool", engine)]
    stream += [frame("input", f"{k} {inputs[k]}") for k in sorted(inputs)] + [frame("output", o) for o in sorted(outputs)]
    return hashlib.sha256(b"".join(stream)).hexdigest()


def file_digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file; a missing one is an error. No path, no work. A file must fit in a task, some 2 GB at most."""
    if not paths:
        return {}
    found = spark.read.format("binaryFile").load(sorted(set(paths))).select("path", F.sha2("content", 256).alias("d")).collect()
    by = {r.path.removeprefix("file:"): r.d for r in found}
    return {p: by["/" + p.removeprefix("file:").lstrip("/")] if p.startswith(("/", "file:")) else by[p] for p in paths}
