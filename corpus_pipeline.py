"""The corpus pipeline over documents: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import mixing, near_dups, packing, secrets, toxicity, workspace
from kilnworks.llm.queries import BYTES

#: None: no stage can be said in SQL. tests/llm holds the rows of run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold, unchanged.

    A null or empty text scores as the model's intercept, repeated rows alike; columns may have any names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs, model, names=("__score", "__predicted"))
    return scored.where("__predicted = 0").select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and near-equal texts: the one of the least doc_id, a null one being the greatest.

    Null and empty texts are equal; of repeated rows one stays.
    """
    return near_dups.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts, weak ones only where linked, are replaced by a mark. A null text stays null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: texts repeated or shortened to the words taken; those not taken go.

    A document without words stays as it is, repeated rows are taken apart from each other, a null source is one of its own.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null or empty text is its end id, a null id comes last."""
    pieces = packing.pack_documents(docs.select("doc_id", "text"), BYTES, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each but the last written as Parquet in the shared folder and read again."""
    docs = workspace.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = workspace.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
