"""Operation logs and plans kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.plans.organize import ACTION


def read_history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines of operations, newest first; lines that are no such record are skipped."""
    df = spark.read.schema(schema.HISTORY).option("mode", "DROPMALFORMED").json(path).where(F.col("entry_id").isNotNull())
    df = df.orderBy(F.desc("logged_at"), "entry_id")
    return df if limit is None else df.limit(limit)


def append_history(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_plan(actions: DataFrame, folder: str, plan_id: str, description: str) -> None:
    """Keep a plan for review: its actions as JSON lines below ``folder/plan_id``, however many there are."""
    rows = actions.select(F.lit(plan_id).alias("plan_id"), F.current_timestamp().alias("created_at"), F.lit(description).alias("description"), *(c.split()[0] for c in ACTION.split(", ")))
    rows.write.mode("errorifexists").json(f"{folder.rstrip('/')}/{plan_id}")


def read_plans(spark: SparkSession, folder: str) -> DataFrame:
    """The actions of all plans of a folder; lines that are no such action are skipped."""
    layout = f"plan_id string, created_at timestamp, description string, {ACTION}"
    df = spark.read.schema(layout).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(folder)
    return df.where(F.col("plan_id").isNotNull() & F.col("action").isNotNull())


def summarize_plans(plans: DataFrame) -> DataFrame:
    """Per plan: when it was made, what it is, and how many actions of each kind."""
    n = lambda kind: F.sum((F.col("action") == kind).cast("long")).alias(kind)
    return plans.groupBy("plan_id").agg(F.max("created_at").alias("created_at"), F.max("description").alias("description"), n("mkdir"), n("move"), n("delete"))
