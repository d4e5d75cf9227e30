"""Exchange with a batch model service as files of JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.api_pages import source_place

# The request's method and address, and the field names of requests and responses.
METHOD = "POST"
URL = "/v1/chat/completions"
REQUEST_SCHEMA = """custom_id STRING, method STRING, url STRING,
    body STRUCT<model: STRING, messages: ARRAY<STRUCT<role: STRING, content: STRING>>>"""
RESPONSE_SCHEMA = """custom_id STRING, response STRUCT<body: STRUCT<
    choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>, error STRING"""
NO_RESPONSE = "No response"


def batch_requests(prompts: DataFrame, model: str) -> DataFrame:
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"))
    return prompts.select(
        "custom_id", F.lit(METHOD).alias("method"), F.lit(URL).alias("url"), body.alias("body")
    )


def write_requests(prompts: DataFrame, path: str, model: str) -> None:
    """One JSON line per prompt. ``prompts`` should be a written table, as answers come later."""
    requests = batch_requests(prompts, model)
    requests.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def read_responses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(custom_id, response)``. Of lines with the same id the last one counts."""
    lines = spark.read.schema(RESPONSE_SCHEMA).json(path)
    content = F.get("response.body.choices", F.lit(0))["message"]["content"]
    placed = lines.select("custom_id", content.alias("response"), source_place().alias("place"))
    return placed.groupBy("custom_id").agg(F.max_by("response", "place").alias("response"))


def read_errors(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Requests that failed. ``strict`` makes any of them an error of the run."""
    lines = spark.read.schema(RESPONSE_SCHEMA).json(path)
    failed = lines.filter(F.col("error").isNotNull()).select("custom_id", "error")
    if strict and not failed.isEmpty():
        raise RuntimeError(f"the batch has failed requests, see {path}")
    return failed


def join_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Every prompt with its answer, or ``No response``."""
    joined = prompts.join(responses.select("custom_id", "response"), "custom_id", "left")
    return joined.withColumn("response", F.coalesce("response", F.lit(NO_RESPONSE)))


# The ledger of an exchange: what was answered and what failed, over all runs. Rows are only added, by one
# commit a run, so a run that is ended early leaves it as it was.
LEDGER = "custom_id string, prompt_hash string, response string, answered boolean"


def prompt_hash() -> Column:
    return F.sha2("prompt", 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``(custom_id, prompt_hash, response, answered)``; empty where there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def open_prompts(prompts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Prompts without an answer: never asked, failed, or asked in other words under the same id."""
    hashed = prompts.withColumn("_hash", prompt_hash())
    done = ledger.filter("answered").select("custom_id", F.col("prompt_hash").alias("_hash"))
    return hashed.join(done, ["custom_id", "_hash"], "left_anti").select(*prompts.columns)


def record_answers(
    prompts: DataFrame, responses: DataFrame, path: str, errors: DataFrame | None = None
) -> None:
    """Adds a run to the ledger. ``prompts`` are those it asked; answers to others are left out.

    Prompts in ``errors`` are noted as failed unless they were answered too.
    """
    asked = prompts.select("custom_id", prompt_hash().alias("prompt_hash"))
    rows = asked.join(responses.select("custom_id", "response"), "custom_id").withColumn("answered", F.lit(True))
    if errors is not None:
        failed = errors.select("custom_id").distinct().join(responses, "custom_id", "left_anti")
        nothing = F.lit(None).cast("string").alias("response")
        noted = asked.join(failed, "custom_id").select("custom_id", "prompt_hash", nothing, F.lit(False).alias("answered"))
        rows = rows.unionByName(noted)
    rows.write.mode("append").parquet(path)


def ledger_answers(prompts: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(custom_id, response)`` of prompts the ledger has an answer to; of several, the greatest."""
    done = ledger.filter("answered").groupBy("custom_id", "prompt_hash").agg(F.max("response").alias("response"))
    asked = prompts.select("custom_id", prompt_hash().alias("prompt_hash"))
    return asked.join(done, ["custom_id", "prompt_hash"]).select("custom_id", "response")


def failed_prompts(ledger: DataFrame) -> DataFrame:
    """``(custom_id, n_failed)`` of prompts that failed and were not answered since."""
    tries = ledger.groupBy("custom_id", "prompt_hash").agg(
        F.count_if(~F.col("answered")).alias("n_failed"), F.max("answered").alias("_done")
    )
    return tries.filter("NOT _done").groupBy("custom_id").agg(F.sum("n_failed").alias("n_failed"))
