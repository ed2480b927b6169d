"""Sources and sinks: every schema is declared, a missing file is an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators import etl

EXAMPLE = (
    "example_id string, hop_type string, num_hops int, query string, answer string, answer_reasoning string, "
    "provenance array<struct<hop: int, event_id: string, type: string, text: string, status: string, supersedes: string, rule: string, session: string>>, "
    "kb array<struct<event_id: string, text: string, timestamp: string, event_type: string, session_id: string>>, "
    "validity_certificate struct<valid: boolean, reason: string, superseding_chain: array<struct<event_id: string, rule: string>>>, employee string, ticker string, domain string, "
    "supersession_edges array<struct<trigger_id: string, target_id: string, rule: string>>"
)
PAIR = "id string, cve_id string, product string, disclosure_text string, patch_text string, release_url string, patch_contains_cve_id boolean, severity string, owner string, repo string, tag string"
RECALL = "id string, norm_name string, generic_name string, brand_name string, query string, anchor_text string, superseder_text string, recall_date string, reason_for_recall string"
RULING = "id string, case_slug string, original_case string, original_citation string, overruling_case string, overruling_citation string, query string, original_url string, overruling_url string, original_text string, overruling_text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL file of examples."""
    return spark.read.schema(EXAMPLE).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array as rows; such a file can't be split."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id``: white-space separated ids of a text file."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def query_cache(spark: SparkSession, path: str, value: str = "query") -> DataFrame:
    """``id`` and a value from JSONL; the last line of an id wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select(F.from_json("value", f"id string, {value} string").alias("r"), F.struct("file", "line").alias("at")).select("r.*", "at")
    return etl.latest_value(rows.where("id IS NOT NULL"), "id", value, "at")


def load_corpus(spark: SparkSession, path: str, ids: str | None = None, distractors: DataFrame | None = None, hop_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Examples with ``gold_id``, and their corpus: the split applies before the corpus is built, the hop type after."""
    e = examples(spark, path)
    if ids:
        e = etl.split_rows(e, split_ids(spark, ids), "example_id")
    corpus = etl.flatten_kb(e)
    if distractors is not None:
        corpus = etl.build_corpus(corpus, distractors)
    e = e.withColumn("gold_id", etl.gold_doc("provenance"))
    return (e.where(F.col("hop_type").contains(hop_type)) if hop_type else e), corpus


def completions(df: DataFrame, prompt: str, complete: Callable[[str], str | None], out: str = "completion", retries: int = 3) -> DataFrame:
    """A column made by a caller's model, batch by batch; None after the last failure."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        import time

        for pdf in batches:
            def one(p):
                for attempt in range(retries):
                    try:
                        return complete(p)
                    except Exception:  # noqa: BLE001  the service's own errors
                        time.sleep(2**attempt)
                return None

            yield pdf.assign(**{out: pdf[prompt].map(one)})

    return df.mapInPandas(run, schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(aggregate: DataFrame, per_example: DataFrame, path: str) -> None:
    """A report's two parts as JSON below one folder."""
    aggregate.write.mode("overwrite").json(f"{path}/aggregate")
    per_example.write.mode("overwrite").json(f"{path}/per_example")


def resume(source: DataFrame, spark: SparkSession, sink: str, schema: str, key: str = "id") -> DataFrame:
    """The rows of ``source`` that a JSONL sink lacks."""
    return etl.remaining(source, spark.read.schema(schema).json(sink), key)
