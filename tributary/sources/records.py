"""Instruction records, generation logs, utilities: reading, mapping, writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.text import normal_field
from tributary.operators.ranks import with_rank


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet, JSON lines, CSV, ORC or text source; JSON and CSV should come with a schema."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(kind).load(path)


def normalize(rows: DataFrame, instruction: str = "instruction", given: str = "input", output: str = "output", rec_id: str = "rec_id") -> DataFrame:
    """Any table as rec_id, instruction, input, output; a column that is not there is empty."""

    def field(name: str) -> Column:
        if name not in rows.columns:
            return F.lit("")
        return normal_field(F.col(name), rows.schema[name].dataType.simpleString())

    return rows.select(F.col(rec_id).cast("long").alias("rec_id"), field(instruction).alias("instruction"), field(given).alias("input"), field(output).alias("output"))


def load_instructions(rows: DataFrame, limit: int | None = None, seed: int = 42, **columns: str) -> DataFrame:
    """Normalised records with an instruction and an output; with a limit, that many in a seeded order."""
    usable = normalize(rows, **columns).where("instruction <> '' and output <> ''")
    return usable if limit is None else usable.orderBy(F.xxhash64("rec_id", F.lit(seed)), "rec_id").limit(limit)


def source_slice(rows: DataFrame, n: int, order: str = "rec_id") -> DataFrame:
    return rows.orderBy(order).limit(n)


def train_eval_split(records: DataFrame, n_eval: int, order: str = "rec_id") -> DataFrame:
    """Adds ``split``: the first max(1, min(n_eval, a fifth of all)) rows are eval, the rest train."""
    ranked = with_rank(records, order)
    size = max(1, min(n_eval, max(1, ranked.count() // 5)))
    return ranked.withColumn("split", F.when(F.col("rank") <= size, "eval").otherwise("train")).drop("rank")


def parse_generation_log(lines: DataFrame) -> DataFrame:
    """(line_no, value) of a JSON-lines log to rec_id, output. Blank, torn and foreign lines are skipped, the last line of
    an id wins, a missing output is empty."""
    parsed = lines.select("line_no", F.from_json("value", "index string, output string").alias("j"))
    index = F.expr("try_cast(trim(j.index) as bigint)")
    rows = parsed.select("line_no", index.alias("rec_id"), F.coalesce("j.output", F.lit("")).alias("output")).where("rec_id is not null")
    return rows.groupBy("rec_id").agg(F.max_by("output", "line_no").alias("output"))


def read_generation_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of one file or a folder of them, of which the lines of later ones win; one that is not there yet is empty."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "rec_id long, output string")
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", F.monotonically_increasing_id().alias("n"))
    return parse_generation_log(lines.select(place.alias("line_no"), "value"))


def append_generations(rows: DataFrame, path: str) -> None:
    """Appends (rec_id, output) as JSON lines that read_generation_log reads."""
    rows.select(F.to_json(F.struct(F.col("rec_id").alias("index"), "output")).alias("value")).write.mode("append").text(path)


def pending_soft_labels(examples: DataFrame, stored: DataFrame) -> DataFrame:
    """Examples without a stored soft label."""
    return examples.join(stored.select("example_id").distinct(), "example_id", "left_anti")


def write_soft_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("batch").parquet(path)


def align_utilities(examples: DataFrame, utilities: DataFrame) -> DataFrame:
    """Every example with its utility, 0 where it has none."""
    return examples.join(utilities, "example_id", "left").withColumn("utility", F.coalesce("utility", F.lit(0.0)))


def answerable(examples: DataFrame) -> DataFrame:
    return examples.where(F.size("answers.text") > 0)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("overwrite").format(kind).save(path)
