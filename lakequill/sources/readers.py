"""Record scans. The order of a log is a sequence column of its own, or the place of its lines in their files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line raises. `limit` keeps the first rows by `order`."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if limit is None:
        return df
    return (df.orderBy(order) if order else df).limit(limit)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A log that may not exist yet: then it is empty."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return spark.createDataFrame([], schema)


def read_torn_log(spark: SparkSession, path: str, schema: str, seq: str) -> DataFrame:
    """Rows before the first malformed line. `seq` is the log's own line number; a malformed line's is found from the text."""
    broken = f"{schema}, _corrupt_record string"
    df = spark.read.schema(broken).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    names = [c for c in df.columns if c != "_corrupt_record"]
    lines = spark.read.text(path).where(F.trim("value") != "")
    good = F.from_json("value", broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    numbered = lines.select(good.alias("r"), F.coalesce(F.regexp_extract("value", rf'"{seq}"\s*:\s*(\d+)', 1).try_cast("long"), F.lit(None).cast("long")).alias("_n"))
    # a torn line without a legible number ends the log where the numbers end
    first_bad = numbered.where("r._corrupt_record IS NOT NULL").agg(F.min(F.coalesce("_n", F.lit((1 << 62)))).alias("_bad"))
    rows = numbered.where("r._corrupt_record IS NULL").select("r.*").select(*names)
    return rows.crossJoin(F.broadcast(first_bad)).where(F.col("_bad").isNull() | (F.col(seq) < F.col("_bad"))).drop("_bad")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that aren't blank, with their place: _file, and _at, which rises through a file.

    _at is the beginning of the split and a number that rises with the lines of one task; nothing in a line is trusted.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("_at"))
    return lines.where(F.trim(F.translate("value", "\t\r", "  ")) != "")


def number_lines(rows: DataFrame, name: str = "_line") -> DataFrame:
    """rows of read_positions, each with its number in its file, from 0. Only counts by split meet in a window."""
    splits = rows.groupBy("_file", "_at.block").agg(F.count("*").alias("_n"), F.min("_at.id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("_file").alias("_f"), F.col("block").alias("_b"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_at.block").orderBy("_at.id")) - 1  # a split has maxPartitionBytes at most
    out = rows.withColumn("_in", inside).join(splits, (F.col("_file") == F.col("_f")) & (F.col("_at.block") == F.col("_b")))
    return out.withColumn(name, F.col("_before") + F.col("_in")).drop("_f", "_b", "_before", "_in")


def read_log_until_torn(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines up to the first line of each file that is not one whole JSON object, with _file and _at.

    A line is read as VARIANT inside brackets, so a second value behind the first one, or a key that stands twice, breaks it too;
    a value of another type than the schema's is null and breaks nothing.
    """
    whole = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<variant>")
    lines = read_positions(spark, path).select("_file", "_at", whole.alias("_w"))
    one = F.when(F.size("_w") == 1, F.get("_w", F.lit(0)))
    lines = lines.select("_file", "_at", F.when(F.schema_of_variant(one).startswith("OBJECT"), one).alias("_v"))
    torn = lines.where("_v IS NULL").groupBy(F.col("_file").alias("_torn")).agg(F.min("_at").alias("_end"))
    kept = lines.where("_v IS NOT NULL").join(torn, F.col("_file") == F.col("_torn"), "left").where(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    fields = T._parse_datatype_string(schema).fields
    return kept.select(*(F.try_variant_get("_v", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields), "_file", "_at")


def read_result_dir(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A folder with one JSON record in each file; names that begin with _ are skipped, the file's stem is task_id."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("task_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, item_index) to prune; no file: nothing."""
    return read_log(spark, path, "task_id string, item_index int")


def split_composite(df: DataFrame, column: str, names: list[str], types: dict[str, str] | None = None, sep: str = "||") -> DataFrame:
    """A composite key cut into named, typed columns; a wrong count of parts raises."""
    parts = F.split(column, "".join("\\" + c for c in sep))
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("composite key: "), F.col(column))).cast("array<string>"))
    return df.select("*", *(checked[i].cast((types or {}).get(n, "string")).alias(n) for i, n in enumerate(names)))


def read_labels(df: DataFrame, kind: str = "human") -> DataFrame:
    """Annotator rows (annotator_id, annotator_kind, labels map) as (annotator_id, item, label): YES, NO, UNSURE or null."""
    other = F.when(F.col("annotator_kind") == kind, F.col("labels")).otherwise(F.raise_error(F.concat(F.lit("not a human annotator: "), F.col("annotator_id"))).cast("map<string,string>"))
    rows = df.select("annotator_id", F.explode(other).alias("item", "raw"))
    norm = F.upper(F.trim("raw"))
    return rows.select("annotator_id", "item", F.when(norm.isin("YES", "NO", "UNSURE"), norm).alias("label"))


def quarantine(df: DataFrame, checks: dict[str, F.Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the reasons they fail."""
    reasons = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda r: r.isNotNull())
    marked = df.withColumn("_reasons", reasons)
    return marked.where(F.size("_reasons") == 0).drop("_reasons"), marked.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")


def check_vectors(df: DataFrame, column: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has `dim` finite components, and the others with the reasons they can't be read."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return quarantine(df, {"missing": v.isNotNull(), "shape": F.size(v) == dim, "values": finite})


def with_sequence(df: DataFrame, *order: str) -> DataFrame:
    """A dense _seq by the given order, for logs that have none of their own."""
    from lakequill.operators.ranks import row_numbers

    return row_numbers(df, [], list(order), "_seq").withColumn("_seq", F.col("_seq") - 1)
