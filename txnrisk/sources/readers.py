"""Scans of transaction files and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

from txnrisk.functions import cleaning
from txnrisk.operators.clean import normalize_columns

TRANSACTION = StructType([StructField(name, kind) for kind, names in [
    (StringType(), ["transaction_id", "customer_id", "kyc_verified"]), (IntegerType(), ["account_age_days"]),
    (DoubleType(), ["transaction_amount"]), (IntegerType(), ["channel"]), (TimestampType(), ["timestamp"]),
    (IntegerType(), ["is_fraud", "transaction_type", "location", "currency", "avg_transaction_amount",
                     "failed_login_attempts", "multi_device_login", "velocity_check", "hour", "weekday", "is_high_value"]),
] for name in names])

# The texts that count as a missing value in a CSV file.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(conf).exists(hadoop_path)


def _typed(text: Column, field: StructField) -> Column:
    known = F.when(~F.trim(text).isin(NULL_TOKENS), text)
    return cleaning.to_double(known) if isinstance(field.dataType, DoubleType) else known.try_cast(field.dataType)


def read_transactions(spark: SparkSession, path: str | list[str], schema: StructType = TRANSACTION) -> DataFrame:
    """CSV with a header, matched to the schema by name. Values that do not fit their type become null, a
    column the file lacks is null, a column the schema lacks stays text."""
    # Without inference only the header is read here.
    text = normalize_columns(spark.read.csv(path, header=True, inferSchema=False))
    have, fields = set(text.columns), {f.name: f for f in schema.fields}
    known = [_typed(F.col(n), f).alias(n) if n in have else F.lit(None).cast(f.dataType).alias(n) for n, f in fields.items()]
    rest = [F.when(~F.trim(c).isin(NULL_TOKENS), F.col(c)).alias(c) for c in text.columns if c not in fields]
    return text.select(*known, *rest)


def read_first(spark: SparkSession, paths: list[str], schema: StructType = TRANSACTION) -> DataFrame:
    """The first path that exists, else no rows."""
    for path in paths:
        if path_exists(spark, path):
            return read_transactions(spark, path, schema)
    return spark.createDataFrame([], schema)


REQUEST_FIELDS = ["transaction_id", "customer_id", "transaction_amount", "account_age_days", "channel", "kyc_verified",
                  "timestamp", "kyc_document_path"]
CORRUPT = "_corrupt_record"


def read_requests(spark: SparkSession, path: str | list[str], fields: list[str] | None = None,
                  whole_files: bool = False) -> DataFrame:
    """Request records, every value as text: one object per line, so that large files are read in parallel, or with
    ``whole_files`` an object or a list of objects per file.

    What is not an object is rejected: it is kept in ``_corrupt_record`` with all fields null.
    """
    columns = [StructField(name, StringType()) for name in [*(fields or REQUEST_FIELDS), CORRUPT]]
    return spark.read.json(path, schema=StructType(columns), multiLine=whole_files, primitivesAsString=True,
                           mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def accepted_requests(requests: DataFrame) -> DataFrame:
    """The usable records; an error where there is none."""
    fields = [c for c in requests.columns if c != CORRUPT]
    good = requests.filter(F.col(CORRUPT).isNull() & F.coalesce(*[F.col(c) for c in fields]).isNotNull()).drop(CORRUPT)
    if good.isEmpty():
        raise ValueError("Empty or invalid JSON input.")
    return good


def kyc_from_document(requests: DataFrame) -> DataFrame:
    """A record with an uploaded document counts as verified, any other as not."""
    return requests.withColumn("kyc_verified", F.col("kyc_document_path").isNotNull().cast("int").cast("string"))
