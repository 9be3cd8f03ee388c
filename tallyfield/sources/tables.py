"""Sources, sinks and extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.uniform import uniform
from tallyfield.operators.ordering import ranked
from tallyfield.sources import schemas


def load_table(spark: SparkSession, name: str, path: str, fmt: str = "csv") -> DataFrame:
    """Read a named table with its declared schema, dates included."""
    if name not in schemas.TABLES:
        raise KeyError(f"unknown table {name!r}; known: {sorted(schemas.TABLES)}")
    reader = spark.read.schema(schemas.TABLES[name])
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd")
    return reader.format(fmt).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read invoice lines from CSV.

    Only an empty customer id is missing; other empty fields stay empty text. Stamps have minutes.
    """
    text = ", ".join(f"{c} string" for c in ("invoice", "stock_code", "description", "quantity",
                                             "invoice_date", "price", "customer_id", "country"))
    raw = (spark.read.schema(text).option("header", True).option("nullValue", "\u0000")
           .option("emptyValue", "").csv(path))
    return raw.select(
        _text("invoice"), _text("stock_code"), _text("description"),
        F.col("quantity").cast("bigint").alias("quantity"),
        F.to_timestamp_ntz("invoice_date", F.lit("yyyy-MM-dd HH:mm")).alias("invoice_date"),
        F.col("price").cast("double").alias("price"),
        F.when(_text("customer_id") != "", F.col("customer_id")).cast("bigint")
        .alias("customer_id"), _text("country"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def load_dated_log(spark: SparkSession, path: str, schema: str = schemas.DATED_LOG,
                   date: str = "date", fmt: str = "csv") -> DataFrame:
    """Scan a log whose dates are integers yyyymmdd, as typed dates."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    return df.withColumn(date, F.to_date(F.col(date).cast("string"), "yyyyMMdd"))


def union_overlapping_extracts(first: DataFrame, second: DataFrame,
                               key: Sequence[str]) -> DataFrame:
    """The first extract plus the second's rows whose key the first does not have.

    Repeats inside one extract stay. Only distinct keys of the first extract are shuffled.
    """
    known = first.select(*key).distinct()
    return first.unionByName(second.join(known, list(key), "left_anti"))


def sample_entities(df: DataFrame, key: str, amount: int | float, seed: int = 0) -> DataFrame:
    """Choose entities by a seeded hash and keep all their rows; NULL keys are dropped.

    A float is a fraction in (0, 1): entities whose hash uniform is below it, decided row by row
    without any shuffle. An int is an exact number of entities, taken in hash order; their rank is
    found with range buckets, so the chosen keys never sit in one task.
    """
    u = uniform(f"entity{seed}", key)
    known = df.filter(F.col(key).isNotNull())
    if isinstance(amount, float):
        if not 0 < amount < 1:
            raise ValueError("a fraction must lie strictly between 0 and 1")
        return known.filter(u < amount)
    if amount < 1:
        raise ValueError("the number of entities must be positive")
    keys = known.select(key).distinct().withColumn("_u", u)
    chosen = ranked(keys, ["_u", key], name="_rank").filter(F.col("_rank") <= amount).select(key)
    return known.join(chosen, key, "left_semi")


def load_journeys(spark: SparkSession, path: str, codes: Mapping[str, str],
                  fmt: str = "csv") -> DataFrame:
    """Journeys stored with one letter per touch, as arrays of channel names."""
    reader = spark.read.schema(schemas.JOURNEYS)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).withColumn("path", decode_path("path", codes))


def decode_path(path: str, codes: Mapping[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    letters = F.filter(F.split(F.col(path), ""), lambda x: x != "")
    return F.transform(letters, lambda x: lookup[x])


def encode_path(path: str, codes: Mapping[str, str]) -> Column:
    """Array of channel names to one letter per touch, for writing."""
    lookup = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (v, k)])
    return F.array_join(F.transform(F.col(path), lambda x: lookup[x]), "")


def write_scores(scores: DataFrame, path: str, model_version: str, scored_at) -> int:
    """Upsert scores keyed by customer and model version; returns the version's row count.

    The table is partitioned by version. A rerun replaces customers scored before and keeps the
    others of that version; other versions are not touched. Within one call the last score of a
    customer (largest row) wins, as one row per key is stored.
    """
    spark = scores.sparkSession
    values = [c for c in scores.columns if c not in ("model_version", "scored_at")]
    tagged = scores.select(*values).withColumn("scored_at", F.lit(str(scored_at)).cast("date"))
    fresh = tagged.groupBy("customer_id").agg(
        F.max(F.struct(*[c for c in tagged.columns if c != "customer_id"])).alias("s")).select(
        "customer_id", "s.*")
    target = f"{path.rstrip('/')}/model_version={model_version}"
    old = _existing(spark, target)
    if old is not None:
        kept = old.join(fresh.select("customer_id"), "customer_id", "left_anti")
        fresh = fresh.unionByName(kept)
    staged = f"{path.rstrip('/')}/_staging_{model_version}"
    fresh.write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(jvm_path) else None


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORES).parquet(path)


def audit_scores(scores: DataFrame, scored_at, model_version: str) -> DataFrame:
    """Counts of rows that break the score table's rules, in one pass."""
    required = ("customer_id", "p_alive", "clv_mean", "clv_hdi_low", "clv_hdi_high", "segment",
                "model_version", "scored_at")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    inside = (F.col("clv_hdi_low") <= F.col("clv_mean")) & (
        F.col("clv_mean") <= F.col("clv_hdi_high"))
    wrong_tag = (F.col("scored_at") != F.lit(str(scored_at)).cast("date")) | (
        F.col("model_version") != model_version)
    return scores.agg(
        F.count_if(missing).alias("incomplete"),
        F.count_if((F.col("p_alive") < 0) | (F.col("p_alive") > 1)).alias("p_outside"),
        F.count_if(~inside).alias("mean_outside"), F.count_if(wrong_tag).alias("wrong_tags"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Per segment: customers, mean probability alive, total value."""
    return scores.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("p_alive").alias("mean_p_alive"),
        F.sum("clv_mean").alias("clv_total"))


def label_positions(flags: DataFrame, flag: Column, row_id: str = "line_id") -> DataFrame:
    """How many rows a flag marks, and a fingerprint that does not depend on row order."""
    part = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("bigint")
    return flags.agg(F.count_if(flag).alias("rows"),
                     F.coalesce(F.sum(F.when(flag, part)), F.lit(0)).alias("fingerprint"))
