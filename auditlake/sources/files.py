"""Files read and written: hash ranges, breach catalogues, pair manifests, encrypted snapshots, findings as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "left string, right string, left_identity string, right_identity string, same_person boolean, split string, demographic_group string, device_class string, _corrupt string"
CATALOGUE = "array<struct<Name:string,Title:string,BreachDate:string,DataClasses:array<string>>>"


def range_lines(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(prefix, suffix, count) of lines SUFFIX:COUNT, in upper case; lines of another form are left out, a body that is null has none."""
    line = bodies.select("prefix", F.explode(F.split(column, r"\r?\n")).alias("line"))
    parts = line.select("prefix", F.upper(F.trim(F.substring_index("line", ":", 1))).alias("suffix"), F.expr("try_cast(trim(substring_index(line, ':', -1)) as bigint)").alias("count"))
    return parts.where("suffix rlike '^[0-9A-F]+$' and count is not null")


def breach_catalogue(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(name, title, date, classes) of JSON catalogues; what isn't one gives no rows."""
    return bodies.select(F.explode(F.from_json(column, CATALOGUE)).alias("b")).select(F.col("b.Name").alias("name"), F.coalesce("b.Title", "b.Name").alias("title"), F.col("b.BreachDate").alias("date"), F.coalesce("b.DataClasses", F.array().cast("array<string>")).alias("classes")).where("name is not null")


def pair_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected rows with their reason) of a CSV manifest of labelled pairs."""
    raw = spark.read.csv(path, header=True, schema=MANIFEST, columnNameOfCorruptRecord="_corrupt", enforceSchema=False)
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("left").isNull() | F.col("right").isNull(), "no path").when(~F.coalesce(F.col("split").isin("calibration", "test"), F.lit(False)), "unknown split").when(F.col("same_person") != (F.col("left_identity") == F.col("right_identity")), "identity against label")
    d = raw.withColumn("reason", reason)
    return d.where("reason is null").drop("reason", "_corrupt"), d.where("reason is not null").select("left", "right", "reason")


def shared_identities(pairs: DataFrame) -> DataFrame:
    """(identity) of those in more than one split; it must be empty."""
    each = pairs.select("split", F.explode(F.array("left_identity", "right_identity")).alias("identity"))
    return each.groupBy("identity").agg(F.count_distinct("split").alias("splits")).where("splits > 1").select("identity")


def sealed(cases: DataFrame, key: Column, payload: str = "payload") -> DataFrame:
    """Adds the payload's sha256 and its AES-GCM ciphertext, bound to the case, in place of the payload."""
    aad = F.col("case_id").cast("string")
    return cases.withColumn("sha256", F.sha2(payload, 256)).withColumn("sealed", F.aes_encrypt(F.col(payload), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)).drop(payload)


def opened(cases: DataFrame, key: Column) -> DataFrame:
    """The payload of sealed cases; null where key, case or content isn't what was sealed."""
    plain = F.try_aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), F.col("case_id").cast("string")).cast("string")
    return cases.withColumn("payload", F.when(F.sha2(plain, 256) == F.col("sha256"), plain)).drop("sealed", "sha256")


def save_case(df: DataFrame, folder: str, table: str) -> None:
    """Writes a snapshot's table, a folder for each case; only the cases in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{folder}/{table}")


def save_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def delete_case(spark: SparkSession, folder: str, table: str, case_id: int | None = None) -> bool:
    """Takes a case's rows of a snapshot table away, or, without a case, all of it; whether anything was there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}" + ("" if case_id is None else f"/case_id={case_id}"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_json(df: DataFrame, path: str) -> None:
    """One JSON object a line: resume states, packages."""
    df.write.mode("overwrite").json(path)
