"""Reading stage files, writing stage tables, and deciding what still has to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.labels import ANSWER
from docstruct.operators.nest import NARRATIVE_DDL, to_label_text

RUN_KEYS = ["rda_model", "extractor", "prompt", "prompt_fingerprint"]


def doc_number(path: Column) -> Column:
    """IO3: the document number in a file's name; null unless the name holds one run of digits."""
    name = F.url_decode(F.element_at(F.split(path, "/"), -1))  # file paths come percent-encoded
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^\D*(\d+)\D*$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def stage_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text ``(tag, doc_id, file, raw)``, one row each; a stage file is one document's."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    where = F.col("_metadata.file_path")
    folder = F.element_at(F.split(where, "/"), -2)
    return files.select(F.url_decode(folder).alias("tag"), doc_number(where).alias("doc_id"), where.alias("file"), F.col("value").alias("raw"))


def parse_block_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO1: files ``(tag, doc_id, file, raw)`` that hold a list of blocks, or an object with ``blocks``,
    as rows with their position; and the files that hold neither, with a reason. An absent label
    becomes ``answer.text``; a null one stays null."""
    entry = "array<map<string,string>>"
    as_object = F.from_json("raw", "map<string,string>")["blocks"]
    marked = files.withColumn("_b", F.from_json(F.when(F.ltrim("raw").startswith("["), F.col("raw")).otherwise(as_object), entry))
    reason = F.when(F.try_parse_json("raw").isNull(), "not valid JSON").otherwise("no list of blocks")
    bad = marked.where("_b IS NULL").select("tag", "doc_id", "file", reason.alias("reason"))
    rows = marked.select("tag", "doc_id", F.posexplode("_b").alias("pos", "b"))
    return rows.select(
        "tag", "doc_id", "pos", F.coalesce(F.col("b")["text"], F.lit("")).alias("text"),
        F.when(F.map_contains_key("b", F.lit("label")), F.col("b")["label"]).otherwise(ANSWER).alias("label"),
        F.col("b")["confidence"].cast("double").alias("confidence"), F.expr("try_cast(b['page'] as int)").alias("page"),
    ), bad


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """IO1: block files ``<tag>/<doc>.json``; see `parse_block_files`."""
    return parse_block_files(stage_files(spark, path))[0]


def parse_structured_files(files: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """IO2: nested documents of files ``(tag, doc_id, file, raw)``, and the files whose root is no object
    (with a reason). *strict* fails the job on the first such file instead."""
    root = F.try_parse_json("raw")
    is_object = F.try_variant_get(root, "$", "map<string,variant>").isNotNull()
    marked = files.withColumn("_ok", is_object)
    if strict:
        marked = marked.withColumn(
            "_ok", F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("not a structured document: "), F.col("file"))))
        )
    whole, bare = F.from_json("raw", f"struct<narrative: {NARRATIVE_DDL}>")["narrative"], F.from_json("raw", NARRATIVE_DDL)
    good = marked.where("_ok").select("tag", "doc_id", F.coalesce(whole, bare).alias("narrative"))
    bad = marked.where(~F.col("_ok")).select("tag", "doc_id", "file", F.lit("root is not an object").alias("reason"))
    return good, bad


def read_structured(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """IO2: nested documents below *path*; see `parse_structured_files`."""
    return parse_structured_files(stage_files(spark, path), strict)


def parse_annotations(files: DataFrame) -> DataFrame:
    """IO3: the annotation of every file that names a document number; others are dropped."""
    good, _ = parse_structured_files(files)
    return good.where(F.col("doc_id").isNotNull()).select("doc_id", "narrative")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """IO3: annotation files of one folder, document number from the name; see `parse_annotations`."""
    return parse_annotations(stage_files(spark, path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Field records as raw JSON per document."""
    return stage_files(spark, path).where(F.col("doc_id").isNotNull()).select("tag", "doc_id", "raw")


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO5: one table per stage, partitioned by tag; only the tags in *df* are replaced."""
    df.write.partitionBy("tag").option("partitionOverwriteMode", "dynamic").format(fmt).mode("overwrite").save(path)


def list_tags(stage: DataFrame) -> DataFrame:
    """IO6: run tags that hold a document, with how many, in name order."""
    return stage.groupBy("tag").agg(F.count_distinct("doc_id").alias("n_docs")).orderBy("tag")


def tags_by_recency(stage: DataFrame, changed: str = "changed_at") -> DataFrame:
    """IO6: run tags, newest first. For a stage read from files, *changed* is
    ``_metadata.file_modification_time``."""
    return stage.groupBy("tag").agg(F.max(changed).alias("newest")).orderBy(F.desc("newest"), "tag")


def pending(docs: DataFrame, done: DataFrame, keys: Sequence[str] = ("tag", "doc_id")) -> DataFrame:
    """IO7: documents without output."""
    return docs.join(done.select(*keys), on=list(keys), how="left_anti")


def stale_runs(wanted: DataFrame, manifest: DataFrame, key: str = "doc_id", fields: Sequence[str] = RUN_KEYS) -> DataFrame:
    """IO8: documents to run again, and which fields of the run record changed."""
    saved = manifest.select(key, F.lit(True).alias("_saved"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = wanted.join(saved, on=key, how="left")
    diff = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fields]))
    changed = F.when(F.col("_saved").isNull(), "no run record").otherwise(F.array_join(diff, ", "))
    return both.withColumn("changed", changed).where("changed <> ''").select(key, "changed")


def fingerprint(*parts: Column) -> Column:
    """IO9: twelve hex characters of what shapes an answer."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 12)


def export_table(slots: DataFrame) -> DataFrame:
    """IO10: what `export_items` writes: ``(tag, doc_id, ord, label, text)``."""
    return to_label_text(slots)


def export_items(slots: DataFrame, path: str, fmt: str = "csv", buckets: int = 64) -> None:
    """IO10: (doc_id, ord, label, text) tables in order, in place of a sheet per document. Folders are by
    tag and hash bucket of the document; only the folders of the tags and buckets written are replaced."""
    rows = export_table(slots).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    out = rows.repartition("tag", "bucket", F.floor(F.col("ord") / (1 << 44))).sortWithinPartitions("tag", "bucket", "doc_id", "ord")
    writer = out.write.partitionBy("tag", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def export_scores(path: str, fmt: str = "parquet", **tables: DataFrame) -> None:
    """IO11: named result tables (summary, per_sample, matrix, every_field) below one folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def replace_tag(spark: SparkSession, stage_path: str, tag: str, backup_path: str, stamp: str) -> None:
    """IO12: copy one tag's rows to ``backup_path/backup=<stamp>``, then empty the tag.

    The stage's other tags, and stage 1 (which has no tag), are not touched. The folder is taken
    from the stage's own files, so a tag that is escaped in its name is found. A second call with
    one stamp finds nothing to copy and leaves the backup as it is.
    """
    own = spark.read.parquet(stage_path).where(F.col("tag") == tag)
    folders = [r[0] for r in own.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct().collect()]  # one per tag
    if not folders:
        return
    kept = own.withColumn("backup", F.lit(stamp))
    kept.write.partitionBy("backup", "tag").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(backup_path)
    for name in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(name))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_scores(scores: DataFrame, path: str) -> None:
    """IO13"""
    scores.write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """IO13"""
    return spark.read.parquet(path)
