"""The published corpus: one JSON document for each event, read and written; id tables; reports."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.functions import text
from almanac.functions.ids import resolve_collisions
from almanac.operators.dedup import redirects, snapshot_diff
from almanac.operators.landing import PUBLISHED
from almanac.operators.numbering import numbered
from almanac.storage import materialize

CORPUS_SCHEMA = "title string, date_start string, date_end string, time_raw string, location string, organizer string, description string, event_url string, sources array<string>, tags array<string>, recurring_group_id long, is_passed int, featured int, _corrupt_record string"


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder with their file names; those that are no JSON are left out."""
    rows = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.filter("_corrupt_record is null and title is not null").drop("_corrupt_record")


def by_source(corpus: DataFrame) -> DataFrame:
    """A row for each source of each document."""
    return corpus.select("*", F.explode("sources").alias("source_url"))


def named(df: DataFrame, mode: str = "suffix", most: int | None = 60) -> DataFrame:
    """Adds ``file``. ``suffix``: names that repeat get _1, _2... in order of date, title and id; ``overwrite``: the last of them stays.
    Slugs are cut to ``most`` letters, as those of the published files are; None leaves them whole.

    Slugs hold no underscore, so a suffixed name is never another's name. Rows are numbered
    over all names and the number of a name's first row is taken off, so a name may have any number of rows.
    """
    placed = numbered(df.withColumn("__base", text.file_name(F.col("date_start"), F.col("title"), most)), ["__base", "date_start", "title", "id"], "__at")
    ends = placed.groupBy("__base").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    out = placed.join(ends, "__base")
    if mode == "overwrite":
        return out.filter("__at = __last").withColumn("file", F.col("__base")).select(*df.columns, "file")
    n = F.col("__at") - F.col("__first")
    name = F.when(n == 0, F.col("__base")).otherwise(F.concat(F.regexp_replace("__base", r"\.json$", ""), F.lit("_"), n.cast("string"), F.lit(".json")))
    return out.withColumn("file", name).select(*df.columns, "file")


def write_corpus(df: DataFrame, folder: str) -> DataFrame:
    """Write each row of ``file`` and the published fields as an indented JSON document; returns ``file, changed``. Documents that say the same are not written again."""
    fields = list(PUBLISHED)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            rows, done = batch.to_pylist(), []
            for r in rows:
                body = (json.dumps({k: r[k] for k in fields}, indent=2, ensure_ascii=False) + "\n").encode()
                path = f"{root}/{r['file']}"
                same = False
                if fs.get_file_info(path).type == pafs.FileType.File:
                    with fs.open_input_stream(path) as f:
                        same = f.read() == body
                if not same:
                    with fs.open_output_stream(path) as f:
                        f.write(body)
                done.append(not same)
            yield pa.RecordBatch.from_pydict({"file": pa.array([r["file"] for r in rows], pa.string()), "changed": pa.array(done, pa.bool_())})

    return materialize(df.select("file", *fields).mapInArrow(run, "file string, changed boolean"), "written")


def stale_files(there: DataFrame, written: DataFrame) -> DataFrame:
    """The ``file`` names that are there and were not written; a null name is none."""
    return there.select("file").filter("file is not null").join(written.select("file"), "file", "left_anti")


def remove_stale(spark: SparkSession, folder: str, written: DataFrame) -> int:
    """Delete documents of the folder that this run has not written; returns how many."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    stale = stale_files(there, written)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{root}/{name}")
            yield batch

    return materialize(materialize(stale, "stale").mapInArrow(run, "file string"), "removed").count()


def seed(corpus: DataFrame, default_source: str = "seed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw, curated and lineage tables of a corpus; documents without title or date are skipped."""
    rows = corpus.filter((text.empty(F.col("title")) != "") & (text.empty(F.col("date_start")) != "")).withColumn("id", F.xxhash64("file"))
    raw = rows.withColumn("source_url", F.coalesce(F.get("sources", F.lit(0)), F.lit(default_source))).withColumn("ord", F.col("id"))
    links = raw.select(F.col("ord").alias("raw_id"), F.col("id").alias("curated_id"), F.lit(0).alias("dedup_round"), F.col("source_url").alias("source"))
    return raw, rows, links


def build_tables(corpus: DataFrame, folder: str, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the corpus under stable ids, sorted by date for pruning, with the redirects from old ids that still lead somewhere; both replace what was there."""
    events = resolve_collisions(corpus, "event_url", "title", "date_start", "file")
    events.repartitionByRange("date_start", "id").sortWithinPartitions("date_start", "id").write.mode("overwrite").parquet(f"{folder}/events")
    stored = corpus.sparkSession.read.parquet(f"{folder}/events")
    if pairs is None:
        pairs = corpus.sparkSession.createDataFrame([], "old_id long, new_id long")
    redirects(stored, pairs).write.mode("overwrite").parquet(f"{folder}/id_redirects")
    return stored, corpus.sparkSession.read.parquet(f"{folder}/id_redirects")


def restore_tables(spark: SparkSession, exported: str, folder: str) -> DataFrame:
    """Replace the event table by an exported one."""
    materialize(spark.read.parquet(exported), "restored").write.mode("overwrite").parquet(f"{folder}/events")
    return spark.read.parquet(f"{folder}/events")


def change_report(before: DataFrame, after: DataFrame, fold: int = 10) -> str:
    """Markdown: what was added, changed and removed between two corpora, by file. Each table shows ``fold`` rows and counts the rest."""
    diff = snapshot_diff(before, after, "file", [c for c in PUBLISHED if c in before.columns])
    rows = diff.join(before.unionByName(after, allowMissingColumns=True).groupBy("file").agg(F.max("title").alias("title"), F.max("date_start").alias("date_start")), "file")
    counts = {r.action: r["count"] for r in diff.groupBy("action").count().collect()}
    out = []
    for action, head in (("A", "Added"), ("M", "Changed"), ("D", "Removed")):
        n = counts.get(action, 0)
        out.append(f"## {head}: {n}")
        shown = rows.filter(F.col("action") == action).select(text.flag_generic_title(text.empty(F.col("title"))).alias("t"), "date_start").orderBy("date_start", "t").limit(fold).collect() if n else []
        out += [f"| {str(r.t).replace('|', '/')} | {r.date_start or '—'} |" for r in shown]
        if n > fold:
            out.append(f"…and {n - fold} more")
    return "\n".join(out) + "\n"
