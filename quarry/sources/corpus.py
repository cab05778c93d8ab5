"""Readers and writers of text corpora, artifacts, logs and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources.
SKIP_DIRS = ["node_modules", ".git", "target", "build", "out", "dist", ".gradle"]


def read_corpus(spark: SparkSession, root: str, suffixes: list[str], skip_dirs: list[str] | None = None, skip_path_regex: str | None = None) -> DataFrame:
    """(path, rel, text): whole files under root with one of the suffixes."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?{base}/", "")
    out = files.select(F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("rel"), F.col("value").alias("text"))
    for d in SKIP_DIRS if skip_dirs is None else skip_dirs:
        out = out.where(~F.contains(F.concat(F.lit("/"), "rel"), F.lit(f"/{d}/")))
    return out.where(~F.col("rel").rlike(skip_path_regex)) if skip_path_regex else out


def top_level(files: DataFrame, rel: str = "rel") -> DataFrame:
    """Distinct top-level names, and whether they are folders."""
    return files.select(F.element_at(F.split(rel, "/"), 1).alias("name"), (F.size(F.split(rel, "/")) > 1).alias("is_dir")).distinct()


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON documents; a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_session_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON message per line; lines that do not parse are dropped."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def corpus_hints(analyses: DataFrame, columns: dict[str, str], seeds: dict[str, list[str]]) -> DataFrame:
    """(kind, hint): distinct values of array columns of prior analyses, and built-in seeds."""
    spark = analyses.sparkSession
    out = None
    for kind, column in columns.items():
        part = analyses.select(F.lit(kind).alias("kind"), F.explode(F.transform(column, lambda x: F.lower(x))).alias("hint"))
        out = part if out is None else out.union(part)
    for kind, values in seeds.items():
        out = out.union(spark.range(1).select(F.lit(kind), F.explode(F.array(*map(F.lit, values)))))
    return out.distinct()


def batch_plan(manifest: DataFrame) -> DataFrame:
    """Rows of a manifest(projects array<struct<name, root, out>>); incomplete ones carry their reason."""
    rows = manifest.select(F.posexplode("projects").alias("ord", "p")).select("ord", "p.*")
    return rows.withColumn("failure", F.when(F.col("name").isNull() | F.col("root").isNull(), "name and root are required"))


#: Document kinds by suffix.
IMPORT_KINDS = {".docx": "docx", ".doc": "doc", ".pdf": "pdf", ".html": "html", ".htm": "html", ".md": "md", ".markdown": "md", ".txt": "txt"}


def import_manifest(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Kind of each file and the warnings that its extracted text gives rise to."""
    kinds = F.create_map(*(F.lit(x) for kv in IMPORT_KINDS.items() for x in kv))
    kind = F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("unknown"))
    n = F.length(F.coalesce(text, F.lit("")))
    rules = F.array(F.when((kind == "pdf") & (n < 50), F.lit("very little text in pdf")), F.when((kind == "doc") & (n == 0), F.lit("no text in doc")))
    return files.select(path, kind.alias("kind"), F.filter(rules, lambda x: x.isNotNull()).alias("warnings"))


def append_delta(df: DataFrame, path: str) -> None:
    """Appends records as JSON lines; a missing time is now, a missing id follows from the time."""
    at = F.coalesce("created_at", F.current_timestamp())
    df.withColumn("created_at", at).withColumn("id", F.coalesce("id", F.regexp_replace(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-"))).write.mode("append").json(path)


def write_version(df: DataFrame, root: str, kind: str, base_name: str, version: str, source_hash: str, label: str | None = None) -> None:
    """Rows of a new version, partitioned by kind, name and version, and an index row."""
    tagged = df.withColumns({"kind": F.lit(kind), "base_name": F.lit(base_name), "version_id": F.lit(version)})
    tagged.write.mode("append").partitionBy("kind", "base_name", "version_id").parquet(f"{root}/data")
    index = df.sparkSession.range(1).select(F.lit(kind).alias("kind"), F.lit(base_name).alias("base_name"), F.lit(version).alias("version_id"), F.lit(source_hash).alias("hash"), F.lit(label).cast("string").alias("label"), F.current_timestamp().alias("created_at"))
    index.write.mode("append").parquet(f"{root}/index")


def artifact_files(versions: DataFrame, files: str, modes: dict[str, str], mode: str) -> DataFrame:
    """Files of a version map whose name fits the mode's pattern."""
    return versions.withColumn(files, F.map_filter(files, lambda k, v: v.rlike(modes[mode])))


def recent(parts: list[DataFrame], at: str, name: str, k: int = 10) -> DataFrame:
    """The k newest rows of several sources; the newest is labelled."""
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc(at), name).limit(k)
    newest = rows.agg(F.max(F.struct(at, name)).alias("m"))
    return rows.crossJoin(newest).select(*rows.columns, F.when((F.col(at) == F.col(f"m.{at}")) & (F.col(name) == F.col(f"m.{name}")), "latest").alias("label"))  # one row
