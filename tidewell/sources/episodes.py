"""Episode-structured inputs: frames in Parquet, metadata in JSON lines and JSON documents."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODES = "episode_index BIGINT, length BIGINT, tasks ARRAY<STRING>, task_index BIGINT, action_config STRING, action_config_json STRING"
TASKS = "task_index BIGINT, task STRING"
_EPISODE_PATH = r"chunk-(\d+)/episode_(\d+)\.parquet$"


def scan_frames(spark: SparkSession, root: str, columns: list[str] | None = None, tolerant: bool = True) -> DataFrame:
    """All ``episode_*.parquet`` files under ``root`` in one distributed scan, with chunk and episode taken from the path.

    ``columns`` prunes the scan; files that are corrupt or vanish are skipped unless ``tolerant`` is off.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "episode_*.parquet").option("mergeSchema", "true")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.parquet(root)
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}")
        df = df.select(*columns, "_metadata.file_path")
    else:
        df = df.select("*", "_metadata.file_path")
    return df.withColumns({"chunk": F.regexp_extract("file_path", _EPISODE_PATH, 1).try_cast("int"), "episode_file": F.regexp_extract("file_path", _EPISODE_PATH, 2).try_cast("bigint")}).drop("file_path")


def episode_paths(spark: SparkSession, root: str) -> DataFrame:
    """``episode_index, path`` of all episodes, from the counts and the template in ``meta/info.json``.

    If the second file (the only one, where there is one) isn't there, numbers have gaps: then the files found under ``data`` in the order of their paths.
    """
    info = spark.read.text(f"{root}/meta/info.json", wholetext=True).select(F.from_json("value", "total_episodes BIGINT, chunks_size BIGINT, data_path STRING").alias("i")).select("i.*").head()
    total, size = info["total_episodes"] or 0, info["chunks_size"] or 1000
    if not total:
        raise FileNotFoundError(f"no episodes in {root}")
    form, names = "", []
    for words, name, spec, _ in Formatter().parse(info["data_path"] or "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"):
        form += words.replace("%", "%%") + (f"%{spec or 'd'}" if name else "")
        names += [name] if name else []
    index = F.col("id")
    parts = {"episode_chunk": F.expr(f"id div {size}"), "episode_index": index}
    paths = spark.range(total).select(index.alias("episode_index"), F.concat(F.lit(f"{root}/"), F.format_string(form, *[parts[n] for n in names])).alias("path"))
    probe = spark._jvm.org.apache.hadoop.fs.Path(paths.where(F.col("episode_index") == min(1, total - 1)).head()["path"])
    if probe.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(probe):
        return paths
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "episode_*.parquet").load(f"{root}/data")
    return found.select(F.regexp_extract("path", _EPISODE_PATH, 2).try_cast("bigint").alias("episode_index"), "path").orderBy("path")


def read_v3_episodes(spark: SparkSession, root: str, camera: str = "observation.images.wrist") -> DataFrame:
    """``episode_index, length, chunk_index, file_index, file_from_index, from_timestamp`` from all files of ``meta/episodes``."""
    rows = spark.read.parquet(f"{root}/meta/episodes/*/*.parquet")
    names = {"data/chunk_index": "chunk_index", "data/file_index": "file_index", f"videos/{camera}/from_timestamp": "from_timestamp"}
    named = {new: F.col(f"`{old}`") for old, new in names.items()}
    return rows.select("episode_index", "length", named["chunk_index"].alias("chunk_index"), named["file_index"].alias("file_index"), F.col("_metadata.row_index").alias("file_from_index"), named["from_timestamp"].alias("from_timestamp"))


def scan_v3_frames(spark: SparkSession, root: str, camera: str = "observation.images.wrist") -> DataFrame:
    """Frames of files that hold many episodes, in the file's time; only frames whose file is the one that the metadata name."""
    frames = spark.read.parquet(f"{root}/data/*/*.parquet").select("*", "_metadata.file_path")
    number = lambda word: F.regexp_extract("file_path", rf"{word}-(\d+)", 1).try_cast("bigint")
    frames = frames.withColumns({"_chunk": number("/chunk"), "_file": number("/file")}).drop("file_path")
    episodes = read_v3_episodes(spark, root, camera)
    here = (F.col("_chunk") == F.col("chunk_index")) & (F.col("_file") == F.col("file_index"))
    rows = frames.join(episodes.select("episode_index", "chunk_index", "file_index", "from_timestamp"), "episode_index").where(here)
    return rows.withColumn("timestamp", F.col("timestamp") + F.col("from_timestamp")).drop("_chunk", "_file", "chunk_index", "file_index", "from_timestamp")


def lookup_frames(frames: DataFrame, wanted: DataFrame, key: str = "episode_index") -> DataFrame:
    """Frames of the episodes in ``wanted``."""
    return frames.join(wanted.select(key).distinct(), key, "left_semi")


def usable_episodes(frames: DataFrame, excluded: DataFrame | None = None, least: int = 2, most: int | None = None, key: str = "episode_index") -> DataFrame:
    """Frames of episodes with ``least`` frames or more that aren't excluded; the first ``most`` episodes, if given."""
    counts = frames.groupBy(key).count().where(F.col("count") >= least)
    if excluded is not None:
        counts = counts.join(excluded.select(key), key, "left_anti")
    if most is not None:
        counts = counts.orderBy(key).limit(most)
    return frames.join(counts.select(key), key, "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A malformed line is an error, or with ``strict`` off it is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def split_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the malformed lines as ``_corrupt_record``."""
    rows = spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    struct = F.from_json("value", rows.schema.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.select(struct.alias("r")).select("r.*")
    return parsed.where("_corrupt_record IS NULL").drop("_corrupt_record"), parsed.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character of the first non-blank line."""
    head = spark.read.text(path).where(F.trim("value") != "").head()
    whole = bool(head) and head.value.lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", str(whole).lower()).json(path)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def file_listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length`` of all files under ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def leaf_datasets(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Folders that hold ``meta/episodes.jsonl``: ``path, name``, in order; folders named in ``skip`` are left out."""
    found = file_listing(spark, root, "episodes.jsonl").where(F.col("path").rlike(r"/meta/episodes\.jsonl$"))
    paths = found.select(F.regexp_replace("path", r"/meta/episodes\.jsonl$", "").alias("path")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return paths.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))).orderBy("path") if skip else paths.orderBy("path")


def datasets_at_depth(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """``path, robot_type, name`` for folders with ``meta/info.json`` exactly ``depth`` levels below ``root``."""
    base = root.rstrip("/")
    found = file_listing(spark, root, "info.json").select(F.regexp_replace("path", r"/meta/info\.json$", "").alias("path"))
    below = F.split(F.regexp_extract("path", "/" + base.strip("/").split("/")[-1] + "/(.*)$", 1), "/")
    rows = found.withColumn("parts", below).where(F.size("parts") == depth)
    return rows.select("path", F.when(F.size("parts") > 1, F.get("parts", F.lit(0))).alias("robot_type"), F.element_at("parts", -1).alias("name")).orderBy("path")


def bad_files(spark: SparkSession, root: str, first: int | None = None) -> DataFrame:
    """``path, reason`` for Parquet files that are empty or lack the format's marks at their start and end.

    Spark's scans pass over files without bytes, so these come from the store's listing, by name and length only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    if first is not None:
        files = files.orderBy("path").limit(first)
    mark = F.lit(b"PAR1")
    sound = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    broken = files.select("path", F.when((F.col("length") < 12) | ~sound, "unreadable footer").alias("reason")).where("reason IS NOT NULL")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, empty = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0 and file.getPath().getName().endswith(".parquet"):
            empty.append((file.getPath().toString(), "empty file"))
    return broken.unionByName(spark.createDataFrame(empty, "path STRING, reason STRING"))


def shift_times(frames: DataFrame, episodes: DataFrame, key: str = "episode_index") -> DataFrame:
    """Frames of files that hold many episodes, with each episode's ``from_timestamp`` added to its frames' times."""
    return frames.join(episodes.select(key, "from_timestamp"), key).withColumn("timestamp", F.col("timestamp") + F.col("from_timestamp")).drop("from_timestamp")


def flatten_reports(reports: DataFrame, nested: bool) -> DataFrame:
    """``dataset, sub_dataset, episode_id, reasons`` from filter reports: a map of episodes, or of sub-datasets to such maps."""
    if nested:
        reports = reports.select("dataset", F.explode("flagged").alias("sub_dataset", "flagged"))
    else:
        reports = reports.select("dataset", F.lit(None).cast("string").alias("sub_dataset"), "flagged")
    return reports.select("dataset", "sub_dataset", F.explode("flagged").alias("episode_id", "reasons")).withColumn("episode_id", F.col("episode_id").try_cast("bigint"))
