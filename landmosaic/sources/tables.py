"""Readers and writers of the logical tables; column aliases."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import fill_if_empty, is_empty

# ---- Fixed values: column aliases and the analysts' column names. ----
ALIASES = {
    "generated_land_use": ["generated_land_use", "land_use", "landuse", "land_use_text", "description", "описание", "generated_landuse", "class_Описание (исходное)", "class_описание (исходное)"],
    "class_ui": ["class_ui", "class", "utt_class", "predicted_class", "класс", "Class", "class_Класс", "class_класс"],
    "subclass_ui": ["subclass_ui", "subclass", "sub_class", "predicted_subclass", "подкласс", "class_Подкласс", "class_подкласс"],
    "class_corrected_ui": ["class_corrected_ui", "откорректированный класс", "class_Откорректированный класс", "class_откорректированный класс"],
    "subclass_corrected_ui": ["subclass_corrected_ui", "откорректированный подкласс", "class_Откорректированный подкласс", "class_откорректированный подкласс"],
    "photos_ui": ["photos_ui", "class_Снимки", "снимки", "photos"],
    "oid": ["oid", "class_ID участка", "id участка", "parcel_id"],
}
EXPORT = {"oid": "class_ID участка", "class_ui": "class_Класс", "subclass_ui": "class_Подкласс", "class_corrected_ui": "class_Откорректированный класс", "subclass_corrected_ui": "class_Откорректированный подкласс", "photos_ui": "class_Снимки", "generated_land_use": "class_Описание (исходное)", "cadastral_number": "class_Кадастровый номер"}
EXPORT_ORDER = ["oid", "cadastral_number", "readable_address", "generated_land_use", *EXPORT.values(), "panorama_status", "geometry"]
REPORT = ["parcel_key", "class_ui", "subclass_ui", "class_corrected_ui", "subclass_corrected_ui", "panorama_status_ui", "photos_ui", "generated_land_use", "cadastral_number"]
# ---- End of fixed values. ----

OBJECT = "id string, name string, class string, class_id int, coordinates struct<lat: double, lon: double>, panorama struct<has_panorama: boolean, timestamp: bigint>, panoramas_by_season map<string, struct<filename: string, lat: double, lon: double>>"
SAMPLE = "struct<image_path: string, class_name: string, class_id: int, object_id: string>"
DOCUMENT = f"class_mapping map<string, int>, train_samples array<{SAMPLE}>, val_samples array<{SAMPLE}>"
LABEL = "image_path string, split string, osm_label string, vlm_label string, vlm_confident boolean, object_id string, raw string"


def work_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share: the one that spark.checkpoint.dir names, or, on a local
    master only, one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='landmosaic-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, outlives any executor, and is worked out once however
    many passes read it. It stays until the folder is cleared, or its files go with removed()."""
    path = work_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str, each: int = 4) -> DataFrame:
    """rows dealt by key over several tasks for each core, for work that is heavy a row: a small file is read in one task."""
    return rows.repartition(each * rows.sparkSession.sparkContext.defaultParallelism, key)


def place_in_files() -> Column:
    """Where a row of Parquet files stands: the file, by name, and the row in it. Spark's own order of rows is another one where
    there are several files (the largest first) or a file is read in parts."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern with stars matches, in any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().toString() for f in (system.globStatus(path) or []))


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders; those that aren't there are no error."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Object metadata, one JSON file each below a folder per class; rows without id go, and folder_class is the folder's name."""
    rows = spark.read.schema(OBJECT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return rows.withColumn("folder_class", F.regexp_replace(folder, "^[^=]*=", "")).where("id IS NOT NULL AND id <> ''")


def checked_objects(objects: DataFrame) -> DataFrame:
    """objects, or an error if one lies in a folder of another class."""
    wrong = misplaced(objects.where("class IS NOT NULL")).select("id", "class", "folder_class").first()
    if wrong:
        raise ValueError(f"object {wrong[0]} of class {wrong[1]} in the folder of {wrong[2]}")
    return objects


def misplaced(objects: DataFrame) -> DataFrame:
    """Objects in a folder of another class; a valid collection has none."""
    return objects.where(~F.col("folder_class").eqNullSafe(F.col("class")))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A dataset document's two sample lists as one table with split."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    part = lambda split: doc.select(F.lit(split).alias("split"), F.explode(f"{split}_samples").alias("s")).select("split", "s.*")
    return part("train").unionByName(part("val"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).json(path)


def statistics(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """split, class_name, n: samples of each class of each split (zero for absent ones), of each split, and of all (nulls)."""
    counts = samples.groupBy("split", "class_name").agg(F.count("*").alias("n"))
    keys = classes.select("class_name").crossJoin(F.broadcast(samples.select("split").distinct()))  # two splits
    counts = keys.join(counts, ["split", "class_name"], "full_outer").select("split", "class_name", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.rollup("split", "class_name").agg(F.sum("n").alias("n"))


def write_dataset(samples: DataFrame, classes: DataFrame, path: str) -> None:
    """Samples by split, and their statistics."""
    samples.write.partitionBy("split").parquet(f"{path}/samples")
    statistics(samples, classes).write.json(f"{path}/statistics")


def append_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").json(path)


def exported(parcels: DataFrame) -> DataFrame:
    """The analysts' columns, in their order; those that there are."""
    out = parcels.select("*", *[F.col(a).alias(b) for a, b in EXPORT.items() if a in parcels.columns])
    if "panorama_status_ui" in out.columns:
        out = out.withColumn("panorama_status", F.col("panorama_status_ui"))
    return out.select(*[f"`{c}`" for c in EXPORT_ORDER if c in out.columns])


def write_report(parcels: DataFrame, path: str) -> None:
    """The report's columns in their order, nulls as ""; semicolons, all cells quoted, quotes doubled."""
    rows = parcels.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in parcels.columns else F.lit("").alias(c) for c in REPORT])
    rows.write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def features(parcels: DataFrame, properties: list[str], geometry: Column, points: Column) -> DataFrame:
    """One GeoJSON-like feature a row."""
    there = [c for c in properties if c in parcels.columns]
    return parcels.select("parcel_key", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*there).alias("properties"), geometry.alias("geometry"), points.alias("view_points"))).alias("feature"))


def client_rows(parcels: DataFrame, text_columns: list[str]) -> DataFrame:
    """Nulls as "", the object id as a number or null."""
    return parcels.select(F.expr("try_cast(oid AS BIGINT)").alias("oid"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in text_columns])


def resolve(df: DataFrame, aliases: list[str], prefer_data: bool = False) -> str | None:
    """The column that an alias names: as spelled, else in any case; with prefer_data the candidate with most non-empty
    values, the first alias on ties. One aggregate looks at all candidates."""
    low = {c.lower(): c for c in reversed(df.columns)}
    found = list(dict.fromkeys(a if a in df.columns else low.get(a.lower()) for a in aliases if a in df.columns or a.lower() in low))
    if not found or not prefer_data or len(found) == 1:
        return found[0] if found else None
    counts = df.agg(*[F.count_if(~is_empty(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(found)]).first()
    return found[max(range(len(found)), key=lambda i: (counts[i], -i))]


def normalised(df: DataFrame) -> DataFrame:
    """df with parcel_key, oid and the text columns under their own names; all other columns stay.

    The description is the alias with most values. Of the others each gap is filled from the alias with most values; what a
    column has of its own stays. Missing columns are "". Without an oid the row's number, from 1, stands for it."""
    from ..operators.ranking import indexed

    low = {c.lower(): c for c in df.columns}
    own = {c: low.get(c) for c in ALIASES}
    values = {}
    for name, aliases in ALIASES.items():
        if name == "oid":
            continue
        source = resolve(df, aliases, prefer_data=True)
        mine = F.col(f"`{own[name]}`").cast("string") if own[name] else F.lit("")
        if source and source != own[name]:
            given = F.col(f"`{source}`").cast("string")
            values[name] = F.coalesce(given, F.lit("")) if name == "generated_land_use" else fill_if_empty(mine, given)
        else:
            values[name] = mine
    oid = resolve(df, ALIASES["oid"])
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ALIASES and c.lower() != "parcel_key"]
    columns = [*rest, *[F.coalesce(v, F.lit("")).alias(c) for c, v in values.items()]]
    if oid:
        out = df.select(F.expr(f"try_cast(`{oid}` AS BIGINT)").alias("oid"), *columns)
    else:
        out = indexed(df.select(F.monotonically_increasing_id().alias("_row"), *columns), ["_row"], "oid").drop("_row").withColumn("oid", F.col("oid") + 1)
    return out.withColumn("parcel_key", F.col("oid").cast("string"))


def without_private(df: DataFrame) -> DataFrame:
    """df without the columns whose names begin with an underscore."""
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")])
