"""Readers of the files that the engine works on, all through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of photos, and media types that uploads may have.
PHOTO_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "heic", "avif", "tif", "tiff"]
ACCEPTED_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/webp", "image/heic", "image/heif", "image/avif", "image/tiff"]
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "avif": "image/avif", "tif": "image/tiff", "tiff": "image/tiff"}


def photos(spark: SparkSession, folder: str, most_bytes: int = 20_000_000) -> DataFrame:
    """path, stem, media_type, length, content, error of the photos in a folder.

    Files of other kinds are left out, and Spark lists no empty ones; error is ``too_large`` beyond ``most_bytes`` (content is then null).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    error = F.when(F.col("length") > most_bytes, "too_large")
    return files.where(ext.isin(PHOTO_EXTENSIONS)).select("path", F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1).alias("stem"), F.element_at(kinds, ext).alias("media_type"), "length", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """photo, fields (map of raw JSON values) of a truth file; keys that begin with _ are comments.

    A field that is absent has no entry; one that is null has the entry ``null``.
    """
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("photo", "fields")).where(~F.col("photo").startswith("_"))
    return rows.select("photo", F.from_json("fields", "map<string,string>").alias("fields"), "fields").toDF("photo", "fields", "json")


def exports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Exported documents (one JSON object a file), with the stem of their file."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("stem", F.regexp_extract(F.input_file_name(), "([^/]+?)(?:--[^/]*)?\\.json$", 1))


def saved_lines(spark: SparkSession, folder: str) -> DataFrame:
    """stem, line, text of saved texts (one document a file)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").withColumn("stem", F.regexp_extract(F.input_file_name(), "([^/]+?)(?:--[^/]*)?\\.txt$", 1))
    return raw.select("stem", F.posexplode(F.split("value", "\n")).alias("line", "text"))


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON whose ``ground_truth`` is JSON in a string: file_name and the parsed truth."""
    rows = spark.read.schema("file_name string, ground_truth string").json(path)
    return rows.select("file_name", F.from_json("ground_truth", schema).alias("truth"))


def labelled_words(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """doc, ix, line, text, field, known of word-box files: empty words go, a graphic word has no field, a label not in ``labels`` is not known."""
    schema = "file_name string, mots array<struct<texte:string,etiquette:string,indice_ligne:int,bbox:array<double>>>"
    rows = spark.read.schema(schema).json(path).select(F.col("file_name").alias("doc"), F.posexplode("mots").alias("ix", "w"))
    label = F.col("w.etiquette")
    field = F.when(label.isin(labels), label)
    return rows.where(F.trim("w.texte") != "").select("doc", "ix", F.col("w.indice_ligne").alias("line"), F.col("w.texte").alias("text"), field.alias("field"), (label.isNull() | label.isin(labels) | label.isin("graphique", "exterieur")).alias("known"), F.col("w.bbox").alias("box"))


def upload_error(media_type: Column, length: Column, most_bytes: int = 20_000_000) -> Column:
    """``bad_request`` for a media type that isn't accepted or an empty file, ``too_large`` beyond ``most_bytes``, else null."""
    return F.when(~F.coalesce(media_type.isin(ACCEPTED_TYPES), F.lit(False)) | (length == 0), "bad_request").when(length > most_bytes, "too_large")


def split(spark: SparkSession, root: str, name: str, schema: str, limit: int | None = None) -> DataFrame:
    """Documents of one split in order of file name; an error if there is none."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/{name}")
    if rows.isEmpty():
        raise ValueError(f"split {name} is empty")
    rows = rows.orderBy("file_name")
    return rows.limit(limit) if limit else rows


def frozen_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary that ``writers.summary`` wrote, to compare a run with."""
    return spark.read.json(path)


def traps(spark: SparkSession, path: str, subcategories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixed receipts of a JSON file (nom, lignes, attendu): name, lines, category, subcategory; and those whose expected sub-category is unknown."""
    schema = "pieges array<struct<nom:string,lignes:array<string>,attendu:struct<categorie:string,sousCategorie:string>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("pieges").alias("p"))
    rows = rows.select(F.col("p.nom").alias("name"), F.col("p.lignes").alias("lines"), F.col("p.attendu.categorie").alias("category"), F.col("p.attendu.sousCategorie").alias("subcategory"))
    return rows, unknown_values(rows, "subcategory", subcategories, "subcategory")


def bench_truth(truths: DataFrame, words: DataFrame) -> DataFrame:
    """truths (doc, subtotal, total, tps, tvq) of made receipts as a reader can know them: taxes is the array of those whose label is printed on the
    document (words: doc, text, field), null ones left out; documents without words are left out.
    """
    printed = words.where(F.col("text").rlike("[\\p{L}\\p{N}]")).groupBy("doc").agg(F.collect_set("field").alias("fields"))
    tax = lambda name: F.when(F.array_contains("fields", name) & F.col(name).isNotNull(), F.struct(F.lit(name.upper()).alias("name"), F.col(name).alias("amount")))
    return truths.join(printed, "doc").select("doc", "subtotal", "total", F.array_compact(F.array(tax("tps"), tax("tvq"))).alias("taxes"))


def unknown_values(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose value is in no row of a dimension: what a schema with an enumeration refuses."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def charset(spark: SparkSession, path: str) -> list[str]:
    """Characters of a recogniser: the file's lines in order, a blank before and a space after; a last empty line is none.

    The file is a vocabulary of bounded size, so it goes to the driver.
    """
    lines = spark.read.text(path, wholetext=True).first()[0].split("\n")
    return ["", *(lines[:-1] if lines and lines[-1] == "" else lines), " "]
