"""Attachments: names, content-addressed storage and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File endings of common media types.
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "application/pdf": ".pdf", "audio/mpeg": ".mp3", "video/mp4": ".mp4", "text/plain": ".txt"}


def file_name(name: Column, mime: Column, content_hash: Column) -> Column:
    """The given name, or the hash with the ending of the type (.bin for others)."""
    ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[mime]
    return F.when(F.trim(name) != "", F.trim(name)).otherwise(F.concat(content_hash, F.coalesce(ext, F.lit(".bin"))))


def stored_names(files: DataFrame) -> DataFrame:
    """files (folder, name, sha) with stored: equal content under one name is stored once; of different contents the first
    by hash keeps the name, the others get 12 characters of their hash in it."""
    w = Window.partitionBy("folder", "name").orderBy("sha")
    base, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    return files.withColumn("_at", F.dense_rank().over(w)).withColumn("stored", F.when(F.col("_at") == 1, F.col("name")).otherwise(F.concat(base, F.lit("_"), F.substring("sha", 1, 12), ext))).drop("_at")


def url(name: Column) -> Column:
    """Percent-encoded, with %20 for a space and slashes as they are."""
    return F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def link(name: Column, mime: Column) -> Column:
    """An image or a link in Markdown."""
    target = F.concat(F.lit("_attachments/"), url(name))
    return F.concat(F.when(mime.startswith("image/"), "!").otherwise(""), F.lit("["), name, F.lit("]("), target, F.lit(")"))
