"""File listings, content hashes and decoded pictures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import rgba_pixel_hash

# Image file extensions.
EXTENSIONS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def by_extension(rows: DataFrame, path: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """Rows whose path ends in one of the extensions, whatever their case; a name of a dot and letters only has none."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return rows.filter(suffix.isin([e.lower() for e in extensions]))


def hashed_contents(rows: DataFrame, name: str, content: str) -> DataFrame:
    """SHA-256 and size of contents held in a table, and whether the row is the first of its content by name.

    The hash is the only key that is shuffled; a content with very many copies costs one partial minimum a task.
    """
    hashed = rows.select(name, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))
    firsts = hashed.groupBy("sha256").agg(F.min(name).alias("_first"))
    return hashed.join(firsts, "sha256").select(name, "sha256", "size", (F.col(name) == F.col("_first")).alias("first"))


def listing(spark: SparkSession, folder: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """Paths of a folder tree by case-blind extension; contents are not read."""
    return by_extension(_files(spark, folder).select("path", "length"), "path", extensions)


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each file."""
    return _files(spark, folder).select("path", F.sha2("content", 256).alias("sha256"))


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pictures; an undecodable file is a row with an error, not a failure.

    Pixel bytes are in the reader's BGR(A) order, rows top to bottom.
    """
    image = F.col("image")
    broken = image["height"] < 0
    return (
        spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
        .select(
            image["origin"].alias("path"), image["width"].alias("width"), image["height"].alias("height"),
            image["nChannels"].alias("channels"), image["data"].alias("data"),
            F.when(broken, "decode_failed").alias("error"),
        )
    )


def fingerprints(images: DataFrame) -> DataFrame:
    """Exact RGBA pixel hash per picture; broken ones keep a null hash."""
    pixel = F.when(F.col("error").isNull(), rgba_pixel_hash("width", "height", "channels", "data"))
    return images.select("path", "width", "height", "error", pixel.alias("pixel_sha256"))


def explode_texels(images: DataFrame) -> DataFrame:
    """(texture_id, x, y, r, g, b, a) rows of decoded pictures.

    ``images``: texture_id, width, height, channels, data. Rows are emitted in
    batches per picture row block, so a task never holds more than one picture
    and a slice of its texels.
    """

    def unpack(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.data is None:
                    continue
                pixels = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
                step = max(1, 262144 // row.width)
                for top in range(0, row.height, step):
                    part = pixels[top : top + step]
                    rows, columns = np.indices(part.shape[:2])
                    color = part[..., 2::-1] if row.channels > 2 else np.repeat(part[..., :1], 3, axis=2)
                    alpha = part[..., 3] if row.channels == 4 else np.full(part.shape[:2], 255, np.uint8)
                    yield pd.DataFrame(
                        {
                            "texture_id": row.texture_id, "x": columns.ravel(), "y": rows.ravel() + top,
                            "r": color[..., 0].ravel().astype(np.int64), "g": color[..., 1].ravel().astype(np.int64),
                            "b": color[..., 2].ravel().astype(np.int64), "a": alpha.ravel().astype(np.int64),
                        }
                    )

    key = images.schema["texture_id"].dataType.simpleString()
    return images.select("texture_id", "width", "height", "channels", "data").mapInPandas(
        unpack, f"texture_id {key}, x long, y long, r long, g long, b long, a long"
    )


def pack_pictures(texels: DataFrame, width: int) -> DataFrame:
    """Full-width pictures as binary rows in BGRA order (the tile storage form).

    A picture is one row of the result, so its bytes are gathered per picture.
    """
    pixel = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "bgra"])
    line = F.array_sort(F.collect_list(F.struct("x", pixel.alias("p"))))
    lines = texels.groupBy("texture_id", "y").agg(line.alias("line")).select(
        "texture_id", "y", F.array_join(F.transform("line", lambda e: e["p"]), "").alias("hexline")
    )
    rows = lines.groupBy("texture_id").agg(F.array_sort(F.collect_list(F.struct("y", "hexline"))).alias("rows"))
    return rows.select(
        "texture_id", F.lit(width).alias("width"), F.size("rows").alias("height"), F.lit(4).alias("channels"),
        F.unhex(F.array_join(F.transform("rows", lambda e: e["hexline"]), "")).alias("data"),
    )
