"""Hashes, stable ids and safe names."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import BLANKS, nfc

# Schema versions that take part in the cache key.
RESULT_SCHEMA = 1
PREPROCESS_SCHEMA = 1

# Device names that cannot be used as a file stem.
RESERVED_STEMS = (
    ["CON", "PRN", "AUX", "NUL", "CLOCK$"]
    + [f"COM{i}" for i in range(1, 10)]
    + [f"LPT{i}" for i in range(1, 10)]
)
_FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def asset_id(pixel_hash: Column) -> Column:
    return F.concat(F.lit("tex_"), F.substring(pixel_hash, 1, 20))


def source_id(path: Column, metadata_json: Column) -> Column:
    seed = F.concat(path, F.lit("\0"), metadata_json)
    return F.concat(F.lit("src_"), F.substring(sha256_hex(seed), 1, 20))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in name order; null fields are kept."""
    row = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(row, {"ignoreNullFields": "false"})


def canonical_digest(**fields: Column) -> Column:
    return sha256_hex(canonical_json(**fields))


def cache_key(pixel_hash: Column, engine_signature: Column, preprocess_digest: Column) -> Column:
    return canonical_digest(
        pixel_hash=pixel_hash,
        engine_signature=engine_signature,
        preprocess_digest=preprocess_digest,
        result_schema=F.lit(RESULT_SCHEMA),
        preprocess_schema=F.lit(PREPROCESS_SCHEMA),
    )


def safe_bundle_name(key: Column) -> Column:
    """Bundle key flattened to one file name."""
    flat = F.replace(F.btrim(F.replace(key, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"), F.lit("@"))
    return F.regexp_replace(flat, r"[^0-9A-Za-z._@-]", "_")


def png_name(key: Column, texture: Column) -> Column:
    return F.concat(F.replace(key, F.lit("/"), F.lit("@")), F.lit("__"), texture, F.lit(".png"))


def sanitize_component(name: Column, stable_id: Column, max_length: int = 120) -> Column:
    """File-system safe component; any change appends a short hash of the id."""
    trimmed = F.regexp_replace(nfc(name), r"[ .\x00-\x1f]+$", "")
    # last dot that is not the first character starts the suffix
    candidate = F.regexp_extract(trimmed, r"(?s)^.*[^./\\][^/\\]*?(\.[^./\\]+)$", 1)
    suffix = F.when(
        (F.length(candidate) <= 16) & ~candidate.rlike(_FORBIDDEN), candidate
    ).otherwise(F.lit(""))
    raw_stem = F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(suffix))
    spaced = F.regexp_replace(F.regexp_replace(raw_stem, _FORBIDDEN, "_"), f"[{BLANKS}]+", " ")
    stem = F.btrim(spaced, F.lit(" ."))
    stem = F.when(stem == "", F.lit("asset")).otherwise(stem)
    stem = F.when(F.upper(stem).isin(RESERVED_STEMS), F.concat(F.lit("_"), stem)).otherwise(stem)
    clean = F.concat(stem, suffix)
    digest = F.substring(sha256_hex(F.coalesce(F.nullif(stable_id, F.lit("")), name)), 1, 8)
    keep = F.greatest(F.lit(1), F.lit(max_length - 10) - F.length(suffix))
    hashed = F.concat(F.substring(stem, F.lit(1), keep), F.lit("__"), digest, suffix)
    return F.when((clean != name) | (F.length(clean) > max_length), hashed).otherwise(clean)


#: Leading hex digits of a row hash that name its bucket in a hash tree: at most 65,536 buckets of a group.
_BUCKET = 4


def tree_digest(rows: DataFrame, keys: list[str], row_hash: Column, out: str = "digest", **counts: Column) -> DataFrame:
    """Order-independent SHA-256 digest of every group's row hashes, ``n`` rows, and how many rows meet each condition.

    A tree of two levels: the hashes of a range of values are sorted and hashed together, then the ranges. A group spreads over its
    ranges, so no task gathers a large one, and equal digests mean equal multisets of rows as far as SHA-256 goes. Rows
    without a hash don't count. Without keys there is one row, also for an empty table.
    """
    marked = rows.select(*keys, row_hash.alias("_h"), *[c.alias(f"_c_{name}") for name, c in counts.items()]).filter("_h is not null")
    leaves = marked.groupBy(*keys, F.substring("_h", 1, _BUCKET).alias("_bucket")).agg(
        sha256_hex(F.array_join(F.array_sort(F.collect_list("_h")), ",")).alias("_leaf"),
        F.count("*").alias("_n"),
        *[F.count(F.when(F.col(f"_c_{name}"), 1)).alias(f"_c_{name}") for name in counts],
    )
    total = F.coalesce(F.sum("_n"), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("_bucket", "_leaf")))
    joined = F.array_join(F.transform(ordered, lambda leaf: leaf["_leaf"]), ",")
    return leaves.groupBy(*keys).agg(
        sha256_hex(F.concat_ws(":", total.cast("string"), joined)).alias(out),
        total.alias("n"),
        *[F.coalesce(F.sum(f"_c_{name}"), F.lit(0)).alias(name) for name in counts],
    )


def field_text(*fields: Column) -> Column:
    """Fields as lengths and values, ``-`` for null, so that different rows never share a text."""
    texts = [c.cast("string") for c in fields]
    return F.concat(*[F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in texts])


def tree_digest_sql(source: str, keys: list[str], row_hash: str = "h", out: str = "digest", **counts: str) -> str:
    """The same digest as a DuckDB query over a table or subquery."""
    by = "".join(f"{k}, " for k in keys)
    inner = "".join(f", count(*) FILTER ({c}) AS {name}" for name, c in counts.items())
    outer = "".join(f", coalesce(sum({name}), 0)::BIGINT AS {name}" for name in counts)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {by}sha256(coalesce(sum(n), 0)::BIGINT::VARCHAR||':'||coalesce(string_agg(leaf, ',' ORDER BY bucket), '')) AS {out},
      coalesce(sum(n), 0)::BIGINT AS n{outer} FROM (
      SELECT {by}substr({row_hash},1,{_BUCKET}) AS bucket, sha256(string_agg({row_hash}, ',' ORDER BY {row_hash})) AS leaf, count(*) AS n{inner}
      FROM {source} WHERE {row_hash} IS NOT NULL GROUP BY {by}bucket){group}"""


@F.pandas_udf(StringType())
def rgba_pixel_hash(
    width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series
) -> pd.Series:
    """SHA-256 over ``RGBA:{w}x{h}\\0`` and the RGBA bytes of a decoded image row."""

    def one(w: int, h: int, n: int, raw: bytes):
        if raw is None or h < 0:
            return None
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, n)
        rgba = np.full((h, w, 4), 255, dtype=np.uint8)
        if n == 1:
            rgba[..., :3] = pixels
        else:
            rgba[..., :3] = pixels[..., 2::-1]
            if n == 4:
                rgba[..., 3] = pixels[..., 3]
        digest = hashlib.sha256(f"RGBA:{w}x{h}\0".encode())
        digest.update(rgba.tobytes())
        return digest.hexdigest()

    return pd.Series([one(*row) for row in zip(width, height, channels, data)], dtype="object")
