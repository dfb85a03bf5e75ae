"""URL filter: host and path rules, then naive Bayes over segmented host and path tokens."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import lower_ascii

#: Buckets of the token counts: the bound of the naive Bayes model.
BUCKETS = 1 << 14
#: Pages that are segmented together, with the candidate words of their names only.
CHUNK = 1024
_CLASSES = ("allow", "block")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased in A-Z, the path up to ``?``, ``#`` or the end; empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits: its host or a subdomain, its path as a beginning."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits concatenated names into words by the most likely unigram path (Viterbi)."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """``counts`` needs no words but those inside the names; ``total`` is the sum over all words."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {word: math.log(total / n) for word, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        #: an unknown stretch costs more than any word, and more for each character
        self.unknown = math.log(total) + 2.0

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = best[end - 1] + self.unknown, end - 1
            for begin in range(max(0, end - self.longest), end):
                word = self.cost.get(name[begin:end])
                if word is not None and best[begin] + word < cost:
                    cost, start = best[begin] + word, begin
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def names_of(text: str) -> list[str]:
    """Runs of letters and of digits."""
    return re.findall(r"[^\W\d_]+|\d+", text.lower())


def tokens_of(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Tokens of a URL: words of the host's names and the path's; numbers by their length."""
    out = []
    for where, text in (("h", host), ("p", path)):
        for name in names_of(text):
            words = [f"#{len(name)}"] if name.isdigit() else segmenter.split(name)
            out += [f"{where}:{word}" for word in words]
    return out


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def _parts(lengths: list[int]):
    """The distinct substrings of the names of a chunk that are as long as some word: (chunk, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, host, path = (batch.column(i).to_pylist() for i in range(3))
            by_chunk: dict[int, set[str]] = {}
            for c, h, p in zip(chunk, host, path, strict=True):
                by_chunk.setdefault(c, set()).update(names_of(h), names_of(p))
            for c, names in by_chunk.items():
                found: set[str] = set()
                for name in names:
                    if not name.isdigit():
                        found.update(name[k : k + size] for size in lengths if size <= len(name) for k in range(len(name) - size + 1))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(found), pa.int64()), pa.array(list(found), pa.string())], names=["_chunk", "word"])

    return run


_PAGE = "_id long, host string, path string, rule string, _verdict string"


def _segment(total: int):
    """The pages of a chunk with the buckets of their tokens, from the chunk's candidate words."""

    def run(pages: pa.Table, candidates: pa.Table) -> pa.Table:
        counts = dict(zip(candidates.column("word").to_pylist(), candidates.column("n").to_pylist(), strict=True))
        segmenter = Segmenter(counts, total)
        known: dict[tuple[str, str], list[int]] = {}

        def side(where: str, text: str) -> list[int]:
            if (where, text) not in known:
                known[where, text] = [_bucket(t) for t in tokens_of(*((text, "") if where == "h" else ("", text)), segmenter)]
            return known[where, text]

        host, path = pages.column("host").to_pylist(), pages.column("path").to_pylist()
        buckets = [side("h", h) + [b for part in p.split("/") if part for b in side("p", part)] for h, p in zip(host, path, strict=True)]
        return pages.drop_columns(["_chunk"]).append_column("buckets", pa.array(buckets, pa.list_(pa.int32())))

    return run


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, weight = model.value
        for batch in batches:
            score = [prior + sum(weight[b] for b in buckets) for buckets in batch.column("buckets").to_pylist()]
            kept = batch.drop_columns(["buckets"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score, pa.float64())], names=[*kept.schema.names, "score"])

    return run


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of all words of the pages' titles; a table of any size."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def page_buckets(split: DataFrame, words: DataFrame) -> DataFrame:
    """Pages (of ``_PAGE``) with the buckets of their tokens, segmented by all ``words``.

    Pages are stored in chunks. The substrings of a chunk's names are joined with the word counts,
    so a frequent name or word comes once per chunk, and a chunk is segmented with its own
    candidates: no task holds the lexicon.
    """
    by_length = words.groupBy(F.length("word").alias("size")).agg(F.sum("n").alias("n")).collect()  # one row per length
    total, lengths = sum(r["n"] for r in by_length), sorted(r["size"] for r in by_length)
    row = F.monotonically_increasing_id()
    pages = cut_lineage(split.withColumn("_chunk", F.shiftright(row, 33) * (1 << 33) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / CHUNK)))
    parts = pages.select("_chunk", "host", "path").mapInArrow(_parts(lengths), "_chunk long, word string").distinct()
    candidates = parts.join(words, "word").select("_chunk", "word", "n")
    segmented = pages.groupBy("_chunk").cogroup(candidates.groupBy("_chunk")).applyInArrow(_segment(total), f"{_PAGE}, buckets array<int>")
    return cut_lineage(segmented)


def fit_bayes(labelled: DataFrame) -> tuple[float, list[float]]:
    """Log odds of block against allow: of the prior and of every token bucket (add-one)."""
    side = F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("_verdict")).cast("long") - 1
    one = F.concat(F.array(F.lit(-1)), "buckets")  # -1 counts the page
    rows = labelled.select(side.alias("side"), F.explode(one).alias("bucket")).groupBy("side", "bucket").agg(F.count("*").alias("n")).collect()
    counts, pages = np.ones((2, BUCKETS)), np.ones(2)
    for r in rows:  # at most two rows per bucket
        if r["bucket"] < 0:
            pages[r["side"]] += r["n"]
        else:
            counts[r["side"], r["bucket"]] += r["n"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return float(np.log(pages[1] / pages[0])), (logs[1] - logs[0]).tolist()


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    The longest rule that fits decides. For other URLs a multinomial naive Bayes model does: its
    tokens are the words that Viterbi segmentation by all title words finds in host and path names, its examples all
    pages that a rule decides, its counts two numbers per hash bucket. ``score`` is the log odds of
    block; at 0 or below the page is allowed.

    Null URLs and those without ``://`` have an empty host and path, no rule, and the verdict of
    the prior. Null html adds no words. Repeated rows and null ids get a row each; extra columns
    are not read; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    split = pages.select(F.col(id_col).cast("long").alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("_verdict", verdict)
    segmented = page_buckets(ruled, cut_lineage(word_counts(pages)))
    model = pages.sparkSession.sparkContext.broadcast(fit_bayes(segmented.filter("_verdict is not null")))
    judged = segmented.mapInArrow(_judge(model), f"{_PAGE}, score double")
    by_score = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", by_score).alias("verdict"), "score")
