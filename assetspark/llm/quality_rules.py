"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, words_of

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that fails the rule; null counts as passed."""

    name: str
    rejects: Column


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_text`` (null as empty) and ``_words``, from which rules are written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_words", words_of(F.col(text_col)))


def base_features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t\\n\\u000b\\f\\r]"))
    words, n = F.col("_words"), F.size("_words")
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    windows = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = lambda i: F.get(F.col("_windows"), i)["h"]
    places = F.transform(
        F.filter(
            F.transform("_windows", lambda w, k: F.when((w["h"] == at(k - 1)) | (w["h"] == at(k + 1)), w["i"])),
            lambda i: i.isNotNull(),
        ),
        lambda i: F.array(i, i + 1, i + 2),
    )
    return (
        docs.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, f"[{SPACES}]", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_repeats", F.size("_hashes") > F.size(F.array_distinct("_hashes")))
        # only texts in which a window comes back are sorted
        .withColumn("_windows", F.when(F.col("_repeats"), windows))
        .withColumn("n_repeat_words", F.when(F.col("_repeats"), F.size(F.array_distinct(F.flatten(places)))).otherwise(0).cast("long"))
        .drop("_lines", "_hashes", "_repeats", "_windows")
    )


def measure(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Cost in seconds and share of rejected rows of every rule on the stored sample."""
    rows = max(1, sample.count())
    out = []
    for rule in rules:
        job = sample.agg(F.sum(rule.rejects.cast("int")))
        job.collect()  # one row; compiles the rule
        began = time.perf_counter()
        rejected = job.collect()[0][0] or 0
        out.append((rule, time.perf_counter() - began, rejected / rows))
    return out


def order_rules(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, best first; names settle ties."""
    return [rule for rule, _, _ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[0].name))]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule, in the given order, that rejects the row; null if none does.

    A later branch is only evaluated when all before it let the row pass.
    """
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def run_cascade(docs: DataFrame, rules: list[Rule], sample: DataFrame, open_rows: Column | None = None) -> DataFrame:
    """Adds ``rejected_by``; ``docs`` and ``sample`` have what the rules read, ``open_rows`` says which rows are judged.

    The order comes from the sample and only changes the cost: a row is kept if no rule rejects
    it, in any order. An empty sample orders the rules by name.
    """
    ordered = order_rules(measure(cut_lineage(sample), rules))
    return docs.withColumn("rejected_by", F.when(F.lit(True) if open_rows is None else open_rows, cascade(ordered)))


def sample_of(docs: DataFrame, rows: int = 2000, seed: int = 5) -> DataFrame:
    """About ``rows`` rows, drawn before anything is computed from them."""
    return docs.sample(fraction=min(1.0, rows / max(1, docs.count())), seed=seed)


def production_rules() -> list[Rule]:
    """Rules over the base features and the words; each catches one kind of damage."""
    n = F.col("n_words")
    words = F.col("_words")
    shouted = F.size(F.filter(words, lambda w: w.rlike("!!")))
    bars = F.size(F.filter(words, lambda w: w == "|"))
    return [
        Rule("word_length", (F.col("word_chars") > 14 * n) | (F.col("word_chars") < 2 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > 2 * n),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 3) & (20 * F.col("n_dup_lines") > n)),
        Rule("repeats", 100 * F.col("n_repeat_words") > 30 * n),
        Rule("shouting", 10 * shouted > n),
        Rule("tables", 10 * bars > n),
    ]


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """One row per document: id, base features, base_failed, kept, rejected_by.

    A document fails the base when it has fewer than ``min_words`` words or when more than
    ``repeat_percent`` of its words stand in repeated 3-word windows. The others run through the
    cascade of ``production_rules``. Null and empty texts have no words and fail the base.
    Repeated rows and null ids get a row each; extra columns are not read; an empty table gives no
    rows. Everything is computed inside the row, so no key gathers rows.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = base_features(with_words(source)).withColumn("base_failed", failed)
    judged = run_cascade(rows, production_rules(), base_features(with_words(sample_of(source))), ~F.col("base_failed"))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
        "rejected_by",
    )
