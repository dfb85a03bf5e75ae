"""Pluggable batch recognizer.

A recognizer is ``fn(payload, variant_id) -> list[dict]`` with text and
confidence. Its signature is a literal that enters the cache key. Stages are
DataFrames: primary over all misses, classify, fallback over what is not yet
confirmed, classify again. A worker keeps the tier of an asset up to date while
its variants are read, and the fallback's worker starts from the readings of the
primary, so both stop as soon as all readings together are confirmed.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .selection import Thresholds, classify, processing_status

Recognizer = Callable[[bytes, str], list[dict]]
#: Ids of the variants to read in order, or a function that yields them for a payload and may raise.
Variants = list[str] | Callable[[bytes], Iterable[str]]

_OUT = "asset_id {key}, call_no long, item long, engine string, variant string, text string, confidence double, ok boolean, error string"
_NAMES = ["asset_id", "call_no", "item", "engine", "variant", "text", "confidence", "ok", "error"]
#: Items of one call that keep their order in ``seq``.
_ITEMS = 1 << 40
#: Calls of the fallback are numbered from here.
_FALLBACK_CALLS = 1 << 20
#: Rows of calls that go to Spark together.
_BATCH = 4096


def combined_signature(primary: str, fallback: str | None) -> str:
    return primary if fallback is None else f"{primary}|{fallback}"


def target_letters(text: str) -> int:
    """Latin and Cyrillic letters of a text, counted after NFC."""
    names = (unicodedata.name(c, "") for c in unicodedata.normalize("NFC", text) if c.isalpha())
    return sum("LATIN" in n or "CYRILLIC" in n for n in names)


def confidence_of(value: object) -> float:
    """Between 0 and 1; what is no finite number is 0."""
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return min(1.0, max(0.0, number)) if math.isfinite(number) else 0.0


class TierState:
    """Whether the readings seen so far confirm an asset.

    Kept per asset: the best reading, and per engine the distinct texts that may agree with another engine's. A new reading is
    compared with earlier texts only, as agreement once found stays.
    """

    def __init__(self, thresholds: Thresholds) -> None:
        self.t = thresholds
        self.best: tuple[float, int, str] | None = None
        self.texts: dict[str, dict[str, None]] = {}
        self.agreed = False

    def add(self, engine: str, text: str, confidence: float) -> None:
        letters = target_letters(text)
        if not letters:
            return
        reading = (confidence, letters, text)
        self.best = reading if self.best is None else max(self.best, reading)
        if self.agreed or not engine or confidence < self.t.agreement_score:
            return
        key = "".join(c.casefold() for c in unicodedata.normalize("NFC", text) if c.isalnum())
        own = self.texts.setdefault(engine, {})
        if key in own:
            return
        matcher = SequenceMatcher(None, "", key)
        for other, seen in self.texts.items():
            if other != engine:
                self.agreed = self.agreed or key in seen or any(self._near(matcher, text) for text in seen)
        own[key] = None

    def _near(self, matcher: SequenceMatcher, earlier: str) -> bool:
        matcher.set_seq1(earlier)
        least = self.t.agreement_similarity
        return matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least

    @property
    def confirmed(self) -> bool:
        strong = self.best is not None and self.best[0] >= self.t.confirmed_score and self.best[1] >= self.t.confirmed_letters
        return strong or self.agreed


def _calls(
    asset: object, payload: bytes, engine: str, recognize: Recognizer, variants: Variants, state: TierState, early_stop: bool, first_call: int
) -> list[tuple]:
    """Rows of the calls of one engine on one asset.

    An exception of the recognizer or of the variants becomes an error row and ends the asset's calls of this engine.
    """
    out: list[tuple] = []
    try:
        for number, variant in enumerate(variants(payload) if callable(variants) else variants, first_call):
            try:
                found = [(unicodedata.normalize("NFC", str(d.get("text", ""))), confidence_of(d.get("confidence"))) for d in recognize(payload, variant)]
            except Exception as error:  # an engine error is data
                out.append((asset, number, 0, engine, variant, None, None, False, f"{engine}/{variant}: {type(error).__name__}: {error}"))
                break
            out.append((asset, number, 0, engine, variant, None, None, True, None))
            for item, (text, confidence) in enumerate(found):
                out.append((asset, number, item, engine, variant, text, confidence, None, None))
                state.add(engine, text, confidence)
            if early_stop and state.confirmed:
                break
    except Exception as error:  # the variants could not be made
        number = out[-1][1] + 1 if out else first_call
        out.append((asset, number, 0, engine, None, None, None, False, f"{engine}: {type(error).__name__}: {error}"))
    return out


def _call_table(rows: list[tuple], key: pa.DataType) -> pa.Table:
    kinds = [key, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def _call_batches(walks: Iterable[list[tuple]], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of many assets per batch."""
    rows: list[tuple] = []
    for calls in walks:
        rows += calls
        if len(rows) >= _BATCH:
            yield from _call_table(rows, key).to_batches()
            rows = []
    yield from _call_table(rows, key).to_batches()


def run_engine(
    assets: DataFrame, engine: str, recognize: Recognizer, variants: Variants, thresholds: Thresholds = Thresholds(), early_stop: bool = True
) -> DataFrame:
    """Calls of one engine over distinct assets (asset_id, payload).

    An asset is one row, so its variants are tried in order inside one task; the walk stops once its readings are confirmed.
    """

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            assets, payloads = batch.column("asset_id"), batch.column("payload")
            walks = (
                _calls(asset.as_py(), payload.as_py(), engine, recognize, variants, TierState(thresholds), early_stop, 0)
                for asset, payload in zip(assets, payloads, strict=True)
            )
            yield from _call_batches(walks, assets.type)

    key = assets.schema["asset_id"].dataType.simpleString()
    return assets.select("asset_id", "payload").mapInArrow(calls, _OUT.format(key=key))


def run_fallback(
    assets: DataFrame, earlier: DataFrame, engine: str, recognize: Recognizer, variants: Variants, thresholds: Thresholds = Thresholds(),
    early_stop: bool = True,
) -> DataFrame:
    """Calls of a second engine on ``assets``, whose tier starts from the ``earlier`` readings (as of ``detections_of``).

    Assets and their readings meet by asset id; a row is one payload and what one engine read in it.
    """

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(asset: object, payload: bytes, seen: list[dict] | None) -> list[tuple]:
            state = TierState(thresholds)
            for r in seen or []:
                state.add(r["engine"], r["text"], r["confidence"])
            return _calls(asset, payload, engine, recognize, variants, state, early_stop, _FALLBACK_CALLS)

        for batch in batches:
            columns = [batch.column(c) for c in ("asset_id", "payload", "seen")]
            walks = (walk(*(value.as_py() for value in row)) for row in zip(*columns, strict=True))
            yield from _call_batches(walks, columns[0].type)

    key = assets.schema["asset_id"].dataType.simpleString()
    reading = F.struct("seq", "engine", "text", "confidence")
    seen = earlier.groupBy("asset_id").agg(F.array_sort(F.collect_list(reading)).alias("seen"))
    return assets.select("asset_id", "payload").join(seen, "asset_id", "left").mapInArrow(calls, _OUT.format(key=key))


def detections_of(calls: DataFrame) -> DataFrame:
    return calls.filter("ok is null and error is null").select(
        "asset_id", "engine", "variant", "text", "confidence", (F.col("call_no") * F.lit(_ITEMS) + F.col("item")).alias("seq"),
    )


def scan_assets(
    assets: DataFrame,
    primary: tuple[str, Recognizer],
    fallback: tuple[str, Recognizer] | None,
    variants: Variants,
    thresholds: Thresholds = Thresholds(),
    early_stop: bool = True,
) -> DataFrame:
    """Tier and processing status of each asset after both stages; errors of both engines are joined by `` | ``."""
    # recognition is the costly step: its calls are stored before they are read again
    first = cut_lineage(run_engine(assets, *primary, variants, thresholds, early_stop))
    calls = first
    if fallback is not None:
        readings = detections_of(first)
        sure = classify(readings, thresholds).filter("tier = 'confirmed'").select("asset_id")
        left = assets.join(sure, "asset_id", "left_anti")
        open_readings = readings.join(sure, "asset_id", "left_anti")
        calls = first.unionByName(cut_lineage(run_fallback(left, open_readings, *fallback, variants, thresholds, early_stop)))
    made = calls.filter("ok is not null")
    # an engine ends at its first error, so there are two at most
    failed = made.filter("error is not null").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("call_no", "error"))).alias("e"))
    errors = failed.select("asset_id", F.array_join("e.error", " | ").alias("errors_text"))
    tiers = classify(detections_of(calls), thresholds)
    joined = processing_status(made).join(tiers, "asset_id", "left").join(errors, "asset_id", "left")
    return joined.select(
        "asset_id", "status", F.col("errors_text").alias("error"), "variant_calls",
        F.coalesce("forced_tier", "tier", F.lit("rejected")).alias("tier"),
        F.when(F.col("forced_tier").isNotNull(), 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
