"""Documents to checked signals: chunks, what can be read of them, and what of that their own words bear out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, money
from . import chunking, extraction, passages
from .grounding import FOUND

STAGE = {"council_minutes": "council_mention", "budget_book": "budget_line"}


@F.pandas_udf(T.ArrayType(FOUND))
def located(sources: pd.Series, quotes: pd.Series) -> pd.Series:
    """Where each of a signal's quotes stands in its chunk; see grounding.locate_quote."""

    def one(source: str | None, own: list | None) -> list[dict]:
        text, places = passages.plain(source or "")
        out = []
        for quote in own if own is not None else []:
            wanted = passages.wanted(quote or "")
            found = passages.located_one(text, wanted) if len(wanted) >= passages.SHORTEST else None
            if found:
                _, score, a, b = found
                out.append({"found": True, "score": round(score, 1), "start": int(places[a]), "end": int(places[b - 1]) + 1, "method": "exact" if score == 100.0 else "fuzzy"})
            else:
                out.append({"found": False, "score": 0.0, "start": None, "end": None, "method": "missing"})
        return out

    return pd.Series([one(s, q) for s, q in zip(sources, quotes, strict=True)])


def checked(signals: DataFrame) -> DataFrame:
    """signals(doc_type, text, chunk_start, day, fiscal_year, unit, evidence, budget_krw, expected_year, timing_text, confidence,
    owner_code, degraded) with budget_krw and expected_year as they are kept, `at` (the quotes' places in the document),
    evidence_ratio, issues and verdict.

    The parser has the last word on an amount: a claim that no quoted amount bears out gives way to the largest of
    them. In a budget book amounts without a unit are of the table's, and its fiscal year is the year expected,
    which needs no words. A signal without an owner, or that was read in a degraded way, is to be reviewed; one
    none of whose quotes is found is rejected.
    """
    book = F.col("doc_type") == "budget_book"
    rows = signals.withColumn("_found", located("text", "evidence"))
    spans = F.transform(F.filter("_found", lambda e: e["found"]), lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]))
    rows = rows.withColumn("_span", F.array_join(spans, "\n"))
    said = F.transform(money.find_amounts("_span"), lambda a: a["value"])
    bare = F.transform(F.regexp_extract_all("_span", F.lit(r"(?<![0-9.,])(\d{1,3}(?:,\d{3})+|\d{4,})(?![0-9,]|\s*[가-힣])"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint") * F.col("unit"))
    rows = rows.withColumn("_amounts", F.array_compact(F.when(book, F.concat(F.coalesce(said, F.array().cast("array<bigint>")), bare)).otherwise(F.coalesce(said, F.array().cast("array<bigint>")))))
    year = extraction.expected_year(F.col("doc_type"), F.col("expected_year"), F.col("fiscal_year"))
    resolved = F.coalesce(dates.timing(F.col("timing_text"), F.col("day")), dates.timing(F.col("_span"), F.col("day")))["year"]
    rows = rows.withColumns({"_ratio": extraction.evidence_ratio(F.transform("_found", lambda e: e["found"])), "_year": year, "_resolved": F.when(~book & year.isNotNull(), resolved), "_grounded": F.exists("_amounts", lambda a: money.agree(F.col("budget_krw"), a))})
    issues = F.array_compact(F.array(
        F.when(F.col("_ratio") == 0, "evidence_not_found").when(F.col("_ratio") < 1, "partial_evidence"),
        F.when(F.col("budget_krw").isNotNull() & ~F.coalesce("_grounded", F.lit(False)), F.when(F.size("_amounts") > 0, "budget_mismatch").otherwise("budget_unsupported")),
        F.when(~book & F.col("_year").isNotNull() & ~F.coalesce(F.col("_resolved") == F.col("_year"), F.lit(False)), "year_unverified"), F.when(F.col("confidence") < 0.4, "low_confidence"),
        F.when(F.col("owner_code").isNull(), "institution_unresolved"), F.when(F.col("degraded").isNotNull(), F.concat(F.lit("degraded:"), "degraded")),
    ))
    places = F.transform("_found", lambda e: F.struct(e["found"].alias("found"), e["score"].alias("score"), (F.col("chunk_start") + e["start"]).alias("start"), (F.col("chunk_start") + e["end"]).alias("end"), e["method"].alias("method")))
    budget = extraction.settled_amount(F.col("budget_krw"), F.array_max("_amounts"), F.coalesce("_grounded", F.lit(False)))
    verdict: Column = F.when(F.array_contains("issues", "evidence_not_found"), "rejected").when(F.size("issues") > 0, "needs_review").otherwise("accepted")
    kept = rows.withColumns({"issues": issues, "at": places, "evidence_ratio": F.col("_ratio"), "budget_krw": F.when(F.col("budget_krw").isNotNull(), budget), "expected_year": F.col("_year")})
    return kept.withColumn("verdict", verdict).drop("_found", "_span", "_amounts", "_ratio", "_year", "_resolved", "_grounded")


def text_signals(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Checked signals of docs(doc_id, doc_type, institution_code, day, fiscal_year, unit, text): council minutes by their
    exchanges, budget books by their blocks. owners(code, executive_code): whose demand a council's words are."""
    known = docs.join(owners.select(F.col("code").alias("institution_code"), "executive_code"), "institution_code", "left").withColumn("owner_code", F.coalesce("executive_code", "institution_code"))
    chunks = chunking.by_type(known.where(F.col("doc_type").isin(*STAGE)), carry=("doc_type", "owner_code", "day", "fiscal_year", "unit")).withColumnRenamed("start", "chunk_start").drop("end", "labels")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ("doc_id", "doc_type", "text", "chunk_start", "day", "fiscal_year", "unit", "owner_code", "title", "category", "commitment", "budget_krw")
    said = extraction.council_signals(chunks.where("kind = 'exchange'"))
    spoken = said.select(*columns, F.col("timing.year").alias("expected_year"), F.col("timing.half").alias("expected_half"), F.col("timing.basis").alias("timing_text"), "evidence", "confidence")
    lines = extraction.budget_signals(chunks.where("kind = 'budget_line'"))
    booked = lines.select(*columns, F.lit(None).cast("int").alias("expected_year"), none("string").alias("expected_half"), none("string").alias("timing_text"), "evidence", F.lit(0.9).alias("confidence"))
    both = spoken.union(booked).withColumn("degraded", none("string"))
    stage = F.coalesce(*(F.when(F.col("doc_type") == d, s) for d, s in STAGE.items()))
    return checked(both).withColumn("stage", stage).drop("text")
