"""Evidence: quotes found again in their source, and claims held against them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, money
from . import passages

LEAST_SCORE = 88.0
FOUND = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("method", T.StringType())])

@F.pandas_udf(FOUND)
def locate_quote(sources: pd.Series, quotes: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a source: exactly after normalising (score 100), else the window most like it
    if that scores 88 or more; quotes under four characters and null ones are missing."""
    rows = []
    for source, quote in zip(sources, quotes, strict=True):
        text, places = passages.plain(source or "")
        wanted = passages.wanted(quote or "")
        found = passages.located_one(text, wanted) if len(wanted) >= passages.SHORTEST else None
        if found:
            _, score, a, b = found
            rows.append((True, round(score, 1), int(places[a]), int(places[b - 1]) + 1, "exact" if score == 100.0 else "fuzzy"))
        else:
            rows.append((False, 0.0, None, None, "missing"))
    return pd.DataFrame(rows, columns=FOUND.names)


def verified(found: Column, span: Column, budget: Column, amounts: Column, year: Column, timing_text: Column, reference: Column, confidence: Column) -> Column:
    """A struct of issues and verdict for a claim with one quote. `found` is what locate_quote gave, span the
    words it found, amounts the won values of span and of the words for the budget."""
    resolved = F.coalesce(dates.timing(timing_text, reference), dates.timing(span, reference))["year"]
    agrees = F.exists(amounts, lambda a: money.agree(budget, a))
    issues = F.array_compact(F.array(
        F.when(~found["found"], "evidence_not_found"), F.when(budget.isNotNull() & ~agrees, F.when(F.size(amounts) > 0, "budget_mismatch").otherwise("budget_unsupported")),
        F.when(year.isNotNull() & ~F.coalesce(resolved == year, F.lit(False)), "year_unverified"), F.when(confidence < 0.4, "low_confidence"),
    ))
    verdict = F.when(F.array_contains(issues, "evidence_not_found"), "rejected").when(F.size(issues) > 0, "needs_review").otherwise("accepted")
    return F.struct(issues.alias("issues"), verdict.alias("verdict"), F.array_max(amounts).alias("budget_parsed"), resolved.alias("year_resolved"))
