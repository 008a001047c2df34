"""Landed source records as documents: envelopes, field picks, digests, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import compact_date
from ..functions.text import first_of, whole_number

#: Fields of the three kinds of procurement record, by meaning; several names are tried in order.
FIELDS = {
    "order_plan": {"external_id": ("orderPlanUntyNo",), "title": ("bizNm",), "published": ("nticeDt",), "amounts": ("sumOrderAmt",), "publisher": ("orderInsttNm",), "code": ("orderInsttCd",), "bids": ("bidNtceNoList",)},
    "prespec": {"external_id": ("bfSpecRgstNo",), "title": ("prdctClsfcNoNm",), "published": ("rcptDt",), "amounts": ("asignBdgtAmt",), "publisher": ("rlDminsttNm",), "code": (), "bids": ("bidNtceNoList",)},
    "bid_notice": {"external_id": ("bidNtceNo",), "title": ("bidNtceNm",), "published": ("bidNtceDt",), "amounts": ("asignBdgtAmt", "bdgtAmt", "presmptPrce"), "publisher": ("dminsttNm",), "code": ("dminsttCd",), "bids": ()},
}
LEAST_AMOUNT = 10_000


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): each landed JSON response whole, as a variant."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("body"))


def envelope_items(body: Column) -> Column:
    """The items of a response: items as a list, as {item: [...]} or as {item: {...}}; none for others."""
    at = lambda p, kind: F.try_variant_get(body, p, kind)
    single = F.when(at("$.response.body.items.item", "map<string,string>").isNotNull(), F.array(at("$.response.body.items.item", "map<string,string>")))
    return F.coalesce(at("$.response.body.items", "array<map<string,string>>"), at("$.response.body.items.item", "array<map<string,string>>"), single, F.array().cast("array<map<string,string>>"))


def total_count(body: Column) -> Column:
    """How many items the source says there are, else how many came."""
    return F.coalesce(F.try_variant_get(body, "$.response.body.totalCount", "bigint"), F.size(envelope_items(body)).cast("bigint"))


def _pick(item: Column, names: tuple[str, ...]) -> Column:
    return first_of(*(F.try_element_at(item, F.lit(n)) for n in names)) if names else F.lit(None).cast("string")


def bid_numbers(text: Column) -> Column:
    """Numbers of a list with commas, blanks cut, the three-digit revision of new-style numbers too, once each."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), r"^(R\d{2}[A-Z]{2}\d{8})\d{3}$", "$1"))
    return F.array_distinct(F.filter(cut, lambda x: x != ""))


def mapped(items: DataFrame, kind: str, item: str = "item") -> DataFrame:
    """Documents of one kind from items (maps of text): rows without id, title or date are left out; the
    amount is the first of its fields that isn't a placeholder."""
    f, x = FIELDS[kind], F.col(item)
    values = [whole_number(F.try_element_at(x, F.lit(n))) for n in f["amounts"]]
    out = items.select(
        F.lit(kind).alias("doc_type"), _pick(x, f["external_id"]).alias("external_id"), _pick(x, f["title"]).alias("title"), compact_date(_pick(x, f["published"])).alias("published_at"),
        F.coalesce(*(F.when(v >= LEAST_AMOUNT, v) for v in values)).alias("amount_krw"), _pick(x, f["publisher"]).alias("publisher_raw"), _pick(x, f["code"]).alias("provider_code"), bid_numbers(_pick(x, f["bids"])).alias("bid_notice_nos"),
        F.map_filter(x, lambda k, v: v.isNotNull() & (v != "")).alias("structured"),
    )
    return out.where("external_id is not null and title is not null and published_at is not null")


def content_hash(title: Column, content: Column, structured: Column) -> Column:
    """SHA-256 of title, content and the structured fields in the order of their names."""
    pairs = F.transform(F.sort_array(F.map_entries(structured)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat_ws("\x1f", title, F.coalesce(content, F.lit("")), F.array_join(pairs, "\x1e")), 256)


def sniffed_type(content: Column) -> Column:
    """MIME type from the first bytes: PDF, HWP (an OLE file), HWPX or another ZIP; else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("255044462D"), "application/pdf").when(head == "D0CF11E0A1B11AE1", "application/x-hwp").when(head.startswith("504B0304"), F.when(F.hex(content).contains(F.hex(F.lit("Contents/section"))), "application/hwp+zip").otherwise("application/zip"))


def plain_html(html: Column) -> Column:
    """Text of simple HTML: block ends are line feeds, tags go, blanks collapse, empty lines close up."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    lines = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|article|ul|nav|footer)>", "\n")
    text = F.regexp_replace(lines, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def field_coverage(documents: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """For each group how many rows there are and which share has each field."""
    share = [F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in fields]
    return documents.groupBy(by).agg(F.count("*").alias("n"), *share)
