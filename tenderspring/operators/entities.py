"""Institutions: names as records write them resolved to codes, without guessing between several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import LEAST, MARGIN, closest

# Provinces, their short names and codes.
PROVINCES = {
    "서울특별시": ("11", "서울시", "서울"), "부산광역시": ("26", "부산시", "부산"), "대구광역시": ("27", "대구시", "대구"), "인천광역시": ("28", "인천시", "인천"), "광주광역시": ("29", "광주"), "대전광역시": ("30", "대전시", "대전"),
    "울산광역시": ("31", "울산시", "울산"), "세종특별자치시": ("36", "세종시", "세종"), "경기도": ("41", "경기"), "강원특별자치도": ("51", "강원도", "강원"), "충청북도": ("43", "충북"), "충청남도": ("44", "충남"),
    "전북특별자치도": ("52", "전라북도", "전북"), "전라남도": ("46", "전남"), "경상북도": ("47", "경북"), "경상남도": ("48", "경남"), "제주특별자치도": ("50", "제주도", "제주"),
}
# Words of bodies that carry a place's name and aren't its government, and an office that is its own.
OWN_BODIES = ("학교", "공사", "공단", "조합", "재단", "의료원", "협의회", "기구")
OWN_OFFICE = "보건의료원"
# Endings of departments.
DEPARTMENTS = ("과", "팀", "담당관", "사업소", "센터", "보건소", "실", "단", "본부")
DEPARTMENT = rf"([가-힣A-Za-z0-9·]{{2,}}(?:{'|'.join(DEPARTMENTS)}))$"


def compact(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\s+", "")


def parsed(name: Column) -> Column:
    """A struct of province, district, is_council and department read off a name."""
    plain = F.trim(F.regexp_replace(name, r"[()]", " "))
    found = F.coalesce(*(F.when(plain.startswith(alias), full) for full, (_, *short) in PROVINCES.items() for alias in (full, *short)))
    alias = F.coalesce(*(F.when(plain.startswith(a), a) for full, (_, *short) in PROVINCES.items() for a in (full, *short)))
    # A province's short name that begins a longer one is no province: 부산진구.
    glued = F.substring(plain, F.length(alias) + 1, F.lit(3)).rlike(r"^[가-힣](구|군|시)")
    province = F.when(~F.coalesce(glued & (F.length(alias) < 3), F.lit(False)), found)
    rest = F.trim(F.when(province.isNotNull(), F.substring(plain, F.length(alias) + 1, F.length(plain))).otherwise(plain))
    first = F.split_part(rest, F.lit(" "), F.lit(1))
    district = F.nullif(F.regexp_extract(F.regexp_replace(first, "특례시", "시"), r"^([가-힣]{1,5}?(?:시|군|구))(?:청|의회|청장|$)", 1), F.lit(""))
    department = F.nullif(F.regexp_extract(rest, DEPARTMENT, 1), F.lit(""))
    council = rest.rlike("(?<!협)의회") | plain.rlike("(?<!협)의회")
    return F.struct(province.alias("province"), district.alias("district"), council.alias("is_council"), department.alias("department"), F.replace(plain, F.lit(OWN_OFFICE), F.lit("")).rlike("|".join(OWN_BODIES)).alias("own_body"))


def resolve(names: DataFrame, institutions: DataFrame, name: str = "raw", hint: str | None = None) -> DataFrame:
    """names with code, method, department and candidates. Tried in order: an exact name or alias; the only
    institution of that district and kind (within the province if one is said); the one that a hint of the
    province leaves; else, of several, none (ambiguous). A body of its own is only found by its exact name.

    institutions(code, name, kind, sido, sigungu, aliases) is a small dimension; candidates are joined on the
    district, not compared with all.
    """
    rows = names.withColumns({"_id": F.monotonically_increasing_id(), "p": parsed(F.col(name)), "_hint": F.col(hint) if hint else F.lit(None).cast("string")})
    alias = institutions.select("code", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), compact))).alias("_alias"))
    exact = rows.join(alias, compact(F.regexp_replace(F.col(name), DEPARTMENT, "")) == F.col("_alias"), "left").groupBy("_id").agg(F.min("code").alias("exact"), F.count("code").alias("n_exact"))
    kind = F.when(F.col("p.is_council"), "council").otherwise("local_gov")
    pool = rows.where("p.district is not null and not p.own_body").join(institutions.select("code", F.col("kind").alias("k"), F.col("sido").alias("s"), "sigungu"), (F.col("p.district") == F.col("sigungu")) & (F.col("k") == kind) & (F.col("p.province").isNull() | (F.col("p.province") == F.col("s"))))
    whole = rows.where("p.district is null and p.province is not null and not p.own_body").join(institutions.select("code", F.col("kind").alias("k"), F.col("sido").alias("s"), "sigungu"), (F.col("p.province") == F.col("s")) & F.col("sigungu").isNull() & (F.col("k") == kind))
    both = pool.select("_id", "code", "s", "_hint").union(whole.select("_id", "code", "s", "_hint"))
    counted = both.groupBy("_id").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.sort_array(F.collect_set(F.when(F.col("s") == F.col("_hint"), F.col("code")))).alias("hinted"))
    out = rows.join(exact, "_id").join(counted, "_id", "left")
    none = F.array().cast("array<string>")
    codes, hinted = F.coalesce("codes", none), F.coalesce("hinted", none)
    method = F.when(F.col("n_exact") == 1, "exact").when(F.size(codes) == 1, "exact").when(F.size(hinted) == 1, "context").when(F.size(codes) > 1, "ambiguous").otherwise("none")
    code = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.size(codes) == 1, F.get(codes, F.lit(0))).when(F.size(hinted) == 1, F.get(hinted, F.lit(0)))
    return out.select(*names.columns, code.alias("code"), method.alias("method"), F.col("p.department").alias("department"), F.when(method == "ambiguous", codes).otherwise(none).alias("candidates"))


def misread(residue: DataFrame, institutions: DataFrame, name: str = "raw", least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """(raw, code, likeness) for names whose letters are like those of one institution's name or alias, at least as much as
    `least`, and less so, by `margin`, like any of another's."""
    alias = institutions.select("code", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    return closest(residue, alias, name, "alias", "code", least, margin)
