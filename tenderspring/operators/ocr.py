"""Texts read by a machine: numbers repaired by columns, words by the closest of a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import closest

#: Letters read for digits, and what is said for won.
LOOKALIKES = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5"}
WON_MISREAD = "윈웜"
#: Particles that may follow a word.
PARTICLES = ("을", "를", "이", "가", "은", "는", "의", "에", "로", "와", "과", "도", "만", "에서", "으로")
LEAST, MARGIN, SHORTEST = 84.0, 4.0, 3

_LIKE = "".join(LOOKALIKES)
_NUMBER = rf"(?<![A-Za-z가-힣0-9{_LIKE},.])[0-9{_LIKE}][0-9{_LIKE},.]*[0-9{_LIKE}](?![A-Za-z가-힣])"


def fixed_numbers(text: Column, in_thousands: Column) -> Column:
    """Letters within numbers as digits, blanks after thousands' commas left out, misread won mended, and, in a table of
    thousands, points between thousands as commas. A run of letters without a digit is no number. Null stays null."""
    parts = F.split(text, rf"(?<=\G|[\s\S])(?={_NUMBER})|(?<=[0-9{_LIKE}])(?![0-9{_LIKE},.])")
    number = rf"^[0-9{_LIKE}][0-9{_LIKE},.]*[0-9{_LIKE}]$"
    digits = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(number) & p.rlike("[0-9]"), F.translate(p, _LIKE, "".join(LOOKALIKES.values()))).otherwise(p)), "")
    joined = F.regexp_replace(digits, r"([0-9]{1,3}),\s+([0-9]{3})(?![0-9])", "$1,$2")
    three = F.regexp_replace(joined, r"(?<![0-9])([0-9]{1,3})\.([0-9]{3})\.([0-9]{3})(?![0-9])", "$1,$2,$3")
    commas = F.regexp_replace(three, r"(?<![0-9])([0-9]{1,3})\.([0-9]{3})(?![0-9])", "$1,$2")
    return F.regexp_replace(F.when(in_thousands, commas).otherwise(joined), rf"([0-9십백천만억])\s?[{WON_MISREAD}](?=[\s,.)]|$)", "$1원")


def _stems(token: Column) -> Column:
    """The token, and what is left of it without a particle, longest first: (stem, tail)."""
    n = F.length(token)
    parts = [F.struct(F.substring(token, F.lit(1), n - k).alias("stem"), F.right(token, F.lit(k)).alias("tail"), F.lit(k).alias("k")) for k in (0, 1, 2)]
    return F.filter(F.array(*parts), lambda s: (F.length(s["stem"]) >= SHORTEST) & ((s["k"] == 0) | s["tail"].isin(*PARTICLES)))


def corrections(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, fixed) for tokens(token) whose stem is nearly one word of lexicon(word), and no other. The longest stem that
    decides counts; one that is a word leaves its token as it is, as do shorter ones after it."""
    stems = tokens.distinct().select("token", F.explode(_stems(F.col("token"))).alias("s")).select("token", "s.*")
    near = closest(stems, lexicon.select("word", F.col("word").alias("code")), "stem", "word", "code", LEAST, MARGIN)
    near = near.where(F.abs(F.length("stem") - F.length("code")) <= 1).select("stem", F.col("code").alias("word"))
    known = lexicon.select(F.col("word").alias("stem"), F.lit(True).alias("known")).distinct()
    first = stems.join(near, "stem", "left").join(known, "stem", "left").where("known or word is not null").groupBy("token").agg(F.min_by(F.struct("word", "tail", "known"), "k").alias("m"))
    return first.where("m.known is null").select("token", F.concat("m.word", "m.tail").alias("fixed"))


def corrected(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """texts with `corrected`: every run of three Hangul syllables or more that is misread is put right. Ids must be
    distinct; null texts stay null."""
    rows = texts.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.col(text_col), r"(?<=[가-힣])(?![가-힣])|(?<![가-힣])(?=[가-힣])")).alias("_at", "_part"))
    is_word = F.col("_part").rlike("^[가-힣]{3,}$")
    found = corrections(rows.where(is_word).select(F.col("_part").alias("token")), lexicon)
    # Only texts with something to mend are put together again.
    mended = rows.join(found, F.col("_part") == F.col("token"), "left")
    touched = mended.where("fixed is not null").select("_id").distinct()
    whole = mended.join(touched, "_id").groupBy("_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("fixed", "_part").alias("x")))), lambda s: s["x"]), "").alias("_new"))
    return texts.join(whole, F.col(id_col) == F.col("_id"), "left").select(*texts.columns, F.coalesce("_new", text_col).alias("corrected"))
