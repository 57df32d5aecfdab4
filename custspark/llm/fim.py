"""Fill-in-middle by one counted-quantifier match a text, in DataFrame functions alone.

regexp_count tells how many units n a text has. Two cuts a <= b are drawn from the document's
id, and a pattern made for the row, (unit{a}+)(unit{b-a}+)(rest), takes prefix, middle and suffix
in one match, whose replacement already has the parts in their new order between marks. The
quantifiers are possessive: the units are walked once, without giving back and without recursion,
so that a text of millions of units needs no more stack than a short one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custspark.llm.common import column

#: A word with the space before it, or space that no word follows. Possessive, as its classes don't overlap.
WORD_UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"


@dataclass(frozen=True)
class Infilling:
    """The unit, the marks, the percentages of texts cut and of those with the suffix first, and the seed.

    A unit is a pattern whose matches follow each other without gaps, written so that it gives nothing back.
    No mark begins as it or another one ends, so that parts beside marks can't be taken for one.
    """

    unit: str = WORD_UNIT
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 50
    suffix_first_percent: int = 80
    seed: int = 42

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _replacement(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def _literal(mark: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in mark)


def _drawn(digest: Column, i: int) -> Column:
    """The i-th 32 bits of a hex digest as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def transform(
    docs: DataFrame, keep: list[str], how: Infilling = Infilling(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Struct ``row`` of the columns kept; n (units), form (plain, psm, spm), output.

    A null or empty text, and one that holds a mark, is plain: its output is the text, empty for null. Cuts
    depend on the id, the seed and n alone, so equal rows have equal results, and a null id draws as the
    empty one. An empty table gives no rows.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    key = F.concat(F.lit(f"{how.seed}:"), F.coalesce(column(docs, id_col).cast("string"), F.lit("")))
    read = docs.select(
        F.struct(*[column(docs, c) for c in keep]).alias("row"), text.alias("text"), F.sha2(key, 256).alias("drawn")
    )
    counted = read.withColumn("n", F.regexp_count("text", F.lit(how.unit)).cast("bigint"))
    one, two = (_drawn(F.col("drawn"), i) % (F.col("n") + 1) for i in (0, 1))
    marked = reduce(lambda a, b: a | b, (F.contains("text", F.lit(m)) for m in how.marks))
    plain = (F.col("n") == 0) | marked | (_drawn(F.col("drawn"), 2) % 100 >= how.cut_percent)
    spm = _drawn(F.col("drawn"), 3) % 100 < how.suffix_first_percent
    cut = counted.select(
        "row",
        "text",
        "n",
        F.least(one, two).alias("a"),
        F.greatest(one, two).alias("b"),
        F.when(plain, "plain").when(spm, "spm").otherwise("psm").alias("form"),
    )
    units = [F.concat(F.lit(f"({how.unit}{{"), x.cast("string"), F.lit("}+)")) for x in (F.col("a"), F.col("b") - F.col("a"))]
    pattern = F.concat(F.lit(r"(?s)\A"), *units, F.lit(r"(.*)\z"))
    p, s, m = map(_replacement, how.marks)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return cut.select("row", "n", "form", output.alias("output"))


def parts(output: Column, form: Column, how: Infilling = Infilling()) -> Column:
    """prefix, middle, suffix of an output that is not plain, else null."""
    at = F.split(output, "|".join(map(_literal, how.marks)), -1)
    first, second, third = (F.element_at(at, i) for i in (2, 3, 4))
    psm = F.struct(first.alias("prefix"), third.alias("middle"), second.alias("suffix"))
    spm = F.struct(second.alias("prefix"), third.alias("middle"), first.alias("suffix"))
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restored(output: Column, parted: Column) -> Column:
    """The text that an output was made from; ``parted`` has the output's parts."""
    joined = F.concat(parted["prefix"], parted["middle"], parted["suffix"])
    return F.when(parted.isNull(), output).otherwise(joined)
