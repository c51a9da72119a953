"""Scalar fields of a step's text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of torque and their factors to N.m, and the marks of a warning.
UNITS = r"kgf?\s?[.·-]?\s?m(?![a-z])|N\s?[.·-]?\s?m(?![a-z])|newton\s?met(?:er|re)s?|[lIi1]bf?[\s.\-]?ft|ft[\s.\-]?[lIi1]bf?"
NUMBER = r"\d{1,3}(?:\.\d{1,2})?"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LBFT, KGFM = 1.35582, 9.80665
WARNING = r"(?is)\b(warning|caution|note|do not|never|must not)\b[:\s]*(.{10,200}?)(?:\.|$)"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def lines_of(text: Column) -> Column:
    """A text's lines, at line feeds, carriage returns and the other characters that end a line; no empty one at the end."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_END})$", ""), LINE_END)


def rounded(value: Column) -> Column:
    """To one decimal by the value's binary digits, exact ties to the even digit; for 0 to 10**14.

    10 * value is taken apart into two products without rounding, so its distance to the middle between two tenths has the
    right sign: 2.45, a little above it as a double, becomes 2.5, 0.15 becomes 0.1 and 2.25, a tie, 2.2.
    """

    def one(x: Column) -> Column:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of its digits
        low = F.floor(x * 10).cast("double")
        over = (high * 10 - (low + 0.5)) + (x - high) * 10
        return (low + F.when(over > 0, 1.0).when((over == 0) & (low % 2 == 1), 1.0).otherwise(0.0)) / 10

    return F.get(F.transform(F.array(value), one), F.lit(0))


# a torque in prose, a number before its unit, and one in a table, a unit before its number
PROSE = rf"(?i)({NUMBER})\s*(?:[-–—]\s*{NUMBER})?\s*({UNITS})"
TABLE = rf"(?i)({UNITS})\s*(?:\([^)]{{0,40}}\))?\s*({NUMBER})"


def has_torque(text: Column) -> Column:
    """Whether torque_nm finds a figure, by one search."""
    return text.rlike(PROSE) | text.rlike(TABLE)


def torque_nm(text: Column) -> Column:
    """The low end of the first torque in N.m, one decimal: a number before its unit, else a unit before its number."""
    prose, table = PROSE, TABLE
    value = F.coalesce(F.nullif(F.regexp_extract(text, prose, 1), F.lit("")), F.nullif(F.regexp_extract(text, table, 2), F.lit(""))).cast("double")
    unit = F.coalesce(F.nullif(F.regexp_extract(text, prose, 2), F.lit("")), F.nullif(F.regexp_extract(text, table, 1), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(F.lower(unit), r"[ \-.·]", ""), "ib|1b", "lb")
    factor = F.when(plain.rlike("^(lbft|ftlb|lbfft|ftlbf)"), LBFT).when(plain.rlike("^kg"), KGFM).otherwise(1.0)
    return rounded(value * factor)


def warning(text: Column) -> Column:
    """The first hazard sentence of more than 16 characters, else null."""
    found = squeezed(F.regexp_extract(text, WARNING, 0))
    return F.when(F.length(found) > 16, found)


def tool(text: Column, tools: list[str]) -> Column:
    """The longest of the tools that the text names in any case, the first on a tie."""
    best = F.lit(None).cast("string")
    for name in sorted(tools, key=len):  # stable: later, longer names take precedence
        best = F.when(F.contains(F.lower(text), F.lit(name.lower())), F.lit(name)).otherwise(best)
    return best


def slug(text: Column, mark: str = "-", default: str = "document") -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark), f"^[{mark}]+|[{mark}]+$", "")
    return F.when(F.length(plain) > 0, plain).otherwise(F.lit(default))


def singular(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike("(sses|shes|ches)$"), word.substr(F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def quoted(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
