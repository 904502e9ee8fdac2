"""Phone numbers: normal form and extraction from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgsieve.functions.text import text_or_empty

# A North American number, plain or punctuated, not inside a longer digit run.
PHONE = r"(?<!\d)((?:\+?1[\s.\-]*)?(?:\(?\d{3}\)?[\s.\-]*)\d{3}[\s.\-]*\d{4})(?!\d)"
TOLL_FREE = r"(?<!\d)((?:\+?1[\s\-.]?)?(?:800|888|877|866|855|844|833)[\s\-.]?\d{3}[\s\-.]?\d{4}\b)"


def e164(raw: Column) -> Column:
    """Best-effort international form; sender names become upper case."""
    s = F.trim(text_or_empty(raw))
    n = F.regexp_replace(s, r"[^\d+]", "")
    return (F.when(s.rlike(r"\p{L}"), F.upper(s))
            .when(n == "", "")
            .when(n.startswith("+"), n)
            .when(F.length(n) == 10, F.concat(F.lit("+1"), n))
            .otherwise(F.concat(F.lit("+"), n)))


def last_ten(raw: Column) -> Column:
    return F.right(F.regexp_replace(text_or_empty(raw), r"\D", ""), F.lit(10))


def extract_phones(text: Column, *exclude: Column) -> Column:
    """Distinct numbers of the text in normal form, in order, without the given ids."""
    found = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(PHONE), F.lit(1)), e164)
    valid = F.filter(found, lambda n: n.startswith("+") & F.length(F.regexp_replace(n, r"\D", "")).between(10, 15))
    skip = F.array(*[e164(x) for x in exclude]) if exclude else F.array().cast("array<string>")
    return F.array_except(F.array_distinct(valid), skip)
