"""Folding of texts: compatibility forms taken apart, marks dropped, case folded."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What the native way covers: Latin letters with marks, and what stands before them.
NATIVE_END = 0x24F
NATIVE = rf"^[\x00-{chr(NATIVE_END)}Ḁ-ỿ‐-’]*$"


def folded(text: str) -> str:
    """One text, the plain way: the rule itself."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _tables() -> tuple[str, str, dict[str, str]]:
    """From the rule: letters that become one other, what they become, and those that become several or none."""
    covered = [chr(k) for k in [*range(NATIVE_END + 1), *range(0x1E00, 0x1F00), *range(0x2010, 0x201A)]]
    changed = {c: folded(c) for c in covered if folded(c) != c}
    one = {a: b for a, b in changed.items() if len(b) == 1}
    return "".join(one), "".join(one.values()), {a: b for a, b in changed.items() if len(b) != 1}


_FROM, _TO, _SEVERAL = _tables()


@F.pandas_udf(StringType())
def _python(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else folded(t))


def fold_native(text: Column) -> Column:
    """:func:`fold_text` for texts of Latin letters; other letters stay as they are."""
    out = F.translate(text, _FROM, _TO)
    several = "[" + "".join(_SEVERAL) + "]"
    spelled = out
    for a, b in _SEVERAL.items():
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    return F.when(out.rlike(several), spelled).otherwise(out)


def fold_text(text: Column) -> Column:
    """NFKD without marks, case folded, for any text; null is empty. Python only sees the texts that hold letters beyond NATIVE."""
    native = text.rlike(NATIVE)
    return F.coalesce(F.when(native, fold_native(text)), _python(F.when(~native, text)), F.lit(""))


def normalized_text(text: Column) -> Column:
    """:func:`fold_text` with each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(fold_text(text), r"[\s\x1c-\x1f\x85    　\xa0 -  ]+", " "))
