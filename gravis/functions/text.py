"""Text normalisation as native Column expressions (no Python UDF).

``fold_accents`` reproduces "NFKD, then keep ASCII" on the JVM: one
``translate`` (one-to-one), then, for texts that are not ASCII yet, a map of the
one-to-many forms and removal of the rest. The tables are made from
``unicodedata`` over all code points, so no character list is written by hand.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters with a one-character ASCII form, those forms, and the
    characters with a longer one, over all code points."""
    one, longer = {}, {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        form = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(form) == 1:
            one[ch] = form
        elif form:
            longer[ch] = form
    return "".join(one), "".join(one.values()), longer


# Every character Python's str.strip() removes (it strips all Unicode
# whitespace, Spark's trim only the space), derived from str.isspace.
WHITESPACE = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


def strip_whitespace(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def fold_accents(c: Column | str) -> Column:
    """ASCII form of the text: decomposed accents removed, compatibility
    characters expanded (e.g. one-half becomes '12'), anything else dropped.
    Only texts that still hold other characters after the one-to-one step are
    looked at character by character."""
    col = F.col(c) if isinstance(c, str) else c
    one, forms, longer = _tables()
    col = F.translate(col, one, forms)
    expand = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    spelled = F.array_join(F.transform(F.regexp_extract_all(col, F.lit(r"(?s)."), F.lit(0)),
                                       lambda ch: F.coalesce(F.try_element_at(expand, ch), ch)), "")
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.regexp_replace(spelled, r"[^\x00-\x7F]", "")).otherwise(col)


def normalize_name(c: Column | str) -> Column:
    """Place-name key: cast to text, strip all whitespace, upper case, fold accents."""
    col = F.col(c) if isinstance(c, str) else c
    return fold_accents(F.upper(strip_whitespace(col.cast("string"))))
