"""Column functions for text cleaning and small string helpers.

Everything here returns a ``Column`` built from native Spark expressions so that
it stays inside whole-stage codegen.  The one exception is HTML entity decoding,
which needs the full HTML5 entity table: that goes through an Arrow-batched
pandas UDF, and only for rows that contain ``&`` (all others send NULL across).
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values (must equal the reference for equal results) -------------
# Encoding repairs, applied in this order. The bare "â€" rule comes before the
# two 'â€"' rules, so those two never fire; the order is kept on purpose.
MOJIBAKE_FIXES = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ('â€"', "—"),
    ('â€"', "-"),
    ("Â", ""),
    ("\x00", ""),
]
# Minimum length of cleaned text kept by the cleaner, and the section minimum.
MIN_TEXT_LENGTH = 50
# ---------------------------------------------------------------------------

# Python's ``\s`` (and ``str.strip``) treat U+001C..U+001F as blanks, Java's
# Unicode ``\s`` does not; add them so both agree.
_WS_RUN = "(?U)[\\s\\x{1c}-\\x{1f}]+"
_TAG = "<[^>]+>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def unescape_html(c) -> Column:
    """HTML5 entity decoding; rows without ``&`` never reach Python."""
    c = _col(c)
    return F.coalesce(_html_unescape(F.when(F.instr(c, "&") > 0, c)), c)


def strip_html(c) -> Column:
    """Decode entities, then replace each tag with one space."""
    c = _col(c)
    return F.regexp_replace(unescape_html(c), _TAG, " ")


def strip_tags(c) -> Column:
    """Tag removal alone (no entity decoding)."""
    return F.regexp_replace(_col(c), _TAG, " ")


def squeeze_whitespace(c) -> Column:
    """Every run of blanks becomes one space, then trim."""
    return F.trim(F.regexp_replace(_col(c), _WS_RUN, " "))


def fix_mojibake(c) -> Column:
    """Ordered literal replacements."""
    out = _col(c)
    for old, new in MOJIBAKE_FIXES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_text_struct(c) -> Column:
    """Html -> whitespace -> encoding, with lengths and change flags.

    Returns a struct ``clean, len_before, len_after, html_changed, ws_changed,
    enc_changed``.  NULL text gives NULL clean text, NULL lengths and false
    flags; empty text is left as is with no change flagged.
    """
    t0 = _col(c)
    nonempty = t0.isNotNull() & (F.length(t0) > 0)
    t1 = F.when(nonempty, strip_html(t0)).otherwise(t0)
    t2 = F.when(F.length(t1) > 0, squeeze_whitespace(t1)).otherwise(t1)
    t3 = F.when(F.length(t2) > 0, fix_mojibake(t2)).otherwise(t2)
    return F.struct(
        t3.alias("clean"),
        F.length(t0).cast("bigint").alias("len_before"),
        F.when(t0.isNotNull(), F.coalesce(F.length(t3), F.lit(0))).cast("bigint").alias("len_after"),
        F.coalesce(nonempty & (t1 != t0), F.lit(False)).alias("html_changed"),
        F.coalesce((F.length(t1) > 0) & (t2 != t1), F.lit(False)).alias("ws_changed"),
        F.coalesce((F.length(t2) > 0) & (t3 != t2), F.lit(False)).alias("enc_changed"),
    )


def clean_text(c) -> Column:
    return clean_text_struct(c)["clean"]


def has_text(c) -> Column:
    """F01 predicate: non-null and non-empty."""
    c = _col(c)
    return c.isNotNull() & (F.length(c) > 0)


def text_length(c) -> Column:
    """Code-point length as BIGINT."""
    return F.length(_col(c)).cast("bigint")


def preview(c, n: int = 200, always_dots: bool = False) -> Column:
    """First n characters plus '...' (only when longer unless always_dots)."""
    c = _col(c)
    dotted = F.concat(F.substring(c, 1, n), F.lit("..."))
    if always_dots:
        return dotted
    return F.when(F.length(c) > n, dotted).otherwise(c)


def slugify(c) -> Column:
    """Lower case, non-alphanumeric runs to '-', '-' trimmed at both ends."""
    s = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def strip_unicode(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing blanks of any kind."""
    return F.regexp_replace(_col(c), "^(?U)[\\s\\x{1c}-\\x{1f}]+|(?U)[\\s\\x{1c}-\\x{1f}]+$", "")


def strip_code_fence(c) -> Column:
    """Strip, drop a leading ```json or ``` and a trailing ```, strip."""
    s = strip_unicode(_col(c))
    s = F.regexp_replace(s, "^```json", "")
    s = F.regexp_replace(s, "^```", "")
    s = F.regexp_replace(s, "```$", "")
    return strip_unicode(s)


def join_nonempty(items: Column, sep: str = ", ") -> Column:
    return F.array_join(items, sep)


def freq_label(entries: Column, n: int = 5) -> Column:
    """``item (45%), ...`` from an array<struct<item,freq>> already ranked.

    Empty or NULL input gives ``(none)``.
    """
    top = F.slice(entries, 1, n)
    txt = F.array_join(
        F.transform(
            top,
            # Python's "{:.0%}" rounds half to even: bround, not round
            lambda x: F.concat(x["item"], F.lit(" ("), F.bround(x["freq"] * 100, 0).cast("bigint").cast("string"), F.lit("%)")),
        ),
        ", ",
    )
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, txt).otherwise(F.lit("(none)"))


def bullet_list(items: Column) -> Column:
    """``- a\\n- b``."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def fallback_name(titles: Column, cluster_id: Column) -> Column:
    """Words (>3 chars, upper-case initial) of the first 3 titles, first 3 kept."""
    words = F.flatten(F.transform(F.slice(titles, 1, 3), lambda t: F.split(F.trim(t), "\\s+")))
    good = F.filter(words, lambda w: (F.length(w) > 3) & w.rlike("^\\p{Lu}"))
    name = F.array_join(F.slice(good, 1, 3), " ")
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Cluster "), cluster_id.cast("string")))


def cluster_label(c) -> Column:
    """T14."""
    c = _col(c)
    return (
        F.when(c == -2, F.lit("Unmatched"))
        .when(c == -1, F.lit("Noise"))
        .otherwise(F.concat(F.lit("Cluster "), c.cast("string")))
    )


def word_split(c) -> Column:
    """Blank-separated words (use with explode)."""
    return F.split(F.trim(_col(c)), "\\s+")


def path_depth(c) -> Column:
    """depth = number of '.' plus number of '['."""
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))) + (
        F.length(c) - F.length(F.replace(c, F.lit("["), F.lit("")))
    )


def path_leaf(c) -> Column:
    """Last dotted part."""
    return F.element_at(F.split(_col(c), "\\."), -1)


def nonblank(c) -> Column:
    """Usable for embedding when the trimmed text is not empty."""
    return F.length(strip_unicode(_col(c))) > 0
