"""String functions of the matching core, as Column expressions; only the full normaliser needs Python.

Patterns use Java's Unicode case folding. Every function maps NULL to NULL.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Markers of versions of a title and of editions of an album, as the matching rules have them. A bracket or
# what follows a dash must be one of them and nothing else. YEAR is four digits, REST any further words; what stands in
# square brackets may be missing.
VERSION = """
remastered YEAR | remaster YEAR | YEAR remastered | YEAR remaster | radio edit | radio mix | radio version
album version | album mix | album edit | single version | single edit | single mix
extended version | extended mix | extended edit | mono version | stereo version | remastered | remaster
live[ REST] | acoustic[ version] | acoustic mix | instrumental[ version] | demo[ version] | deluxe[ edition] | deluxe version
"""
DECORATION = """
deluxe[ edition] | deluxe version | expanded[ edition] | special[ edition] | anniversary[ edition]
collector[ edition] | collectors[ edition] | collector's[ edition] | collector'[ edition] | limited[ edition]
bonus[ edition] | bonus version | bonuss[ edition] | bonuss version | bonus track[ edition] | bonus track version
bonus tracks[ edition] | bonus tracks version | remastered YEAR | remaster YEAR | YEAR remastered | YEAR remaster
remastered | remaster | reissue | explicit[ version] | explicit content | clean[ version]
"""
# Words that a bracket cut off by a length limit begins with.
CUT = "live|acoustic|remastered|remaster|deluxe|extended|radio|album|single|mono|stereo|instrumental|demo"
GUEST = "feat\\.?|ft\\.?|featuring"
GUEST_OR_WITH = GUEST + "|with"


def phrases(listed: str) -> str:
    """The regular expression of a list of phrases."""
    one = lambda p: re.sub(r"\[ (\w+)\]", r"(?:\\s+\1)?", p).replace("YEAR", r"\d{4}").replace("REST", r"[^)\]]+").replace(" ", r"\s+")
    return "|".join(one(p.strip()) for p in re.split(r"[|\n]", listed) if p.strip())


def _tidy(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def _normal(s: str | None) -> str | None:
    if s is None:
        return None
    out = unicodedata.normalize("NFKD", s.strip().lower())
    kept = [c for c in out if unicodedata.category(c) != "Mn" and (unicodedata.category(c)[0] in "LN" or c.isspace())]
    return re.sub(r"\s+", " ", "".join(kept)).strip()


@pandas_udf(StringType())
def _normalize_any(s: pd.Series) -> pd.Series:
    return s.map(_normal, na_action="ignore")


def normalize(c: Column) -> Column:
    """Trimmed, lower case, decomposed, without marks and punctuation, single blanks.

    Call it on distinct strings: every value passes through Arrow.
    """
    return _normalize_any(c)


def strip_featured(c: Column) -> Column:
    """An artist without "(feat. ...)" anywhere and without a trailing "feat. ..."."""
    out = F.regexp_replace(c, f"(?iU)\\s*[\\(\\[]\\s*(?:{GUEST})\\s[^\\)\\]]*[\\)\\]]", "")
    return _tidy(F.regexp_replace(out, f"(?iU)\\s+(?:{GUEST})\\s.*$", ""))


def _without_closing(c: Column, pattern: str) -> Column:
    """``c`` without a closing bracket, square bracket or dash and what the pattern matches whole after it."""
    out = F.regexp_replace(c, f"(?iU)\\s*\\((?:{pattern})\\)\\s*$", "")
    out = F.regexp_replace(out, f"(?iU)\\s*\\[(?:{pattern})\\]\\s*$", "")
    return _tidy(F.regexp_replace(out, f"(?iU)\\s+[-–—]\\s+(?:{pattern})\\s*$", ""))


def strip_version(c: Column) -> Column:
    """A title without a version marker at its end, in brackets or after a dash. A remix is another recording."""
    return _without_closing(c, phrases(VERSION))


def strip_decoration(c: Column) -> Column:
    """An album without an edition or reissue decoration at its end."""
    return _without_closing(c, phrases(DECORATION))


def strip_title_featuring(c: Column) -> Column:
    """A title without a closing "(feat. ...)" or "[feat. ...]"."""
    out = F.regexp_replace(c, f"(?iU)\\s*\\((?:{GUEST_OR_WITH})\\s+[^)\\]]+\\)\\s*$", "")
    return _tidy(F.regexp_replace(out, f"(?iU)\\s*\\[(?:{GUEST_OR_WITH})\\s+[^)\\]]+\\]\\s*$", ""))


def without_track_number(c: Column) -> Column:
    """A title without a track number in front of it; the rest stays as it is, blanks at its end too."""
    return F.regexp_replace(c, "^\\d{1,3}[_\\-. \\t\\n\\f\\r]+(?=[^ \\t\\n\\f\\r])", "")


def strip_track_number(c: Column) -> Column:
    return _tidy(F.regexp_replace(c, "^\\d{1,3}[_\\-.\\s]+(?=\\S)", ""))


def strip_truncated(c: Column) -> Column:
    """A title without a marker bracket that was cut off; one with any closed bracket stays as it is."""
    cut = F.regexp_replace(c, f"(?iU)\\s*\\((?:{GUEST_OR_WITH}|{CUT})[^)]*$", "")
    return F.when(c.rlike("\\([^)]*\\)"), c).otherwise(_tidy(cut))


def lead_artist(c: Column) -> Column:
    """The first of several joined artists."""
    first = _tidy(F.regexp_extract(c, "(?iU)^(.*?)(?:\\s*,\\s*|\\s+-\\s+|\\s*&\\s*|\\s+(?:and|et|vs\\.?|x)\\s+)", 1))
    return F.when(first != "", first).otherwise(c)


def has_featuring(c: Column) -> Column:
    closed = c.rlike(f"(?iU)\\((?:{GUEST_OR_WITH})\\s+[^)]+\\)|\\[(?:{GUEST_OR_WITH})\\s+[^\\]]+\\]")
    return closed | (~c.rlike("\\([^)]*\\)") & c.rlike(f"(?iU)\\((?:{GUEST_OR_WITH})\\s+"))


def couple_key(artist: Column, title: Column) -> Column:
    return F.struct(F.lower(F.trim(artist)).alias("artist"), F.lower(F.trim(title)).alias("title"))


def correction_or_null(given: Column, candidate: Column) -> Column:
    changed = (F.trim(candidate) != "") & (F.lower(F.trim(given)) != F.lower(F.trim(candidate)))
    return F.when(changed, F.trim(candidate))


def byte_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance in bytes of UTF-8, or -1 above ``most``."""
    latin = lambda c: F.decode(F.encode(c, "utf-8"), "iso-8859-1")
    return F.levenshtein(latin(a), latin(b), most)


def search_url(base: str, *parts: Column) -> Column:
    """``base`` followed by the parts in URL form, or NULL if a part is missing."""
    return F.when(
        ~F.greatest(*[(F.coalesce(p, F.lit("")) == "") for p in parts], F.lit(False)),
        F.concat(F.lit(base), F.concat_ws("/", *[F.url_encode(p) for p in parts])),
    )
