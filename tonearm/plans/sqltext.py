"""The string rules of the matching core as DuckDB SQL, written from the rules and not from the Column expressions."""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_RAISED, _DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
#: Letters that stand for several.
_MANY = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ⅷ": "viii", "ⅶ": "vii", "ⅻ": "xii", "ⅲ": "iii", "ⅱ": "ii",
         "ⅳ": "iv", "ⅵ": "vi", "ⅸ": "ix", "ⅺ": "xi", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x"}
S = r"[\s\x{85}\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    """The normaliser; DuckDB has no compatibility decomposition, so its cases, and the parts of Hangul, are spelled out."""
    out = f"translate({x}, {quoted(_WIDE + _BLANKS + _RAISED)}, {quoted(_NARROW + ' ' * len(_BLANKS) + _DIGITS)})"
    out = f"lower(trim({out}))"
    for one, many in _MANY.items():
        out = f"replace({out}, '{one}', '{many}')"
    out = rf"regexp_replace(strip_accents({out}), '[^\p{{L}}\p{{N}}\s]', '', 'g')"
    out = rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"
    at = "(unicode(c) - 44032)"
    final = f"CASE WHEN {at} % 28 > 0 THEN chr(4519 + {at} % 28) ELSE '' END"
    parts = f"CASE WHEN c BETWEEN '가' AND '힣' THEN chr(4352 + {at} // 588) || chr(4449 + {at} % 588 // 28) || {final} ELSE c END"
    whole = f"array_to_string(list_transform(string_split(n, ''), lambda c: {parts}), '')"
    return f"(SELECT CASE WHEN regexp_matches(n, '[가-힣]') THEN {whole} ELSE n END FROM (SELECT {out} AS n))"


def tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


_VERSION = (
    r"remaster(ed)? \d{4}|\d{4} remaster(ed)?|(radio|album) (edit|mix|version)|(single|extended) (version|edit|mix)|(mono|stereo) version"
    r"|remaster(ed)?|live( [^)\]]+)?|acoustic( (version|mix))?|(instrumental|demo)( version)?|deluxe( (edition|version))?"
)
_DECORATION = (
    r"deluxe( (edition|version))?|(expanded|special|anniversary|collector''?s?|limited)( edition)?|bonus( track)?s?( (edition|version))?"
    r"|remaster(ed)? \d{4}|\d{4} remaster(ed)?|remaster(ed)?|reissue|explicit( (version|content))?|clean( version)?"
)
_GUEST = r"(feat\.?|ft\.?|featuring|with)"


def _closing(x: str, pattern: str) -> str:
    p = pattern.replace(" ", f"{S}+")
    x = rf"regexp_replace({x}, '(?i){S}*\(({p})\){S}*$', '')"
    x = rf"regexp_replace({x}, '(?i){S}*\[({p})\]{S}*$', '')"
    return tidy(rf"regexp_replace({x}, '(?i){S}+[-–—]{S}+({p}){S}*$', '')")


def version(x: str) -> str:
    return _closing(x, _VERSION)


def decoration(x: str) -> str:
    return _closing(x, _DECORATION)


def title_featuring(x: str) -> str:
    x = rf"regexp_replace({x}, '(?i){S}*\({_GUEST}{S}+[^)\]]+\){S}*$', '')"
    return tidy(rf"regexp_replace({x}, '(?i){S}*\[{_GUEST}{S}+[^)\]]+\]{S}*$', '')")


def track_number(x: str) -> str:
    return tidy(rf"regexp_replace({x}, '^\d{{1,3}}[_\-.\s]+(\S)', '\1')")


def truncated(x: str) -> str:
    begin = r"(feat\.?|ft\.?|featuring|with|live|acoustic|remaster(ed)?|deluxe|extended|radio|album|single|mono|stereo|instrumental|demo)"
    cut = tidy(rf"regexp_replace({x}, '(?i){S}*\({begin}[^)]*$', '')")
    return rf"CASE WHEN regexp_matches({x}, '\([^)]*\)') THEN {x} ELSE {cut} END"


def featuring(x: str) -> str:
    closed = rf"regexp_matches({x}, '(?i)\({_GUEST}{S}+[^)]+\)|\[{_GUEST}{S}+[^\]]+\]')"
    return rf"({closed} OR (NOT regexp_matches({x}, '\([^)]*\)') AND regexp_matches({x}, '(?i)\({_GUEST}{S}+')))"


def featured(x: str) -> str:
    guest = r"(feat\.?|ft\.?|featuring)"
    x = rf"regexp_replace({x}, '(?i){S}*[(\[]{S}*{guest}{S}[^)\]]*[)\]]', '', 'g')"
    return tidy(rf"regexp_replace({x}, '(?i){S}+{guest}{S}.*$', '', 'g')")


def lead(x: str) -> str:
    first = tidy(rf"regexp_extract({x}, '(?i)^(.*?)({S}*,{S}*|{S}+-{S}+|{S}*&{S}*|{S}+(and|et|vs\.?|x){S}+)', 1)")
    return f"CASE WHEN {first} <> '' THEN {first} ELSE {x} END"


def bare(x: str) -> str:
    return truncated(f"({title_featuring(version(track_number(x)))})")
