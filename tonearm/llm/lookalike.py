"""One consistent form for text that looks the same but holds different characters.

Arrow batches go through SQL embedded in DuckDB inside each task: composition by ``nfc_normalize``, single
characters by ``translate``, ligatures and numerals that stand for several letters by ``replace``, invisible
characters by a regular expression. The tables below are made by rule from the Unicode database (width, blanks,
composition, invisible characters); only the look-alike letters are fixed values.

What a reader can see stays: letter case, accents, digits, raised figures, runs of blanks, line breaks.

Defined cases: NULL stays NULL and the empty string stays empty; text of invisible characters alone becomes
empty; whole texts are processed whatever their length; the form of a form is itself; repeated rows are kept by
``canonical_column`` and count once in ``equal_looking_pairs``; other columns pass through untouched, and the
added column's name is a parameter, so no name can clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets with the shape of a Latin letter.
CYRILLIC_LATIN = ("АВЕЅІЈКМНОРСТХԚԜУҮӀѴԌаеѕіјорсухԁһԛԝүӏѵ", "ABESIJKMHOPCTXQWYYIVGaesijopcyxdhqwylv")
GREEK_LATIN = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοαιρυγ", "ABEZHIKMNOPTYXvoaipuy")
ARMENIAN_LATIN = ("ՕՍՏօսհոցզ", "OUSouhngq")
CHEROKEE_LATIN = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ")
# Hyphens drawn as the ASCII one.
HYPHENS = "‐‑"
# Characters without ink (joiners, marks of direction, soft hyphen, variation selectors).
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿"
)

_COMPAT_KINDS = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"}
#: Letters and digits in the type styles of mathematics.
STYLES = range(0x1D400, 0x1D800)
STYLED = re.compile(f"[{chr(STYLES[0])}-{chr(STYLES[-1])}]")
#: Letters in the shapes that they take within a word.
SHAPES = range(0xFB50, 0xFE00)


@cache
def tables() -> tuple[dict[int, str], dict[str, str]]:
    """(one character to one, one character to several)."""
    one: dict[int, str] = {ord(h): "-" for h in HYPHENS}
    several: dict[str, str] = {}
    letters = dict(zip(*CYRILLIC_LATIN)) | dict(zip(*GREEK_LATIN)) | dict(zip(*ARMENIAN_LATIN)) | dict(zip(*CHEROKEE_LATIN))
    one |= {ord(k): v for k, v in letters.items()}
    for code in STYLES:
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain != chr(code) and len(plain) == 1:
            one[code] = letters.get(plain, plain)
    for code in range(0x80, 0x10000):
        c = chr(code)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            one[code] = " "
        elif kind in _COMPAT_KINDS and " " not in rest:
            one[code] = chr(int(rest, 16))
        elif kind == "<compat>" and (0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1:
                one[code] = plain
            else:
                several[c] = plain
        elif 0x370 <= code <= 0x52F and code not in one:
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and base in letters:
                one[code] = unicodedata.normalize("NFC", letters[base] + "".join(marks))
    return {k: v for k, v in one.items() if len(v) == 1}, several


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def canonical_sql(column: str) -> str:
    """The DuckDB query of the canonical form ``form`` of ``column`` of the relation t."""
    one, several = tables()
    # A long table costs with every string, so rare letters are looked up only in strings that hold one.
    rare = {k: v for k, v in one.items() if k in STYLES or k in SHAPES}
    one = {k: v for k, v in one.items() if k not in rare}
    plain = f"translate(x, {_quoted(''.join(map(chr, rare)))}, {_quoted(''.join(rare.values()))})"
    plain = f"CASE WHEN regexp_matches(x, '[{chr(STYLES[0])}-{chr(STYLES[-1])}{chr(SHAPES[0])}-{chr(SHAPES[-1])}]') THEN {plain} ELSE x END"
    spread = reduce(lambda e, kv: f"replace({e}, {_quoted(kv[0])}, {_quoted(kv[1])})", several.items(), "y")
    spread = f"CASE WHEN regexp_matches(y, '[{''.join(several)}]') THEN {spread} ELSE y END"
    chars, images = _quoted("".join(map(chr, one))), _quoted("".join(one.values()))
    # Width comes before composition, so that a narrow kana joins its mark; then marks sit on the mapped letters.
    form = f"nfc_normalize(translate(nfc_normalize(translate({spread}, {chars}, {images})), {chars}, {images}))"
    return (
        f"SELECT CASE WHEN y IS NULL OR regexp_full_match(y, '[\\x00-\\x7F]*') THEN y ELSE {form} END AS form "
        f"FROM (SELECT {plain} AS y FROM (SELECT regexp_replace({column}, '[{INVISIBLE}]', '', 'g') AS x FROM t))"
    )


def fold(text: str) -> str:
    """The canonical form of one string, for use on strings that are already in Python."""
    if text.isascii():
        return text
    seen, images = _fold_table()
    swap = lambda m: images.get(m.group(), m.group())
    # A set with characters beyond the basic plane is searched one by one, so these go first and by a range.
    text = STYLED.sub(swap, text)
    text = unicodedata.normalize("NFC", seen.sub(swap, text))
    return unicodedata.normalize("NFC", seen.sub(swap, text))


@cache
def _fold_table() -> tuple[re.Pattern, dict[str, str]]:
    one, several = tables()
    hidden = re.compile(f"[{INVISIBLE}]")
    images = {chr(c): "" for c in range(0x10000) if hidden.match(chr(c))}
    images |= {chr(k): v for k, v in one.items()} | several
    return re.compile("[" + re.escape("".join(c for c in images if c < "\U00010000")) + "]"), images


def _canonical(column: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect() as con:
            con.execute("SET threads = 1")
            for batch in batches:
                texts = pa.table({"s": batch.column(batch.schema.get_field_index(column))})
                form = con.from_arrow(texts).query("t", canonical_sql("s")).to_arrow_table().column("form")
                form = form.cast(pa.string())
                whole = form.combine_chunks() if form.num_chunks != 1 else form.chunk(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, whole], names=[*batch.schema.names, into])

    return run


def canonical_column(df: DataFrame, column: str, into: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``column`` as a new last column ``into``."""
    if into in df.columns:
        raise ValueError(f"column {into} exists already")
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])
    return df.mapInArrow(_canonical(column, into), schema)


def distinct_texts(*columns: DataFrame) -> DataFrame:
    """(text): every non-empty string of the one-column tables, once."""
    texts = [c.toDF("text").where(F.col("text") != "") for c in columns]
    return reduce(DataFrame.union, texts).distinct()


def equal_looking_pairs(texts: DataFrame) -> DataFrame:
    """(text_a, text_b) of different strings of ``texts`` (text) with one canonical form; text_a < text_b.

    A string that equals its form is the only such one of its class, so joining the changed strings with all
    strings on the form yields every pair; the join never builds a class in one row.
    """
    formed = canonical_column(texts, "text", "form")
    left = formed.where(F.col("text") != F.col("form")).select(F.col("text").alias("a"), "form")
    right = formed.select(F.col("text").alias("b"), "form", (F.col("text") == F.col("form")).alias("plain"))
    pairs = left.join(right, "form").where((F.col("plain") & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("text_a"), F.greatest("a", "b").alias("text_b")).distinct()
