"""Sentence units of texts in any script, by a pushdown automaton over each line.

The stack holds the open quotations and brackets; a terminator counts only on an empty stack, or as the last mark
inside a quotation or bracket that closes onto an empty stack. A second, small stack holds the indents of list
entries, which gives each unit its list level. Before a full stop a trie of abbreviations, read backwards from the
stop, decides whether the stop can end a unit. Scripts bring their own terminators: ideographic and Devanagari
stops end a unit whatever follows, Latin ones only before something that can start one. Thai writes no stop, and a
blank there parts sentences as well as phrases: it ends a unit after Thai letters unless the next phrase opens with a
word that carries a sentence on, the last one closes with a word that announces more (``THAI_CARRIES``,
``THAI_ANNOUNCES``), a repetition or omission mark stands at it, or a number or foreign words stand alone between
blanks.

The time is linear in the text: every stop looks back over one word of at most ``LONGEST`` letters, what lies behind it
is carried along in counters, and the last place of each closing mark is known before the line is read.

Defined cases: NULL, empty and blank texts give no units; a line break always ends a unit; a mark that opens
without closing on its line is an ordinary character; units cover every character that is not a blank between
units; equal texts under different ids are cut alike and repeated rows each give their units; whole texts are
processed whatever their length; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that bind to the word after them.
BINDING = """
dr prof mr mrs ms st vs approx incl feat ft i.e e.g cf viz al ca vgl bzw hr fr mme mlle sr sra srta dra ej aprox env
sen rev gen capt lt col sgt mt ed eds trans hon s.a s.l см тыс им ул др.-греч डॉ श्री د
""".split()
# Abbreviations that bind to a number after them.
NUMBERED = """
no nos nr nrs n num fig figs vol vols pp pt pts ch sec art abb tab kap pág págs стр рис гл № núm
jan feb mar apr jun jul aug sep sept oct nov dec
""".split()
# Abbreviations that can stand at the end of a sentence.
FINAL = "inc ltd co corp bros jr etc usw uvm ff u.s u.k u.s.a p.m a.m a.d b.c т.д т.п д п г гг руб мин m km kg min".split()
# Words before a German ordinal number.
ORDINAL_LEAD = {"am", "im", "vom", "zum", "beim", "der", "dem", "den", "des", "die", "das", "bis", "ab", "seit"}

TERMINATORS = ".!?…。！？｡．।॥؟۔։။"
STRONG = "。！？｡।॥။"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›"}
PAIRS |= {"“": "”", "‘": "’", "„": "“", "‚": "‘", "〝": "〟"}
CLOSERS = set(PAIRS.values())
LINE = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
EVENT = re.compile(
    "[" + re.escape(TERMINATORS + "".join(PAIRS) + "".join(CLOSERS)) + '"' + "]|(?<=[฀-๿\\d])[  　]+(?=\\S)"
)
MARKER = re.compile(r"\s*(?:\d{1,3}[.)]|[A-Za-z][.)]|[ivxlIVXL]{1,5}[.)]|[-*•‣–—])\s+")
INVISIBLE = "­​‌‍⁠﻿"
WORD = re.compile(r"[^\s(\[{“„«\"「『（‘—–,;:/]*\Z")
#: Of a longer word only the last letters are read; no abbreviation or ordinal is that long.
LONGEST = 24
# Thai words that carry a sentence on after a blank, and words before a blank that announce more.
THAI_CARRIES = re.compile("และ|หรือ|แต่(?!ง)|เพราะ|เนื่องจาก|ซึ่ง|โดย|เพื่อ(?!น)|กับ|จึง|ก็|ว่า(?!ง)|รวมถึง|ตลอดจน|ๆ|ฯ")
THAI_ANNOUNCES = ("เช่น", "ได้แก่", "คือ", "ว่า", "และ", "หรือ", "นาย", "นางสาว", "ดร.", "ฯ", "ๆ")


def trie(*classes: tuple[str, list[str]]) -> dict:
    """Abbreviations by class, as a trie over their letters from the last to the first."""
    root: dict = {}
    for name, words in classes:
        for word in words:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = name
    return root


ABBREVIATIONS = trie(("final", FINAL), ("numbered", NUMBERED), ("binding", BINDING))


def abbreviation(word: str) -> str | None:
    node = ABBREVIATIONS
    for c in reversed(word.lower()):
        node = node.get(c)
        if node is None:
            return None
    return node.get("")


def word_start(line: str, start: int, end: int) -> int:
    """Where the word that ends at ``end`` begins, looking back no further than ``start`` and ``LONGEST`` letters."""
    return WORD.search(line, max(start, end - LONGEST), end).start()


def thai_ends(line: str, start: int, at: int, after: int, total: int) -> bool:
    """Whether the blank from ``at`` to ``after`` ends a unit that began at ``start``: see the module's text."""
    i = at
    while i > start and (line[i - 1].isdigit() or line[i - 1] in ".,"):
        i -= 1
    if i == start or not "฀" <= line[i - 1] <= "๿" or line.endswith(THAI_ANNOUNCES, start, at) or THAI_CARRIES.match(line, after):
        return False
    if i < at or "฀" <= line[after] <= "๿":
        return True
    # Numbers or foreign words: alone between blanks they belong to the sentence around them.
    end = after
    while end < total and not "฀" <= line[end] <= "๿":
        end += 1
    return not (end < total and line[end - 1].isspace())


def starts(line: str, at: int) -> bool:
    """Whether a unit can start at ``at``: capital, digit, letter without case, opening mark, or a word like dB."""
    c = line[at]
    if c.isalpha():
        if not c.islower():
            return True
        word = re.compile(r"\w+").match(line, at).group()
        return any(x.isupper() for x in word[1:])
    return c.isdigit() or c in PAIRS or c in "\"¿¡#@-–—*•'№$€£"


def stop_ends(line: str, start: int, dot: int, after: int) -> bool:
    """Whether the full stop at ``dot`` can end a unit; ``after`` is where the next word begins."""
    begin = word_start(line, start, dot)
    if begin == dot:
        return True
    word, first = line[begin:dot], line[after]
    if word.isdigit():
        if first.isdigit() or not first.isupper():
            return not first.islower()
        lead = line[word_start(line, start, begin - 1) : begin - 1] if begin > start else ""
        return begin > start and lead.lower() not in ORDINAL_LEAD
    kind = abbreviation(word)
    if kind == "binding":
        return False
    if kind == "numbered":
        return not first.isdigit()
    letters = re.split(r"[.\-‐‑]", word)
    if len(letters[-1]) == 1 and letters[-1].isalpha():
        if len(letters) > 1 and "." in word and "-" not in word:
            return kind == "final" or letters[-1].isupper()
        before = line[max(start, begin - 4) : begin].rstrip()
        return kind == "final" and before[-1:] in ("." if word in "дп" else "0123456789") and before != ""
    return True


def lower_case_ends(line: str, start: int, mark: int, blanks: int, capital: bool) -> bool:
    """Whether a mark before a small letter ends a unit: text written without capitals still has sentences.

    After a full stop it does if the word is written out; after other marks only if the unit holds no ``capital`` and
    more than one of ``blanks``.
    """
    if line[mark] != ".":
        return blanks > 1 and not capital
    word = line[word_start(line, start, mark) : mark]
    return len(word) > 1 and word.isalpha() and word.islower() and abbreviation(word) is None


def line_ends(line: str) -> list[int]:
    """The ends of the units of one line, the last one included."""
    ends: list[int] = []
    stack: list[str] = []
    opened_at: list[int] = []
    start = len(line) - len(line.lstrip())
    total = len(line.rstrip())
    marker = MARKER.match(line)
    skip = marker.end() if marker else 0
    thai = any("฀" <= c <= "๿" for c in line)
    last = {closer: line.rfind(closer, 0, total) for closer in {*CLOSERS, '"'} if closer in line}
    seen, blanks, capital = start, 0, False

    def cut(end: int) -> None:
        nonlocal start, seen, blanks, capital
        ends.append(end)
        start = end
        while start < total and line[start].isspace():
            start += 1
        seen, blanks, capital = start, 0, False

    done = 0
    for event in EVENT.finditer(line, skip, total):
        at, c = event.start(), event.group()
        if at < done:
            continue
        if c[0].isspace():
            if thai and not stack and at > start and thai_ends(line, start, at, event.end(), total):
                cut(at)
            continue
        closed = False
        if stack and c == stack[-1]:
            stack.pop()
            unit_start = opened_at.pop() == start
            if stack:
                continue
            inner = at - 1
            while inner > 0 and line[inner].isspace():
                inner -= 1
            if line[inner] not in TERMINATORS:
                continue
            closed = True
        elif c in PAIRS or c == '"':
            closer = PAIRS.get(c, '"')
            if last.get(closer, -1) > at:
                stack.append(closer)
                opened_at.append(at)
            continue
        elif c in CLOSERS:
            continue
        elif stack:
            continue
        end = at + 1
        strong = c in STRONG
        while end < total and (line[end] in TERMINATORS or line[end] in CLOSERS and line[end] not in PAIRS):
            strong = strong or line[end] in STRONG
            end += 1
        done = end
        after = end
        while after < total and (line[after].isspace() or line[after] in INVISIBLE):
            after += 1
        if after >= total:
            continue
        gap, nxt = any(x.isspace() for x in line[end:after]), line[after]
        if closed:
            # A quotation that a particle follows is a part of the sentence around it; a bracket never is.
            alone = unit_start and (c in ")）]］" or not "\u3041" <= nxt <= "\u309f")
            if starts(line, after) and nxt not in "-–—" and (gap or alone):
                cut(end)
            continue
        if strong:
            cut(end)
            continue
        ellipsis = "…" in line[at:end] or line[at:end] == "..."
        if gap and not starts(line, after):
            passed = line[seen:at]
            seen, blanks, capital = at, blanks + passed.count(" "), capital or any(x.isupper() for x in passed)
            if not ellipsis and lower_case_ends(line, start, at, blanks, capital):
                cut(end)
        elif gap:
            if c != "." or end > at + 1 or stop_ends(line, start, at, after):
                cut(end)
        elif ellipsis:
            if nxt.isalpha() and not nxt.islower() and end - at > 1 or nxt in PAIRS:
                cut(end)
        elif nxt.isalpha() and not nxt.islower() and (nxt.isupper() or c in "!?؟"):
            # No blank was written; the word before must be no abbreviation or one that can end a sentence.
            tail = line[word_start(line, start, at) : at]
            long = len(tail) > 1 and tail[-1].isalpha() and not tail[-1].isupper() and "." not in tail
            kind = abbreviation(tail)
            if (kind is None and long) or (kind == "final" and stop_ends(line, start, at, after)):
                cut(end)
    if start < total:
        ends.append(total)
    return ends


def unit_offsets(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, list level) of every unit of ``text``, in order."""
    indents: list[int] = []
    for found in LINE.finditer(text):
        line = found.group()
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        if MARKER.match(line):
            while indents and indents[-1] > indent:
                indents.pop()
            if not indents or indents[-1] < indent:
                indents.append(indent)
        elif not indents or indent <= indents[-1]:
            indents = []
        begin = indent
        for end in line_ends(line):
            while line[begin].isspace():
                begin += 1
            yield found.start() + begin, found.start() + end, len(indents)
            begin = end


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "unit", "start_pos", "end_pos", "list_level"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    for batch in batches:
        rows: list[list[int]] = [[] for _ in names]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            for n, (start, end, level) in enumerate(unit_offsets(text.as_py() or "")):
                for column, value in zip(rows, (doc, n, start, end, level)):
                    column.append(value)
            if len(rows[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=schema)
                rows = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=schema)


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, unit, start_pos, end_pos, list_level): one row per unit of ``documents`` (doc_id long, text).

    Offsets are in code points. The scan feeds the automaton directly; there is no shuffle.
    """
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return texts.mapInArrow(_units, "doc_id long, unit long, start_pos long, end_pos long, list_level long")
