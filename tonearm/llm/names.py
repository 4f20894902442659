"""Variant spellings of names, linked by a trie join.

A name is read into its descriptor (orchestra, jazz band, duo, ...) and its core words: letters are brought to one
form, articles, titles of disc jockeys and kinds of "and" are dropped, short given names and abbreviated
descriptors are spelled out, "Last, First" is turned round. Names with equal descriptor and core words form a
class. Classes are compared by the trie join: the core words, joined as written, are cut into segments; names sharing
a segment at a compatible place meet in one shard, whose names form a trie; a Levenshtein automaton with
transpositions walks the trie and lists all neighbours within the bound. Every order of a name's words walks the tries
(up to ``ORDERED`` words; of longer names the rotations and two sorted orders), so moved words, misspelt or not, and
joined words meet. Two edits spoil at most three of four
segments, unless both swap letters across segment borders, and then the names have the same letters, which is one
more key to meet on: no neighbour is missed. A segment that many names share is split over several tries. Initials
are matched against the words they abbreviate by the same join, for any number of words and initials; a name of
nothing but single letters abbreviates none.

A class joins the nearest class that is more frequent, within a bound that grows with its length; two classes that are
both well attested, by their share or by plays and spellings alone, stay apart however close they are, and so do two
different spellings with the same number of plays, of which neither can be told to be the other's slip. A credit that
joins a guest to an artist is left out: "feat." and its kin always make one, "with" only in a bracket or after a name
that the table holds by itself.

Defined cases: NULL, empty and blank names are no names; letter case counts as a difference between names and is
ignored in comparing them; ties between equally near classes go to the more frequent one, then to the smaller key;
repeated names add to a class's frequency; an empty table gives no pairs; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations, permutations, product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.lookalike import fold
from tonearm.session import durable

BOUND = 2
#: Of names with at most so many words every order is tried.
ORDERED = 4
SEGMENTS = BOUND + 2


def kept_places(lengths: Iterable[int]) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a neighbour of one of the lengths can keep a segment.

    What is shifted before a segment and after it adds up to the bound at most. Of the whole segments there is always
    one that is shifted by no more places than segments stand before it, and by no more after it than stand after it:
    slips crowded on one side leave a segment on the other.
    """
    return [
        (d, i, s)
        for d in lengths
        for i in range(SEGMENTS)
        for s in range(-BOUND, BOUND + 1)
        if abs(s) + abs(d + s) <= BOUND and abs(s) <= i and abs(d + s) < SEGMENTS - i
    ]


#: A name looks for neighbours that are no longer than it.
PLACES = kept_places(range(-BOUND, 1))
#: A trie of one segment holds about this many names; a more frequent segment gets several tries.
TRIE_NAMES = 2000
#: One task's table of strings to index and to look up has about this many rows.
SHARD_ROWS = 500_000
#: A class with at least this many spellings and this share of the other's frequency is an act of its own.
OWN_SPELLINGS, OWN_SHARE = 3, 0.3
#: So many plays keep a class with that many spellings, or with that share, apart from any other, however frequent.
OWN_PLAYS = 1000

# Given names and their short forms.
SHORT_FORMS = """
abigail: abby gail | alexander: alex sandy sasha xander lex | anthony: tony ant | benjamin: ben benji benny
christopher: chris kit topher | deborah: debbie deb debra | dorothea: dora thea dot dolly dorothy
eleonora: leo nora ella ellie | elizabeth: liz beth lizzie betty eliza bess libby | francisco: paco pancho fran cisco
frederick: fred freddie freddy | giuseppe: pino beppe peppe | guillaume: guy gui | harold: hal harry
james: jim jimmy jamie | johannes: hannes jo johan | josephine: josie jo fina posy | katherine: kate kathy katie kat kit kitty
leonard: len leo lenny | margaret: meg maggie peg peggy marge greta | matilda: tilly mattie tilda
michael: mike mick mickey | mikhail: misha mischa | nicholas: nick nico nicky | patricia: pat patty trish tricia
robert: bob rob robbie bobby bert | samuel: sam sammy | susanna: sue sanna susie suzy | theodore: ted theo teddy
victoria: tori vicky vic | william: will bill billy willie liam | edward: ed eddie ned | richard: dick rick richie
thomas: tom tommy | joseph: joe joey | charles: charlie chuck | daniel: dan danny | andrew: andy drew
"""
# Shortened descriptors.
DESCRIPTOR_FORMS = {
    "orch": "orchestra", "symph": "symphony", "sym": "symphony", "philh": "philharmonic", "phil": "philharmonic",
    "ens": "ensemble", "ch": "chamber", "chb": "chamber", "str": "string", "qrt": "quartet", "qt": "quartet", "quart": "quartet",
    "qnt": "quintet", "quint": "quintet", "bb": "big band", "bd": "band", "bnd": "band",
}
HEADS = {"orchestra", "philharmonic", "ensemble", "choir", "trio", "quartet", "quintet", "band"}
QUALIFIERS = {"symphony", "chamber", "string", "big", "jazz", "brass"}
ARTICLES = {"the", "les", "der", "die", "das", "los", "las", "el", "la", "le", "il", "i"}
ANDS = {"&", "+", "and", "et", "und", "y", "n'", "n", "'n'", "’n’", "n’"}
GUEST = re.compile(r"\S\s*[(\[]?\s*\b(?:feat|ft|featuring)\b\.?\s+\S|\S\s*[(\[]\s*with\s+\S", re.IGNORECASE)
WITH = re.compile(r"\S\s+with\s+\S", re.IGNORECASE)
ACCENTS = re.compile("[\u0300-\u036f]")
WORD = re.compile(r"[^\s\-‐–,;()\[\]/]+")


@cache
def given_names() -> dict[str, tuple[str, ...]]:
    """Short or full given name -> the full names it can stand for."""
    out: dict[str, tuple[str, ...]] = {}
    for entry in re.split(r"[|\n]", SHORT_FORMS.strip()):
        full, _, short = entry.partition(":")
        for s in [full.strip(), *short.split()]:
            out[s] = (*out.get(s, ()), full.strip())
    return out


class Reading(NamedTuple):
    """Descriptor and core words of a name; ``initials`` tells whether a word is a single letter."""

    kind: str
    words: tuple[str, ...]
    initials: bool

    @property
    def letters(self) -> str:
        return "".join(sorted(w for w in self.words if len(w) == 1))

    @property
    def key(self) -> str:
        return self.kind + "|" + " ".join(sorted(self.words))


def plain(text: str) -> str:
    """Small letters without accents; marks that make another letter, as in kana, stay."""
    folded = fold(text)
    if not folded.isascii():
        folded = ACCENTS.sub("", unicodedata.normalize("NFKD", folded))
        folded = unicodedata.normalize("NFC", folded)
    return folded.casefold()


def one_edit(a: str, b: str) -> bool:
    """Whether one letter was added, dropped or changed, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


@cache
def _descriptor(word: str) -> str:
    if word in DESCRIPTOR_FORMS:
        return DESCRIPTOR_FORMS[word]
    if len(word) > 3 and word not in HEADS | QUALIFIERS:
        near = [d for d in sorted(HEADS | QUALIFIERS) if len(d) > 4 and one_edit(word, d)]
        return near[0] if near else word
    return word


def read(name: str) -> Reading | None:
    """The reading of one name, or None for guest credits and names without letters."""
    if GUEST.search(name):
        return None
    text = plain(name).strip()
    if "," in text:
        front, _, back = text.rpartition(",")
        text = front if back.strip() in ARTICLES else f"{back.strip()} {front}"
    words = WORD.findall(text)
    if not words:
        return None
    # A lone "n" joins two names as it stands; "N." is an initial.
    squeezed = ["&" if w in ANDS else w.strip(".'’\"!?*_") for w in words]
    if len(words) > 1:
        # A disc jockey's title, in front, behind, or in two parts.
        for title in (["d", "j"], ["dj"], ["d.j"], ["deejay"]):
            n = len(title)
            if squeezed[:n] == title and len(squeezed) > n:
                words, squeezed = words[n:], squeezed[n:]
                break
            if squeezed[-n:] == title and len(squeezed) > n:
                words, squeezed = words[:-n], squeezed[:-n]
                break
    article = squeezed[0] in ARTICLES or (2 <= len(squeezed[0]) <= 4 and one_edit(squeezed[0], "the"))
    if len(squeezed) > 1 and article and squeezed[0] not in given_names():
        words, squeezed = words[1:], squeezed[1:]
    duo = len(squeezed) > 2 and "&" in squeezed[1:-1]
    core = [w for i, w in enumerate(squeezed) if w and not (w == "&" and 0 < i < len(squeezed) - 1)]
    spelled = " ".join(_descriptor(w.replace(".", "")) for w in core).split()
    if len(spelled) > 2 and spelled[-2] in {"big", "jazz", "brass"} and one_edit(spelled[-1], "band"):
        spelled[-1] = "band"
    if len(spelled) > 2 and spelled[-1] == "band" and len(spelled[-2]) <= 4 and one_edit(spelled[-2], "big"):
        spelled[-2] = "big"
    descriptors = [w for w in spelled if w in HEADS]
    if descriptors:
        kept = HEADS | QUALIFIERS
        kind = " ".join(sorted({w for w in spelled if w in kept}))
        core = [w for w in spelled if w not in kept and w != "of" and w not in ARTICLES]
    else:
        kind = "duo" if duo else ""
        if len(core) >= 2 and not duo:
            ends = (0, len(core) - 1)
            full = [given_names().get(w, ()) if i in ends else () for i, w in enumerate(core)]
            core = [f[0] if len(f) == 1 else w for f, w in zip(full, core)]
    core = [w.replace(".", "") for w in core if w.replace(".", "")]
    if not core:
        core, kind = [w for w in spelled if w], ""
    return Reading(kind, tuple(core), any(len(w) == 1 for w in core)) if core else None


def spelled(words: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    """A short form of several given names stands for each of them."""
    return product(*[given_names().get(w, (w,)) if i in (0, len(words) - 1) else (w,) for i, w in enumerate(words)])


def orders(words: tuple[str, ...]) -> set[str]:
    """The words joined in other orders than the one given."""
    if len(words) <= ORDERED:
        turned = permutations(words)
    else:
        turned = (words[i:] + words[:i] for i in range(len(words)))
    return {"".join(t) for t in turned} - {"".join(words)}


def forms(reading: Reading) -> list[tuple[str, str, bool]]:
    """(space, string, turned) under which a reading takes part in the trie join; strings meet within their space.

    Turned strings only walk the tries, they are not in them; two words are, both ways round.
    """
    out: dict[str, bool] = {}
    for words in spelled(reading.words):
        held = {"".join(words)} | (orders(words) if len(words) == 2 else set())
        if len(words) > ORDERED:
            held |= {"".join(sorted(words)), "".join(sorted(words, key=lambda w: w[::-1]))}
        out |= dict.fromkeys(orders(words) - out.keys(), True) | dict.fromkeys(held, False)
    rest = "".join(w for w in reading.words if len(w) > 1)
    initial = [(initial_space(reading.kind, reading.letters), rest, False)] if reading.initials and rest else []
    return [(reading.kind, s, turned) for s, turned in sorted(out.items())] + initial


def lead_key(name: str) -> str | None:
    """The key of what stands before a bare "with"."""
    found = WITH.search(name)
    lead = read(name[: found.start() + 1]) if found else None
    return lead.key if lead else None


def initial_space(kind: str, letters: str) -> str:
    return f"{kind}|{letters}|initial"


def abbreviated(kind: str, words: tuple[str, ...], shapes: set[tuple[int, int]]) -> list[tuple[str, str]]:
    """The pairs that initials for some of the words would give; ``shapes`` are the (words, initials) that occur."""
    out = set()
    for count in sorted(k for n, k in shapes if n == len(words)):
        for variant, short in product(spelled(words), combinations(range(len(words)), count)):
            letters = "".join(sorted(variant[i][0] for i in short))
            out.add((initial_space(kind, letters), "".join(w for i, w in enumerate(variant) if i not in short)))
    return sorted(out)


class Automaton:
    """Levenshtein automaton with transpositions: rows of the distance table within ``bound`` of the diagonal.

    A state is a pair of neighbouring rows; moving along a letter depends on the state and on where the letter
    occurs in the window of the query, so moves are remembered across queries and names.
    """

    def __init__(self, bound: int = BOUND) -> None:
        self.bound, self.width = bound, 2 * bound + 1
        self.full = (1 << (self.width + 1)) - 1
        none = (bound + 1,) * self.width
        self.start = (none, tuple(min(abs(k), bound + 1) if k >= 0 else bound + 1 for k in range(-bound, bound + 1)), 0)
        self.moves: dict[tuple, tuple | None] = {}

    def windows(self, query: str) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for i, c in enumerate(query):
            out[c] |= 1 << (i + self.bound + 1)
        return out

    def move(self, state: tuple, bits: int) -> tuple | None:
        key = (state, bits)
        if key not in self.moves:
            self.moves[key] = self._move(state, bits)
        return self.moves[key]

    def _move(self, state: tuple, bits: int) -> tuple | None:
        before, row, old_bits = state
        cap, new = self.bound + 1, []
        for k in range(self.width):
            best = row[k] + (not bits >> (k + 1) & 1)
            if k + 1 < self.width:
                best = min(best, row[k + 1] + 1)
            if k:
                best = min(best, new[k - 1] + 1)
            # The letter two back in the query is this one, and the letter before this one is the query's next.
            if bits >> k & 1 and old_bits >> (k + 2) & 1:
                best = min(best, before[k] + 1)
            new.append(min(best, cap))
        return (row, tuple(new), bits) if min(new) <= self.bound else None


class Trie:
    def __init__(self, entries: Iterable[tuple[str, int]]) -> None:
        self.root: dict = {}
        for string, payload in entries:
            node = self.root
            for c in string:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(payload)

    def near(self, query: str, automaton: Automaton) -> Iterator[tuple[int, int]]:
        """(payload, distance) of every entry within the automaton's bound of ``query``."""
        windows, n, bound, full = automaton.windows(query), len(query), automaton.bound, automaton.full
        stack = [(self.root, automaton.start, 0)]
        while stack:
            node, state, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    k = n - depth + bound
                    if 0 <= k < automaton.width and state[1][k] <= bound:
                        for payload in child:
                            yield payload, state[1][k]
                    continue
                after = automaton.move(state, windows.get(c, 0) >> depth & full)
                if after is not None:
                    stack.append((child, after, depth + 1))


PAIRS = pa.list_(pa.struct([("space", pa.string()), ("string", pa.string()), ("turned", pa.bool_())]))


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, counts = batch.column("name").to_pylist(), batch.column("n").to_pylist()
        out = [(n, c, r) for n, c, r in ((n, c, read(n)) for n, c in zip(names, counts)) if r]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([n for n, _, _ in out], pa.string()),
                pa.array([c for _, c, _ in out], pa.int64()),
                pa.array([r.key for _, _, r in out], pa.string()),
                pa.array([r.letters for _, _, r in out], pa.string()),
                pa.array([{"kind": r.kind, "words": list(r.words)} for _, _, r in out], pa.struct([("kind", pa.string()), ("words", pa.list_(pa.string()))])),
                pa.array([[{"space": k, "string": s, "turned": t} for k, s, t in forms(r)] for _, _, r in out], PAIRS),
                pa.array([lead_key(n) for n, _, _ in out], pa.string()),
            ],
            names=["name", "n", "key", "letters", "reading", "strings", "lead"],
        )


def _abbreviations(shapes: set[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readings = batch.column("reading").to_pylist()
            strings = [[{"space": k, "string": s, "turned": False} for k, s in abbreviated(r["kind"], tuple(r["words"]), shapes)] for r in readings]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(strings, PAIRS)], names=["id", "strings"])

    return run


def edits(length: int) -> int:
    """How many edits may lie between names of this length: short names are near to most others."""
    return 0 if length < 5 else 1 if length < 8 else BOUND


def _walk(shard: pa.Table, scaled: bool = False) -> pa.Table:
    """Edges (u, v, space, distance) of one shard: a trie per block, walked by the block's probes.

    ``scaled`` bounds the edits by the shorter string, and lets full names meet among their abbreviations only initials.
    """
    shard = shard.sort_by([("block", "ascending"), ("salt", "ascending"), ("probe", "ascending")])
    columns = [shard.column(c).to_pylist() for c in ("block", "salt", "probe", "id", "string", "initial", "full")]
    automaton = Automaton()
    found: dict[tuple[int, int, bool], int] = {}
    start, n = 0, shard.num_rows
    block, salt, probe, ids, strings, initial, full = columns
    while start < n:
        end = start + 1
        while end < n and block[end] == block[start] and salt[end] == salt[start]:
            end += 1
        middle = next((k for k in range(start, end) if probe[k]), end)
        if start < middle < end and any(ids[k] != ids[start] for k in range(start, end)):
            trie = Trie((strings[k], k) for k in range(start, middle))
            for k in range(middle, end):
                for j, distance in trie.near(strings[k], automaton):
                    far = scaled and (distance > edits(min(len(strings[k]), len(strings[j]))) or (initial[k] and full[k] and full[j]))
                    if ids[j] != ids[k] and not far:
                        edge = (ids[k], ids[j], initial[k])
                        found[edge] = min(distance, found.get(edge, distance))
        start = end
    return pa.table(
        {
            "u": pa.array([e[0] for e in found], pa.int64()),
            "v": pa.array([e[1] for e in found], pa.int64()),
            "initial": pa.array([e[2] for e in found], pa.bool_()),
            "distance": pa.array(list(found.values()), pa.int64()),
        }
    )


def trie_join(strings: DataFrame, scaled: bool = False) -> DataFrame:
    """(u, v, initial, distance), both ways, of all strings within the bound in one space.

    ``strings`` is (id long, space, string, initial boolean), if ``scaled`` with full boolean, which tells names
    without single letters, and turned boolean, for strings that only walk the tries; the bound then depends on the
    length. Segments are cut and placed in the JVM; only the
    blocks reach Python.
    """
    strings = strings if scaled else strings.select("*", F.lit(False).alias("full"), F.lit(False).alias("turned"))
    least = 2 * int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, strings.count() * (len(PLACES) + SEGMENTS + 2) // SHARD_ROWS)
    size = F.length("string")
    border = lambda length, i: F.floor(length * i / SEGMENTS)
    segment = lambda length, i, shift: F.substring(
        F.col("string"), (border(length, i) + shift + 1).cast("int"), (border(length, i + 1) - border(length, i)).cast("int")
    )
    block = lambda length, i, shift: F.xxhash64("space", length, F.lit(i), segment(length, i, shift))
    letters = F.xxhash64("space", F.lit(-1), F.array_sort(F.split("string", "")))
    index = [block(size, i, 0) for i in range(SEGMENTS)] + [letters]
    probes = [
        F.when((border(size + d, i) + s >= 0) & (border(size + d, i + 1) + s <= size) & (size + d > 0), block(size + d, i, s))
        for d, i, s in PLACES
    ] + [letters]
    rows = lambda keys, probe: (strings if probe else strings.where(~F.col("turned"))).select(
        "id", "string", "initial", "full", F.lit(probe).alias("probe"), F.explode(F.array_distinct(F.array(*keys))).alias("block")
    ).where(F.col("block").isNotNull())
    indexed, probing = rows(index, False), rows(probes, True)
    crowded = (
        indexed.groupBy("block")
        .count()
        .where(F.col("count") > TRIE_NAMES)
        .select("block", F.ceil(F.col("count") / TRIE_NAMES).cast("int").alias("salts"))
    )
    crowded = durable(crowded)
    salts = F.coalesce("salts", F.lit(1))
    # The names of a crowded segment are dealt over its tries; its probes visit all of them.
    dealt = indexed.join(crowded, "block", "left").withColumn("salt", F.pmod(F.xxhash64("id", "string"), salts).cast("int"))
    sent = probing.join(crowded, "block", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both = dealt.drop("salts").unionByName(sent.drop("salts"))
    shard = F.pmod(F.xxhash64("block", "salt"), F.lit(shards)).alias("shard")
    edges = both.select("*", shard).groupBy("shard").applyInArrow(lambda t: _walk(t, scaled), "u long, v long, initial boolean, distance long")
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "initial", "distance"))
    return ways.groupBy("u", "v", "initial").agg(F.min("distance").alias("distance"))


def link_names(names: DataFrame, credits: bool = False) -> DataFrame:
    """(name, n, entity) of ``names`` (name, n): spellings of one artist share the entity number.

    With ``credits``, a name that a bare "with" joins to a guest is listed too, under the entity of its first artist.
    """
    usable = names.where(F.trim("name") != "").groupBy("name").agg(F.sum("n").cast("long").alias("n"))
    readings = usable.mapInArrow(
        _readings,
        "name string, n long, key string, letters string, reading struct<kind:string,words:array<string>>, "
        "strings array<struct<space:string,string:string,turned:boolean>>, lead string",
    )
    read = durable(readings.select("*", F.xxhash64("key").alias("id"), F.when(F.col("lead").isNotNull(), F.xxhash64("lead")).alias("lead_id")).drop("lead"))
    joined = F.col("lead_id").isNotNull()
    alone = read.where(~joined).select(F.col("id").alias("lead_id")).distinct()
    guests = read.where(joined).join(alone, "lead_id", "left_semi")
    readings = read.join(guests.select("name"), "name", "left_anti")
    best = F.max_by(F.struct("reading", "strings"), F.struct("n", "name"))
    classes = durable(
        readings.groupBy("id")
        .agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("spellings"), F.first("letters").alias("letters"), best.alias("best"))
        .select("id", "weight", "spellings", "letters", (F.col("letters") != "").alias("initials"), "best.reading", "best.strings")
    )
    # Full names are abbreviated only in the ways in which some name is: few pairs of small numbers.
    count = F.size("reading.words")
    shapes = classes.where("initials").select(count, F.length("letters")).where(count > F.length("letters")).distinct()
    shapes = {tuple(r) for r in shapes.collect()}
    listed = classes.select("id", "strings", (~F.col("initials")).alias("full"))
    if shapes:
        whole = classes.where(~F.col("initials") & count.isin(sorted({n for n, _ in shapes}))).select("id", "reading")
        short = whole.mapInArrow(_abbreviations(shapes), "id long, strings array<struct<space:string,string:string,turned:boolean>>")
        listed = listed.unionByName(short.withColumn("full", F.lit(True)))
    strings = listed.select("id", "full", F.explode("strings").alias("s")).select(
        "id", "full", "s.space", "s.string", "s.turned", F.endswith("s.space", F.lit("|initial")).alias("initial")
    )
    edges = trie_join(strings, scaled=True)
    side = lambda c: classes.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("weight", "spellings", "initials", "letters")])
    edges = durable(edges.join(side("u"), "u").join(side("v"), "v"))

    heavier = F.struct("v_weight", "v") > F.struct(F.col("u_weight").alias("v_weight"), F.col("u").alias("v"))
    spelt, share = F.col("u_spellings") >= OWN_SPELLINGS, F.col("u_weight") > OWN_SHARE * F.col("v_weight")
    # Typos have few spellings of their own and do not come near the plays of the name; moved words are no typos.
    attested = (F.col("distance") > 0) & (F.col("u_weight") >= OWN_PLAYS) & (spelt | share)
    own = (spelt & share) | attested
    # A single letter is never a typo of another; without it, or joined to a word, the letters have to be the same.
    clear = (F.col("distance") == 0) | (F.col("v_weight") > F.col("u_weight"))
    alike = (F.col("u_letters") == F.col("v_letters")) & heavier & clear & ~own
    joined = F.expr("u_initials AND NOT v_initials AND distance = 0")
    up = edges.where(~F.col("initial") & (alike | joined))
    parent = up.groupBy("u").agg(F.min(F.struct("distance", (-F.col("v_weight")).alias("w"), "v")).alias("best"))
    parent = parent.select(F.col("u").alias("id"), F.col("best.v").alias("root"))
    roots = classes.select("id").join(parent, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    # Every step leads to a heavier class or from one with single letters to one without; each round doubles the length of the chains that are followed,
    # until all have ended.
    moved = True
    while moved:
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        step = roots.join(ahead, "root").select("id", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved"))
        step = durable(step)
        moved, roots = not step.where("moved").isEmpty(), step.drop("moved")

    short = edges.where("initial AND u_initials AND NOT v_initials AND distance <= 1")
    rooted = short.join(roots.withColumnRenamed("id", "v"), "v")
    options = rooted.groupBy("u", "root").agg(F.min("distance").alias("distance"))
    options = options.join(classes.select(F.col("id").alias("root"), F.col("weight").alias("root_weight")), "root")
    order = Window.partitionBy("u").orderBy("distance", F.col("root_weight").desc(), "root")
    ranked = options.select(
        "*", F.row_number().over(order).alias("k"), F.lead("root_weight").over(order).alias("next"),
        F.lead("distance").over(order).alias("next_distance"),
    )
    # Initials that fit two acts equally well name neither, unless one is far more frequent.
    clear = ranked.where(
        "k = 1 AND (next IS NULL OR next_distance > distance OR root_weight >= 5 * next)"
    ).select(F.col("u").alias("id"), F.col("root").alias("full"))
    final = roots.join(clear.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("full", "root").alias("entity"))
    linked = readings.join(final, "id").select("name", "n", "entity")
    if not credits:
        return linked
    led = guests.select("name", "n", F.col("lead_id").alias("id")).join(final, "id")
    return linked.unionByName(led.select("name", "n", "entity"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of different names of one entity; name_a < name_b."""
    a = linked.select(F.col("name").alias("name_a"), "entity")
    b = linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
