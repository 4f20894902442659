"""Plays and library tracks of the same recording, linked without a common key.

Candidates share the artist's entity (the trie join of names) and have titles within two slips of each other (a letter
added, dropped or changed, or two neighbours swapped), found on segments of the title, so neither an artist with many
tracks nor a popular title is crossed with itself. Titles are read into a base, numbers and takes; track numbers, guest
credits, editions, file labels and file types are dropped.

Heuristics vote on every candidate: title (yes if equal, no if a word differs that is a word in its own right), numbers,
take, artist as written, album, recording identifier; each says yes, no or nothing. A generative model explains the
counts of vote patterns (at most 3^6, whatever the number of candidates) by hidden classes: the same recording, or
another one for one of the reasons there are, another part, another take, another title. A class of the latter kind is
defined by the vote that reveals it, at a fixed accuracy (``REVEALED``); all else is learned by expectation
maximisation: how large each class is, how often each heuristic errs on the same recording, and what each says in every
class, from starting tables that count as ``STRENGTH`` candidates (for the defining votes as many as there are). Heuristics that agree more than the classes explain
are correlated, and their evidence is shared out before the model is fitted again. The confidence is the posterior of
the first class, and nothing but the confidence decides.

An identifier alone makes no candidate: many belong to something else. It votes.

Defined cases: a play or track without artist or title (NULL or empty) has no candidates; a title of labels or
numbers alone is compared whole; plays with equal texts get equal answers; a track kept twice is returned twice;
repeated rows each count as one vote; empty tables give no pairs; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.lookalike import fold
from tonearm.llm.names import BOUND as EDITS
from tonearm.llm.names import SEGMENTS, kept_places, link_names, plain
from tonearm.session import durable
from tonearm.sources.tables import present

VOTES = ("title", "numbers", "take", "artist", "album", "identifier")
CLASSES = ("same", "other part", "other take", "other title")
#: Weight, in candidates, of what the model holds of each class before it sees data.
STRENGTH = 100
#: Share of all candidates that every class holds before it sees data, so rare reasons stay reasons.
LEAST_SHARE = 0.01
OTHER_TITLES, OTHER_SHARE, OTHER_LETTERS = 3, 0.1, 4

# Words of labels that do not make another recording.
LABEL_WORDS = set(
    """official audio video music lyric lyrics visualizer hq hd uhd album single version edition remaster remastered remastering
    mono stereo deluxe special expanded anniversary bonus track explicit clean original reissue digital mixdown full
    """.split()
)
# Words that name another take.
TAKE_WORDS = set("live acoustic demo instrumental unplugged karaoke remix cover rehearsal session acapella dub orchestral".split())
ROMAN = re.compile(r"(?=[ivx]{1,5}\Z)x{0,2}(?:ix|iv|v?i{0,3})\Z")
RAISED = {c: f" ^{unicodedata.digit(c)} " for c in "⁰¹²³⁴⁵⁶⁷⁸⁹"}
TRACK = re.compile(r"^\s*\d{1,3}\s*(?:[._)]|\s-)\s*(?=\D)")
GUEST_GROUP = re.compile(r"\s*[(\[]\s*(?:feat|ft|featuring|with)\b\.?[^)\]]*(?:[)\]]|$)")
GUEST_TAIL = re.compile(r"\s+(?:feat|ft|featuring)\b\.?\s.*$")
CUT_GUEST = re.compile(r"\s*[(\[](?:f|fe|fea|feat|ft)?\.?\s*$")
GROUP = re.compile(r"\s*(?:[(\[]([^()\[\]]*)[)\]]|\s[-–—]\s+([^()\[\]]*?)\s*$)")
GUEST_ARTIST = r"(?i)\s+([(\[]?\s*\b(feat|ft|featuring)\b\.?|[(\[]\s*with)\s.*$"
# File types, and kinds of "and".
FILE = re.compile(r"(?<=\w|[)\]])\s*\.(?:mp3|flac|ogg|oga|opus|m4a|mp4|aac|wav|wma|aiff?|ape|alac)\s*$")
AND = re.compile(r"\s(?:&|\+|and|und|et)\s|\s?&\s?")


def read_title(title: str) -> tuple[str, str, str, str]:
    """(base, numbers, takes, words) of a title; the base is its words without blanks."""
    text = "".join(RAISED.get(c, c) for c in fold(title))
    text = plain(text)
    text = CUT_GUEST.sub("", GUEST_TAIL.sub("", GUEST_GROUP.sub("", TRACK.sub("", FILE.sub("", text)))))
    text = AND.sub(" and ", text.replace("_", " "))
    takes: set[str] = set()

    def group(m: re.Match) -> str:
        words = re.findall(r"\w+", (m.group(1) or m.group(2) or "").replace("mix-down", "mixdown"))
        own = TAKE_WORDS & set(words)
        if own:
            takes.update(own)
            return " "
        labels = [w for w in words if w in LABEL_WORDS]
        return " " if labels and all(w in LABEL_WORDS or w.isdigit() for w in words) else m.group()

    before = None
    while before != text:
        before = text
        text = GROUP.sub(group, text)
    words = re.findall(r"\^\d|\w+", text.replace("_", " "))
    numbers, rest = [], []
    for i, w in enumerate(words):
        following = words[i + 1] if i + 1 < len(words) else ""
        if w in ("pt", "part", "no", "nr", "vol") and (following.isdigit() or ROMAN.match(following or "-")):
            continue
        lead = words[i - 1] if i and words[i - 1] in ("pt", "part") else ""
        roman = ROMAN.match(w) and i and (len(w) > 1 or i == len(words) - 1 or lead)
        if w.isdigit() or w[0] == "^" or roman:
            numbers.append(("p" if lead else "") + (w.lstrip("0") or "0"))
        else:
            rest.append(w)
    if not rest:
        whole = "".join(re.findall(r"\w", plain(title)))
        return whole, "", ",".join(sorted(takes)), whole
    return "".join(rest), ",".join(sorted(numbers)), ",".join(sorted(takes)), " ".join(rest)


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        read = [read_title(t) for t in texts.to_pylist()]
        parts = [pa.array([r[i] for r in read], pa.string()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([texts, *parts], names=["text", "base", "numbers", "takes", "words"])


def read_titles(texts: DataFrame) -> DataFrame:
    """(text, base, numbers, takes, words) of every different text of ``texts`` (text)."""
    once = texts.where(present("text")).distinct()
    return once.mapInArrow(_titles, "text string, base string, numbers string, takes string, words string")


def near_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entity, left_base, right_base, distance) of titles of one entity within ``EDITS`` slips.

    Both sides are (entity, base). Two slips spoil at most three of four segments of the right-hand title, unless both
    are swaps across segment borders, and then the letters are the same, which is one more key; a whole segment stands
    in the left-hand title, moved by no more than the slips. A swap takes two edits and changes no letter, so two
    edits that move letters count as one slip. Titles below eight letters may
    differ by one slip, below four not at all.
    """
    size, border = F.length("base"), lambda length, i: F.floor(length * i / SEGMENTS)
    piece = lambda length, i, s: F.substring(
        F.col("base"), (border(length, i) + s + 1).cast("int"), (border(length, i + 1) - border(length, i)).cast("int")
    )
    key = lambda length, i, s: F.xxhash64("entity", length, F.lit(i), piece(length, i, s))
    letters = F.xxhash64("entity", F.lit(-1), F.array_sort(F.split("base", "")))
    places = [
        F.when((size + d > 0) & (border(size + d, i) + s >= 0) & (border(size + d, i + 1) + s <= size), key(size + d, i, s))
        for d, i, s in kept_places(range(-EDITS, EDITS + 1))
    ]
    index = right.select(
        F.col("entity").alias("right_entity"),
        F.col("base").alias("right_base"),
        F.explode(F.array(*[key(size, i, 0) for i in range(SEGMENTS)], letters)).alias("block"),
    )
    probe = left.select("entity", F.col("base").alias("left_base"), F.explode(F.array_distinct(F.array(*places, letters))).alias("block"))
    shorter = F.least(F.length("left_base"), F.length("right_base"))
    allowed = F.when(shorter >= 8, EDITS).when(shorter >= 4, 1).otherwise(0)
    met = probe.where(F.col("block").isNotNull()).join(index, "block")
    met = met.where(F.col("entity") == F.col("right_entity")).select("entity", "left_base", "right_base").distinct()
    # A swap is two edits that change no letter: slips = (edits + changed letters) / 2 or, where all change, the edits.
    edits = F.levenshtein("left_base", "right_base", 2 * EDITS)
    measured = met.withColumn("edits", edits).where(F.col("edits") >= 0)
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x, F.lit("")))
    letters = F.array_distinct(F.split(F.concat("left_base", "right_base"), ""))
    apart = F.aggregate(letters, F.lit(0), lambda n, x: n + F.abs(count("left_base", x) - count("right_base", x)))
    changed = (apart + F.abs(F.length("left_base") - F.length("right_base"))) / 2
    slips = F.when(F.col("edits") <= 1, F.col("edits")).otherwise(F.ceil((F.col("edits") + changed) / 2).cast("int"))
    near = measured.withColumn("distance", slips)
    return near.where(F.col("distance") <= allowed).select("entity", "left_base", "right_base", "distance")


def other_words(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """(lead, title, track_id) of pairs whose titles differ by a word that is a word in its own right.

    A slip of the pen makes a word that stands in few titles beside the one that was meant; a word that stands in
    at least ``OTHER_TITLES`` titles and ``OTHER_SHARE`` as many as its counterpart was meant itself. Words of fewer
    than ``OTHER_LETTERS`` letters are too easily made of each other to tell.
    """
    frequency = (
        read.select("base", F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
        .groupBy("word")
        .agg(F.countDistinct("base").alias("n"))
    )
    a, b = F.split("words", " "), F.split("track_words", " ")
    changed = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] != x["b"])
    slips = pairs.where((F.col("distance") > 0) & (F.size(a) == F.size(b)))
    slips = slips.select("lead", "title", "track_id", F.explode(changed).alias("x")).select("lead", "title", "track_id", "x.a", "x.b")
    own = frequency.select(F.col("word").alias("a"), F.col("n").alias("own"))
    meant = frequency.select(F.col("word").alias("b"), F.col("n").alias("meant"))
    long = slips.where((F.length("a") >= OTHER_LETTERS) & (F.length("b") >= OTHER_LETTERS))
    both = long.join(own, "a").join(meant, "b")
    return (
        both.where((F.col("own") >= OTHER_TITLES) & (F.col("own") >= OTHER_SHARE * F.col("meant")))
        .select("lead", "title", "track_id")
        .distinct()
    )


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def candidates(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """(play_id, track_id, pattern) of all candidates with their votes.

    ``plays`` is (play_id, artist, title, album, identifier); ``tracks`` the same with track_id and identifiers
    (an array).
    """
    lead = F.trim(F.regexp_replace("artist", GUEST_ARTIST, ""))
    usable = present("artist") & present("title")
    plays = plays.where(usable).withColumn("lead", lead)
    tracks = tracks.where(usable).withColumn("lead", lead)
    names = plays.select("lead").unionAll(tracks.select("lead")).groupBy(F.col("lead").alias("name"))
    entity = link_names(names.agg(F.count(F.lit(1)).alias("n")), credits=True).select(F.col("name").alias("lead"), "entity")
    texts = [t.select(F.col(c).alias("text")) for t in (plays, tracks) for c in ("title", "album")]
    read = durable(read_titles(texts[0].unionAll(texts[1]).unionAll(texts[2]).unionAll(texts[3])))
    titles = read.select(F.col("text").alias("title"), "base", "numbers", "takes", "words")
    albums = read.select(F.col("text").alias("album"), F.col("base").alias("album_base"))
    entity = durable(entity)

    # Every play of the same artist and title has the same candidates: they are sought once.
    known = with_album(tracks.join(entity, "lead").join(titles, "title"), albums, "track_id")
    known = durable(
        known.select(
            "track_id", "entity", "base", "numbers", "takes", "words", F.lower("lead").alias("track_lead"),
            F.col("album_base").alias("track_album"), "identifiers",
        )
    )
    songs = plays.select("lead", "title").distinct().join(entity, "lead")
    songs = songs.join(known.select("entity").distinct(), "entity", "left_semi").join(titles, "title")
    near = near_titles(songs.select("entity", "base").distinct(), known.select("entity", "base").distinct())
    pairs = (
        songs.join(near.withColumnRenamed("left_base", "base"), ["entity", "base"])
        .join(
            known.select(
                "track_id", "entity", F.col("base").alias("right_base"), F.col("numbers").alias("track_numbers"),
                F.col("takes").alias("track_takes"), F.col("words").alias("track_words"), "track_lead", "track_album",
                "identifiers",
            ),
            ["entity", "right_base"],
        )
        .select(
            "lead", "title", "track_id", "distance", "words", "track_words", "track_lead", "track_album", "identifiers",
            (F.col("numbers") == F.col("track_numbers")).alias("numbers_agree"),
            (F.col("takes") == F.col("track_takes")).alias("take_agrees"),
        )
    )
    pairs = durable(pairs)
    pairs = pairs.join(other_words(pairs, read).withColumn("other", F.lit(True)), ["lead", "title", "track_id"], "left")
    rows = with_album(plays.join(pairs, ["lead", "title"]), albums, "play_id")
    said = present("identifier") & (F.size("identifiers") > 0)
    both = F.col("album_base").isNotNull() & F.col("track_album").isNotNull()
    votes = [
        vote(F.col("distance") == 0, F.col("other").isNotNull()),
        vote(F.col("numbers_agree"), ~F.col("numbers_agree")),
        vote(F.col("take_agrees"), ~F.col("take_agrees")),
        vote(F.lower("lead") == F.col("track_lead"), F.lit(False)),
        vote(both & (F.col("album_base") == F.col("track_album")), both),
        vote(said & F.array_contains("identifiers", F.col("identifier")), said),
    ]
    pattern = sum(((v + 1) * 3**i for i, v in enumerate(votes)), F.lit(0)).cast("int")
    return rows.select("play_id", "track_id", pattern.alias("pattern"))


def with_album(rows: DataFrame, albums: DataFrame, key: str) -> DataFrame:
    """``rows`` with the reading of their album; those without one are spread over the tasks by ``key``."""
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(key), F.lit(997)).cast("string"))
    keyed = rows.withColumn("_album", F.when(present("album"), F.col("album")).otherwise(spread))
    return keyed.join(albums.withColumnRenamed("album", "_album"), "_album", "left").drop("_album")


class LabelModel:
    """Hidden classes behind the votes; learned from pattern counts alone.

    ``tables[k, i, v]`` is how often heuristic i says v (no, nothing, yes) in class k, ``sizes[k]`` the class's share.
    """

    #: What each heuristic says of the same recording to begin with (no, yes), and the vote that defines a class.
    SAME = {
        "title": (0.0005, 0.9), "numbers": (0.0005, 0.9995), "take": (0.0005, 0.9995),
        "artist": (0.0, 0.75), "album": (0.1, 0.6), "identifier": (0.05, 0.1),
    }
    REVEALED = {"other part": ("numbers", 0.97), "other take": ("take", 0.97), "other title": ("title", 0.97)}
    #: Another recording has the identifier of this one only by mistake.
    ELSEWHERE = (0.1, 0.01)

    def __init__(self, rounds: int = 60) -> None:
        self.rounds = rounds
        self.start = np.empty((len(CLASSES), len(VOTES), 3))
        self.fixed = np.zeros((len(CLASSES), len(VOTES)), bool)
        for k, c in enumerate(CLASSES):
            for i, v in enumerate(VOTES):
                no, yes = self.ELSEWHERE if k and v == "identifier" else self.SAME[v]
                if k and self.REVEALED[c][0] == v:
                    no, yes = self.REVEALED[c][1], (1 - self.REVEALED[c][1]) / 2
                    self.fixed[k, i] = True
                self.start[k, i] = no, 1 - no - yes, yes
        self.defining = self.fixed.any(0)
        self.start += 1e-5
        self.start /= self.start.sum(2, keepdims=True)
        self.tables = self.start.copy()
        self.sizes, self.weights = np.full(len(CLASSES), 1 / len(CLASSES)), np.ones(len(VOTES))

    @staticmethod
    def votes(patterns: np.ndarray) -> np.ndarray:
        return patterns[:, None] // 3 ** np.arange(len(VOTES)) % 3

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of every class for each row of votes."""
        columns = np.arange(len(VOTES))
        log = np.stack([(np.log(t[columns[None, :], votes]) * self.weights).sum(1) for t in self.tables], 1) + np.log(self.sizes)
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[:, 0]

    def _maximise(self, votes: np.ndarray, counts: np.ndarray) -> None:
        for _ in range(self.rounds):
            p = self.classes(votes) * counts[:, None]
            for k in range(len(CLASSES)):
                # The starting tables count as some candidates, so no rule is ever certain and few data change little;
                # those of the votes that define a class count as much as the data, or classes would trade places.
                total = self.start[k] * np.where(self.defining, max(STRENGTH, counts.sum()), STRENGTH)[:, None]
                for i in range(len(VOTES)):
                    total[i] += np.bincount(votes[:, i], p[:, k], 3)
                self.tables[k] = np.where(self.fixed[k][:, None], self.start[k], total / total.sum(1, keepdims=True))
            sizes = p.sum(0) + LEAST_SHARE * counts.sum()
            self.sizes = sizes / sizes.sum()

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        if not len(patterns):
            return self
        votes = self.votes(patterns)
        self._maximise(votes, counts)
        p, x = self.classes(votes), votes - 1.0
        excess = np.zeros((len(VOTES), len(VOTES)))
        for k in range(len(CLASSES)):
            w = counts * p[:, k]
            if w.sum() > 1:
                centred = x - np.average(x, 0, w)
                covariance = (centred * w[:, None]).T @ centred / w.sum()
                deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
                excess += covariance / np.outer(deviation, deviation) * w.sum() / counts.sum()
        np.fill_diagonal(excess, 0)
        self.weights = 1 / (1 + np.clip(excess, 0, 1).sum(1))
        self._maximise(votes, counts)
        return self


def link_recordings(
    plays: DataFrame, tracks: DataFrame, least: float = 0.5, answered: DataFrame | None = None
) -> DataFrame:
    """(play_id, track_id, confidence) of candidates whose posterior reaches ``least``.

    All plays count in linking the names; those in ``answered`` (play_id) get no answer. They are taken out
    of the candidates, which are narrow, and not out of the plays, so the plays' texts are moved once.
    """
    spark = plays.sparkSession
    found = candidates(plays, tracks)
    if answered is not None:
        found = found.join(answered, "play_id", "left_anti")
    found = durable(found)
    counted = found.groupBy("pattern").count().collect()  # at most 3^6 rows
    patterns = np.array([r["pattern"] for r in counted], np.int64)
    model = LabelModel().fit(patterns, np.array([r["count"] for r in counted], float))
    scores = model.posterior(model.votes(patterns)) if len(patterns) else np.zeros(0)
    table = spark.createDataFrame(list(zip(patterns.tolist(), scores.tolist())), "pattern int, confidence double")
    scored = found.join(F.broadcast(table), "pattern")
    return scored.where(F.col("confidence") >= least).select("play_id", "track_id", "confidence")
