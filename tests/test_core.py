"""Edge cases of the core operators against hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import filters, matching, orphans, pipeline, recommend, rolling, stats, sync
from tonearm.plans import listening, syncing
from tonearm.sources import landing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_orphans_nulls_empties_and_clashing_columns(spark):
    child = spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "", "x"), (5, "zz", None), (5, "zz", None)], "id long, ref string, period string"
    )
    parent = spark.createDataFrame([("a", 9), (None, 9), ("a", 8)], "ref string, id long")
    out = orphans.orphan_rows(child, "id", "ref", F.coalesce("period", F.lit("none")), parent, "ref", "t")
    assert rows(out.select("row_key", "period")) == [("2", "x"), ("5", "none"), ("5", "none")]
    assert rows(orphans.orphan_report(out)) == [("t", "none", 2, 1), ("t", "x", 1, 1)]
    assert orphans.orphan_rows(child.limit(0), "id", "ref", F.lit("p"), parent, "ref", "t").count() == 0
    assert orphans.orphan_rows(child, "id", "ref", F.lit("p"), parent.limit(0), "ref", "t").count() == 4


DAY = lambda n: date.fromordinal(date(2024, 1, 1).toordinal() + n)


def amounts(spark, daily):
    return spark.createDataFrame([(e, DAY(d), n) for (e, d), n in daily.items()], "entity string, day date, n long")


def totals(state):
    return {(r.entity, (r.day - DAY(0)).days): (r.n, r.t7, r.t30) for r in state.collect()}


def rebuilt(daily):
    out = {}
    for e in {e for e, _ in daily}:
        own = {d: n for (x, d), n in daily.items() if x == e}
        for d in range(min(own), max(own) + 1):
            out[e, d] = (own.get(d, 0), *(sum(n for k, n in own.items() if d - w < k <= d) for w in (7, 30)))
    return out


def test_rolling_state_is_kept_through_versions_like_a_full_rebuild(spark):
    import random

    for seed in (1,):
        random.seed(seed)
        log, known = None, {}
        for version in range(3):
            # New days, late amounts of any age, returns after long gaps, withdrawals and new entities at once.
            batch = {(random.choice("uvwxyz"), random.randint(0, 60 * (version + 1))): random.randint(1, 5) for _ in range(random.choice((1, 8)))}
            withdrawn = [k for k, n in known.items() if n > 1][:2]
            batch |= {k: -1 for k in withdrawn}
            for k, n in batch.items():
                known[k] = known.get(k, 0) + n
            state = rolling.current(log) if log is not None else rolling.empty_state(spark)
            part = rolling.step(state, amounts(spark, batch), version)
            before = totals(state)
            changed = {k for k, t in rebuilt(known).items() if before.get(k) != t}
            written = set(totals(part))
            assert changed <= written
            assert all(k not in before or any(e == k[0] and d <= k[1] < d + 30 for e, d in batch) for k in written)
            log = part if log is None else log.unionByName(part)
            log = spark.createDataFrame(log.collect(), log.schema)
        assert totals(rolling.current(log)) == rebuilt(known)


def test_rolling_corrections_fill_gaps_and_new_entities_end_with_their_last_day(spark):
    state = rolling.current(rolling.step(rolling.empty_state(spark), amounts(spark, {("u", 60): 2}), 0))
    out = totals(rolling.correct(state, amounts(spark, {("u", 0): 1, ("v", 5): 4, ("u", 75): 1}), 1))
    # Day 60 lies beyond the reach of the play of day 0 and before the gap to day 75.
    assert sorted(out) == [*(("u", d) for d in range(76) if d != 60), ("v", 5)]
    assert out["u", 59] == (0, 0, 0) and out["u", 29] == (0, 0, 1) and out["u", 75] == (1, 1, 3)


def test_rolling_advance_carries_live_entities_only(spark):
    state = rolling.step(rolling.empty_state(spark), amounts(spark, {("u", 0): 3, ("v", 9): 1}), 0)
    for d in range(10, 33):
        state = state.unionByName(rolling.advance(state, amounts(spark, {("w", d): 1} if d == 31 else {("w", 99): 1}), str(DAY(d)), 1))
        state = spark.createDataFrame(state.collect(), state.schema)
    got = totals(state)
    assert got["u", 10] == (0, 0, 3) and got["u", 29] == (0, 0, 3) and got["u", 30] == (0, 0, 0) and ("u", 31) not in got
    assert got["v", 32] == (0, 0, 1) and got["w", 32] == (0, 1, 1)
    # Only the days up to the last activity are reported.
    assert rolling.with_averages(state).where("entity = 'v'").count() == 1
    assert rolling.maintain(amounts(spark, {("u", 0): 1}).withColumn("version", F.lit(1)).limit(0)).count() == 0


def test_distinct_plays_ignores_repeats_and_missing_users(spark):
    at, later = datetime(2024, 1, 1, 3), datetime(2024, 8, 1)
    df = spark.createDataFrame(
        [("u", at, "a", "t", at), ("u", at, "a", "t", None), ("u", at, None, "t", later), (None, at, "a", "t", at), ("", at, "a", "t", at), ("u", None, "a", "t", at)],
        "lastfm_user string, played_at timestamp_ntz, artist string, title string, fetched_at timestamp_ntz",
    )
    assert rows(rolling.distinct_plays(df)) == [("u", date(2024, 1, 1), 1, 4048), ("u", date(2024, 1, 1), 1, 4049)]


@pytest.mark.parametrize(
    "fn, given, wanted",
    [
        (text.normalize, "Beyoncé", "beyonce"), (text.normalize, "AC/DC", "acdc"), (text.normalize, " a \t  b ", "a b"),
        (text.strip_featured, "A (feat. B) C", "A C"), (text.strip_featured, "A feat. B", "A"),
        (text.strip_version, "X (Remastered 2009)", "X"), (text.strip_version, "X - Live", "X"), (text.strip_version, "Live and Let Die", "Live and Let Die"),
        (text.strip_decoration, "X (Deluxe Edition)", "X"), (text.strip_decoration, "Deluxe", "Deluxe"),
        (text.strip_track_number, "01 - X", "X"), (text.strip_track_number, "1979", "1979"), (text.strip_track_number, "100. X", "X"),
        (text.strip_truncated, "X (feat. J", "X"), (text.strip_truncated, "X (a) (feat. J", "X (a) (feat. J"),
        (text.lead_artist, "A & B", "A"), (text.lead_artist, "A vs. B", "A"), (text.lead_artist, "Malcolm X", "Malcolm X"),
    ],
)
def test_strings(spark, fn, given, wanted):
    assert spark.createDataFrame([(given,)], "s string").select(fn(F.col("s"))).first()[0] == wanted
    assert spark.createDataFrame([(None,)], "s string").select(fn(F.col("s"))).first()[0] is None


def test_track_numbers_go_and_blanks_stay(spark, tmp_path):
    from compare import both, connect

    titles = ["01 - X", " 01 X ", "X (feat. The ", "02_X\t", "1979", "01 - ", "01\x0bX", "3. \u00a0X", "01-\nX\n", "1234 X", "", None]
    spark.createDataFrame([(t,) for t in titles + titles[:3]], "title string").toPandas().to_parquet(tmp_path / "scrobbles.parquet")
    got, want = both(spark, connect(tmp_path), "titles", syncing.track_number_titles, syncing.REGISTRY.sql["track_number_titles"], str(tmp_path))
    assert got == want and len(got) == 11
    assert {r[1]: r[0] for r in got}["X (feat. The "] == "X (feat. The "


def test_filters():
    assert filters.parse_cascade("2024", "13", "1") == (2024, None, None)
    assert filters.cascade_range(2024, 2, 31) is None
    assert filters.months_back(datetime(2024, 3, 31), 1) == datetime(2024, 3, 2)
    assert filters.months_back(datetime(2026, 6, 27), 24) == datetime(2024, 6, 27)


def test_windows_reach_the_scan(spark, capsys):
    for query in (listening.top_tracks_window, listening.hit_parade, listening.window_totals, listening.anniversary_top):
        query(spark, "/root/testdata/sf0.001").explain("formatted")
        plan = capsys.readouterr().out
        assert "GreaterThanOrEqual(submission_time" in plan and "LessThan(submission_time" in plan


def test_markers_must_fill_the_bracket(spark):
    fn = {text.strip_version: [("Song (The Album I Lost)", 0), ("Song (Long Live Rock)", 0), ("X – Live", "X"), ("X (Deluxe)", "X"), ("X [Live at the Hall]", "X"), ("X (Remix)", 0), ("Y - 2011 Remaster", "Y")],
          text.strip_decoration: [("X (Special)", "X"), ("X (Deluxe)", "X"), ("X (Collector's Edition)", "X"), ("X [Bonus Track Version]", "X"), ("X (Clean)", "X"), ("Remastered Hits", 0)],
          text.strip_truncated: [("X (Lively", "X"), ("X (foo", 0)], text.has_featuring: [("X (with Y)", True), ("X [ft. Y]", True), ("X (feat. Y", True), ("X (Radio Edit)", False)]}
    for f, cases in fn.items():
        for given, wanted in cases:
            got = spark.createDataFrame([(given,)], "s string").select(f(F.col("s"))).first()[0]
            assert got == (given if wanted == 0 and not isinstance(wanted, bool) else wanted), (f, given)


def test_streaks_kickstart_and_heatmap(spark):
    plays = lambda days: spark.createDataFrame([("u", d) for d in days], "who string, ts timestamp_ntz")
    d = lambda m, n: datetime(2026, m, n, 9)
    out = stats.streak_summary(plays([d(1, 1), d(1, 2), d(1, 3), d(2, 10), d(2, 11), d(2, 12)]), "who", datetime(2026, 2, 13))
    assert rows(out) == [("u", 3, "2026-01-01", "2026-01-03", 3)]
    k = [(1, "a", 9), (1, "b", 10), (2, "a", 8), (2, "c", 9), (3, "b", 7)]
    df = spark.createDataFrame([(i, datetime(2026, 1, n, h)) for n, i, h in k], "item string, ts timestamp_ntz")
    assert [r.item for r in stats.kickstart(df, "item", 5).collect()] == ["a", "b"]
    many = [(datetime(2026, 1, 1 + i, 1),) for i, n in enumerate((1, 5, 10, 50)) for _ in range(n)]
    heat = stats.heatmap(spark.createDataFrame(many, "ts timestamp_ntz"), spark, datetime(2026, 1, 4))
    assert [r.level for r in heat.where("plays > 0").orderBy("day").collect()] == [1, 2, 3, 4]
    assert heat.agg(F.max("level")).first()[0] == 4 and stats.heatmap(spark.createDataFrame([], "ts timestamp_ntz"), spark, datetime(2026, 1, 4)).agg(F.max("level")).first()[0] == 0


def test_suppression_is_a_greedy_fold(spark):
    df = spark.createDataFrame([("e", 0, 1), ("e", 50, 2), ("e", 100, 3), ("f", 50, 4), ("e", 100, 5)], "entity string, t long, id long")
    assert rows(sync.suppress_near_duplicates(df)) == [(1, True), (2, False), (3, True), (4, True), (5, False)]


def test_cascade_stages(spark):
    columns = "id string, artist string, album_artist string, title string, album string, mbz_track_id string, mbz_recording_id string"
    library = spark.createDataFrame(
        [
            ("m1", "Artist", "Artist", "Song", "Album (Deluxe Edition)", None, "id-1"), ("m2", "Artist feat. Guest", "Artist", "Other", "B", "", None),
            ("m3", "Duo", "Various", "Twin", "X", None, None), ("m4", "Duo", "Various", "Twin", "X", None, None),
        ],
        columns,
    )
    plays = spark.createDataFrame(
        [
            ("zzz", "zzz", None, "id-1"), ("artist", "song", "album", None), ("Artist", "Other - Live", "", None), ("Duo", "Twin", "X", None),
            (None, "Song", None, None), ("Nobody", "Nothing", None, None),
        ],
        "artist string, title string, album string, mbid_track string",
    )
    got = {(r.artist, r.title): (r.media_file_id, r.strategy) for r in matching.match_cascade(plays, library).collect()}
    assert got == {
        ("zzz", "zzz"): ("m1", "mbid"), ("artist", "song"): ("m1", "triplet"), ("Artist", "Other - Live"): ("m2", "couple"),
        ("Duo", "Twin"): ("m3", "couple"),
    }


def test_cascade_answers_plays_of_every_sync_state(spark, tmp_path):
    plays = [(1, "Artist", "Song", None, None), (2, "Artist", "Other", None, None), (3, "zzz", "zzz", None, "id-3"), (4, "Artist", "Last", None, None),
             (5, "Artist", "Sonk", None, None), (6, "Artist", "Othr", None, None), (7, "zzz", "Third", None, "id-3")]
    states = [(1, "navidrome", "matched"), (2, "navidrome", "pending"), (4, "navidrome", "unmatched"), (5, "navidrome", "pending"), (3, "strawberry", "matched")]
    tracks = [(f"m{i}", "Artist", "", t, "Album", "", f"id-{i}") for i, t in enumerate(["Song", "Other", "Last", "Third"])]
    for name, data, schema in (
        ("scrobbles", plays, "id long, artist string, title string, album string, mbid_track string"),
        ("scrobble_sync", states, "scrobble_id long, target string, status string"),
        ("media_file", tracks, "id string, artist string, album_artist string, title string, album string, mbz_track_id string, mbz_recording_id string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = syncing.match_cascade(spark, str(tmp_path)).select("title", "media_file_id", "strategy")
    assert rows(found) == [("Last", "m2", "couple"), ("Other", "m1", "couple"), ("Song", "m0", "couple"), ("Third", "m3", "mbid"), ("zzz", "m3", "mbid")]
    # Only what the cascade left goes to the fuzzy match.
    assert rows(syncing.fuzzy_match(spark, str(tmp_path))) == [("artist", "othr", "m1", 1), ("artist", "sonk", "m0", 1)]


MEDIA = "id string, artist string, album_artist string, title string, album string, mbz_track_id string, mbz_recording_id string"


def test_pipeline_sources_answer_in_order(spark):
    library = spark.createDataFrame([("m1", "La Ruda", "", "Song", "A", None, "id-1"), ("m2", "Alpha", "", "Right Title", "B", None, None), ("m3", "Alpha", "", "Other", "B", "id-3", None)], MEDIA)
    at = lambda m: datetime(2024, 1, 1, 0, m)
    plays = [(1, "La Ruda Salska", "Song", None, None, at(1)), (2, "Noise", "Skip me", None, None, at(2)), (3, "Noise", "Points", None, None, at(3)), (4, "Alpha", "Rihgt Titel", None, None, at(4)),
             (5, "Beta", "Cached", None, None, at(5)), (6, "Beta", "No", None, None, at(6)), (7, "Beta", "Old", None, None, at(7)), (8, "Gamma", "Asked", None, None, at(8)), (9, "Alpha", "Othr", None, None, at(9)),
             (10, "Couple", "First", None, "id-3", at(10)), (11, "couple", "first", None, None, at(11)), (12, "Couple", "first", None, None, at(0)), (13, "!!", "?", None, "id-1", at(13))]
    p = spark.createDataFrame(plays, "id long, artist string, title string, album string, mbid_track string, played_at timestamp_ntz")
    tracks = spark.createDataFrame([("noise", "Skip Me", None), ("Noise", "points", "m2")], pipeline.TRACK_ALIAS)
    artists = spark.createDataFrame([("La Ruda Salska", "La Ruda")], pipeline.ARTIST_ALIAS)
    day = lambda d: datetime(2024, 1, d)
    cache = spark.createDataFrame([("beta", "cached", "m1", "couple", day(1)), ("beta", "no", None, "negative", datetime(2024, 2, 20)), ("beta", "old", None, "negative", day(1))], pipeline.CACHE)
    corrections = spark.createDataFrame([("Alpha", "Rihgt Titel", None, None, "Right Title")], pipeline.LOOKUP)
    infos = spark.createDataFrame([("Gamma", "Asked", "id-1", None, None)], pipeline.LOOKUP)
    now = filters.moment(datetime(2024, 3, 1))
    out = pipeline.match(p, library, now, track_aliases=tracks, artist_aliases=artists, cache=cache, corrections=corrections, infos=infos, fuzzy=2)
    got = {r.id: (r.target_id, r.strategy, r.source) for r in out.collect()}
    assert got == {
        1: ("m1", "couple", "cascade"), 2: (None, None, "skip"), 3: ("m2", None, "alias"), 4: ("m2", "correction", "cascade"), 5: ("m1", "couple", "cache"),
        6: (None, None, "negative"), 7: (None, None, "cascade"), 8: ("m1", "correction", "cascade"), 9: ("m3", "fuzzy", "cascade"),
        # The earliest play of the couple, which has no identifier, decides for all of it.
        10: (None, None, "cascade"), 11: (None, None, "cascade"), 12: (None, None, "cascade"), 13: ("m1", "mbid", "cascade"),
    }
    memo = pipeline.memo_rows(out, now)
    kept = pipeline.remember(cache, memo)
    assert {(r.artist_norm, r.title_norm, r.target_id, r.strategy) for r in kept.where("artist_norm = 'beta'").collect()} == {("beta", "cached", "m1", "couple"), ("beta", "no", None, "negative"), ("beta", "old", None, "negative")}
    assert kept.count() == 3 + memo.count() - 1
    assert pipeline.forget(cache).count() == 0 and pipeline.forget(cache, negative_only=True).count() == 1
    one = spark.createDataFrame([("beta", "no")], "artist_norm string, title_norm string")
    assert pipeline.forget(cache, couples=one).count() == 2 and pipeline.forget(cache, artists=one.select("artist_norm")).count() == 0


def test_pipeline_classifies_and_flushes(spark):
    matched = spark.createDataFrame([(i, "m1" if i < 5 else None, "couple", "skip" if i == 6 else "cascade") for i in range(1, 7)], "id long, target_id string, strategy string, source string")
    plays = spark.createDataFrame([(1, "u", 1000), (2, "u", 1050), (3, "u", 1100), (4, "u", 5030), (5, "u", 9), (6, "u", 9)], "id long, user_id string, t long")
    existing = spark.createDataFrame([("u", "m1", 5000, 5000), ("v", "m1", 1000, 1000)], "user_id string, media_file_id string, t long, submission_time long")
    out = pipeline.classify(matched, plays, existing)
    assert rows(out.select("id", "status")) == [(1, "matched"), (2, "duplicate"), (3, "matched"), (4, "duplicate"), (5, "unmatched"), (6, "skipped")]
    assert rows(pipeline.classify(matched, plays, existing, dry_run=True).select("id", "status"))[:4] == [(1, "matched"), (2, "matched"), (3, "matched"), (4, "duplicate")]
    annotation = spark.createDataFrame([("u", "m1", "media_file", 9, None, 4, True, None)], "user_id string, item_id string, item_type string, play_count int, play_date timestamp_ntz, rating int, starred boolean, starred_at timestamp_ntz")
    new, touched = pipeline.flush(out, existing, annotation)
    assert rows(new) == [("u", "m1", 1000), ("u", "m1", 1100)]
    assert [(r.play_count, r.rating, r.starred, r.play_date) for r in touched.collect()] == [(3, 4, True, datetime(1970, 1, 1, 1, 23, 20))]
    assert pipeline.report(out).first().asDict() == {"matched": 2, "duplicates": 2, "unmatched": 1, "skipped": 1, "considered": 6}
    songs = spark.createDataFrame([("m1", 5, 1050)], "id string, playcount long, lastplayed long")
    assert rows(pipeline.counter_sync(out, songs)) == [("m1", 7, 1100)]


def test_counter_target_prefers_identifier_then_exact_then_bare(spark):
    songs = spark.createDataFrame([("1", "Daft", "Get Lucky", None, None, 5), ("2", "Daft", "get lucky", None, None, 9), ("3", "Béta", "Élan", "x", None, 1)], "id string, artist string, title string, mbz_track_id string, mbz_recording_id string, playcount long")
    asked = spark.createDataFrame([(1, "daft", "GET LUCKY", None), (2, "Daft feat. P", "Get Lucky (Radio Edit)", None), (3, "beta", "Elan", None), (4, "beta", "élan", None), (5, "q", "q", "x")], "key long, artist string, title string, mbid_track string")
    # A title that differs by its accent only is not found, as the first comparison is in lower case.
    assert rows(pipeline.match_counters(asked, songs)) == [(1, "2"), (2, "2"), (4, "3"), (5, "3")]


def test_nearest_vectors_in_blocks_equal_brute_force(spark):
    import random

    random.seed(6)
    data = [(i, None if i == 7 else [random.randint(0, 4) * 1.0 for _ in range(3)]) for i in range(60)]
    v = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r.near for r in recommend.nearest_vectors(v.where("id < 9"), v, 4, block=3).collect()}
    known = {i: x for i, x in data if x}
    for i in (i for i in range(9) if i in known):
        near = sorted((sum((a - b) ** 2 for a, b in zip(known[i], x)), j) for j, x in known.items() if j != i)[:4]
        assert [got[i, r] for r in range(1, 5)] == [j for _, j in near]


def test_guests_are_left_out_at_every_separator(spark):
    library = spark.createDataFrame([("m1", "x with y feat z", "", "song"), ("m2", "with y", "", "song"), ("m3", "x", "", "song")], "id string, a string, aa string, t string")
    led = matching.couple_entries(library).where("mode = 'feat'").select("a", "id")
    assert set(rows(led)) == {("x", "m1"), ("x with y", "m1")}


def test_near_strings_equals_brute_force(spark):
    import itertools
    import random

    random.seed(5)
    words = sorted({"".join(random.choice("ab") for _ in range(random.randint(0, 7))) for _ in range(60)})
    lev = lambda a, b: min(lev(a[1:], b) + 1, lev(a, b[1:]) + 1, lev(a[1:], b[1:]) + (a[0] != b[0])) if a and b else len(a) + len(b)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.l, r.r): r.distance for r in matching.near_strings(df, df, 2).collect()}
    assert got == {(a, b): d for a, b in itertools.product(words, words) if (d := lev(a, b)) <= 2}


def test_landing_and_merge(spark):
    page = '{"recenttracks":{"track":{"artist":{"#text":"A","mbid":""},"name":"T","mbid":"","image":[{"#text":"x"},{"#text":""}],"date":{"uts":"5"}}}}'
    now = '{"recenttracks":{"track":[{"artist":{"#text":"A"},"name":"T","@attr":{"nowplaying":"true"}}]}}'
    out = landing.recent_tracks(spark.createDataFrame([(page,), (now,), (None,)], "value string"), "u")
    assert [(r.artist, r.title, r.mbid_track, r.image_url) for r in out.collect()] == [("A", "T", None, "x")]
    source = spark.createDataFrame([("A", 1.0, None, "s"), ("a", 2.0, "m", "t"), ("B", 9.0, None, "s")], "artist string, score double, mbid string, source string")
    merged = recommend.merge([source], spark.createDataFrame([("b",)], "artist string"), 5)
    assert [tuple(r) for r in merged.collect()] == [(3.0, "A", "m", ["s", "t"])]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", None)], "k long, v string, at long")
    assert rows(sync.upsert(old, new, ["k"], "at").select("k", "v")) == [(1, "c"), (2, "b"), (3, "e")]


def test_playlists_are_isolated_and_empty_ones_change_nothing(spark):
    from tonearm.operators import playlists

    ids = lambda *x: spark.createDataFrame([(i + 1, v) for i, v in enumerate(x)], "position int, id string")

    def broken():
        raise RuntimeError("no service")

    existing = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep"), ("z", 1, "other")], "name string, position int, id string")
    definitions = {"a": lambda: ids("x", "y"), "b": lambda: ids("x").limit(0), "c": broken, "d": lambda: ids("q"), "off": lambda: ids("q")}
    runs = playlists.generate(definitions, existing, settings={"playlist.off.enabled": "0"})
    assert [(r.slug, r.action) for r in runs] == [("a", "replaced"), ("b", "empty"), ("c", "error"), ("d", "created")] and runs[2].error == "no service"
    assert rows(playlists.kept(existing, runs)) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "keep"), ("d", 1, "q"), ("z", 1, "other")]
    assert [r.action for r in playlists.generate(definitions, existing, slug="off", dry_run=True)] == ["dry-run"]
    with pytest.raises(ValueError):
        playlists.generate(definitions, existing, slug="nope")
    assert sorted(r.id for r in playlists.shuffled(ids("a", "b", "c"), 3).collect()) == ["a", "b", "c"]


def test_snapshots_settings_and_run_log(spark):
    from datetime import timedelta

    from tonearm.operators import snapshots

    now = datetime(2024, 5, 1)
    held = snapshots.compute("u", {"n": spark.createDataFrame([(3,)], "plays long")}, now)
    both = snapshots.store(snapshots.store(spark.createDataFrame([], snapshots.SCHEMA), held), held)
    assert [(r.key, r.section, r.payload) for r in both.collect()] == [("u", "n", '[{"plays":3}]')]
    live = lambda: spark.createDataFrame([(9,)], "plays long")
    assert snapshots.top_list(both, "u", "n", live, filtered=False).first()[0] == 3
    assert snapshots.top_list(both, "u", "n", live, filtered=True).first()[0] == snapshots.top_list(both, "v", "n", live, filtered=False).first()[0] == 9
    assert snapshots.get(both, "v").count() == 0 and snapshots.get(both, "v", lambda: held).count() == 1
    settings = snapshots.put(snapshots.put(spark.createDataFrame([], "key string, value string"), "k", "1"), "k", "2")
    assert snapshots.setting(settings, "k") == "2" and snapshots.setting(settings, "q", "d") == "d"
    ticks = iter(now + timedelta(seconds=s) for s in (0, 2, 10, 11))
    good = snapshots.recorded(spark, "sync", "r1", "Sync", lambda: next(ticks), lambda: {"matched": 2})
    bad = snapshots.recorded(spark, "sync", "r2", "Sync", lambda: next(ticks), lambda: 1 / 0)
    runs = good.unionByName(bad)
    assert [(r.status, r.metrics, r.duration_ms) for r in runs.orderBy("reference").collect()] == [("success", '{"matched": 2}', 2000), ("error", None, 1000)]
    assert filters.runs_filter(runs, kind="sync", status="error", label="syn").count() == 1
    assert snapshots.without_older(runs, "started_at", now + timedelta(seconds=5)).count() == 1


def test_aliases_by_album_then_artist(spark):
    from tonearm.operators import aliases

    library = spark.createDataFrame([("1", "Other Credit", "Ensemble", "alb-1"), ("2", "Arto", "Golden", "x"), ("3", "Arto", "Silver", "x"), ("4", "Twin", "Twinn", "y"), ("5", "Twin", "Twina", "y")], "id string, artist string, title string, mbz_album_id string")
    couples = [("Orelsan", "Ensemble", ["alb-1"], 5), ("Arto", "Goldne", [], 3), ("Arto", "Silver", [], 2), ("Twin", "Twin", ["y"], 1), ("Arto", "Zzzzzz", ["none"], 1), ("Known", "Couple", [], 1), ("Q", "Silverr", ["x"], 1), ("Q", "", [], 1)]
    df = spark.createDataFrame(couples, "artist string, title string, albums array<string>, plays long")
    existing = spark.createDataFrame([("known", "couple")], "a string, t string")
    got = {(r.artist, r.title): (r.id, r.strategy, r.state) for r in aliases.track_aliases(df, library, existing).collect()}
    assert got == {
        ("Orelsan", "Ensemble"): ("1", "album-exact", "alias"), ("Arto", "Goldne"): ("2", "artist-fuzzy", "alias"), ("Arto", "Silver"): (None, None, "resolvable"),
        ("Twin", "Twin"): (None, None, "ambiguous"), ("Arto", "Zzzzzz"): (None, None, "none"), ("Known", "Couple"): (None, None, "existing"), ("Q", "Silverr"): ("3", "album-fuzzy", "alias"),
    }


def test_suggestions_from_looked_up_candidates(spark):
    from tonearm.operators import aliases

    unmatched = spark.createDataFrame([("Prince Rogers", 9), ("Two Faced", 8), ("Owned", 7), ("Rare", 1), ("Low", 6), ("Aliased", 5)], "artist string, plays long")
    library = spark.createDataFrame([("Prince",), ("PRINCE",), ("Face A",), ("Face B",), ("owned",)], "name string")
    c = [("Prince Rogers", "m1", "Prince", 100, ["prince", "Symbol"]), ("Two Faced", "m2", "Face A", 90, ["Face B", " "]), ("Low", "m3", "Prince", 79, None), ("Rare", "m1", "Prince", 99, None)]
    candidates = spark.createDataFrame(c, "query string, mbid string, name string, score int, aliases array<string>")
    out = aliases.suggest(unmatched, candidates, library, spark.createDataFrame([("aliased",)], "source_artist string"), least_plays=2)
    assert rows(out.select("source", "kind", "targets")) == [("Low", "none", None), ("Prince Rogers", "unique", ["PRINCE"]), ("Two Faced", "ambiguous", ["Face A", "Face B"])]
    assert rows(aliases.candidate_names(candidates.limit(1)).select("name")) == [("Prince",), ("Symbol",)]


def test_recommendations_leave_out_owned_and_ignored(spark):
    merged = spark.createDataFrame([("A", 9.0, "id-a"), ("Béta", 8.0, None), ("C", 7.0, None), ("D", 6.0, ""), ("E", 5.0, None)], "artist string, score double, mbid string")
    found = spark.createDataFrame([("C", 0, "id-c", 90), ("D", 0, "id-d", 84), ("D", 1, "id-x", 99), ("E", 0, "id-e", 85)], "query string, pos int, mbid string, score int")
    name = lambda *n: spark.createDataFrame([(x,) for x in n], "artist string")
    ids = spark.createDataFrame([("id-c",), (None,)], "mbid string")
    out = recommend.recommend(merged, found, name("beta"), name("zzz"), ids, 3)
    assert [tuple(r) for r in out.collect()] == [("A", 9.0, "id-a"), ("D", 6.0, None), ("E", 5.0, "id-e")]
    snapshot = recommend.saved(out, "2024-01-01").unionByName(spark.createDataFrame([("x", "no json")], "generated_at string, payload string"))
    assert [r.artist for r in recommend.loaded(snapshot).collect()] == ["A", "D", "E"]
    assert [r.artist for r in recommend.loaded(recommend.removed(snapshot.limit(1), "id-a", "D")).collect()] == ["D", "E"]
    assert [r.artist for r in recommend.loaded(recommend.removed(snapshot.limit(1), None, " d")).collect()] == ["A", "E"]
    once = recommend.ignore(spark.createDataFrame([("name", "a")], "kind string, value string"), "id-a", "A")
    assert rows(once) == [("mbid", "id-a"), ("name", "a")]
    scores = recommend.from_recordings(spark.createDataFrame([("r", 0.5), ("s", 0.25)], "recording string, score double"), spark.createDataFrame([("r", "m", "N"), ("s", "m", "N"), ("q", "m", "N")], "recording string, mbid string, name string"))
    assert rows(scores) == [("N", 75.0, "m")]


def test_equal_recommendation_scores_tie(spark):
    parts = {"A": [0.3] * 3, "B": [0.9], "C": [0.1] * 9, "D": [0.7, 0.2], "E": [0.8]}
    seed = spark.createDataFrame([(str(i), 1.0) for i in range(9)] + [("w", 3.0)], "artist string, weight double")
    similar = [(str(i), a, m) for a, ms in parts.items() for i, m in enumerate(ms)] + [("w", "F", 0.3), ("w", "G", 0.1)]
    found = recommend.from_similar(seed, spark.createDataFrame(similar, "seed string, artist string, match double"))
    assert rows(found.select("artist", "score")) == [("A", 0.9), ("B", 0.9), ("C", 0.9), ("D", 0.9), ("E", 0.8), ("F", 0.9), ("G", 0.3)]
    source = lambda s: found.select("artist", "score", F.lit(None).cast("string").alias("mbid"), F.lit(s).alias("source"))
    none = spark.createDataFrame([], "artist string")
    merged = recommend.merge([source("s"), source("t"), source("u")], none, None)
    assert rows(merged.select("artist", "score")) == [("A", 2.7), ("B", 2.7), ("C", 2.7), ("D", 2.7), ("E", 2.4), ("F", 2.7), ("G", 0.9)]
    assert [r.artist for r in recommend.merge([source("s")], none, 3).collect()] == ["A", "B", "C"]


def test_library_lookups_and_shapes(spark):
    from tonearm.operators import library

    users = spark.createDataFrame([("u1", "admin")], "id string, user_name string")
    assert library.user_id(users, "admin") == "u1"
    with pytest.raises(LookupError):
        library.user_id(users, "nobody")
    plays = spark.createDataFrame([("b",), ("a",), ("",), ("",), ("",), (None,)], "lastfm_user string")
    assert library.default_user(plays) == "a" and library.default_user(plays.limit(0)) is None
    media = spark.createDataFrame([("m1", "A", "T"), ("m2", "", "U"), ("m3", None, "")], "id string, artist string, title string")
    ids = spark.createDataFrame([(1, "m3"), (2, "gone"), (3, "m1"), (4, "m2")], "pos int, id string")
    assert [tuple(r) for r in library.labels(ids, media).collect()] == [(1, "m3", ""), (3, "m1", "A — T"), (4, "m2", "U")]
    assert [r.id for r in library.missing_ids(ids, media).collect()] == ["gone"]
    notes = spark.createDataFrame([("m1", "media_file", 3)], "item_id string, item_type string, play_count int")
    assert sorted(r.id for r in library.never_played(notes, media, 5, 1).collect()) == ["m2", "m3"]
    shaped = library.insert_shape(spark.createDataFrame([("u", 1)], "user_id string, play_count int"), ["ann_id", "user_id", "rated_at"])
    assert shaped.columns == ["ann_id", "user_id", "rated_at"] and len(shaped.first().ann_id) == 36
    asked = spark.createDataFrame([("art", "sonk"), ("artt", "song")], "a string, t string")
    owned = spark.createDataFrame([("art", "va", "song")], "a string, aa string, t string")
    told = library.suggestions(matching.diagnose(asked, owned.withColumn("id", F.lit("m"))), asked, owned)
    assert {(r.a, r.verdict): (r.artists and r.artists[0].name, r.titles and r.titles[0].distance) for r in told.collect()} == {("art", "title_near_match"): (None, 1), ("artt", "artist_near_match"): ("art", None)}


def test_landed_answers(spark):
    page = lambda value, **more: spark.createDataFrame([(value, *more.values())], ", ".join(["value string", *[f"{k} string" for k in more]]))
    loved = landing.loved_tracks(page('{"lovedtracks":{"track":{"name":"T","mbid":"","artist":{"name":"A"},"date":{"uts":"0"}}}}'), "u")
    assert rows(loved) == [("u", "A", "T", None, None)]
    similar = landing.similar_artists(page('{"similarartists":{"artist":[{"name":" ","match":"1"},{"name":" B ","mbid":"m","match":"0.5","url":"x"}]}}', seed="A"))
    assert rows(similar) == [("A", "B", "m", 0.5, "x")]
    known = lambda value, path="track": rows(landing.lookups(page(value, artist="Ac", title="Ti"), path))[0][2:]
    assert known('{"track":{"name":"ti ","mbid":"m","artist":{"name":"AC/DC"}}}') == ("m", "AC/DC", None)
    assert known('{"corrections":{"correction":{"track":{"name":"Tin","artist":{"name":"ac"}}}}}', "corrections.correction.track") == (None, None, "Tin")
    assert known('{"error":6,"message":"no"}') == known("oops") == (None, None, None)
    lists = landing.playlists(page('{"subsonic-response":{"playlists":{"playlist":[{"id":"1","name":"P","owner":"me","songCount":2},{"id":"2","name":"P","owner":"you"}]}}}'))
    assert rows(landing.playlist_named(lists, "P", "you")) == [("2", "P", "you", 0)]
    tracks = landing.playlist_tracks(page('{"subsonic-response":{"playlist":{"id":"1","name":"P","entry":[{"id":"x","title":"T"},{"id":"y"}]}}}'))
    assert rows(tracks.select("position", "id")) == [(1, "x"), (2, "y")]
    assert rows(landing.recommended_recordings(page('{"payload":{"mbids":[{"recording_mbid":"r","score":0.5},{"recording_mbid":""}]}}'))) == [("r", 0.5)] and landing.recommended_recordings(page("")).count() == 0
    assert rows(landing.recording_artists(page('{"r":{"artist":{"artists":[{"artist_mbid":"m","name":"N"},{"name":"no id"}]}}}'))) == [("r", "m", "N")]
    assert rows(landing.artist_candidates(page('{"artists":[{"id":"m","name":"N","score":91,"aliases":[{"name":"X"}]},{"id":"n","name":"O"}]}', query="q")).select("pos", "mbid", "score", "aliases")) == [(0, "m", 91, ["X"]), (1, "n", 0, [])]
    assert rows(landing.known_ids(page('[{"foreignArtistId":"m"},{"foreignArtistId":""}]'))) == [("m",)]
    assert landing.search_phrase(' a"b ') == 'artist:"a\\"b"' and landing.search_phrase(" ") is None
    assert [len(c) for c in landing.in_chunks([str(i % 60) for i in range(120)])] == [50, 10]


def test_client_retries_and_signs():
    import hashlib

    from tonearm.sources import client

    answers = iter([OSError("lost"), (503, "busy"), (200, '{"ok":1}')])

    def transport(params):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    waits = []
    assert client.call(transport, {}, pause=waits.append) == {"ok": 1} and waits == [1.0, 2.0]
    with pytest.raises(client.ServiceError) as told:
        client.call(lambda p: (200, '{"error":6,"message":"not found"}'), {})
    assert told.value.code == 6
    with pytest.raises(client.ServiceError):
        client.call(lambda p: (429, "slow"), {}, pause=lambda s: None)
    pages = client.paged(lambda p: (200, '{"x":{"@attr":{"totalPages":"3"}}}'), {}, "x")
    assert len(list(pages)) == 3
    sent = []
    assert client.write_loves([{"artist": "A", "title": "T"}], lambda p: sent.append(p) or (200, "{}"), "k", "s", "sess") == 1
    assert sent[0]["api_sig"] == hashlib.md5(b"api_keykartistAmethodtrack.lovesksesstrackTs").hexdigest()
    assert client.artist_to_add([{"foreignArtistId": "m"}], "m", 1, "/f")["monitored"]
    with pytest.raises(LookupError):
        client.artist_to_add([], "m", 1, "/f")


def test_backups(spark, tmp_path):
    from tonearm.sources import backup

    path, target = str(tmp_path / "t.parquet"), str(tmp_path / "copies")
    spark.range(3).write.parquet(path)
    at = lambda d: datetime(2024, 1, d)
    for d in (1, 2, 3):
        copy = backup.backup(spark, path, target, "t", at(d), keep=2)
    assert backup.quick_check(spark, copy, ["id"]) == 3
    with pytest.raises(ValueError):
        backup.quick_check(spark, copy, ["other"])
    assert backup.prune_older_than(spark, target, 0, at(9)) == [] and len(backup.prune_older_than(spark, target, 6, at(9))) == 1
    assert backup.due(None, at(1)) and not backup.due(at(1), at(1)) and backup.due(at(1), at(2))


def test_sync_helpers(spark):
    cache = spark.createDataFrame([("a", None, datetime(2024, 1, 1)), ("b", None, datetime(2024, 3, 1)), ("c", "m", datetime(2020, 1, 1))], "artist_norm string, target_id string, resolved_at timestamp_ntz")
    now = filters.moment(datetime(2024, 3, 2))
    assert sorted(r.artist_norm for r in sync.purge_stale(cache, "resolved_at", now, 30).collect()) == ["b", "c"] and sync.purge_stale(cache, "resolved_at", now, 0).count() == 3
    assert sync.purge(cache, cache.limit(1), ["artist_norm"]).count() == 2
    stars = sync.add_stars(spark.createDataFrame([("u", "m", "media_file", 1, None, 0, False, None)], "user_id string, item_id string, item_type string, play_count int, play_date timestamp_ntz, rating int, starred boolean, starred_at timestamp_ntz"), spark.createDataFrame([("u", "m"), ("u", "n")], "user_id string, item_id string"), now)
    assert rows(stars.select("item_id", "starred", "starred_at")) == [("m", True, datetime(2024, 3, 2)), ("n", True, datetime(2024, 3, 2))]
    loved = spark.createDataFrame([("A", "T", None)], "artist string, title string, mbid string")
    pulled = sync.pull_loves(loved, spark.createDataFrame([], "mbid string, item_id string"), spark.createDataFrame([("A", "T", "m")], "artist string, title string, item_id string"))
    assert rows(pulled) == [("A", "T", None, "m")]
    assert landing.fetch_window(datetime(2024, 1, 2), datetime(2024, 2, 1)) == (datetime(2024, 1, 1, 23), None)
    assert landing.fetch_window(None, datetime(2024, 2, 3), None, "2024-02-02") == (datetime(2024, 2, 1), datetime(2024, 2, 3))
    assert filters.period_bounds("7d", datetime(2024, 1, 8)) == (datetime(2024, 1, 1), datetime(2024, 1, 8)) and filters.period_bounds("all-time", datetime(2024, 1, 8)) == (None, None)
    one = spark.createDataFrame([("A B", "C&D", "")], "a string, t string, e string")
    assert one.select(text.search_url("http://x/", F.col("a"), F.col("t"))).first()[0] == "http://x/A+B/C%26D" and one.select(text.search_url("http://x/", F.col("a"), F.col("e"))).first()[0] is None
    assert one.select(text.correction_or_null(F.col("a"), F.lit(" a b "))).first()[0] is None


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from tonearm.streaming import ingest

    source, folder, other = tmp_path / "scrobbles.parquet", str(tmp_path / "a"), str(tmp_path / "b")
    schema = "lastfm_user string, played_at timestamp_ntz, artist string, title string"
    add = lambda *r: spark.createDataFrame([("u", datetime(2024, 1, d, h), "a", t) for d, h, t in r], schema).write.mode("append").parquet(str(source))
    add((1, 1, "x"), (1, 1, "x"), (1, 2, "y"))
    run = lambda: (
        ingest.run_to_table(ingest.deduplicated(ingest.play_stream(spark, str(tmp_path))).select("title"), folder),
        ingest.run_to_totals(ingest.daily_counts(ingest.play_stream(spark, str(tmp_path)), "lastfm_user"), ["lastfm_user", "day"], other),
    )
    once, totals = run()
    assert rows(once) == [("x",), ("y",)] and rows(totals) == [("u", "2024-01-01", 3)]
    # A repeat within the lateness is no new play; a late play changes its day's total.
    add((1, 1, "x"), (1, 5, "z"), (2, 1, "w"))
    once, totals = run()
    assert rows(once) == [("w",), ("x",), ("y",), ("z",)] and rows(totals) == [("u", "2024-01-01", 5), ("u", "2024-01-02", 1)]
