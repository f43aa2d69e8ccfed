"""Readers, streams and statistics on small fixtures with hand-computed results."""

import json

import pytest
from pyspark.sql import functions as F

from crease.functions.prefix import prefix_sums
from crease.functions.scalars import role_name, safe_div, season_years, strip_suffix_key, venue_key
from crease.operators.features import badge, dismissals
from crease.operators.leagues import average_rank_pct
from crease.operators.models import ridge
from crease.errors import ConfigurationError, QualityError, SourceError
from crease.operators.dimensions import violations
from crease.operators.validation import DELIVERY_TYPES, MATCH_TYPES
from crease.sources.files import (
    backfilled, config_rows, csv_texts, csv_typed, extract, fetch, file_name_of, first_source, load_config, manifest, markdown, pruned, reconcile, source_named, sql_on_files, united_competitions,
    validate_catalog, write_parameters, write_table, write_validated, yearly_auctions,
)
from crease.sources.match_json import delivery_rows, match_rows, normalise, read_matches, unsupported
from crease.streaming.live import deduplicated, live_innings, sessions, windowed, written_once


def ball(extras=None, wickets=None, actual="0.1"):
    runs = {"batter": 1, "extras": sum((extras or {}).values()), "total": 1 + sum((extras or {}).values())}
    return {"actual_delivery": actual, "batter": "A", "bowler": "B", "non_striker": "C", "runs": runs} | ({"extras": extras} if extras else {}) | ({"wickets": wickets} if wickets else {})


@pytest.fixture
def match_files(tmp_path):
    wickets = [{"kind": "run out", "player_out": "C"}, {"kind": "retired hurt", "player_out": "A"}]
    info = {"balls_per_over": 6, "dates": ["2024-01-02"], "gender": "male", "overs": 20, "season": "2023/24", "teams": ["X", "Y"], "venue": "V", "players": {"X": ["A"], "Y": ["B"]}, "outcome": {"winner": "X", "by": {"runs": 7}}, "registry": {"people": {"A": "1"}}}
    balls = [ball(), ball({"wides": 1}), ball({"noballs": 1}), ball({"byes": 1, "legbyes": 2, "penalty": 5}, wickets)]
    innings = [{"team": "X", "overs": [{"over": 0, "deliveries": balls}]}, {"team": "Y", "super_over": True, "overs": [{"over": 0, "deliveries": [ball()]}]}]
    (tmp_path / "test").mkdir()
    (tmp_path / "test/123.json").write_text("﻿" + json.dumps({"meta": {"revision": 1}, "info": info, "innings": innings}), encoding="utf-8")
    (tmp_path / "test/bad.json").write_text('{"meta": {}}')
    return str(tmp_path)


def test_match_files(spark, match_files):
    raw = read_matches(spark, match_files)
    assert unsupported(raw).count() == 1
    m = match_rows(raw).first()
    assert (m.match_id, m.outcome_type, m.outcome_margin_value, m.outcome_margin_unit, m.innings_count, m.super_over_innings_count) == ("test:123", "by", 7, "runs", 2, 1)
    d = delivery_rows(raw.where("info is not null")).orderBy("innings_number", "delivery_in_over").collect()
    assert [x.is_legal_ball for x in d[:4]] == [True, False, False, True] and [x.legal_ball_number for x in d[:4]] == [1, None, None, 2]
    assert d[3].extras_json == '{"byes":1,"legbyes":2,"penalty":5}' and d[3].dismissal_type == "run out|retired hurt" and d[3].dismissal_count == 2
    assert d[4].delivery_key == "test:123:2:0:1" and d[4].is_super_over


@pytest.mark.parametrize(
    ("result", "want"),
    [({"winner": "X", "by": {"wickets": 3}}, ("X", "by", 3, "wickets")), ({"result": "tie", "winner": "X"}, (None, "tie", None, None)), ({"result": "no result"}, (None, "no result", None, None)),
     ({"bowl_out": "X", "winner": "X"}, (None, "bowl_out", None, None)), ({"winner": "Y"}, ("Y", None, None, None)), (None, (None, None, None, None))],
)
def test_outcomes(spark, tmp_path, result, want):
    info = {"teams": ["X", "Y"], "missing": ["umpires", {"player": "A"}], "event": {"name": "Cup", "match_number": 4}, "officials": {"umpires": ["U", "V"]}} | ({"outcome": result} if result else {})
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.json").write_text(json.dumps({"info": info, "innings": []}))
    m = match_rows(read_matches(spark, str(tmp_path))).first()
    assert (m.outcome_winner, m.outcome_type, m.outcome_margin_value, m.outcome_margin_unit) == want
    assert (m.missing_json, m.event_json, m.officials_json) == ('["umpires",{"player":"A"}]', '{"match_number":4,"name":"Cup"}', '{"umpires":["U","V"]}')
    assert {c: t for c, t in match_rows(read_matches(spark, str(tmp_path))).dtypes} == MATCH_TYPES


def test_normalise_writes_checked_tables_in_order(spark, match_files, tmp_path):
    with pytest.raises(SourceError, match="unsupported"):
        normalise(spark, match_files, str(tmp_path / "out"))
    (tmp_path / "test/bad.json").unlink()
    (tmp_path / "test/001.json").write_text((tmp_path / "test/123.json").read_text(encoding="utf-8-sig"))
    m, d = normalise(spark, match_files, str(tmp_path / "out"))
    assert [r.match_id for r in m.collect()] == ["test:001", "test:123"] and d.count() == 10
    keys = [r.delivery_key for r in d.collect()]
    assert keys == sorted(keys) and dict(d.dtypes) == DELIVERY_TYPES | {"season": "string"}
    with pytest.raises(Exception, match="exists"):
        normalise(spark, match_files, str(tmp_path / "out"))


def test_configurations_and_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}]')
    assert config_rows(spark, str(tmp_path / "a.json"), "a bigint").first().a == 1
    (tmp_path / "b.json").write_text("{")
    for bad in ("b.json", "none.json"):
        with pytest.raises(ConfigurationError):
            load_config(str(tmp_path / bad))
    good = {"source_name": "Ball Data", "competition": "ipl, bbl", "format": "ZIP archive", "status": "active", "url": "http://x/get?id=1"}
    catalog = {"sources": [good], "required_competitions": ["bbl"]}
    validate_catalog(catalog)
    for change in ({"sources": []}, {"sources": [good, good]}, {"sources": [good | {"status": "gone"}]}, {"sources": [good | {"url": ""}]}, {"sources": [{"source_name": "x"}]}, {"required_competitions": ["psl"]}):
        with pytest.raises(ConfigurationError):
            validate_catalog(catalog | change)
    assert source_named(catalog, "Ball Data") is good
    with pytest.raises(SourceError):
        source_named(catalog, "other")
    assert [file_name_of(x) for x in (good, good | {"filename": "../a.csv"}, good | {"url": "http://x/y/z.json?q=1"}, {"source_name": "A-b  c!", "format": "?"})] == ["ball_data.zip", "a.csv", "z.json", "a-b_c.dat"]


def test_fetch_and_extract(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("d/1.json", "{}")
    source = {"source_name": "s", "url": (tmp_path / "in.zip").as_uri(), "filename": "kept.zip"}
    path, digest = fetch(source, str(tmp_path / "raw"))
    with pytest.raises(SourceError, match="exists"):
        fetch(source, str(tmp_path / "raw"))
    assert [p.name for p in extract(str(path), str(tmp_path / "x"), digest)] == ["1.json"]
    with pytest.raises(SourceError, match="hash"):
        extract(str(path), str(tmp_path / "y"), "0")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(SourceError, match="unsafe"):
        extract(str(tmp_path / "bad.zip"), str(tmp_path / "z"))
    assert not (tmp_path / "out.txt").exists()


def test_other_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\ny,\n")
    assert [tuple(r) for r in csv_typed(spark, str(tmp_path / "t.csv"), "a bigint, b string").collect()] == [(1, "x"), (None, None)]
    assert first_source(spark, str(tmp_path / "no.parquet"), str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(SourceError):
        first_source(spark, str(tmp_path / "no.parquet"))
    rows = spark.createDataFrame([(1, "k"), (2, "l")], "a bigint, b string")
    for format in ("parquet", "csv", "json"):
        write_table(rows, str(tmp_path / format), format=format)
    assert sql_on_files(spark, "select max(a) m from {t}", t=str(tmp_path / "parquet")).first().m == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and csv_texts(spark, str(tmp_path / "csv")).columns == ["a", "b"]
    check = lambda df: violations(df, {"a positive": F.col("a") > 1})
    with pytest.raises(QualityError, match="a positive: 1"):
        write_validated(rows, str(tmp_path / "v"), check)
    assert write_validated(rows.where("a > 1"), str(tmp_path / "v"), check).count() == 1
    write_parameters({"b": 1, "a": [2]}, str(tmp_path / "m/p.json"))
    assert load_config(str(tmp_path / "m/p.json")) == {"a": [2], "b": 1}
    assert markdown(rows, 1).endswith("| 1 | k |\n\n1 more rows are not shown.")
    now, then = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string"), spark.createDataFrame([("a", "0"), ("c", "3")], "path string, sha256 string")
    assert {tuple(r) for r in backfilled(now, then).collect()} == {("a", "0"), ("c", "3"), ("b", "2")} and [tuple(r) for r in pruned(now, then).collect()] == [("a", "0")]
    both = united_competitions({"ipl": rows, "bbl": rows.limit(1)}, {"ipl": "Main League"}, "a bigint", spark)
    assert sorted(r.competition for r in both.collect()) == ["Main League", "Main League", "bbl"] and united_competitions({}, {}, "a bigint", spark).columns == ["a", "competition"]


def test_yearly_layouts(spark, tmp_path):
    (tmp_path / "A_2013.csv").write_text(',Name,Price in $,Role,TeamName\n0,Chris,"625,000",AR,C\n')
    (tmp_path / "A_2025.csv").write_text(',Name ,Nationality,BasePrices in Rs,Winning Bid in Rs,TeamName\n0,Noor  ,Overseas,"2,00,00,000 ","10,00,00,000 ",C\n')
    got = {r.year: r for r in yearly_auctions(spark, [str(p) for p in tmp_path.glob("*.csv")]).collect()}
    assert (got[2013].price, got[2013].currency) == (625_000, "USD") and (got[2025].price, got[2025].currency, got[2025].name_raw) == (1e8, "INR", "Noor")
    assert yearly_auctions(spark, []).count() == 0


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a")
    now = manifest(spark, str(tmp_path / "in"))
    then = now.withColumn("sha256", F.lit("other"))
    assert reconcile(now, now).first().status == "verified" and reconcile(now, then).first().status == "changed"
    assert reconcile(now, now.where("false")).first().status == "untracked" and reconcile(now.where("false"), now).first().status == "missing"
    write_table(now, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        write_table(now, str(tmp_path / "out"))
    assert markdown(now.select("n_bytes")) == "| n_bytes |\n|---|\n| 1 |"


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "a", 1.0), (1, "2024-01-01 00:00:00", 7, "a", 1.0), (2, "2024-01-01 00:10:00", 7, "a", 2.0), (3, "2024-01-01 02:00:00", 7, "b", 3.0)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert {(r.event_type, r.n_events, r.total) for r in windowed(events).collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
    assert sorted(r.n_events for r in sessions(events).collect()) == [1, 2]
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = deduplicated(stream).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 3


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert q.exception() is None


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "event_id bigint, ts string, user_id bigint, event_type string, value double"
    batches = [[(1, "2024-01-01 00:05:00", 7, "a", 1.0)], [(2, "2024-01-01 05:00:00", 7, "a", 2.0)], [(4, "2024-01-01 09:00:00", 7, "a", 4.0)], [(3, "2024-01-01 00:06:00", 7, "a", 9.0)], [(5, "2024-01-01 15:00:00", 7, "a", 5.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/0")).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run(windowed(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")))
    got = {str(r.start)[11:13]: r.total for r in spark.table("late").collect()}
    assert got["00"] == 1.0 and got["05"] == 2.0  # event 3 came after its window was closed


def test_a_batch_is_written_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second run repeats the batch, as after a lost checkpoint
        run(written_once(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_innings_state_counts_a_delivery_once(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "delivery_key string, match_id string, innings_number bigint, total_runs bigint, is_wicket int, is_legal int"
        for k, rows in enumerate([[("m:1:0:1", "m", 1, 4, 0, 1), ("m:1:0:2", "m", 1, 1, 1, 1)], [("m:1:0:2", "m", 1, 1, 1, 1), ("m:1:0:3", "m", 1, 2, 0, None)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        run(live_innings(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")))
        assert tuple(spark.sql("select runs, wickets, balls from live order by runs desc").first()) == (7, 1, 2)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_scalars(spark):
    one = spark.createDataFrame([("2023/24",), ("1999/00",), ("2023-2024",), ("in 2021",), ("x",), (None,)], "s string")
    start, end = season_years(F.col("s"))
    assert [tuple(r) for r in one.select(start, end).collect()] == [(2023, 2024), (1999, 1900), (2023, 2024), (2021, 2021), (None, None), (None, None)]
    r = spark.range(1).select(safe_div(F.lit(1), F.lit(0)).alias("a"), safe_div(F.lit(1), F.lit(0), None).alias("b"), role_name(F.lit(" Wicket Keeper")).alias("c"), role_name(F.lit("Coach")).alias("d"), strip_suffix_key(venue_key(F.lit("Eden & Park, Kol")), F.lit("kol")).alias("e")).first()
    assert tuple(r) == (0.0, None, "Wicket-Keeper", "Unknown", "eden and park")


def test_badges_and_ranks(spark):
    rows = [(0.20, 0.30), (0.30, 0.10), (0.50, 0.30), (0.55, 0.08)]
    got = [r.b for r in spark.createDataFrame(rows, "f double, i double").select(badge(F.lit(True), F.col("f"), F.col("i")).alias("b")).collect()]
    assert got == ["Elite", "High Floor", "Boom-or-Bust", "Moderate"]
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None)], "k string, v double")
    assert sorted((r.p for r in v.select(average_rank_pct(F.col("v"), ["k"]).alias("p")).collect()), key=lambda x: -1 if x is None else x) == [None, pytest.approx(1 / 3), pytest.approx(2.5 / 3), pytest.approx(2.5 / 3)]


def test_dismissals_are_padded(spark):
    df = spark.createDataFrame([("m", "A|B", "caught"), ("m", "C", None), ("m", None, None)], "match_id string, dismissal_player_out string, dismissal_type string")
    assert [(r.player, r.kind) for r in dismissals(df, ["match_id"]).collect()] == [("A", "caught"), ("B", "caught"), ("C", "unknown")]


def test_ridge_recovers_a_line(spark):
    rows = [(float(i), float(i * i % 7), 3.0 * i - 2.0 * (i * i % 7) + 1.0, None) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, y double, z double")
    p = ridge(df, ["a", "b", "z"], "y", (1e-9,))[1e-9]
    assert df.select(F.max(F.abs(p - F.col("y")))).first()[0] < 1e-3


def test_prefix_sums_by_brute_force(spark):
    rows = [(k, (i * 7919) % (1 << 31), i % 5 + 1) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    want = {(k, o): sum(v for k2, o2, v in rows if k2 == k and o2 < o) for k, o, _ in rows}
    assert {(r.k, r.o): r.before for r in prefix_sums(df, ["k"], F.col("o"), "v", "before", 8).collect()} == want
