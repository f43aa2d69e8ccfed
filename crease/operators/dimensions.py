"""Dimensions, participation, identity audit and data quality over the raw tables."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.prefix import dense_ranks
from crease.functions.scalars import compact_key, initials_key, literal_map, name_tokens, role_name, season_years, strip_suffix_key, surname_initial, venue_key
from crease.operators.facts import matches
from crease.operators.nested import P6_SQL, delivery_children
from crease.sources.tables import table

# Words of a competition's name, in the order in which categories are tried; any other name is domestic.
CATEGORY_WORDS = (
    ("IPL", ("indian premier league", "ipl")),
    ("Overseas Franchise", ("big bash", "bbl", "caribbean premier league", "cpl", "pakistan super league", "psl", "sa20", "ilt20", "major league cricket", "mlc", "the hundred", "bpl",
                            "bangladesh premier league", "lanka premier league", "lpl", "super smash", "t20 blast")),
    ("Domestic", ("syed mushtaq ali", "ranji", "vijay hazare", "deodhar", "duleep", "sheffield shield", "marsh cup", "csa t20", "plunket shield")),
    ("International", ("t20i", "odi", "test", "world cup", "asia cup", "champions trophy", "international")),
)
# Former keys of grounds and their present ones.
LINEAGE = {
    "feroz shah kotla": "arun jaitley stadium", "feroz shah kotla ground": "arun jaitley stadium",
    "sardar patel stadium": "narendra modi stadium", "sardar patel stadium motera": "narendra modi stadium", "motera stadium": "narendra modi stadium",
    "punjab cricket association stadium": "punjab cricket association is bindra stadium", "punjab cricket association stadium mohali": "punjab cricket association is bindra stadium",
    "is bindra stadium": "punjab cricket association is bindra stadium", "rajiv gandhi international stadium uppal": "rajiv gandhi international stadium",
    "daren sammy national cricket stadium gros islet st lucia": "daren sammy national cricket stadium gros islet", "sir vivian richards stadium north sound antigua": "sir vivian richards stadium north sound",
    "dr dy patil sports academy mumbai": "dr dy patil sports academy", "maharaja yadavindra singh international cricket stadium mullanpur": "maharaja yadavindra singh international cricket stadium new chandigarh",
    "queen's park oval port of spain trinidad": "queen's park oval port of spain", "gmhba stadium south geelong victoria": "simonds stadium south geelong victoria",
    "brian lara stadium tarouba trinidad": "brian lara stadium tarouba", "kensington oval bridgetown barbados": "kensington oval bridgetown", "ma chidambaram stadium chepauk": "ma chidambaram stadium",
    "providence stadium guyana": "providence stadium", "sabina park kingston jamaica": "sabina park kingston", "warner park basseterre st kitts": "warner park basseterre",
}

#: Parts of a block of candidates, and partitions they are spread over.
SALTS, SPREAD = 8, 48


def participation(spark: SparkSession, base: str) -> DataFrame:
    """One row for each player of each team list; a match without lists gives one row with no player for each team."""
    m = table(spark, base, "matches").select("match_id", "competition", "season", "match_date", "teams_json", "players_json").dropDuplicates(["match_id"])
    lists = F.from_json("players_json", "map<string,array<string>>")
    m = m.withColumn("lists", lists)
    keys = ["match_id", "competition", "season", "match_date"]
    listed = m.where(F.size("lists") > 0).select(*keys, F.explode("lists").alias("team", "names")).select(*keys, "team", F.explode("names").alias("player"))
    bare = m.where(F.coalesce(F.size("lists"), F.lit(-1)) <= 0).select(*keys, F.explode(F.from_json("teams_json", "array<string>")).alias("team"), F.lit(None).cast("string").alias("player"))
    return listed.unionByName(bare)


def participation_summary(spark: SparkSession, base: str) -> DataFrame:
    return participation(spark, base).where("player is not null").groupBy("player", "competition").agg(F.count_distinct("match_id").alias("n_matches"), F.count_distinct("team").alias("n_teams"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"), F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons"))


def category(name: Column) -> Column:
    """The category of a competition by the first of the words that its name holds; NULL is Other, any other Domestic."""
    low = F.lower(F.trim(name))
    out = F.when(name.isNull(), "Other")
    for label, words in CATEGORY_WORDS:
        holds = F.lit(False)
        for w in words:
            holds = holds | low.contains(w)
        out = out.when(holds, label)
    return out.otherwise("Domestic")


def competitions(spark: SparkSession, base: str) -> DataFrame:
    m = matches(spark, base)
    start, end = season_years(F.col("season"))
    return m.groupBy("competition", "season").agg(F.count("*").alias("n_matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date")).select("competition", "season", "n_matches", start.alias("start_year"), end.alias("end_year"), category(F.col("competition")).alias("category"), "first_date", "last_date")


def venues(spark: SparkSession, base: str) -> DataFrame:
    """Grounds by their present key: the most frequent spelling is canonical (ties by name); ids follow the key's order.

    Former keys become present ones first. Matches without a ground are VEN_UNKNOWN.
    """
    m = table(spark, base, "matches").select("match_id", "venue", "city").dropDuplicates(["match_id"])
    blank = F.coalesce(F.trim("venue"), F.lit("")) == ""
    key = strip_suffix_key(venue_key(F.col("venue")), F.coalesce(venue_key(F.col("city")), F.lit("")))
    m = m.withColumn("key", F.when(~blank, F.coalesce(F.try_element_at(literal_map(LINEAGE), key), key)))
    m = m.withColumn("venue", F.when(~blank, F.col("venue")))
    spelt = m.groupBy("key", "venue").agg(F.count("*").alias("n"))
    g = spelt.groupBy("key").agg(F.min_by("venue", F.struct((-F.col("n")).alias("n"), "venue")).alias("canonical"), F.sum("n").alias("n_matches"), F.count("*").alias("n_variants"))
    ranked = dense_ranks(g, "key", "rank")
    venue_id = F.when(F.col("key").isNull(), "VEN_UNKNOWN").otherwise(F.format_string("VEN_%04d", F.col("rank")))
    return ranked.select(venue_id.alias("venue_id"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce("canonical", F.lit("")).alias("canonical"), "n_matches", F.when(F.col("key").isNull(), 0).otherwise(F.col("n_variants")).cast("bigint").alias("n_variants"))


def similar_venues(spark: SparkSession, base: str, least: float = 0.8) -> DataFrame:
    """Pairs of grounds with similar keys for review, as if every ground were compared with every other."""
    return similar_keys(venues(spark, base).where("key <> ''").select("venue_id", "key"), least)


def similar_keys(v: DataFrame, least: float) -> DataFrame:
    """Pairs of rows of ``v`` (venue_id, key) whose similarity is at least ``least`` and below 1.

    A key is at most (2 - least) / least times as long as one that similar, so keys meet by length; each length
    is spread over salts, and bounds drop most pairs before their similarity is computed.
    """
    v = v.withColumns({"n": F.length("key"), "letters": letters(F.col("key"))})
    far = F.ceil(F.col("n") * F.lit((2 - least) / least)).cast("int")
    a = v.select(*[F.col(c).alias(f"{c}_a") for c in v.columns], F.explode(F.sequence("n", far)).alias("n_b")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    b = v.select(*[F.col(c).alias(f"{c}_b") for c in v.columns]).withColumn("salt", F.pmod(F.hash("key_b"), F.lit(SALTS)))
    a, b = (x.repartition(SPREAD, "n_b", "salt") for x in (a, b))
    met = a.hint("merge").join(b, ["n_b", "salt"]).where((F.col("n_a") < F.col("n_b")) | (F.col("key_a") < F.col("key_b")))
    met = met.where(reach("letters_a", "letters_b", F.col("n_a") + F.col("n_b")) >= least - 1e-9)
    turned = F.col("key_a") > F.col("key_b")
    side = lambda c, x, y: F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    pairs = met.select(side("venue_id", "a", "b").alias("id_1"), side("key", "a", "b").alias("key_1"), side("venue_id", "b", "a").alias("id_2"), side("key", "b", "a").alias("key_2"))
    return similar(pairs, "key_1", "key_2", least).where(F.col("similarity").isNotNull() & (F.col("ratio") < 1)).drop("ratio")


def letters(c: Column) -> Column:
    """How often each letter occurs in a text, then the number of all other characters."""
    each = F.transform(F.array(*[F.lit(x) for x in ascii_lowercase]), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))
    return F.concat(each, F.array(F.length(c) - F.aggregate(each, F.lit(0), lambda n, k: n + k)))


def reach(a: str, b: str, total: Column) -> Column:
    """The most that the similarity of two texts with these ``letters`` can be; ``total`` is their joint length."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, k: n + k)
    return F.when(total > 0, 2.0 * both / total).otherwise(1.0)


def similar(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """pairs + ratio and similarity (ratio to three places): twice the matching characters over all, longest common
    blocks first. Both are NULL where the ratio is below ``least``, which is judged before it is rounded."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([SequenceMatcher(None, p, q).ratio() if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    r = F.col("ratio")
    return pairs.withColumn("ratio", ratio(F.col(a), F.col(b))).withColumn("ratio", F.when(r >= least, r)).withColumn("similarity", F.round("ratio", 3))


def observations(spark: SparkSession, base: str) -> DataFrame:
    """Every name seen in the ball-by-ball columns, among the fielders of wickets and in the lots, with its rows by source."""
    balls = table(spark, base, "deliveries")
    d = balls.select("delivery_key", "batter", "bowler", "non_striker").dropDuplicates(["delivery_key"])
    rows = d.unpivot(["delivery_key"], ["batter", "bowler", "non_striker"], "source", "name").select("source", "name")
    caught = delivery_children(balls).where("child_kind = 'fielder'").select("parent_key", "pos_1", "pos_2", F.col("label").alias("name")).distinct()
    lots = table(spark, base, "auction_lots").select("lot_id", F.col("name_raw").alias("name")).dropDuplicates(["lot_id"])
    every = rows.unionByName(caught.select(F.lit("fielder").alias("source"), "name")).unionByName(lots.select(F.lit("lots").alias("source"), "name"))
    sources = ["batter", "bowler", "non_striker", "fielder", "lots"]
    return every.where(F.trim("name") != "").groupBy(F.trim("name").alias("name")).pivot("source", sources).count().na.fill(0)


def identity_audit(spark: SparkSession, base: str) -> DataFrame:
    """Each name in exactly one bucket: exact, normalised, initials, ambiguous or unmatched."""
    names = observations(spark, base).select("name")
    r = table(spark, base, "people_register").select("player_id", "player_name").distinct()
    by = lambda key: r.select(key.alias("k"), "player_id").where("k is not null and k <> ''").groupBy("k").agg(F.count_distinct("player_id").alias("n"), F.min("player_id").alias("id"))
    tiers = [("exact", F.col("name"), F.col("player_name")), ("normalised", compact_key(F.col("name")), compact_key(F.col("player_name"))), ("initials", initials_key(F.col("name")), initials_key(F.col("player_name"))), ("surname", surname_initial(F.col("name")), surname_initial(F.col("player_name")))]
    out = names
    for tier, of_name, of_register in tiers:
        out = out.withColumn("k", of_name).join(by(of_register).withColumnsRenamed({"n": f"{tier}_n", "id": f"{tier}_id"}), "k", "left").drop("k")
    bucket, player = F.lit("unmatched"), F.lit(None).cast("string")
    for tier in ("surname", "initials", "normalised", "exact"):
        bucket = F.when(F.col(f"{tier}_n") == 1, tier).when(F.col(f"{tier}_n") > 1, "ambiguous").otherwise(bucket)
        player = F.when(F.col(f"{tier}_n") == 1, F.col(f"{tier}_id")).when(F.col(f"{tier}_n") > 1, F.lit(None)).otherwise(player)
    return out.select("name", bucket.alias("bucket"), player.alias("player_id"))


def near_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, player_id, player_name, similarity) of the names of ``left`` and ``right`` that share an initial and are
    at least that similar. A pair of several shared initials meets at the first only; initials are spread over salts,
    and bounds drop most pairs before their similarity is computed."""
    starts = lambda t: F.array_sort(F.array_distinct(F.transform(t, lambda x: F.substring(x, 1, 1))))
    a = left.withColumns({"x": F.lower("name"), "heads": starts(name_tokens(F.col("name")))})
    b = right.withColumns({"y": F.lower("player_name"), "heads2": starts(F.filter(name_tokens(F.col("player_name")), lambda t: F.length(t) > 1))})
    a = a.withColumns({"n": F.length("x"), "letters": letters(F.col("x")), "head": F.explode("heads"), "salt": F.pmod(F.hash("name"), F.lit(SALTS))})
    b = b.withColumns({"n2": F.length("y"), "letters2": letters(F.col("y")), "head": F.explode("heads2")}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    a, b = (x.repartition(SPREAD, "head", "salt") for x in (a, b))
    met = a.hint("merge").join(b, ["head", "salt"]).where(F.col("head") == F.array_min(F.array_intersect("heads", "heads2")))
    total = F.col("n") + F.col("n2")
    met = met.where((2.0 * F.least("n", "n2") >= (least - 1e-9) * total) & (reach("letters", "letters2", total) >= least - 1e-9))
    pairs = met.select("name", "player_id", "player_name", "x", "y")
    return similar(pairs, "x", "y", least).where("similarity is not null").select("name", "player_id", "player_name", "similarity")


def fuzzy_candidates(spark: SparkSession, base: str, least: float = 0.7, keep: int = 3) -> DataFrame:
    """For each name without a register entry its three most similar registered names, with the accept rule.

    A name meets the registered names with a word of over one letter that starts as any of its words does.
    """
    left = identity_audit(spark, base).where("bucket = 'unmatched'").select("name")
    right = table(spark, base, "people_register").select("player_id", "player_name").distinct()
    scored = near_names(left, right, least)
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), "player_name")
    ranked = scored.withColumns({"place": F.row_number().over(order), "next": F.lead("similarity").over(order)})
    s, margin = F.col("similarity"), F.col("similarity") - F.coalesce("next", F.lit(0.0))
    accept = (F.col("place") == 1) & ((s >= 0.82) | ((margin >= 0.2) & (s >= 0.75)) | (F.col("next").isNull() & (s >= 0.78)))
    return ranked.where(F.col("place") <= keep).select("name", "player_id", "player_name", "similarity", "place", accept.alias("accept"), F.when(accept & (s >= 0.88), "high").when(accept, "medium").alias("confidence"))


def players(spark: SparkSession, base: str) -> DataFrame:
    """People of the register with their role, matches and leagues."""
    p = participation(spark, base).where("player is not null").groupBy(F.col("player").alias("player_name")).agg(F.count_distinct("match_id").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("competition")), "|").alias("competitions"))
    r = table(spark, base, "people_register").distinct()
    return r.join(p, "player_name", "left").select("player_id", "player_name", "country", role_name(F.col("playing_role")).alias("role"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("competitions", F.lit("")).alias("competitions"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations, n_rows): all rules of a table in one pass; a rule that is NULL is not violated."""
    one = rows.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in rules)
    return one.selectExpr("n_rows", f"stack({len(rules)}, {pairs}) as (rule, n_violations)").select("rule", "n_violations", "n_rows")


def quality(spark: SparkSession, base: str) -> DataFrame:
    """The checks of deliveries and matches as report rows."""
    raw = table(spark, base, "deliveries").drop("loaded_at")
    d = raw.dropDuplicates(["delivery_key"])
    m = table(spark, base, "matches").dropDuplicates(["match_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {
        "total is bat plus extras": zero("total_runs") == zero("batter_runs") + zero("extra_runs"),
        "extras add up": zero("extra_runs") == zero("byes_runs") + zero("legbyes_runs") + zero("noballs_runs") + zero("penalty_runs") + zero("wides_runs"),
        "legal ball has no wide or no-ball": F.col("is_legal_ball") == ((zero("wides_runs") == 0) & (zero("noballs_runs") == 0)),
        "legal number only on legal balls": F.col("legal_ball_number").isNull() == ~F.coalesce(F.col("is_legal_ball"), F.lit(False)),
        "players named": F.col("batter").isNotNull() & F.col("bowler").isNotNull(),
        "key has its parts": F.col("delivery_key") == F.concat_ws(":", "match_id", "innings_number", "over_number", "delivery_in_over"),
        "runs not negative": (zero("batter_runs") >= 0) & (zero("extra_runs") >= 0),
        "boundary dependency in range": (4 * (zero("batter_runs") == 4).cast("int") + 6 * (zero("batter_runs") == 6).cast("int")) <= F.greatest(zero("batter_runs"), F.lit(0)),
    }
    out = violations(d, rules)
    keys = raw.groupBy("delivery_key").agg(F.count("*").alias("n"))
    out = out.unionByName(keys.agg(F.lit("key occurs once").alias("rule"), F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("n_violations"), F.count("*").alias("n_rows")))
    orphans = d.select("match_id").join(m.select("match_id"), "match_id", "left_anti")
    out = out.unionByName(orphans.agg(F.lit("match exists").alias("rule"), F.count("*").alias("n_violations")).crossJoin(d.agg(F.count("*").alias("n_rows"))))
    numbered = d.where("is_legal_ball").withColumn("k", F.row_number().over(Window.partitionBy("match_id", "innings_number").orderBy("over_number", "delivery_in_over")))
    out = out.unionByName(violations(numbered, {"legal balls are numbered in order": F.col("legal_ball_number") == F.col("k")}))
    bound = d.groupBy("match_id").agg(F.max("innings_number").alias("k")).join(m.select("match_id", "innings_count", "super_over_innings_count"), "match_id")
    return out.unionByName(violations(bound, {"innings within the match": F.col("k") <= F.col("innings_count") + F.coalesce("super_over_innings_count", F.lit(0))}))


def completeness(spark: SparkSession, base: str) -> DataFrame:
    lots = table(spark, base, "auction_lots").drop("loaded_at").dropDuplicates(["lot_id"])
    names = ["name_raw", "nationality", "price_in_usd", "price_in_rs", "base_prices_in_rs", "winning_bid_in_rs", "role_raw", "team_name", "capped_uncapped"]
    one = lots.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(c) for c in names])
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return one.selectExpr("n_rows", f"stack({len(names)}, {pairs}) as (field, n_missing)").select("field", "n_rows", "n_missing", F.round(100 * F.col("n_missing") / F.col("n_rows"), 4).alias("missing_pct"))


QUERIES = {
    "s20_participation": participation, "f32_participation_summary": participation_summary, "f30_competitions": competitions, "f31_venues": venues, "j15_similar_venues": similar_venues, "e01_observations": observations,
    "e05_identity_audit": identity_audit, "e07_fuzzy_candidates": fuzzy_candidates, "f29_players": players, "v05_quality": quality, "a29_completeness": completeness,
}

PARTICIPATION_SQL = """mm as (select distinct match_id, competition, season, match_date, teams_json, players_json from matches),
 li as (select match_id, competition, season, match_date, e.key team, e.value v from mm, json_each(mm.players_json) e),
 pa as (select match_id, competition, season, match_date, team, unnest(from_json(v, '["VARCHAR"]')) player from li union all
        select match_id, competition, season, match_date, unnest(from_json(teams_json, '["VARCHAR"]')) team, null player from mm where match_id not in (select match_id from li))"""
OBS_SQL = f"""d as (select distinct delivery_key, batter, bowler, non_striker from deliveries), fd as (select distinct parent_key, pos_1, pos_2, label from ({P6_SQL}) where child_kind = 'fielder'), l as (select distinct lot_id, name_raw from auction_lots),
 u as (select 'batter' source, batter as name from d union all select 'bowler', bowler from d union all select 'non_striker', non_striker from d union all select 'fielder', label from fd union all select 'lots', name_raw from l),
 ob as (select trim(name) as name, count(*) filter (source = 'batter') batter, count(*) filter (source = 'bowler') bowler, count(*) filter (source = 'non_striker') non_striker, count(*) filter (source = 'fielder') fielder, count(*) filter (source = 'lots') lots from u where trim(name) <> '' group by 1)"""
QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
LINEAGE_SQL = ", ".join(f"({QUOTED(k)}, {QUOTED(v)})" for k, v in LINEAGE.items())
CATEGORY_SQL = "case when competition is null then 'Other' " + " ".join(
    f"when {' or '.join(f'contains(lower(trim(competition)), {QUOTED(w)})' for w in words)} then '{label}'" for label, words in CATEGORY_WORDS
) + " else 'Domestic' end"
SQL = {
    "s20_participation": f"with {PARTICIPATION_SQL} select * from pa",
    "f32_participation_summary": f"with {PARTICIPATION_SQL} select player, competition, count(distinct match_id) n_matches, count(distinct team) n_teams, min(match_date) first_date, max(match_date) last_date, string_agg(distinct season, ',' order by season) seasons from pa where player is not null group by 1, 2",
    "f30_competitions": f"""with mm as (select distinct match_id, competition, season, match_date from matches),
        g as (select competition, season, count(*) n_matches, min(match_date) first_date, max(match_date) last_date from mm group by 1, 2)
        select competition, season, n_matches, try_cast(nullif(regexp_extract(season, '((?:19|20)[0-9][0-9])', 1), '') as integer) start_year,
        case when regexp_matches(season, '^[0-9][0-9][0-9][0-9][/-][0-9][0-9]$') then try_cast(season[1:2] || season[6:7] as integer) when regexp_matches(season, '^[0-9][0-9][0-9][0-9][/-][0-9][0-9][0-9][0-9]$') then try_cast(season[6:9] as integer)
        else try_cast(nullif(regexp_extract(season, '((?:19|20)[0-9][0-9])', 1), '') as integer) end end_year,
        {CATEGORY_SQL} category, first_date, last_date from g""",
    "f31_venues": f"""with mm as (select distinct match_id, venue, city from matches), ln(f, t) as (values {LINEAGE_SQL}), kv as (select *, trim(regexp_replace(regexp_replace(replace(replace(lower(venue), '&', ' and '), '-', ' '), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')) k,
        coalesce(trim(regexp_replace(regexp_replace(replace(replace(lower(city), '&', ' and '), '-', ' '), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')), '') c from mm),
        ks as (select match_id, venue, case when length(c) > 0 and suffix(k, ' ' || c) and length(trim(substr(k, 1, greatest(length(k) - length(c), 0)))) > 0 then trim(substr(k, 1, greatest(length(k) - length(c), 0))) else k end s from kv),
        ky as (select case when trim(venue) <> '' then coalesce(t, s) end "key", case when trim(venue) <> '' then venue end venue from ks left join ln on ln.f = s),
        sp as (select "key", venue, count(*) n from ky group by 1, 2), g as (select "key", min_by(venue, (-n, venue)) canonical, sum(n)::bigint n_matches, count(*) n_variants from sp group by 1)
        select case when "key" is null then 'VEN_UNKNOWN' else 'VEN_' || lpad((dense_rank() over (order by "key" nulls last))::varchar, 4, '0') end venue_id, coalesce("key", '') "key", coalesce(canonical, '') canonical, n_matches,
        case when "key" is null then 0 else n_variants end n_variants from g""",
    "e01_observations": f"with {OBS_SQL} select * from ob",
    "e05_identity_audit": f"""with {OBS_SQL}, tk as (select name, regexp_extract_all(lower(name), '[a-z]+') t from ob), rt as (select distinct player_id, player_name, regexp_extract_all(lower(player_name), '[a-z]+') t from people_register),
        nk as (select name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') k1, case when len(t) >= 2 then list_aggregate(list_transform(t[1:len(t) - 1], lambda x: x[1:1]), 'string_agg', '') || ':' || t[-1] end k2, case when len(t) >= 2 then t[-1] || ':' || t[1][1:1] end k3 from tk),
        rk as (select player_id, player_name, regexp_replace(lower(player_name), '[^a-z0-9]', '', 'g') k1, case when len(t) >= 2 then list_aggregate(list_transform(t[1:len(t) - 1], lambda x: x[1:1]), 'string_agg', '') || ':' || t[-1] end k2, case when len(t) >= 2 then t[-1] || ':' || t[1][1:1] end k3 from rt),
        a0 as (select player_name k, count(distinct player_id) n, min(player_id) id from rk group by 1), a1 as (select k1 k, count(distinct player_id) n, min(player_id) id from rk where k1 <> '' group by 1),
        a2 as (select k2 k, count(distinct player_id) n, min(player_id) id from rk where k2 is not null group by 1), a3 as (select k3 k, count(distinct player_id) n, min(player_id) id from rk where k3 is not null group by 1)
        select name, case when a0.n = 1 then 'exact' when a0.n > 1 then 'ambiguous' when a1.n = 1 then 'normalised' when a1.n > 1 then 'ambiguous' when a2.n = 1 then 'initials' when a2.n > 1 then 'ambiguous' when a3.n = 1 then 'surname' when a3.n > 1 then 'ambiguous' else 'unmatched' end bucket,
        case when a0.n = 1 then a0.id when a0.n > 1 then null when a1.n = 1 then a1.id when a1.n > 1 then null when a2.n = 1 then a2.id when a2.n > 1 then null when a3.n = 1 then a3.id end player_id
        from nk left join a0 on a0.k = name left join a1 on a1.k = nk.k1 left join a2 on a2.k = nk.k2 left join a3 on a3.k = nk.k3""",
    "f29_players": f"""with {PARTICIPATION_SQL}, p as (select player player_name, count(distinct match_id) n, string_agg(distinct competition, '|' order by competition) c from pa where player is not null group by 1)
        select player_id, r.player_name, country, case lower(trim(playing_role)) when 'batter' then 'Batter' when 'batsman' then 'Batter' when 'bowler' then 'Bowler' when 'all-rounder' then 'All-Rounder' when 'wicket-keeper' then 'Wicket-Keeper' else 'Unknown' end as role,
        coalesce(n, 0)::bigint n_matches, coalesce(c, '') competitions from (select distinct * from people_register) r left join p using (player_name)""",
    "v05_quality": """with raw as (select * exclude (loaded_at) from deliveries), d as (select distinct * from raw), mm as (select distinct match_id, innings_count, super_over_innings_count from matches),
        z as (select *, coalesce(total_runs, 0) tr, coalesce(batter_runs, 0) br, coalesce(extra_runs, 0) er, coalesce(byes_runs, 0) + coalesce(legbyes_runs, 0) + coalesce(noballs_runs, 0) + coalesce(penalty_runs, 0) + coalesce(wides_runs, 0) xs from d),
        k as (select delivery_key, count(*) n from raw group by 1), lg as (select *, row_number() over (partition by match_id, innings_number order by over_number, delivery_in_over) k from d where is_legal_ball),
        bo as (select match_id, max(innings_number) k from d group by 1)
        select 'total is bat plus extras' as rule, count(*) filter (tr <> br + er) n_violations, count(*) n_rows from z union all select 'extras add up', count(*) filter (er <> xs), count(*) from z
        union all select 'legal ball has no wide or no-ball', count(*) filter (is_legal_ball <> (coalesce(wides_runs, 0) = 0 and coalesce(noballs_runs, 0) = 0)), count(*) from z
        union all select 'legal number only on legal balls', count(*) filter ((legal_ball_number is null) <> (not coalesce(is_legal_ball, false))), count(*) from z
        union all select 'players named', count(*) filter (batter is null or bowler is null), count(*) from z
        union all select 'key has its parts', count(*) filter (delivery_key <> concat_ws(':', match_id, innings_number, over_number, delivery_in_over)), count(*) from z
        union all select 'runs not negative', count(*) filter (br < 0 or er < 0), count(*) from z union all select 'boundary dependency in range', count(*) filter ((br = 4)::int * 4 + (br = 6)::int * 6 > greatest(br, 0)), count(*) from z
        union all select 'key occurs once', count(*) filter (n > 1), count(*) from k union all select 'match exists', count(*) filter (match_id not in (select match_id from mm)), count(*) from d
        union all select 'legal balls are numbered in order', count(*) filter (legal_ball_number <> k), count(*) from lg
        union all select 'innings within the match', count(*) filter (k > innings_count + coalesce(super_over_innings_count, 0)), count(*) from bo join mm using (match_id)""",
    "a29_completeness": "with l as (select distinct * exclude (loaded_at) from auction_lots) " + " union all ".join(
        f"select '{c}' field, count(*) n_rows, count(*) filter ({c} is null or trim({c}) = '') n_missing, round(100 * count(*) filter ({c} is null or trim({c}) = '') / count(*), 4) missing_pct from l"
        for c in ("name_raw", "nationality", "price_in_usd", "price_in_rs", "base_prices_in_rs", "winning_bid_in_rs", "role_raw", "team_name", "capped_uncapped")
    ),
}
