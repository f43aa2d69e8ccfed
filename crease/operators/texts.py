"""Queries over the scalar functions on texts, dates, roles and money, and the guarded lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.lookups import with_lookup, with_required_lookup
from crease.functions.scalars import ROLE_NAMES, literal_map, name_key, role_name, season_years, single_spaced
from crease.operators.auction import SALES_SQL, sales
from crease.sources.tables import table


def token_set(c: Column) -> Column:
    """The distinct runs of letters of a text, in their order, case kept."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0)))


def plain_tokens(c: Column) -> Column:
    """The words of a text by blanks, after punctuation is removed, in lower case."""
    return F.filter(F.split(name_key(c), " "), lambda x: x != "")


def slug(c: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def season_name(c: Column) -> Column:
    """2023-2024 for a season over two years, the year for one of a single year, UNKNOWN for none, else the text as it is."""
    start, end = season_years(c)
    years = F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.when(c.isNull(), "UNKNOWN").otherwise(F.coalesce(F.when(start.isNotNull(), years), F.trim(c)))


def year_in(c: Column) -> Column:
    """The first year from 2000 to 2099 that stands alone in a text; NULL without one."""
    return F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")


def iso_date(c: Column) -> Column:
    """The date of an ISO text, NULL where it is none."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def role_or_typed(c: Column) -> Column:
    """The canonical role, or the role as typed (trimmed) where it is not known; NULL stays NULL."""
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(literal_map(ROLE_NAMES), F.lower(F.trim(c))), F.trim(c)))


def name_tokens_query(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "people_register").select("player_id", "full_name").distinct()
    n = F.col("full_name")
    return p.select("player_id", F.array_join(token_set(n), " ").alias("token_set"), F.array_join(plain_tokens(n), " ").alias("tokens"), F.size(token_set(n)).alias("n_tokens"))


def slugs(spark: SparkSession, base: str) -> DataFrame:
    """A competition's season as an identifier."""
    m = table(spark, base, "matches").select("competition", "season").distinct().where("competition is not null")
    return m.select("competition", "season", slug(F.concat_ws(" ", "competition", F.coalesce("season", F.lit("")))).alias("competition_id"))


def seasons(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "matches").select("season").distinct()
    start, end = season_years(F.col("season"))
    return m.select("season", season_name(F.col("season")).alias("season_name"), start.alias("start_year"), end.alias("end_year"), year_in(F.col("season")).alias("year_in_text"))


def dates(spark: SparkSession, base: str) -> DataFrame:
    """Match dates as dates, those that are none counted, by season."""
    m = table(spark, base, "matches").select("match_id", "season", "match_date").distinct()
    d = iso_date(F.col("match_date"))
    return m.groupBy("season").agg(F.count("*").alias("n_matches"), F.count_if(d.isNull()).alias("n_undated"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def roles(spark: SparkSession, base: str) -> DataFrame:
    """Lots by role, both ways: unknown roles as Unknown, and as typed."""
    lots = table(spark, base, "auction_lots").select("lot_id", "role_raw").distinct()
    return lots.groupBy(role_name(F.col("role_raw")).alias("role"), role_or_typed(F.col("role_raw")).alias("role_typed")).agg(F.count("*").alias("n_lots"))


def role_parts(spark: SparkSession, base: str) -> DataFrame:
    """Roles that name several, one row for each part."""
    lots = table(spark, base, "auction_lots").select("lot_id", "role_raw").distinct().where("trim(role_raw) <> ''")
    part = F.explode(F.split(F.regexp_replace(single_spaced(F.col("role_raw")), " ?[/,|&] ?", "|"), r"\|"))
    return lots.select("lot_id", part.alias("part")).where("part <> ''").groupBy(F.lower("part").alias("part")).agg(F.count("*").alias("n_lots"))


def crores(spark: SparkSession, base: str) -> DataFrame:
    """Rupee sales in crore, clipped to 0.1 to 30."""
    s = sales(spark, base).where("currency = 'INR' and price is not null")
    crore = F.col("price") / 1e7
    return s.select("lot_id", F.round(crore, 6).alias("crore"), F.round(F.greatest(F.lit(0.1), F.least(crore, F.lit(30.0))), 6).alias("clipped"))


def region_of_nation(spark: SparkSession, base: str) -> DataFrame:
    """Nations with their region, which each must have: a missing one raises."""
    regions = table(spark, base, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return with_required_lookup(table(spark, base, "nation").select("n_nationkey", "n_name", "n_regionkey"), regions, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


def venue_of_mapping(spark: SparkSession, base: str) -> DataFrame:
    """Known spellings with their ground, by composite key and guarded: as many rows as spellings."""
    grounds = table(spark, base, "dim_venues").select("venue_id", "canonical_venue", "city")
    return with_lookup(table(spark, base, "venue_mapping").select("raw_venue", "venue_id").distinct(), grounds, ["venue_id"])


def repeated_lots(spark: SparkSession, base: str) -> DataFrame:
    """Every lot whose name and year occur in more than one lot (all of them, not only the later ones)."""
    keys = ["name_raw", "auction_year"]
    lots = table(spark, base, "auction_lots").select("lot_id", *keys).distinct()
    many = lots.groupBy(*keys).agg(F.count("*").alias("n_lots")).where("n_lots > 1").select(F.struct(*keys).alias("k2"), "n_lots")
    rows = lots.withColumn("k", F.struct(*keys))
    return rows.join(many, F.col("k").eqNullSafe(F.col("k2"))).select("lot_id", *keys, "n_lots")


QUERIES = {
    "t04_tokens": name_tokens_query, "t10_slugs": slugs, "d01_seasons": seasons, "d03_dates": dates, "t13_roles": roles, "t15_role_parts": role_parts, "n03_crores": crores,
    "j04_required": region_of_nation, "j01_guarded": venue_of_mapping, "pred18_repeated": repeated_lots,
}

ROLE_SQL = "case " + " ".join(f"when lower(trim(role_raw)) = '{k}' then '{v}'" for k, v in ROLE_NAMES.items()) + " else {0} end"
YEAR_SQL = "try_cast(nullif(regexp_extract({0}, '((?:19|20)[0-9][0-9])', 1), '') as integer)".format
END_SQL = """case when regexp_matches(season, '^[0-9][0-9][0-9][0-9][/-][0-9][0-9]$') then try_cast(season[1:2] || season[6:7] as integer)
   when regexp_matches(season, '^[0-9][0-9][0-9][0-9][/-][0-9][0-9][0-9][0-9]$') then try_cast(season[6:9] as integer) else """ + YEAR_SQL("season") + " end"
SQL = {
    "t04_tokens": """with t as (select distinct player_id, full_name, regexp_extract_all(full_name, '[a-zA-Z]+') t from people_register), u as (select *, list_filter(t, lambda x, i: list_position(t, x) = i) d from t)
        select player_id, array_to_string(d, ' ') token_set, trim(regexp_replace(regexp_replace(lower(trim(full_name)), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) tokens, len(d)::integer n_tokens from u""",
    "t10_slugs": "select distinct competition, season, trim(regexp_replace(lower(competition || ' ' || coalesce(season, '')), '[^a-z0-9]+', '_', 'g'), '_') competition_id from matches where competition is not null",
    "d01_seasons": f"""with s as (select distinct season from matches), y as (select season, {YEAR_SQL("season")} a, {END_SQL} b from s)
        select season, case when season is null then 'UNKNOWN' when a is null then trim(season) when a = b then a::varchar else concat_ws('-', a, b) end season_name, a start_year, b end_year,
        try_cast(nullif(regexp_extract(season, '\\b(20[0-9][0-9])\\b', 1), '') as integer) year_in_text from y""",
    "d03_dates": """with m as (select distinct match_id, season, match_date from matches), d as (select season, strftime(try_strptime(trim(match_date), '%Y-%m-%d'), '%Y-%m-%d') d from m)
        select season, count(*) n_matches, count(*) filter (d is null) n_undated, min(d) first_date, max(d) last_date from d group by 1""",
    "t13_roles": f"""with l as (select distinct lot_id, role_raw from auction_lots) select {ROLE_SQL.format("'Unknown'")} as role, case when role_raw is not null then {ROLE_SQL.format("trim(role_raw, ' ')")} end role_typed, count(*) n_lots from l group by 1, 2""",
    "t15_role_parts": """with l as (select distinct lot_id, role_raw from auction_lots where trim(role_raw, ' ') <> ''), p as (select lot_id, unnest(string_split(regexp_replace(trim(regexp_replace(role_raw, '\\s+', ' ', 'g')), ' ?[/,|&] ?', '|', 'g'), '|')) part from l)
        select lower(part) part, count(*) n_lots from p where part <> '' group by 1""",
    "j04_required": "select n_nationkey, n_name, r_name from nation join region on r_regionkey = n_regionkey",
    "j01_guarded": "select venue_id, raw_venue, canonical_venue, city from (select distinct raw_venue, venue_id from venue_mapping) left join (select distinct * from dim_venues) using (venue_id)",
    "pred18_repeated": """with l as (select distinct lot_id, name_raw, auction_year from auction_lots), n as (select *, count(*) over (partition by name_raw, auction_year) n_lots from l) select * from n where n_lots > 1""",
}
SQL["n03_crores"] = f"with {SALES_SQL} select lot_id, round(price / 1e7, 6) crore, round(greatest(0.1, least(price / 1e7, 30)), 6) clipped from sa where currency = 'INR' and price is not null"
