"""Reader of nested match files: one row for each match and one for each delivery.

Files lie as ``<root>/<competition>/<match id>.json``. The schema is explicit, so nothing is inferred and files are
read once; the rows of a match come from three nested explodes and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.errors import ContractError, SourceError
from crease.sources.tables import durable

PERSONS = "map<string,array<string>>"
DELIVERY = (
    "struct<actual_delivery:string,batter:string,bowler:string,non_striker:string,runs:struct<batter:bigint,extras:bigint,total:bigint>,extras:map<string,bigint>,"
    "wickets:array<struct<kind:string,player_out:string,fielders:array<struct<name:string,substitute:boolean>>>>,review:map<string,string>,replacements:map<string,string>>"
)
SCHEMA = (
    "meta struct<data_version:string,created:string,revision:bigint>, info struct<balls_per_over:bigint,city:string,dates:array<string>,event:string,gender:string,match_type:string,officials:string,"
    f"outcome:struct<winner:string,result:string,bowl_out:string,`by`:map<string,bigint>>,overs:bigint,player_of_match:array<string>,players:{PERSONS},registry:struct<people:map<string,string>>,season:string,"
    "missing:string,supersubs:string,team_type:string,teams:array<string>,toss:struct<winner:string,decision:string>,venue:string>, "
    f"innings array<struct<team:string,super_over:boolean,miscounted_overs:map<string,struct<balls:bigint,umpire:string>>,overs:array<struct<over:bigint,deliveries:array<{DELIVERY}>>>>>, _corrupt string"
)


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    """Raw match records with competition, source_match_id and match_id. A file without ``info`` has info NULL."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/*.json")
    path = F.col("_metadata.file_path")
    competition, stem = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"([^/]+)\.json$", 1)
    return raw.select(competition.alias("competition"), stem.alias("source_match_id"), F.concat_ws(":", competition, stem).alias("match_id"), path.alias("source_path"), "meta", "info", "innings")


def unsupported(raw: DataFrame) -> DataFrame:
    """The files that are no match: damaged, or without ``info``."""
    return raw.where("info is null").select("source_path")


def outcome(o: Column) -> tuple[Column, Column, Column, Column]:
    """(winner, type, margin value, margin unit): a margin first, then the result's own word without a winner, then a
    bowl-out without one, else the winner alone."""
    unit = F.get(F.map_keys(o["by"]), F.lit(0))
    drawn = unit.isNull() & (o["result"].isNotNull() | o["bowl_out"].isNotNull())
    kind = F.when(unit.isNotNull(), "by").when(o["result"].isNotNull(), o["result"]).when(o["bowl_out"].isNotNull(), "bowl_out")
    return F.when(~F.coalesce(drawn, F.lit(False)), o["winner"]), kind, F.try_element_at(o["by"], unit), unit


def match_rows(raw: DataFrame) -> DataFrame:
    """The 37 columns of the matches table; nested members stay as canonical JSON text."""
    i = F.col("info")
    winner, kind, value, unit = outcome(i["outcome"])
    supers = F.filter("innings", lambda x: F.coalesce(x["super_over"], F.lit(False)))
    json = lambda c: canonical(F.to_json(c))
    return raw.where("info is not null").select(
        "match_id", "source_match_id", "competition", "source_path", F.col("meta.data_version").alias("meta_data_version"), F.col("meta.created").alias("meta_created"), F.col("meta.revision").alias("meta_revision"),
        F.get(i["dates"], F.lit(0)).alias("match_date"), F.to_json(i["dates"]).alias("dates_json"), i["season"].alias("season"), i["gender"].alias("gender"), i["match_type"].alias("match_type"), i["team_type"].alias("team_type"),
        i["balls_per_over"].alias("balls_per_over"), i["overs"].alias("scheduled_overs"), i["city"].alias("city"), i["venue"].alias("venue"), F.get(i["teams"], F.lit(0)).alias("team_1"), F.get(i["teams"], F.lit(1)).alias("team_2"),
        F.to_json(i["teams"]).alias("teams_json"), canonical(i["event"]).alias("event_json"), canonical(i["officials"]).alias("officials_json"),
        winner.alias("outcome_winner"), kind.alias("outcome_type"), value.alias("outcome_margin_value"), unit.alias("outcome_margin_unit"), json(i["outcome"]).alias("outcome_json"),
        i["toss"]["winner"].alias("toss_winner"), i["toss"]["decision"].alias("toss_decision"), F.to_json(i["player_of_match"]).alias("player_of_match_json"), json(i["players"]).alias("players_json"),
        json(i["registry"]["people"]).alias("registry_people_json"), canonical(i["missing"]).alias("missing_json"), canonical(i["supersubs"]).alias("supersubs_json"),
        F.to_json(F.transform("innings", lambda x: x.dropFields("overs"))).alias("innings_metadata_json"),
        F.coalesce(F.size("innings"), F.lit(0)).cast("bigint").alias("innings_count"), F.coalesce(F.size(supers), F.lit(0)).cast("bigint").alias("super_over_innings_count"),
    )


def delivery_rows(raw: DataFrame) -> DataFrame:
    """One row for each delivery; ``legal_ball_number`` counts legal balls within the innings, NULL on others."""
    keys = ["match_id", "source_match_id", "competition", "source_path"]
    a = raw.select(*keys, F.col("info.season").alias("season"), F.posexplode("innings").alias("i", "n"))
    b = a.select(*keys, "season", "i", F.col("n.team").alias("innings_team"), F.coalesce("n.super_over", F.lit(False)).alias("is_super_over"), F.explode("n.overs").alias("o"))
    c = b.select(*keys, "season", (F.col("i") + 1).cast("bigint").alias("innings_number"), "innings_team", "is_super_over", F.col("o.over").alias("over_number"), F.posexplode("o.deliveries").alias("p", "d"))
    extra = lambda k: F.coalesce(F.try_element_at(F.col("d.extras"), F.lit(k)), F.lit(0)).cast("bigint")
    d = c.withColumn("delivery_in_over", (F.col("p") + 1).cast("bigint")).withColumns({f"{k}_runs": extra(k) for k in ("byes", "legbyes", "noballs", "penalty", "wides")} | {
        "is_legal_ball": (extra("wides") == 0) & (extra("noballs") == 0)})
    balls = Window.partitionBy("match_id", "innings_number").orderBy("over_number", "delivery_in_over").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("legal_ball_number", F.when(F.col("is_legal_ball"), F.sum(F.col("is_legal_ball").cast("bigint")).over(balls)))
    w = F.col("d.wickets")
    joined = lambda field: F.nullif(F.array_join(F.transform(w, lambda x: x[field]), "|"), F.lit(""))
    ball = F.when(F.col("d.actual_delivery").contains("."), F.split_part("d.actual_delivery", F.lit("."), F.lit(2)).try_cast("bigint"))
    return d.select(
        F.concat_ws(":", "match_id", "innings_number", "over_number", "delivery_in_over").alias("delivery_key"), *keys, "season", "innings_number", "innings_team", "is_super_over", "over_number", "delivery_in_over",
        F.col("d.actual_delivery").alias("actual_delivery"), ball.alias("ball_in_over"), "legal_ball_number", "is_legal_ball", F.col("d.batter").alias("batter"), F.col("d.bowler").alias("bowler"), F.col("d.non_striker").alias("non_striker"),
        F.col("d.runs.batter").alias("batter_runs"), F.col("d.runs.extras").alias("extra_runs"), F.col("d.runs.total").alias("total_runs"), "byes_runs", "legbyes_runs", "noballs_runs", "penalty_runs", "wides_runs",
        F.coalesce(F.size(w), F.lit(0)).cast("bigint").alias("dismissal_count"), joined("kind").alias("dismissal_type"), joined("player_out").alias("dismissal_player_out"),
        F.to_json(F.coalesce(w, F.array().cast(w_type()))).alias("wickets_json"), canonical(F.to_json("d.extras")).alias("extras_json"), canonical(F.to_json("d.review")).alias("review_json"), canonical(F.to_json("d.replacements")).alias("replacements_json"),
    )


def w_type() -> str:
    return "array<struct<kind:string,player_out:string,fielders:array<struct<name:string,substitute:boolean>>>>"


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks."""
    return F.to_json(F.try_parse_json(text))


def normalise(spark: SparkSession, root: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Reads all match files below ``root``, checks them, and writes ``out``/matches.parquet and deliveries.parquet.

    Raises SourceError where a file is no match, ContractError where a key occurs twice or a delivery has no match, and
    where the output exists. Rows are written in the order of competition, file and ball, so two runs write the same.
    """
    raw = durable(read_matches(spark, root))
    bad = unsupported(raw).orderBy("source_path").limit(5).collect()
    if bad:
        raise SourceError("unsupported match structure: " + ", ".join(r[0] for r in bad))
    m, d = match_rows(raw), durable(delivery_rows(raw))
    for rows, key in ((m, "match_id"), (d, "delivery_key")):
        twice = rows.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()
        if twice:
            raise ContractError(f"duplicate {key}: " + ", ".join(str(r[0]) for r in twice))
    paths = f"{out}/matches.parquet", f"{out}/deliveries.parquet"
    m.repartitionByRange("competition", "source_match_id").sortWithinPartitions("competition", "source_match_id").write.mode("errorifexists").parquet(paths[0])
    order = ["competition", "source_match_id", "innings_number", "over_number", "delivery_in_over"]
    d.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(paths[1])
    return spark.read.parquet(paths[0]), spark.read.parquet(paths[1])
