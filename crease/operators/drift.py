"""Schemas that drift between files: one consistent table, and every change from file to file.

Records are read as path-value rows with the raw JSON type of each value. Statistics of (file, path, type) give each
file's schema; neighbouring files of a feed are compared on those statistics alone, so the comparison costs as many
rows as there are fields in files, not records. A field that disappears and one that appears are one renamed field if
their values have the same profile: the signatures of a path's values (magnitudes of numbers, starts of words, flags)
are counted over all files, and two profiles are compared by what they share. Words that the two names share count
too; no list of names is asked. The typed table is projected from the same path-value rows, and cells that do not
convert are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.scalars import literal_map
from crease.operators.units import parse_amount
from crease.sources.tables import durable, table

FILE = ["feed_id", "season"]

# Names that the columns of the consistent table are known by (lower case, blanks and marks as one blank).
ATTRIBUTE_HEADERS = {
    "player": ("name", "cricketer", "player name", "player", "full name"),
    "team": ("teamname", "team name", "team", "franchise", "buyer", "sold to", "bought by", "squad"),
    "price": ("price in", "price in rs", "price in usd", "winning bid in rs", "winning bid", "final bid", "sold price", "hammer price", "price"),
    "base_price": ("base price", "baseprices in rs", "base prices in rs", "reserve price", "floor", "base"),
    "role": ("role", "playing role", "player type", "discipline", "speciality", "specialty", "skill"),
    "nationality": ("nationality", "origin", "indian overseas", "country"),
    "capped": ("capped uncapped", "is capped", "capped status", "caps"),
    "age": ("age",), "hand": ("batting hand",), "remarks": ("remarks",), "lot": ("lot no",), "set": ("set no",),
    "rtm": ("rtm used",), "league_matches": ("league matches",), "agency": ("agency",), "session": ("session",),
}
#: Two fields are alike from this likeness on; weights of shared words of the names, and of flags and small numbers (below
#: 10^(SMALL/3)) in a profile.
ALIKE, NAME_WEIGHT, COMMON_WEIGHT, SMALL = 0.2, 0.3, 0.3, 12
NUMBER, YES, NO = r"^(\d+(?:\.\d+)?)[a-z]{0,3}$", ("y", "yes", "true"), ("n", "no", "false")
HEADER_ATTRIBUTE = {h: a for a, headers in ATTRIBUTE_HEADERS.items() for h in headers}


def json_type(v: Column) -> Column:
    """string, number, boolean, array, object or null of a variant."""
    t = F.upper(F.schema_of_variant(v))
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null").when(t.startswith("STRING"), "string").when(t.startswith("BOOLEAN"), "boolean")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")
    )


def path_values(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """One row for each member of each record: keys, path (trimmed name), json_type, value text.

    A record that is no JSON object, and NULL, give no row. A member that occurs twice in one record under names
    which differ in blanks only keeps both rows.
    """
    parsed = rows.select(*keys, F.try_parse_json(json).alias("v")).where(F.col("v").isNotNull() & (F.schema_of_variant("v").startswith("OBJECT")))
    members = parsed.withColumnRenamed("v", "record").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("record").outer()))
    v = F.col("value")
    return members.select(*keys, F.trim("key").alias("path"), json_type(v).alias("json_type"), F.when(~F.is_variant_null(v), v.cast("string")).alias("value"))


def path_statistics(members: DataFrame) -> DataFrame:
    """For each file, path and type: the number of values (nulls are the type 'null')."""
    return members.groupBy(*FILE, "path", "json_type").agg(F.count("*").alias("n_values"))


def header_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def signatures(json_type: Column, value: Column) -> Column:
    """What a value looks like: n:k for a number of magnitude 10^(k/3), b:y or b:n for a flag, else t: and the first
    three letters of each word. The parts of lists and objects count, the names of parts do not."""
    parts = (
        F.when(json_type == "array", F.from_json(value, "array<string>"))
        .when(json_type == "object", F.map_values(F.from_json(value, "map<string,string>"))).otherwise(F.array(value))
    )

    def of(part: Column) -> Column:
        t = F.lower(F.trim(F.regexp_replace(part, r"(?<=\d),(?=\d)", "")))
        number = F.regexp_extract(t, NUMBER, 1).try_cast("double")
        magnitude = F.when(number > 0, F.floor(F.round(F.log10(number) * 3, 9))).otherwise(0).cast("string")
        words = F.transform(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)), lambda w: F.concat(F.lit("t:"), F.substring(w, 1, 3)))
        return (
            F.when(t.rlike(NUMBER), F.array(F.concat(F.lit("n:"), magnitude))).when(t.isin(*YES), F.array(F.lit("b:y")))
            .when(t.isin(*NO), F.array(F.lit("b:n"))).otherwise(words)
        )

    return F.flatten(F.transform(F.array_compact(parts), of))


def profiles(members: DataFrame) -> DataFrame:
    """(path, signature, p): the share of each signature among those of a path over all files; flags and small numbers are
    discounted, as they tell little of what they are about."""
    each = members.where("value is not null").select("path", F.explode(signatures(F.col("json_type"), F.col("value"))).alias("signature"))
    counted = each.groupBy("path", "signature").agg(F.count("*").alias("n"))
    total = counted.groupBy("path").agg(F.sum("n").alias("total"))
    small = F.substring("signature", 3, 9).try_cast("int") < SMALL
    common = F.col("signature").startswith("b:") | (F.col("signature").startswith("n:") & F.coalesce(small, F.lit(False)))
    weight = F.when(common, COMMON_WEIGHT).otherwise(1.0)
    return counted.join(total, "path").select("path", "signature", (weight * F.col("n") / F.col("total")).alias("p"))


def name_words(c: Column) -> Column:
    """The distinct words of a field's name, also where they are joined (TeamName)."""
    spread = F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))
    return F.array_distinct(F.regexp_extract_all(spread, F.lit("[a-z0-9]+"), F.lit(0)))


def likeness(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """pairs (from, to) + ``likeness``: what the profiles share, and a bonus for shared words of the names."""
    x = profile.select(F.col("path").alias("from"), "signature", F.col("p").alias("p"))
    y = profile.select(F.col("path").alias("to"), "signature", F.col("p").alias("q"))
    distinct = pairs.select("from", "to").distinct()
    shared = distinct.join(x, "from").join(y, ["to", "signature"]).groupBy("from", "to").agg(F.sum(F.least("p", "q")).alias("shared"))
    a, b = name_words(F.col("from")), name_words(F.col("to"))
    either = F.size(F.array_union(a, b))
    words = F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)
    scored = distinct.join(shared, ["from", "to"], "left")
    scored = scored.select("from", "to", F.round(F.coalesce("shared", F.lit(0.0)) + NAME_WEIGHT * words, 9).alias("likeness"))
    return pairs.join(scored, ["from", "to"])


def attributes(members: DataFrame) -> DataFrame:
    """path -> attribute for every path: by the known names of the table's columns, an unknown name by the known path
    whose profile is most like its own."""
    known = F.try_element_at(literal_map(HEADER_ATTRIBUTE), header_key(F.col("path")))
    paths = durable(members.select("path").distinct().withColumn("known", known))
    new, old = paths.where("known is null"), paths.where("known is not null")
    profile = profiles(members)
    near = profile.join(new.select("path"), "path").select(F.col("path").alias("from"), "signature")
    meet = near.join(profile.join(old.select("path"), "path").select(F.col("path").alias("to"), "signature"), "signature").select("from", "to").distinct()
    best = likeness(meet, profile).where(F.col("likeness") >= ALIKE).join(old.select(F.col("path").alias("to"), "known"), "to")
    best = best.groupBy("from").agg(F.max_by("known", F.struct("likeness", "to")).alias("guess"))
    return paths.join(best, paths.path == F.col("from"), "left").select("path", F.coalesce("known", "guess").alias("attribute"))


def changes(members: DataFrame) -> DataFrame:
    """Every change of a file against the feed's nearest earlier season that has a file.

    A field that is gone and one that has come are a renamed field when each is the other's most like one (ties by
    name) and the likeness is at least ALIKE.
    """
    stats = path_statistics(members)
    types = F.array_sort(F.collect_set(F.when(F.col("json_type") != "null", F.col("json_type"))))
    fields = durable(stats.groupBy(*FILE, "path").agg(types.alias("types")))
    files = fields.select(*FILE).distinct()
    files = files.withColumn("before", F.lag("season").over(Window.partitionBy("feed_id").orderBy("season"))).where("before is not null")
    side = lambda rows, x: rows.select(*FILE, F.col("path").alias("name"), F.col("path").alias(x), F.col("types").alias(f"{x}_types"))
    new = side(files.join(fields, FILE), "to")
    old = side(files.join(fields.withColumnRenamed("season", "before"), ["feed_id", "before"]), "from")
    both = durable(old.join(new, [*FILE, "name"], "full").drop("name"))
    gone, come = both.where("`to` is null").select(*FILE, "from", "from_types"), both.where("`from` is null").select(*FILE, "to", "to_types")
    scored = likeness(gone.select(*FILE, "from").join(come.select(*FILE, "to"), FILE), profiles(members)).where(F.col("likeness") >= ALIKE)
    best = lambda x, y: F.row_number().over(Window.partitionBy(*FILE, x).orderBy(F.desc("likeness"), y))
    paired = scored.withColumns({"a": best("from", "to"), "b": best("to", "from")}).where("a = 1 and b = 1").select(*FILE, "from", "to")
    # A pair's row on the side that is gone holds both; on the side that has come nothing is left of it.
    renamed = gone.join(paired, [*FILE, "from"], "left").join(come, [*FILE, "to"], "left")
    added = come.join(paired.select(*FILE, "to"), [*FILE, "to"], "left_anti").withColumns({"from": F.lit(None).cast("string"), "from_types": F.lit(None).cast("array<string>")})
    columns = [*FILE, "from", "to", "from_types", "to_types"]
    pairs = renamed.select(*columns).unionByName(added.select(*columns)).unionByName(both.where("`from` = `to`").select(*columns))
    one = F.col("from").isNotNull() & F.col("to").isNotNull()
    kind = F.array_compact(
        F.array(
            F.when(F.col("from").isNull(), F.lit("added")),
            F.when(F.col("to").isNull(), F.lit("removed")),
            F.when(one & (F.col("from") != F.col("to")), F.lit("renamed")),
            F.when(one & (F.col("from_types") != F.col("to_types")), F.lit("retyped")),
        )
    )
    return pairs.select(
        *FILE, F.explode(kind).alias("change_kind"), F.coalesce("from", F.lit("")).alias("field_from"), F.coalesce("to", F.lit("")).alias("field_to")
    )


def typed_table(members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the consistent table, the cells whose value does not convert to the column's type).

    A list gives all its elements, joined by ", " (in a column of numbers or flags only a list of one converts). Every
    part of an object is kept in the map ``parts`` by "attribute.part", and currencies and short team names in columns.
    ``others`` maps a path to its values: members without an attribute, and values of an attribute that the record holds
    besides the one in its column.
    """
    cells = members.where("json_type <> 'null'").join(attributes(members), "path")
    part = lambda name: F.get_json_object("value", f"$.{name}")
    elements = F.when(F.col("json_type") == "array", F.from_json("value", "array<string>"))
    members_of = F.when(F.col("json_type") == "object", F.from_json("value", "map<string,string>"))
    text = F.when(F.col("json_type") == "array", F.nullif(F.array_join(elements, ", "), F.lit(""))).when(
        F.col("json_type") == "object", F.coalesce(F.nullif(F.concat_ws(" ", part("first"), part("last")), F.lit("")), part("name"), part("amount"), part("code"))
    ).otherwise(F.col("value"))
    cells = durable(cells.select(*keys, "path", "attribute", "json_type", "value", F.trim(text).alias("text"), members_of.alias("parts"), F.coalesce(F.size(elements) > 1, F.lit(False)).alias("several")))
    numbers, wholes, flags = ("price", "base_price"), ("age", "lot", "set", "league_matches"), ("capped", "rtm")
    one = F.when(~F.col("several"), F.col("text"))
    amount = parse_amount(one)
    number = amount["value"] * F.coalesce(amount["scale"], F.lit(1.0))
    whole = F.regexp_extract(one, r"(\d+)", 1).try_cast("bigint")
    yes, no = F.lower(one).isin("true", "y", "yes", "capped"), F.lower(one).isin("false", "n", "no", "uncapped")
    flag = F.when(yes, True).when(no, False)
    failed = (
        (F.col("attribute").isin(*numbers) & number.isNull()) | (F.col("attribute").isin(*wholes) & whole.isNull())
        | (F.col("attribute").isin(*flags) & flag.isNull()) | F.col("text").isNull()
    )
    texts = [a for a in ATTRIBUTE_HEADERS if a not in (*numbers, *wholes, *flags)]
    cells = cells.withColumns({"number": number, "whole": whole, "flag": flag, "failed": F.col("attribute").isNotNull() & failed})
    of = lambda names, c: F.when(F.col("attribute").isin(*names), F.col(c))
    order = [F.asc_nulls_last(x) for x in (of(numbers, "number"), of(wholes, "whole"), of(flags, "flag"))] + [F.asc_nulls_last("text"), F.desc(F.col("json_type") == "object"), "path", "value"]
    cells = cells.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "attribute").orderBy(*order)))
    first = F.col("k") == 1
    pick = lambda a, c: F.min(F.when((F.col("attribute") == a) & first, F.col(c))).alias(a)
    piece = lambda a, p: F.min(F.when((F.col("attribute") == a) & first, F.try_element_at("parts", F.lit(p)))).alias(f"{a}_{p}")
    money = F.when(F.lower("path").rlike(r"\$|usd|dollar"), "USD").when(F.lower("path").rlike(r"\b(rs|inr|rupees?)\b"), "INR")
    named = lambda a: F.min(F.when((F.col("attribute") == a) & first, money))
    spare = F.when(F.col("attribute").isNull() | ~first, F.struct("path", "value"))
    pieces = F.when(F.col("attribute").isNotNull() & first, F.transform(F.map_entries("parts"), lambda e: F.struct(F.concat_ws(".", "attribute", e["key"]).alias("key"), e["value"].alias("value"))))
    spares = F.array_sort(F.collect_list(spare))
    paths = F.array_distinct(F.transform(spares, lambda x: x["path"]))
    others = F.map_from_arrays(paths, F.transform(paths, lambda p: F.transform(F.filter(spares, lambda x: x["path"] == p), lambda x: x["value"]))).alias("others")
    out = cells.groupBy(*keys).agg(
        *[pick(a, "text") for a in texts], *[pick(a, "number") for a in numbers], *[pick(a, "whole") for a in wholes], *[pick(a, "flag") for a in flags],
        *[F.coalesce(piece(a, "currency"), named(a)).alias(f"{a}_currency") for a in numbers], piece("team", "short"), F.map_from_entries(F.flatten(F.collect_list(pieces))).alias("parts"), others,
    )
    return out, cells.where("failed").select(*keys, "path", "attribute", "json_type", "value")


def auction_members(spark: SparkSession, base: str, keys: tuple[str, ...] = ("feed_id", "season")) -> DataFrame:
    rows = table(spark, base, "auction_file_rows").select("feed_id", "season", "row_no", "record_json").distinct()
    return durable(path_values(rows, list(keys), "record_json"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return changes(auction_members(spark, base)).distinct()


def p3_paths(spark: SparkSession, base: str) -> DataFrame:
    return path_statistics(auction_members(spark, base))


def p3_table(spark: SparkSession, base: str) -> DataFrame:
    keys = ("feed_id", "season", "row_no")
    return typed_table(auction_members(spark, base, keys), list(keys))[0]


def p3_cast_failures(spark: SparkSession, base: str) -> DataFrame:
    keys = ("feed_id", "season", "row_no")
    return typed_table(auction_members(spark, base, keys), list(keys))[1]


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_table": p3_table, "p3_cast_failures": p3_cast_failures}

MEMBERS_SQL = """r as (select distinct feed_id, season, row_no, record_json from auction_file_rows),
 me as (select r.feed_id, r.season, trim(e.key) path, e.value v, case e.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean'
   when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then 'null' else 'number' end json_type from r, json_each(r.record_json) e)"""
PROFILE_SQL = """
 vp as (select path, json_extract_string(v, '$') t from me where json_type not in ('null', 'array', 'object')
   union all select me.path, json_extract_string(x.value, '$') from me, json_each(me.v) x where json_type in ('array', 'object')),
 vt as (select path, lower(trim(regexp_replace(t, '([0-9]),([0-9])', '\\1\\2', 'g'))) t from vp where t is not null),
 nu as (select path, t, try_cast(nullif(regexp_extract(t, '^([0-9]+(?:[.][0-9]+)?)[a-z]{0,3}$', 1), '') as double) x from vt),
 sg as (select path, unnest(case when x is not null then ['n:' || case when x > 0 then floor(round(log10(x) * 3, 9))::bigint::varchar else '0' end]
   when t in ('y', 'yes', 'true') then ['b:y'] when t in ('n', 'no', 'false') then ['b:n']
   else list_transform(regexp_extract_all(t, '[a-z]+'), lambda w: 't:' || w[1:3]) end) signature from nu),
 pc as (select path, signature, count(*) n from sg group by all),
 pr as (select path, signature, (case when signature like 'b:%' or (signature like 'n:%' and try_cast(signature[3:] as integer) < 12) then 0.3::double else 1.0::double end) * n / sum(n) over (partition by path) p from pc)"""
WORDS_SQL = "list_distinct(regexp_extract_all(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'))".format
SQL = {
    "p3_paths": f"with {MEMBERS_SQL} select feed_id, season, path, json_type, count(*) n_values from me group by all",
    "p3_found": f"""with {MEMBERS_SQL}, {PROFILE_SQL},
        fi as (select feed_id, season, path, coalesce(list_sort(list_distinct(list(json_type) filter (json_type <> 'null'))), []) types from me group by all),
        se as (select feed_id, season, lag(season) over (partition by feed_id order by season) b from (select distinct feed_id, season from fi)),
        nw as (select se.feed_id, se.season, path, types from se join fi using (feed_id, season) where b is not null),
        ol as (select se.feed_id, se.season, path, types from se join fi on fi.feed_id = se.feed_id and fi.season = se.b),
        go as (select * from ol where (feed_id, season, path) not in (select (feed_id, season, path) from nw)),
        co as (select * from nw where (feed_id, season, path) not in (select (feed_id, season, path) from ol)),
        cp as (select g.feed_id, g.season, g.path f, c.path t from go g join co c using (feed_id, season)),
        sh as (select d.f, d.t, sum(least(x.p, y.p)) s from (select distinct f, t from cp) d join pr x on x.path = d.f join pr y on y.path = d.t and y.signature = x.signature group by all),
        sc as (select cp.*, round(coalesce(s, 0) + 0.3::double * len(list_intersect({WORDS_SQL("cp.f")}, {WORDS_SQL("cp.t")}))
            / greatest(len(list_distinct(list_concat({WORDS_SQL("cp.f")}, {WORDS_SQL("cp.t")}))), 1), 9) k from cp left join sh using (f, t)),
        be as (select *, row_number() over (partition by feed_id, season, f order by k desc, t) a, row_number() over (partition by feed_id, season, t order by k desc, f) b from sc where k >= 0.2),
        pa as (select feed_id, season, f, t from be where a = 1 and b = 1),
        al as (select g.feed_id, g.season, g.path f, pa.t, g.types ft, c.types tt from go g left join pa on pa.feed_id = g.feed_id and pa.season = g.season and pa.f = g.path
                left join co c on c.feed_id = g.feed_id and c.season = g.season and c.path = pa.t
            union all select feed_id, season, null, path, null, types from co where (feed_id, season, path) not in (select (feed_id, season, t) from pa)
            union all select feed_id, season, o.path, n.path, o.types, n.types from ol o join nw n using (feed_id, season, path))
        select feed_id, season, 'added' change_kind, '' field_from, t field_to from al where f is null union select feed_id, season, 'removed', f, '' from al where t is null
        union select feed_id, season, 'renamed', f, t from al where f <> t union select feed_id, season, 'retyped', f, t from al where f is not null and t is not null and ft <> tt""",
}
