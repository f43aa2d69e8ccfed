"""Deeply nested records as flat child tables that keep the link to their parent and the place in it.

Each JSON text is decoded once to text-valued lists and maps (so numbers stay as written), whatever shape it has:
a list, a single object in place of a list, a wrapper object, or the whole text once more encoded as a JSON string.
Nested transforms attach the positions, flatten joins the inner arrays and one inline emits the rows of a parent
table, so a parent is scanned once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.sources.tables import table

CHILD = "array<struct<child_kind:string,pos_1:bigint,pos_2:bigint,label:string,detail:string>>"


def complete(text: Column) -> Column:
    """The text of a complete JSON document, decoded once if it is a JSON string; else NULL."""
    quoted = F.ltrim(text).startswith('"')
    decoded = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    whole = F.trim(F.regexp_replace(F.when(quoted, decoded).otherwise(text), r"^\s+|\s+$", ""))
    valid = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(valid(whole) & (~quoted | valid(text)), whole)


def members(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def items(text: Column) -> Column:
    """A list's elements as texts; a single object or value is a list of one; NULL gives none."""
    one = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(F.length(text) > 0, F.array(text))
    return F.filter(F.coalesce(one, F.array().cast("array<string>")), lambda x: x.isNotNull())


def objects(text: Column) -> Column:
    """The elements that are objects, as maps; others keep their place as NULL."""
    return F.transform(items(text), lambda x: F.when(x.startswith("{"), members(x)))


def child(kind: str, pos_1: Column, pos_2: Column, label: Column, detail: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(F.lit(kind).alias("child_kind"), pos_1.cast("bigint").alias("pos_1"), pos_2.cast("bigint").alias("pos_2"), text(label).alias("label"), text(detail).alias("detail"))


def has(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def flag(m: Column, key: str, word: str) -> Column:
    return F.when(F.lower(has(m, key)) == "true", F.lit(word))


def wickets(rows: Column) -> list[Column]:
    """Child lists of the wickets of a ball; ``rows``: its objects."""
    own = F.transform(rows, lambda w, i: child("wicket", i + 1, F.lit(0), has(w, "player_out"), has(w, "kind")))

    def fielders(w: Column, i: Column) -> Column:
        def one(f: Column, j: Column) -> Column:
            m = F.when(f.startswith("{"), members(f))
            return child("fielder", i + 1, j + 1, F.when(m.isNotNull(), has(m, "name")).otherwise(f), flag(m, "substitute", "substitute"))

        return F.transform(items(has(w, "fielders")), one)

    return [own, F.flatten(F.transform(rows, fielders))]


def replacements(m: Column) -> list[Column]:
    """Child lists of the replacements on a ball; ``m``: the members of its object."""

    def of(kind: str) -> Column:
        return F.transform(objects(has(m, kind)), lambda r, i: child(f"replacement_{kind}", i + 1, F.lit(0), has(r, "in"), has(r, "out")))

    return [of("match"), of("role")]


def people(whole: Column, top: Column) -> list[Column]:
    """Child list of a match's registry; ``whole``: its complete text, ``top``: its members if it is an object."""
    inner = F.coalesce(F.when(has(top, "people").startswith("{"), members(has(top, "people"))), top)
    of_map = F.transform(F.map_entries(inner), lambda e: child("person", F.lit(0), F.lit(0), e["key"], e["value"]))
    listed = F.when(whole.startswith("["), whole).when(has(top, "people").startswith("["), has(top, "people"))
    of_list = F.transform(F.filter(objects(listed), lambda p: p.isNotNull()), lambda p: child("person", F.lit(0), F.lit(0), has(p, "name"), has(p, "id")))
    return [F.when(listed.isNotNull(), of_list).otherwise(F.coalesce(of_map, F.array().cast(CHILD)))]


def innings(rows: Column) -> list[Column]:
    """Child lists of a match's innings; ``rows``: their objects."""
    own = F.transform(rows, lambda x, i: child("innings", i + 1, F.lit(0), has(x, "team"), flag(x, "super_over", "super_over")))

    def powerplays(x: Column, i: Column) -> Column:
        def one(p: Column, j: Column) -> Column:
            return child("powerplay", i + 1, j + 1, has(p, "type"), F.concat_ws("-", has(p, "from"), has(p, "to")))

        return F.transform(objects(has(x, "powerplays")), one)

    def miscounted(x: Column, i: Column) -> Column:
        def one(e: Column) -> Column:
            over = members(e["value"])
            return child("miscounted_over", i + 1, e["key"].try_cast("bigint"), has(over, "umpire"), has(over, "balls"))

        entries = F.map_entries(members(has(x, "miscounted_overs")))
        return F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), one)

    def absent(x: Column, i: Column) -> Column:
        def name(a: Column) -> Column:
            return F.when(a.startswith("{"), has(members(a), "name")).otherwise(a)

        return F.transform(items(has(x, "absent_hurt")), lambda a, j: child("absent_hurt", i + 1, j + 1, name(a), F.lit("")))

    return [own, *[F.flatten(F.transform(rows, f)) for f in (powerplays, miscounted, absent)]]


def children(parents: DataFrame, key: str, lists: list[Column]) -> DataFrame:
    """All child rows of a parent table by one inline. NULL, blank and incomplete texts give none."""
    empty = F.array().cast(CHILD)
    every = F.concat(*[F.coalesce(x.cast(CHILD), empty) for x in lists])
    rows = parents.select(F.col(key).alias("parent_key"), F.inline(every))
    return rows.select("child_kind", "parent_key", "pos_1", "pos_2", "label", "detail")


def delivery_children(deliveries: DataFrame) -> DataFrame:
    """Each text becomes a column of its objects once; all lists are made from these columns."""
    rows = deliveries.where("wickets_json <> '[]' or replacements_json is not null")
    rows = rows.select("delivery_key", complete(F.col("wickets_json")).alias("w"), complete(F.col("replacements_json")).alias("r"))
    rows = rows.select("delivery_key", objects(F.col("w")).alias("w"), members(F.col("r")).alias("r"))
    return children(rows, "delivery_key", [*wickets(F.col("w")), *replacements(F.col("r"))])


def registry_people(matches: DataFrame) -> DataFrame:
    """Child rows of the registries alone."""
    rows = matches.select("match_id", complete(F.col("registry_people_json")).alias("p"))
    rows = rows.select("match_id", "p", F.when(F.col("p").startswith("{"), members(F.col("p"))).alias("top"))
    return children(rows, "match_id", people(F.col("p"), F.col("top")))


def match_children(matches: DataFrame) -> DataFrame:
    rows = matches.select("match_id", complete(F.col("registry_people_json")).alias("p"), complete(F.col("innings_metadata_json")).alias("i"))
    wrapped = F.when(F.col("i").startswith("{"), has(members(F.col("i")), "innings"))
    rows = rows.select("match_id", "p", F.when(F.col("p").startswith("{"), members(F.col("p"))).alias("top"), F.coalesce(wrapped, F.col("i")).alias("i"))
    rows = rows.select("match_id", "p", "top", objects(F.col("i")).alias("i"))
    return children(rows, "match_id", [*people(F.col("p"), F.col("top")), *innings(F.col("i"))])


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    rows = delivery_children(table(spark, base, "deliveries")).unionByName(match_children(table(spark, base, "matches")))
    return rows.where("parent_key is not null and pos_2 is not null").distinct()


QUERIES = {"p6_found": p6_found}

# A complete text, decoded where it is a JSON string; members and elements by JSON functions.
WHOLE = "case json_type(try_cast({0} as json)) when 'VARCHAR' then try_cast(json_extract_string(try_cast({0} as json), '$') as json) else try_cast({0} as json) end".format
ITEMS = "case json_type({0}) when 'ARRAY' then cast({0} as json[]) when 'NULL' then [] else case when {0} is null then [] else [{0}] end end".format
TEXT = "coalesce(json_extract_string({0}, '{1}'), '')".format
P6_SQL = f"""with d as (select delivery_key k, {WHOLE("wickets_json")} w, {WHOLE("replacements_json")} r from deliveries),
 wi as (select k, unnest({ITEMS("w")}) x, generate_subscripts({ITEMS("w")}, 1) i from d),
 wo as (select * from wi where json_type(x) = 'OBJECT'),
 fi as (select k, i, unnest({ITEMS("json_extract(x, '$.fielders')")}) f, generate_subscripts({ITEMS("json_extract(x, '$.fielders')")}, 1) j from wo),
 re as (select k, g, unnest({ITEMS("v")}) x, generate_subscripts({ITEMS("v")}, 1) i from (select k, 'match' g, json_extract(r, '$.match') v from d union all select k, 'role', json_extract(r, '$.role') from d)),
 m as (select match_id k, {WHOLE("registry_people_json")} p, {WHOLE("innings_metadata_json")} n from matches),
 pe as (select k, case when json_type(p) = 'OBJECT' and json_type(json_extract(p, '$.people')) in ('OBJECT', 'ARRAY') then json_extract(p, '$.people') else p end p from m),
 il as (select k, case when json_type(n) = 'OBJECT' and json_type(json_extract(n, '$.innings')) is not null then json_extract(n, '$.innings') else n end n from m),
 ix as (select k, unnest({ITEMS("n")}) x, generate_subscripts({ITEMS("n")}, 1) i from il),
 io as (select * from ix where json_type(x) = 'OBJECT'),
 pp as (select k, i, unnest({ITEMS("json_extract(x, '$.powerplays')")}) p, generate_subscripts({ITEMS("json_extract(x, '$.powerplays')")}, 1) j from io),
 ab as (select k, i, unnest({ITEMS("json_extract(x, '$.absent_hurt')")}) a, generate_subscripts({ITEMS("json_extract(x, '$.absent_hurt')")}, 1) j from io),
 mo as (select io.k, i, try_cast(e.key as bigint) o, e.value v from io, json_each(io.x, '$.miscounted_overs') e),
 al as (select 'wicket' child_kind, k parent_key, i pos_1, 0 pos_2, {TEXT("x", "$.player_out")} as label, {TEXT("x", "$.kind")} detail from wo
  union all select 'fielder', k, i, j, case when json_type(f) = 'OBJECT' then {TEXT("f", "$.name")} else {TEXT("f", "$")} end,
    case when json_type(f) = 'OBJECT' and lower(json_extract_string(f, '$.substitute')) = 'true' then 'substitute' else '' end from fi
  union all select 'replacement_' || g, k, i, 0, {TEXT("x", "$.in")}, {TEXT("x", "$.out")} from re where json_type(x) = 'OBJECT'
  union all select 'person', pe.k, 0, 0, e.key, {TEXT("e.value", "$")} from pe, json_each(case when json_type(p) = 'OBJECT' then p else null::json end) e
  union all select 'person', k, 0, 0, {TEXT("x", "$.name")}, {TEXT("x", "$.id")} from (select k, unnest(cast(p as json[])) x from pe where json_type(p) = 'ARRAY') where json_type(x) = 'OBJECT'
  union all select 'innings', k, i, 0, {TEXT("x", "$.team")}, case when lower(json_extract_string(x, '$.super_over')) = 'true' then 'super_over' else '' end from io
  union all select 'powerplay', k, i, j, {TEXT("p", "$.type")}, concat_ws('-', json_extract_string(p, '$.from'), json_extract_string(p, '$.to')) from pp where json_type(p) = 'OBJECT'
  union all select 'miscounted_over', k, i, o, {TEXT("v", "$.umpire")}, {TEXT("v", "$.balls")} from mo where o is not null
  union all select 'absent_hurt', k, i, j, case when json_type(a) = 'OBJECT' then {TEXT("a", "$.name")} else {TEXT("a", "$")} end, '' from ab)
 select distinct child_kind, parent_key, pos_1::bigint pos_1, pos_2::bigint pos_2, label, detail from al where parent_key is not null"""
SQL = {"p6_found": P6_SQL}
