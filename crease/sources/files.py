"""CSV, configuration and file-provenance sources, and the sinks."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import urlopen

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.errors import ConfigurationError, QualityError, SourceError
from crease.functions.scalars import blank_to_null, money
from crease.sources.tables import durable

HEADERS = {
    "name": "name_raw", "nationality": "nationality", "price in $": "price_in_usd", "price in rs": "price_in_rs", "baseprices in rs": "base_prices_in_rs", "winning bid in rs": "winning_bid_in_rs",
    "role": "role_raw", "teamname": "team_name", "capped/uncapped": "capped_uncapped",
}


def csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, an empty cell as '' and not NULL; header names trimmed, an unnamed index column dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = [c for c in df.columns if c.strip() and not c.startswith("_c")]
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in names])


def yearly_auctions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of different layouts in one table: the union of their known columns, absent ones NULL.

    year is the first four digits of the file name; price and currency come from the column that is filled, the
    winning bid before rupees before dollars.
    """
    out = None
    for p in sorted(paths):
        df = csv_texts(spark, p)
        known = {c: HEADERS[c.strip().lower()] for c in df.columns if c.strip().lower() in HEADERS}
        rows = df.select(*[blank_to_null(F.col(f"`{c}`")).alias(n) for c, n in known.items()], F.lit(Path(p).name).alias("source_file"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*HEADERS.values(), "source_file")))
    for c in HEADERS.values():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    price = F.coalesce(money(F.col("winning_bid_in_rs")), money(F.col("price_in_rs")), money(F.col("price_in_usd")))
    inr = F.coalesce(money(F.col("winning_bid_in_rs")), money(F.col("price_in_rs"))).isNotNull()
    return out.withColumns({"year": F.regexp_extract("source_file", r"(\d{4})", 1).try_cast("bigint"), "price": price, "currency": F.when(inr, "INR").when(price.isNotNull(), "USD")})


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and the given types; a cell that does not convert is NULL, not an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def load_config(path: str) -> dict | list:
    """A small JSON or YAML document on the driver (YAML where its reader is installed). ConfigurationError otherwise."""
    file = Path(path)
    if not file.is_file():
        raise ConfigurationError(f"no configuration file {path}")
    text = file.read_text(encoding="utf-8-sig")
    try:
        if file.suffix.lower() in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as absent:
                raise ConfigurationError("YAML needs the package yaml") from absent
            return yaml.safe_load(text)
        return json.loads(text)
    except ConfigurationError:
        raise
    except Exception as bad:
        raise ConfigurationError(f"{path} cannot be read: {bad}") from bad


def config_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small list of records (JSON or YAML) as a DataFrame."""
    records = load_config(path)
    return spark.createDataFrame(records if isinstance(records, list) else [records], schema)


def sql_on_files(spark: SparkSession, query: str, **tables: str) -> DataFrame:
    """A SQL query over Parquet files: each ``{name}`` in it stands for the table at the path given by that name."""
    return spark.sql(query, **{name: spark.read.parquet(path) for name, path in tables.items()})


def first_source(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the paths that can be read: Parquet, CSV (texts) or JSON by its ending. SourceError if none can."""
    for p in paths:
        try:
            if p.endswith(".csv"):
                return csv_texts(spark, p)
            return spark.read.json(p) if p.endswith(".json") else spark.read.parquet(p)
        except AnalysisException:
            continue
    raise SourceError("none of the sources can be read: " + ", ".join(paths))


# What every entry of a source catalog must have, and the states it may be in.
SOURCE_FIELDS, SOURCE_STATES = ("source_name", "competition", "format", "status"), ("active", "planned", "deprecated", "manual")


def validate_catalog(catalog: dict) -> None:
    """Raises ConfigurationError for the first entry of a source catalog that breaks its rules: needed fields, one name
    each, a known state, an address where it is active, and every required competition named in one."""
    sources = catalog.get("sources")
    if not isinstance(sources, list) or not sources:
        raise ConfigurationError("the catalog has no sources")
    names: set[str] = set()
    for s in sources:
        lacks = [f for f in SOURCE_FIELDS if f not in s]
        name = s.get("source_name")
        if lacks:
            raise ConfigurationError(f"source {name!r} lacks {lacks}")
        if not isinstance(name, str) or not name or name in names:
            raise ConfigurationError(f"source name {name!r} is empty or occurs twice")
        names.add(name)
        if s["status"] not in SOURCE_STATES:
            raise ConfigurationError(f"source {name!r} has the unknown state {s['status']!r}")
        if s["status"] == "active" and not s.get("url"):
            raise ConfigurationError(f"active source {name!r} has no url")
    for c in catalog.get("required_competitions", []):
        if not any(c in str(s["competition"]) for s in sources):
            raise ConfigurationError(f"no source covers {c!r}")


def source_named(catalog: dict, name: str) -> dict:
    """The entry of a catalog with that name, or SourceError: only listed sources are fetched."""
    for s in catalog.get("sources", []):
        if s.get("source_name") == name:
            return s
    raise SourceError(f"no source is named {name!r}")


def file_name_of(source: dict) -> str:
    """The file a source is kept as: its own file name, else the last part of its address if that has an ending, else its
    name as a slug with the ending of its format."""
    given = str(source.get("filename") or "").replace("\\", "/").rsplit("/", 1)[-1]
    if given:
        return given
    last = urlparse(str(source.get("url") or "")).path.strip().rsplit("/", 1)[-1]
    if re.search(r"\.[A-Za-z0-9]{2,5}$", last):
        return last
    slug = re.sub(r"_+", "_", re.sub(r"[^\w-]", "_", str(source.get("source_name", "raw_data")).lower())).strip("_")
    kind = str(source.get("format", "")).lower()
    ending = next((e for word, e in (("zip", "zip"), ("csv", "csv"), ("json", "json"), ("html", "html"), ("web", "html"), ("pdf", "pdf")) if word in kind), "dat")
    return f"{slug}.{ending}"


def fetch(source: dict, folder: str, overwrite: bool = False) -> tuple[Path, str]:
    """Downloads a source into ``folder``: (path, SHA-256). An existing file is kept: without ``overwrite`` it is an error."""
    root = Path(folder).resolve()
    target = (root / file_name_of(source)).resolve()
    if not target.is_relative_to(root):
        raise SourceError(f"{target} lies outside {folder}")
    if target.exists() and not overwrite:
        raise SourceError(f"{target} exists and is not overwritten")
    root.mkdir(parents=True, exist_ok=True)
    part, digest = target.with_suffix(target.suffix + ".part"), hashlib.sha256()
    with urlopen(source["url"], timeout=60) as answer, open(part, "wb") as out:  # noqa: S310
        while block := answer.read(1 << 20):
            digest.update(block)
            out.write(block)
    if part.stat().st_size == 0:
        part.unlink()
        raise SourceError(f"{source['url']} gave an empty file")
    part.replace(target)
    return target, digest.hexdigest()


def extract(archive: str, folder: str, sha256: str | None = None) -> list[Path]:
    """Unpacks a ZIP archive; a member that would leave the folder, another hash than told, or an empty archive is an
    error, and then nothing is unpacked."""
    if sha256 is not None and hashlib.sha256(Path(archive).read_bytes()).hexdigest() != sha256:
        raise SourceError(f"{archive} is not the archive with that hash")
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        files = [m for m in z.infolist() if not m.is_dir()]
        if not files:
            raise SourceError(f"{archive} is empty")
        for m in z.infolist():
            if not (root / m.filename).resolve().is_relative_to(root):
                raise SourceError(f"{archive} holds the unsafe member {m.filename}")
        root.mkdir(parents=True, exist_ok=True)
        z.extractall(root)
    return [root / m.filename for m in files]


def united_competitions(tables: dict[str, DataFrame], names: dict[str, str], schema: str, spark: SparkSession) -> DataFrame:
    """Tables by competition code in one, with the competition's full name (its code where it has none); without any table
    an empty one of ``schema`` with the column ``competition``."""
    out = None
    for code in sorted(tables):
        rows = tables[code].withColumn("competition", F.lit(names.get(code, code)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], f"{schema}, competition string") if out is None else out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def reconcile(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """path and status of each file of either side: verified, changed, untracked or missing."""
    j = found.select("path", F.col("sha256").alias("now")).join(recorded.select("path", F.col("sha256").alias("then")), "path", "full")
    status = F.when(F.col("then").isNull(), "untracked").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("then"), "verified").otherwise("changed")
    return j.select("path", status.alias("status"))


def backfilled(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """The record with the files it did not know; what it knows stays as it is, also where the file changed."""
    return recorded.unionByName(found.join(recorded.select("path"), "path", "left_anti").select(*recorded.columns))


def pruned(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """The record without the files that are gone."""
    return recorded.join(found.select("path"), "path", "left_semi")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, format: str = "parquet") -> None:
    """Parquet, CSV (with a header) or JSON lines to a new path; an existing one is an error, as a path that is read must
    not be overwritten."""
    w = df.write.mode("errorifexists").format(format).option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_validated(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes a table only if its report of rules has no violation (QualityError otherwise), and reads it back."""
    kept = durable(df)
    broken = check(kept).where("n_violations > 0").collect()
    if broken:
        raise QualityError("; ".join(f"{r['rule']}: {r['n_violations']}" for r in broken))
    write_table(kept, path)
    return df.sparkSession.read.parquet(path)


def write_parameters(parameters: dict, path: str) -> None:
    """The parameters of a model as a JSON document with sorted keys, through a new file that replaces the old one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    new = target.with_suffix(target.suffix + ".new")
    new.write_text(json.dumps(parameters, sort_keys=True, ensure_ascii=False, indent=1), encoding="utf-8")
    new.replace(target)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table. Beyond ``limit`` rows the rest is left out and the last line says how many."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    text = head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit])
    return text if len(rows) <= limit else f"{text}\n\n{df.count() - limit} more rows are not shown."
