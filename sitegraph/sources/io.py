"""Sources and sinks: page scan, crawl save/load, CSV export, URL lists,
robots.txt source.

A saved crawl is a folder of parquet tables (``crawl``, ``inlinks``,
``config``, ``extractions``, ``exclusions``).  Writes go to a fresh version
folder and a small ``_CURRENT`` pointer file is replaced last, so a reader
never sees a half-written crawl and a lost executor only re-runs tasks of the
current write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph.functions import urls as U
from sitegraph.functions.idna import ascii_host
from sitegraph.settings import CrawlSettings

FETCH_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("html", T.StringType()),
    T.StructField("history", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]))),
])


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page scan: fetched pages as rows, normalised to the fetch schema
    (missing status -> 200, headers -> empty map, history -> empty)."""
    df = spark.read.parquet(path)
    cols = set(df.columns)

    def have(name, default):
        return F.col(name) if name in cols else default

    return df.select(
        *([F.col("page_id")] if "page_id" in cols else []),
        F.col("url").cast("string").alias("url"),
        have("status_code", F.lit(200)).cast("int").alias("status_code"),
        have("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        F.col("html").cast("string").alias("html"),
        have("history", F.array().cast(FETCH_SCHEMA["history"].dataType)).alias("history"),
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_pointer(spark: SparkSession, folder: str, version: str) -> None:
    fs, p = _fs(spark, f"{folder.rstrip('/')}/_CURRENT")
    tmp = _fs(spark, f"{folder.rstrip('/')}/_CURRENT.{uuid.uuid4().hex}")[1]
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode("utf-8")))
    out.close()
    # one overwriting rename: a reader finds the old version or the new one
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), conf).rename(
        fs.makeQualified(tmp), fs.makeQualified(p), how)


def current_version(spark: SparkSession, folder: str) -> str:
    fs, p = _fs(spark, f"{folder.rstrip('/')}/_CURRENT")
    stream = fs.open(p)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    line = reader.readLine()
    reader.close()
    return line.strip()


def save_crawl(spark: SparkSession, folder: str, crawl: DataFrame, settings: CrawlSettings,
               inlinks: DataFrame | None = None) -> str:
    """Write a crawl (tables + settings) as a new version; returns its path.

    ``CRAWL_ITEMS`` is stored joined by ``', '``; keys ending in
    ``_PASSWORD`` are never stored."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    base = f"{folder.rstrip('/')}/{version}"
    crawl.write.mode("overwrite").parquet(f"{base}/crawl")
    if inlinks is not None:
        inlinks.write.mode("overwrite").parquet(f"{base}/inlinks")
    spark.createDataFrame(settings.as_rows(), "setting string, value string") \
        .write.mode("overwrite").parquet(f"{base}/config")
    spark.createDataFrame(list(settings.extractions), "name string, type string, value string") \
        .write.mode("overwrite").parquet(f"{base}/extractions")
    spark.createDataFrame(list(settings.exclusions), "operator string, value string") \
        .write.mode("overwrite").parquet(f"{base}/exclusions")
    _write_pointer(spark, folder, version)
    return base


def load_crawl(spark: SparkSession, folder: str) -> dict:
    """Read the current version: DataFrames for every table and the settings
    (``CRAWL_ITEMS`` split back into a list)."""
    base = f"{folder.rstrip('/')}/{current_version(spark, folder)}"
    out = {"crawl": spark.read.parquet(f"{base}/crawl")}
    fs, p = _fs(spark, f"{base}/inlinks")
    if fs.exists(p):
        out["inlinks"] = spark.read.parquet(f"{base}/inlinks")
    config = spark.read.parquet(f"{base}/config")
    out["config"] = config.withColumn(
        "items", F.when(F.col("setting") == "CRAWL_ITEMS",
                        F.transform(F.split("value", ","), lambda x: F.trim(x))))
    out["extractions"] = spark.read.parquet(f"{base}/extractions")
    out["exclusions"] = spark.read.parquet(f"{base}/exclusions")
    return out


def settings_from_config(rows: list, extractions: list = (), exclusions: list = ()) -> CrawlSettings:
    """Rebuild settings from (setting, value) rows of a loaded crawl (tiny
    config table, read on the driver by design)."""
    d = dict(rows)
    items = tuple(i.strip() for i in d.get("CRAWL_ITEMS", "").split(",") if i.strip())
    return CrawlSettings(
        mode=d.get("MODE", "Spider"), crawl_items=items or CrawlSettings().crawl_items,
        extraction_separator=d.get("EXTRACTION_SEPARATOR", "; "), agent=d.get("UA_SHORT", "Googlebot"),
        root_domain=d.get("ROOT_DOMAIN"), starting_url=d.get("STARTING_URL"),
        exclusions=tuple(tuple(e) for e in exclusions), extractions=tuple(tuple(e) for e in extractions))


# NULL is written as \N so that it stays distinct from an empty string.
NULL_MARK = "\\N"


BOM = "\ufeff"
#: Name of the part with the header: it sorts before Spark's own ``part-00000-...``.
HEADER_PART = "part-0-header.csv"


def export_csv(df: DataFrame, path: str, bom: bool = True, one_header: bool = True) -> None:
    """CSV export of any view: header row, comma separated, quoted only
    where needed, UTF-8, with the byte-order mark spreadsheet programs look
    for (``bom``).

    With ``one_header`` the folder is one file in pieces: a first part holds
    the mark and the header, the parts after it hold rows only, in the order
    of the view.  All parts put together in the order of their names
    (``cat part-*``, ``hadoop fs -getmerge``) are the one file a user opens;
    the tasks write them in parallel and nothing passes through one of them.
    Without it every part is a file of its own, with mark and header."""
    if bom and not one_header and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").option("header", not one_header).option("encoding", "UTF-8") \
        .option("quoteAll", False).option("escape", '"').option("nullValue", NULL_MARK).csv(path)
    if one_header:
        fs, folder = _fs(df.sparkSession, path)
        head = (BOM if bom else "") + ",".join(_csv_name(c) for c in df.columns) + "\n"
        out = fs.create(df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder, HEADER_PART), True)
        try:
            out.write(bytearray(head.encode()))
        finally:
            out.close()


def _csv_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\r\n') else name


def read_csv_export(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV export of either form; without ``schema`` all columns are strings."""
    def reader(header):
        return (spark.read.option("header", header).option("escape", '"').option("multiLine", True)
                .option("nullValue", NULL_MARK).option("emptyValue", ""))

    fs, folder = _fs(spark, path)
    head = spark._jvm.org.apache.hadoop.fs.Path(folder, HEADER_PART)
    if fs.exists(head):
        rows = reader(False).option("pathGlobFilter", "part-[0-9][0-9]*")
        if schema is not None:
            return rows.schema(schema).csv(path)
        names = [_unmarked(n) for n in reader(True).csv(head.toString()).columns]
        return rows.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    if schema is not None:
        return reader(True).schema(schema).csv(path)
    df = reader(True).csv(path)
    return df.withColumnRenamed(df.columns[0], _unmarked(df.columns[0])) if df.columns else df


def _unmarked(name: str) -> str:
    return name.lstrip(BOM)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URL-list source: one URL per line; keep lines with scheme and network
    location (as written), de-duplicated."""
    return spark.read.text(path).filter(U.list_url_ok("value")).select(F.col("value").alias("url")).distinct()


def robots_source(robots: DataFrame) -> DataFrame:
    """robots.txt responses keyed by host: the text counts only with status
    200; other statuses mean "no rules" (text NULL)."""
    return robots.select(ascii_host(F.lower("host")).alias("host"),
                         F.when(F.col("status_code") == 200, F.col("robots_text")).alias("robots_text"),
                         "status_code")


def resume_crawl(spark: SparkSession, folder: str, register: bool = True) -> dict:
    """Load a saved crawl for resuming: settings (from the tiny config
    tables), the pending queue (discovered, not crawled), the progress
    counters, and the report views registered again."""
    from sitegraph.operators.state import pending, progress
    from sitegraph.operators.views import register_views

    loaded = load_crawl(spark, folder)
    settings = settings_from_config(
        [(r["setting"], r["value"]) for r in loaded["config"].select("setting", "value").collect()],
        [tuple(r) for r in loaded["extractions"].collect()],
        [tuple(r) for r in loaded["exclusions"].collect()])
    crawl = loaded["crawl"]
    out = {"settings": settings, "crawl": crawl, "pending": pending(crawl), "progress": progress(crawl),
           "inlinks": loaded.get("inlinks")}
    if register:
        out["views"] = register_views(crawl, loaded.get("inlinks"))
    return out
