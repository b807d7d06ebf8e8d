"""URL filters with dated list entries, applied as of each capture's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"
_PATH = r"//[^/?#]*(/[^?#]*)"

#: The list that the registered query applies: (list, pattern, day of the change, whether it is listed from then on).
LIST = [
    ("gambling", "free-bets.example.com", "2024-02-01", True),
    ("gambling", "free-bets.example.com", "2024-09-01", False),
    ("gambling", "free-bets.example.com", "2024-11-15", True),
    ("spam", "tionsh.example.net", "2024-03-10", True),
    ("spam", "tionsh.example.net", "2024-07-01", False),
    ("spam", "blog.tionsh.example.net/es", "2024-05-01", True),
    ("spam", "ththth.example.org", "2024-01-20", True),
    ("phishing", "therth.example.org", "2024-06-01", True),
    ("phishing", "therth.example.org", "2024-06-15", False),
    ("phishing", "m.tiontion.example.com/en", "2024-04-01", True),
    ("malware", "blog.tionble.example.com", "2024-08-01", True),
    ("malware", "ththan.example.net", "2024-01-01", True),
]


def list_entries(spark: SparkSession, rows: list[tuple[str, str, str, bool]] = LIST) -> DataFrame:
    """Rows (list, pattern, since, listed) as a DataFrame."""
    d = spark.createDataFrame(rows, "list string, pattern string, since string, listed boolean")
    return d.withColumn("since", F.col("since").cast("timestamp_ntz"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, pattern, valid_from, valid_to) of dated entries.

    An entry holds until the next one of its list and pattern; valid_to is null
    if there is none.  Of entries of one moment, one that lists wins.
    Patterns compare in lower case.  Entries with a null in list, pattern,
    since or listed are left out.
    """
    e = entries.select("list", F.lower("pattern").alias("pattern"), F.col("since").cast("timestamp_ntz").alias("since"), "listed").na.drop()
    e = e.groupBy("list", "pattern", "since").agg(F.max("listed").alias("listed"))
    following = F.lead("since").over(Window.partitionBy("list", "pattern").orderBy("since"))
    return e.withColumn("valid_to", following).where("listed").select("list", "pattern", F.col("since").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_extract(url, _HOST, 1), F.lit(".")))


def keys_of(url: Column) -> Column:
    """What an entry may name: the host and its parent domains, and the host with each leading part of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.lower(F.regexp_extract(url, _PATH, 1)), "/"), lambda x: x != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(host != "", F.concat(parents, paths))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Returns page_id, url, host, fetched, blocked, lists and patterns, a row for each row of captures.

    A capture is blocked if an entry that was active when it was fetched names
    its host, a parent domain, or its host with a leading part of its path.
    lists and patterns hold what matched, sorted and joined with commas, null
    if nothing did.  Entries meet captures by equality of the key, and their
    intervals are then compared with the fetch time; each distinct (url,
    fetched) is looked up once.  Which side is broadcast, if any, is left to
    the sizes that are found at run time.

    Null urls, urls without host and null times are never blocked.  Repeated
    rows come back as often as they occur.  Columns besides id, url and time
    are never read.
    """
    c = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp_ntz").alias("fetched"))
    looked = c.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    keyed = looked.select("url", "fetched", F.explode(keys_of(F.col("url"))).alias("key"))
    on = (F.col("key") == F.col("pattern")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hits = keyed.join(intervals(entries), on).groupBy("url", "fetched").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns")
    )
    hits = hits.select(F.col("url").alias("h_url"), F.col("fetched").alias("h_fetched"), "lists", "patterns")
    out = c.join(hits, (F.col("url") == F.col("h_url")) & (F.col("fetched") == F.col("h_fetched")), "left")
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched", F.col("lists").isNotNull().alias("blocked"), "lists", "patterns")


def fetch_time(page_id: Column) -> Column:
    """The pages table has no fetch time; one day of 2024 stands in for it, by page_id."""
    return F.expr("cast('2024-01-01' as timestamp_ntz)") + F.make_dt_interval(F.pmod(page_id * 37, F.lit(365)).cast("int"))


def filter_sql(rows: list[tuple[str, str, str, bool]] = LIST) -> str:
    values = ", ".join(f"('{a}', '{b}', TIMESTAMP '{c} 00:00:00', {d})" for a, b, c, d in rows)
    return rf"""
    WITH e AS (SELECT * FROM (VALUES {values}) AS v(list, pattern, since, listed)),
    i AS (SELECT list, pattern, listed, since AS valid_from, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS valid_to FROM e),
    c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * ((page_id * 37) % 365) AS fetched,
                 lower(rtrim(regexp_extract(url, '{_HOST}', 1), '.')) AS host, lower(regexp_extract(url, '{_PATH}', 1)) AS path FROM pages),
    p AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM c),
    k AS (SELECT DISTINCT url, fetched, unnest(list_concat(list_transform(range(1, len(labels) + 1), lambda n: array_to_string(labels[n:], '.')),
                 list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(parts[:n], '/')))) AS key FROM p WHERE host <> ''),
    h AS (SELECT url, fetched, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns
          FROM k JOIN i ON key = pattern AND listed AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY url, fetched)
    SELECT c.page_id, c.url, c.host, c.fetched, h.lists IS NOT NULL AS blocked, h.lists, h.patterns
    FROM c LEFT JOIN h ON c.url = h.url AND c.fetched = h.fetched"""
