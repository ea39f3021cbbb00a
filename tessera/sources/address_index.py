"""An index of crawled addresses, sorted by reversed host, that seeds a crawl by ranges.

The key of http://www.Blog.example.com:80/a?b#c is com,example,blog)/a?b: all addresses of a domain, its subdomains' too,
are neighbours. The index is written in ranges of the key, sorted, with small row groups; a domain or a folder asked for
is a range, so its filter reaches the scan and skips files and row groups by their least and greatest keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.web import matches_glob

#: Parts of an address: scheme, user, host, port and the rest; its fragment is left out.
ADDRESS = "^\\s*(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^#]*)"


def reversed_host(host: Column) -> Column:
    """com,example for www.Example.com; a trailing dot and www. go."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(host), "[.]+$", ""), "^www[0-9]*[.]", "")
    return F.array_join(F.reverse(F.split(plain, "[.]")), ",")


def address_key(c: Column | str) -> Column:
    """The key of an address; null where it is not one of the web's."""
    c = F.col(c) if isinstance(c, str) else c
    part = lambda k: F.regexp_extract(c, ADDRESS, k)
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3).startswith("/"), part(3)).otherwise(F.concat(F.lit("/"), part(3)))
    return F.when(part(1) != "", F.concat(reversed_host(part(1)), port, F.lit(")"), F.trim(path)))


def write_index(addresses: DataFrame, folder: str, files: int | None = None, url: str = "url", group_bytes: int = 1 << 20) -> None:
    """The distinct addresses of a table as an index of files of one range each; addresses that have no key are left out.

    Equal keys keep their smallest address. files: by default the session's number of shuffle partitions.
    """
    n = files or int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = addresses.select(address_key(url).alias("key"), F.col(url).alias("url")).where("key IS NOT NULL")
    one = keyed.groupBy("key").agg(F.min("url").alias("url"))
    one.repartitionByRange(n, "key").sortWithinPartitions("key").write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(folder)


def _upper(prefix: str) -> str:
    """The least text behind all that begin with the prefix."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def _between(prefix: str) -> Column:
    return (F.col("key") >= prefix) & (F.col("key") < _upper(prefix))


def seeds(spark: SparkSession, folder: str, domain: str, path: str = "", pattern: str | None = None, subdomains: bool = True) -> DataFrame:
    """(key, url) of a domain in the index: plain ranges of the key, which Parquet statistics answer.

    path: only addresses whose path begins with it; pattern: a glob that the whole address matches. Without subdomains only the
    domain's own host on its usual port counts. A domain without addresses gives no rows.
    """
    host = ",".join(reversed(domain.lower().strip(".").removeprefix("www.").split(".")))
    wanted = _between(f"{host}){path}")
    if subdomains:
        # other ports, and hosts below this one, whose path is the rest of the key
        wanted = wanted | ((_between(f"{host}:") | _between(f"{host},")) & F.regexp_extract("key", "^[^)]*[)](.*)$", 1).startswith(path))
    found = spark.read.parquet(folder).where(wanted)
    return found.where(matches_glob(F.col("url"), pattern)) if pattern else found


def seeds_of(index: DataFrame, domains: DataFrame, column: str = "domain") -> DataFrame:
    """(domain, key, url) for a table of domains: an address meets each of its host's ends, so the join is one of equal texts.

    A host gives as many rows as it has labels; the domains are never put into one filter.
    """
    names = domains.select(F.col(column).alias("domain")).where("domain IS NOT NULL").distinct().withColumn("__host", reversed_host(F.col("domain")))
    labels = F.split(F.regexp_extract("key", "^([^:)]*)", 1), ",")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.lit(1), k), ","))
    return index.select("key", "url", F.explode(ends).alias("__end")).join(names, F.col("__end") == F.col("__host")).select("domain", "key", "url")
