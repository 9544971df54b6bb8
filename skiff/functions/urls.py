"""URL splitting as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the generic syntax of a URL (scheme, authority, path, query, fragment).
GENERIC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def urlsplit(url: Column) -> Column:
    clean = F.regexp_replace(url, "[\t\r\n]", "")
    part = [F.regexp_extract(clean, GENERIC, i) for i in range(1, 6)]
    return F.struct(F.lower(part[0]).alias("scheme"), part[1].alias("netloc"), part[2].alias("path"), part[3].alias("query"), part[4].alias("fragment"))


def urlparse(url: Column) -> Column:
    """urlsplit with the parameters after ; of the last path segment apart."""
    s = urlsplit(url)
    path = s["path"]
    cut = r"^(.*/[^/;]*|[^/;]*);(.*)$"
    has = path.rlike(cut) & (F.instr(F.substring_index(path, "/", -1), ";") > 0)
    return F.struct(
        s["scheme"].alias("scheme"), s["netloc"].alias("netloc"),
        F.when(has, F.regexp_extract(path, r"^((?:.*/)?[^/;]*);", 1)).otherwise(path).alias("path"),
        F.when(has, F.regexp_extract(path, r"^(?:.*/)?[^/;]*;(.*)$", 1)).otherwise("").alias("params"),
        s["query"].alias("query"), s["fragment"].alias("fragment"),
    )


def netloc_parts(netloc: Column) -> Column:
    """username, password, hostname and port; NULL where missing."""
    info = F.when(F.contains(netloc, F.lit("@")), F.regexp_extract(netloc, r"^(.*)@", 1))
    host = F.regexp_extract(netloc, r"^(?:.*@)?(.*)$", 1)
    name = F.regexp_extract(host, r"^([^:]*)", 1)
    port = F.regexp_extract(host, r":([0-9]+)$", 1)
    return F.struct(
        F.regexp_extract(info, r"^([^:]*)", 1).alias("username"),
        F.when(F.contains(info, F.lit(":")), F.regexp_extract(info, r":(.*)$", 1)).alias("password"),
        F.when(name != "", name).alias("hostname"),
        F.when(port != "", port).try_cast("bigint").alias("port"),
    )
