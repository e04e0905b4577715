"""Queries on dates of pages and on orders by language, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import pages
from .operators import orders
from .registry import query

#: By the last digit of the page's id: what is put into its head, and the moment that it says.
_SAID = {
    0: ("<meta property=\"article:modified_time\" content=\"2024-05-0{d}T10:00:00+02:00\"><script>{{\"dateModified\": \"2020-01-01\"}}</script>", "2024-05-0{d} 08:00:00"),
    1: ("<meta content=\"2024-06-0{d}\" name=\"x\" property=\"og:updated_time\">", "2024-06-0{d} 00:00:00"),
    2: ("<meta property=\"article:modified_time\" content=\"soon\"><script>{{\"datePublished\":\"2019-01-01\",\"dateModified\" : \"2024-07-0{d}T01:02:03Z\"}}</script>", "2024-07-0{d} 01:02:03"),
    3: ("<time datetime=\"2001-01-01\">x</time><time class=\"entry updated\" datetime=\"2024-08-0{d}\">x</time>", "2024-08-0{d} 00:00:00"),
    4: ("(Senast uppdaterad: 0{d}.09.2024)", "2024-09-0{d} 12:00:00"),
    5: ("<meta property=\"article:published_time\" content=\"2024-10-0{d}\"><time datetime=\"2001-01-01\">x</time>", "2024-10-0{d} 00:00:00"),
    6: ("<script>{{\"datePublished\": \"2024-11-0{d}\"}}</script>", "2024-11-0{d} 00:00:00"),
    7: ("<time datetime=\"2024-12-0{d}\">x</time>", "2024-12-0{d} 00:00:00"),
}
_HEAD = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '" + said.format(d="' || (page_id % 9 + 1) || '") + "'" for k, (said, _) in _SAID.items()) + " ELSE '' END"
_MOMENT = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '" + at.format(d="' || (page_id % 9 + 1) || '") + "'" for k, (_, at) in _SAID.items()) + " WHEN 8 THEN '2024-02-0' || (page_id % 9 + 1) || ' 12:00:00' ELSE '2024-01-01 00:00:00' END"


@query(f"SELECT page_id, {_MOMENT} AS at FROM pages")
def page_dates(t):
    html = F.concat(F.expr(_HEAD), F.coalesce("html", F.lit("")))
    url = F.when(F.col("page_id") % 10 == 8, F.expr("'https://x.example/2024-02-0' || (page_id % 9 + 1) || '/a'")).otherwise("https://x.example/20240202")
    at = pages.article_date(html, url, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t("pages").select("page_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT p_type, p_partkey, name, place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC NULLS LAST, name COLLATE sv, p_partkey) AS place FROM (SELECT *, translate(p_name, 'aou', 'åöä') AS name FROM part)) WHERE place <= 20""")
def first_in_swedish(t):
    rows = t("part").withColumn("name", F.translate("p_name", "aou", "åöä"))
    return orders.first_of_each(rows, ["p_type"], "-p_size", "~name", tie="p_partkey", most=20).select("p_type", "p_partkey", "name", "place")
