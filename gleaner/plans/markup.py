"""Registered queries over the elements of the given pages. The SQL reads the pages' regular parts by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html as H
from .catalogue import n, query

#: SQL of a text between two patterns, without entities and outer blanks. As HTML has it, these names need no semicolon.
INNER = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'))"
BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'), '(?s)<style>.*?</style>', '<style>', 'g'), '(?s)<!--.*?-->', '', 'g')"


def one(pattern: str) -> str:
    return INNER.format(f"regexp_extract(html, '(?s){pattern}', 1)")


@query("Q_tag_inventory", f"SELECT tag AS name, count(*) AS elements, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all({BARE}, '<([a-z][a-z0-9]*)(?:\\s[^>]*)?>', 1)) AS tag FROM pages) GROUP BY tag")
def tags(t):
    """Tags of all pages: elements, and pages that have them."""
    found = H.inventory(t.pages.select("page_id", "html")).where("kind = 'tag'")
    return found.groupBy("name").agg(F.sum("n").alias("elements"), n("pages"))


@query("Q_class_inventory", f"""SELECT page_id, 'class' AS kind, CAST(1 AS BIGINT) AS place, 'ad' AS name, CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS n, 'div' AS tags, left({one('<div class="ad">([^<]*)</div>')}, 140) AS sample FROM pages
 UNION ALL SELECT page_id, 'title', 1, 'title', 1, 'title', {one('<title>(.*?)</title>')} FROM pages""")
def classes(t):
    """Classes of each page with a sample, and its title."""
    return H.inventory(t.pages.select("page_id", "html")).where("kind <> 'tag'").select("page_id", "kind", "place", "name", "n", "tags", "sample")


@query("Q_select_text", f"SELECT page_id, place, tag, text FROM (SELECT page_id, CAST(1 AS BIGINT) AS place, 'title' AS tag, {one('<title>(.*?)</title>')} AS text FROM pages UNION ALL SELECT page_id, 2, 'h1', {one('<h1>(.*?)</h1>')} FROM pages)")
def selected_text(t):
    return H.select(t.pages.select("page_id", "html"), "head > title, body article > h1:first-child")


@query("Q_select_links", f"""SELECT page_id, place, 'li' AS tag, {INNER.format("regexp_extract(item, '>([^<]*)</a>', 1)")} AS text, 'https://site.example' || replace(regexp_extract(item, 'href="([^"]*)"', 1), '&amp;', '&') AS href, '' AS src FROM
 (SELECT page_id, unnest(items) AS item, CAST(unnest(range(1, len(items) + 1)) AS BIGINT) AS place FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>(.*?)</li>', 1) AS items FROM pages))""")
def selected_links(t):
    """The entries of each page's menu and where they lead."""
    return H.select(t.pages.select("page_id", "html"), "nav > ul > li", "links", root="https://site.example")


@query("Q_select_html", "SELECT page_id, CAST(1 AS BIGINT) AS place, 'nav' AS tag, trim(regexp_replace(replace(regexp_replace(nav, '</?[a-z]+[^>]*>', ' ', 'g'), '&amp;', '&'), ' +', ' ', 'g')) AS text, nav AS html FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages)")
def selected_html(t):
    return H.select(t.pages.select("page_id", "html"), "body > nav", "html")


@query("Q_select_classes", f"""SELECT page_id, CAST(1 AS BIGINT) AS place, 'div' AS tag, {one('<div class="ad">([^<]*)</div>')} AS text FROM pages""")
def selected_classes(t):
    return H.select_classes(t.pages.select("page_id", "html"), ["ad", "banner", "sponsored:now"])
