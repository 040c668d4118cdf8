"""Metadata from documentation pages: tables of columns, query text, links, and the providers that are asked in turn.

A page is a row with its HTML as text; everything but the parse of query text is a column expression, so a page costs one pass
and no shuffle. Entities are decoded by an Arrow UDF once for each page, after its tags are gone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import lineage
from concordia.operators.enrich import last_wins

#: Names of data types, and normalised header names of the three columns that are looked for.
TYPE = r"(?i)\b(NUMBER|VARCHAR2|NVARCHAR2|DATE|TIMESTAMP|CHAR|CLOB|BLOB)\b"
HEADERS = {"column": ["COLUMNNAME", "COLUMN", "NAME"], "type": ["DATATYPE", "TYPE"], "comment": ["COMMENTS", "COMMENT", "DESCRIPTION"]}
#: Characters before and after a column's name that the text fallback reads, and how many of them it returns; least length of a description.
BEFORE, AFTER, SAMPLE, LEAST = 220, 320, 200, 8
#: Cells of a row in the six-cell layout, and the place (from 0) of the description.
CELLS, COMMENT_AT = 6, 5
_ROW, _CELL = "\x1e", "\x1f"


def page_rows(html: Column) -> Column:
    """array<array<string>>: the cells of each table row, tags gone, entities decoded, white space collapsed."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1))
    bare = F.transform(rows, lambda r: F.array_join(F.transform(cells(r), lambda c: F.regexp_replace(c, "<[^>]+>", " ")), _CELL))
    plain = text.unescape_html(F.array_join(F.filter(bare, lambda r: r != ""), _ROW))
    return F.transform(F.split(plain, _ROW), lambda r: F.transform(F.split(r, _CELL), text.normalize_ws))


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), 0)


def metadata_in_rows(rows: Column, column: Column) -> Column:
    """struct(description, data_type) of a column in page_rows(), blank where no row names it.

    Headers add up over the rows until the column and one of the others is known; the first row below that names the column
    counts. Failing that, the first row that holds the name at all: its first cell with a type, its first other long cell.
    """
    start = F.struct(*[F.lit(x).cast("int").alias(n) for n, x in (("n", 0), ("h", 0), ("c", -1), ("t", -1), ("d", -1))])

    def step(s: Column, r: Column) -> Column:
        def place(kind: str, old: Column) -> Column:
            known = F.transform(r, lambda c: c.isin(HEADERS[kind]))
            return F.when(F.array_contains(known, True), (F.size(r) - F.array_position(F.reverse(known), True)).cast("int")).otherwise(old)

        c, t, d, n = place("column", s["c"]), place("type", s["t"]), place("comment", s["d"]), s["n"] + 1
        done = (c >= 0) & ((t >= 0) | (d >= 0))
        return F.when(s["h"] > 0, s).otherwise(F.struct(n.alias("n"), F.when(done, n).otherwise(0).alias("h"), c.alias("c"), t.alias("t"), d.alias("d")))

    none = F.struct(F.lit("").alias("description"), F.lit("").alias("data_type"))

    def exact(row: Column, head: Column) -> Column:
        return F.struct(F.coalesce(F.get(row, head["d"]), F.lit("")).alias("description"), F.coalesce(F.nullif(F.get(row, head["t"]), F.lit("")), F.lit("N/A")).alias("data_type"))

    def loose(cells: Column, token: Column) -> Column:
        def said(kind: Column) -> Column:
            known = _first(cells, lambda c: ~text.normalize_token(c).isin(token, text.normalize_token(kind)) & (F.length(c) >= LEAST))
            return F.struct(F.coalesce(known, F.lit("")).alias("description"), kind.alias("data_type"))

        return F.when(cells.isNotNull(), text.let(F.coalesce(_first(cells, lambda c: F.regexp_like(c, F.lit(TYPE))), F.lit("N/A")), said)).otherwise(none)

    def told(x: Column) -> Column:
        """x: rows, their normalised cells (names) and the token."""

        def below(head: Column) -> Column:
            places = F.when((head["h"] > 0) & (head["h"] < F.size(x["rows"])), F.sequence(head["h"], F.size(x["rows"]) - 1)).otherwise(F.array().cast("array<int>"))
            at = _first(places, lambda i: F.get(F.get(x["names"], i), head["c"]) == x["token"])
            return text.let(at, lambda i: F.when(i.isNotNull(), exact(F.get(x["rows"], i), head)))

        any_row = _first(F.sequence(F.lit(0), F.size(x["rows"]) - 1), lambda i: F.array_contains(F.get(x["names"], i), x["token"]))
        found = F.coalesce(text.let(F.aggregate(x["names"], start, step), below), text.let(F.get(x["rows"], any_row), lambda cells: loose(cells, x["token"])))
        return F.when((x["token"] == "") | (F.size(x["rows"]) < 1), none).otherwise(found)

    held = F.struct(rows.alias("rows"), F.transform(rows, lambda r: F.transform(r, text.normalize_token)).alias("names"), text.normalize_token(column).alias("token"))
    return text.let(held, told)


def metadata_in_text(page: Column, column: Column) -> Column:
    """struct(description, data_type) from the text around the first mention of the column in any case."""

    def said(at: Column) -> Column:
        begin = F.greatest(F.lit(1), at - BEFORE)
        around = text.normalize_ws(F.substring(page, begin, F.least(F.length(page), at - 1 + AFTER) - begin + 1))
        kind = lambda x: F.coalesce(F.nullif(F.upper(F.regexp_extract(x, TYPE, 1)), F.lit("")), F.lit("N/A"))
        found = text.let(around, lambda x: F.struct(F.substring(x, 1, SAMPLE).alias("description"), kind(x).alias("data_type")))
        return F.when(at > 0, found).otherwise(F.struct(F.lit("").alias("description"), F.lit("").alias("data_type")))

    return text.let(F.position(F.upper(column), F.upper(page)), said)


def column_metadata(pages: DataFrame, by: str | list[str], html_col: str = "html", column_col: str = "column", rows_col: str | None = None) -> DataFrame:
    """(by, description, data_type) of each row's column on its page: from tables, else from the text around its name.

    rows_col: page_rows() of the page, where they are known already.
    """
    keep = [by] if isinstance(by, str) else by
    cells = F.col(rows_col) if rows_col else page_rows(F.col(html_col))
    rows = pages.select(*keep, F.coalesce(html_col, F.lit("")).alias("__page"), F.coalesce(column_col, F.lit("")).alias("__column"), cells.alias("__rows"))
    rows = rows.select(*keep, "__page", "__column", metadata_in_rows(F.col("__rows"), F.col("__column")).alias("a"))
    known = (F.col("a.description") != "") | ~F.col("a.data_type").isin("", "N/A")
    rows = rows.select(*keep, F.when(known, F.col("a")).otherwise(metadata_in_text(F.col("__page"), F.col("__column"))).alias("m"))
    return rows.select(*keep, "m.description", "m.data_type")


def six_cell_descriptions(pages: DataFrame, by: str, html_col: str = "html") -> DataFrame:
    """(by, column, description) from rows of CELLS cells or more that begin with a column name; the last row of a name counts."""
    rows = pages.select(by, F.posexplode(page_rows(F.col(html_col))).alias("ord", "cells"))
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    named = (F.size("cells") >= CELLS) & F.regexp_like(cell(0), F.lit("^[A-Z0-9_#$]+$")) & ~F.upper(cell(1)).isin("TYPE", "DATATYPE")
    told = (cell(COMMENT_AT) != "") & ~F.upper(cell(COMMENT_AT)).isin("COMMENTS", "DESCRIPTION")
    found = rows.where(named & told).select(by, F.upper(cell(0)).alias("column"), cell(COMMENT_AT).alias("description"), "ord")
    return last_wins(found, [by, "column"], "ord").select(by, "column", "description")


def query_text(html: Column) -> Column:
    """The longest <pre> that reads like a query, the first of equals; else all <p class="p"> together, if they do; else ''."""

    def pieces(pattern: str, gap: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))
        bare = text.unescape_html(F.array_join(F.transform(found, lambda b: F.regexp_replace(b, "<[^>]+>", gap)), _ROW))
        return F.transform(F.split(bare, _ROW), text.normalize_ws)

    is_query = lambda b: F.contains(F.upper(b), F.lit("SELECT ")) & F.contains(F.upper(b), F.lit(" FROM "))
    pres = F.filter(pieces(r"(?is)<pre[^>]*>(.*?)</pre>", " "), is_query)
    best = F.aggregate(pres, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    prose = text.normalize_ws(F.array_join(pieces(r"""(?is)<p[^>]*class=["']p["'][^>]*>(.*?)</p>""", ""), " "))
    return F.when(best != "", best).when(is_query(prose), prose).otherwise("")


def document_info(pages: DataFrame, table_col: str = "table", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(key, description) and (key, ref_ord, ref) of documentation pages, one for each table; a key is struct(table, column).

    The descriptions are those of six-cell rows; the references those of the page's query, by output column, to tables it names.
    """
    named = lineage.spread(pages.select(text.table_name(F.col(table_col)).alias("__table"), html_col))
    told = six_cell_descriptions(named, "__table", html_col)
    refs = lineage.select_references(named.select("__table", query_text(F.col(html_col)).alias("sql")), "__table")
    key = lambda t, c: F.struct(F.col(t).alias("table"), F.col(c).alias("column"))
    described = told.select(key("__table", "column").alias("key"), "description")
    edges = refs.select(key("__table", "out_alias").alias("key"), "ref_ord", key("ref_table", "ref_column").alias("ref"))
    return described, edges


def harvest_links(html: Column, site: str, paths: list[str], excluded: list[str]) -> Column:
    """The page's distinct links, in order, to hosts that end in site.

    Absolute links to the site come first, then links that begin with one of paths, made absolute, then those in redirects
    (?q= or ?url=). Links that hold an excluded part are left out.
    """
    quote = reduce(lambda s, c: s.replace(c, "\\" + c), ".-/?", site)
    grab = lambda pattern: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))
    own = grab(f'(?i)href="(https?://(?:[^"/]*\\.)?{quote}[^"]*)"')
    near = F.concat(F.array().cast("array<string>"), *[F.transform(grab(f'(?i)href="({p}[^"]+)"'), lambda x: F.concat(F.lit(f"https://{site}"), x)) for p in paths])
    sent = F.transform(grab(r'(?i)href="[^"]*/url\?(?:[^"]*?[&;])?(?:q|url)=(https?[^"&]+)'), lambda x: F.try_url_decode(x))
    links = F.transform(F.concat(own, near, sent), lambda x: F.replace(F.btrim(x), F.lit("&amp;"), F.lit("&")))
    host = lambda x: F.coalesce(F.lower(F.regexp_extract(x, r"(?i)^https?://([^/?#:]+)", 1)), F.lit(""))
    kept = F.filter(links, lambda x: host(x).endswith(site.lower()) & reduce(lambda a, e: a & ~F.contains(F.lower(x), F.lit(e)), excluded, F.lit(True)))
    return F.array_distinct(kept)


def cascade(keys: DataFrame, key: str, providers: list[tuple[str, DataFrame]], default: str = "N/A") -> DataFrame:
    """(key, description, provider) from the first provider, in order, with a description that is not blank; else the default.

    providers: a name and (key, description), a row for each key; as many joins as providers.
    """
    out, answers = keys.select(key), []
    for i, (name, rows) in enumerate(providers):
        out = out.join(rows.select(key, F.col("description").alias(f"__{i}")), key, "left")
        answers.append(F.when(F.btrim(F.coalesce(f"__{i}", F.lit(""))) != "", F.struct(F.col(f"__{i}").alias("description"), F.lit(name).alias("provider"))))
    last = F.struct(F.lit(default).alias("description"), F.lit("default").alias("provider"))
    return out.select(key, F.coalesce(*answers, last).alias("a")).select(key, "a.*")
