"""Queries on scoping: anchors, islands, windows and page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import scope
from concordia.plans.inputs import table

SQL: dict[str, str] = {}
#: Words that stand for groups: each occurs strictly, only inside other words, or not at all in some documents.
WORDS = ["the", "with", "anvil", "tion"]
#: Tokens that make a page relevant.
TOKENS = ["THATH", "ENTI", "RING"]


def _anchors(pages: Column) -> Column:
    """Structs (name, pages) of the words."""
    return F.array(*[F.struct(F.lit(w).alias("name"), scope.named_pages(pages, scope.literal_terms([w])).alias("pages")) for w in WORDS])


def _windows(pages: Column) -> Column:
    return scope.anchor_windows(_anchors(pages), F.size(pages).cast("long"), F.lit(len(WORDS)))


_BLOCKS = """
WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents),
pages AS (SELECT doc_id, generate_subscripts(b, 1) AS page_no, unnest(b) AS block FROM lines),
sizes AS (SELECT doc_id, count(*) AS n_pages FROM pages GROUP BY doc_id),
bare AS MATERIALIZED (SELECT *, regexp_replace(upper(replace(block, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS n FROM pages),
marks AS ("""
# one constant pattern for each word: a pattern made from a column would be compiled for each row
_BLOCKS += "\n  UNION ALL ".join(
    f"""SELECT doc_id, '{w}' AS name, page_no, regexp_matches(block, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 'i') AS strict, contains(n, '{w.upper()}') AS loose FROM bare"""
    for w in WORDS
)
_BLOCKS += """),
best AS (SELECT *, bool_or(strict) OVER (PARTITION BY doc_id, name) AS any_strict FROM marks),
anchors AS (SELECT doc_id, name, page_no FROM best WHERE CASE WHEN any_strict THEN strict ELSE loose END)
"""
_ISLANDS = """
, freq AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS f FROM anchors),
flagged AS (SELECT *, page_no <= 20 AND f >= 3 AS front FROM freq),
used AS (SELECT doc_id, name, page_no FROM (SELECT *, bool_or(NOT front) OVER (PARTITION BY doc_id, name) AS rest FROM flagged) WHERE NOT front OR NOT rest),
steps AS (SELECT *, CASE WHEN page_no - lag(page_no) OVER w <= 6 THEN 0 ELSE 1 END AS new FROM used WINDOW w AS (PARTITION BY doc_id, name ORDER BY page_no)),
ids AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, name ORDER BY page_no) AS cluster FROM steps),
islands AS (SELECT doc_id, name, cluster, min(page_no) AS first, max(page_no) AS last, count(*) AS size, list(page_no ORDER BY page_no) AS pp FROM ids GROUP BY ALL),
main AS (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY size DESC, first) = 1),
windows AS (SELECT doc_id, name, first AS window_start, pp, n_pages,
   greatest(first, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first, name) - 1, n_pages)) AS window_end FROM main JOIN sizes USING (doc_id))
"""


def q11_find_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name each of four words: whole words, or else normalised forms."""
    flat = lambda pages: F.flatten(F.transform(_anchors(pages), lambda g: F.transform(g["pages"], lambda p: F.struct(g["name"].alias("name"), p.alias("page_no")))))
    return scope.fold_documents(table(spark, sf_dir, "documents"), flat)


SQL["q11_find_pages"] = _BLOCKS + "SELECT doc_id, name, page_no FROM anchors"


def q12_cluster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of the anchors of each word, with the primary one marked, for both gaps."""

    def parted(g: Column, gap: int) -> Column:
        def marked(found: Column) -> Column:
            best = scope.primary(found)["first"]
            row = lambda x: F.struct(g["name"].alias("name"), F.lit(gap).cast("long").alias("gap"), x["first"].alias("first"), x["last"].alias("last"), x["size"].alias("size"), (x["first"] == best).alias("is_primary"))
            return F.transform(found, row)

        return text.let(scope.islands(g["pages"], gap), marked)

    gaps = (scope.RELEVANT_GAP, scope.ANCHOR_GAP)
    return scope.fold_documents(table(spark, sf_dir, "documents"), lambda pages: F.flatten(F.transform(_anchors(pages), lambda g: F.concat(*[parted(g, gap) for gap in gaps]))))


SQL["q12_cluster_pages"] = (
    _BLOCKS
    + """
, gaps AS (SELECT unnest([2, 6])::BIGINT AS gap),
steps AS (SELECT gap, doc_id, name, page_no, CASE WHEN page_no - lag(page_no) OVER (PARTITION BY gap, doc_id, name ORDER BY page_no) <= gap THEN 0 ELSE 1 END AS new FROM anchors, gaps),
ids AS (SELECT *, sum(new) OVER (PARTITION BY gap, doc_id, name ORDER BY page_no) AS cluster FROM steps),
islands AS (SELECT gap, doc_id, name, cluster, min(page_no) AS first, max(page_no) AS last, count(*) AS size FROM ids GROUP BY ALL)
SELECT doc_id, name, gap, first, last, size, row_number() OVER (PARTITION BY gap, doc_id, name ORDER BY size DESC, first) = 1 AS is_primary FROM islands
"""
)


def q13_anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.fold_documents(table(spark, sf_dir, "documents"), _windows).select("doc_id", "name", "window_start", "window_end")


SQL["q13_anchor_windows"] = _BLOCKS + _ISLANDS + "SELECT doc_id, name, window_start, window_end FROM windows"


def q14_select_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(*[F.lit(t) for t in TOKENS])
    picked = lambda w, pages: F.struct(w["name"].alias("name"), scope.select_pages(w, pages, F.size(pages).cast("long"), tokens).alias("pages"))
    chosen = scope.fold_documents(table(spark, sf_dir, "documents"), lambda pages: F.transform(_windows(pages), lambda w: picked(w, pages)))
    return chosen.select("doc_id", "name", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


SQL["q14_select_pages"] = (
    _BLOCKS
    + _ISLANDS
    + """
, norms AS (SELECT doc_id, page_no, regexp_replace(upper(replace(block, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS n FROM pages),
hits AS (SELECT w.doc_id, name, window_start, page_no FROM windows w JOIN norms n ON w.doc_id = n.doc_id AND page_no BETWEEN window_start AND window_end
         WHERE contains(n, 'THATH') OR contains(n, 'ENTI') OR contains(n, 'RING')),
hstep AS (SELECT *, CASE WHEN page_no - lag(page_no) OVER (PARTITION BY doc_id, name ORDER BY page_no) <= 2 THEN 0 ELSE 1 END AS new FROM hits),
hid AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, name ORDER BY page_no) AS c FROM hstep),
hisl AS (SELECT doc_id, name, c, min(page_no) AS lo, max(page_no) AS hi, count(*) AS size, any_value(window_start) AS ws FROM hid GROUP BY ALL),
besti AS (SELECT * FROM hisl QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY abs(lo - ws), size DESC, lo) = 1),
core AS (SELECT w.*, coalesce(greatest(window_start, lo - 1), window_start) AS a, coalesce(least(window_end, hi + 1), window_end) AS z FROM windows w LEFT JOIN besti b USING (doc_id, name)),
picked AS (
  SELECT doc_id, name, unnest(range(a, z + 1)) AS p FROM core
  UNION SELECT doc_id, name, p FROM (SELECT doc_id, name, n_pages, unnest(list_concat(pp, list_transform(pp, lambda x: x - 1), list_transform(pp, lambda x: x + 1))) AS p FROM core) WHERE p BETWEEN 1 AND n_pages
  UNION SELECT doc_id, name, unnest(range(x, y + 1)) FROM (SELECT doc_id, name, x, lead(x) OVER (PARTITION BY doc_id, name ORDER BY x) AS y FROM (SELECT doc_id, name, unnest(pp) AS x FROM core)) WHERE y - x BETWEEN 2 AND 3)
SELECT doc_id, name, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages FROM picked GROUP BY doc_id, name
"""
)
