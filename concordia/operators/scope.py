"""Which blocks of a document belong to which model: anchors, islands, windows and page selection.

A document's pages are one array, and every step is a fold over it inside the document's row: nothing is exploded before the
result and nothing is shuffled. Pages are structs (page_no, block, norm), in order; groups are structs (name, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import text

ANCHOR_GAP, RELEVANT_GAP, FRONT_PAGES, LEAST_FRONT = 6, 2, 20, 3


def _lines(text_col: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), text.normalize_ws), lambda x: x != "")


def blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, page_no, block): non-blank lines with collapsed white space, numbered from 1."""
    return docs.select("doc_id", F.posexplode(_lines(text_col)).alias("p", "block")).select("doc_id", (F.col("p") + 1).cast("long").alias("page_no"), "block")


def blocks_with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """blocks() with n_pages, the number of blocks of the document, so nothing has to count them again."""
    # the outer form keeps the optimizer from splitting the text a second time, as a filter for empty arrays
    rows = docs.select("doc_id", _lines(text_col).alias("__l")).select("doc_id", F.size("__l").cast("long").alias("n_pages"), F.posexplode_outer("__l").alias("p", "block"))
    return rows.where("p IS NOT NULL").select("doc_id", (F.col("p") + 1).cast("long").alias("page_no"), "block", "n_pages")


#: Fields of a dataset that give tokens, their least length, prefixes that datasets are also known without, and hits that are kept of a page.
TOKEN_FIELDS, TOKEN_LENGTH, PREFIXES, MOST_HITS = 24, 6, ("G_", "Q_"), 20


def scope_tokens(name: Column, source: Column, fields: Column) -> Column:
    """A dataset's tokens: its name and source with and without their prefix, then the long ones of its first fields; each once."""
    marks = []
    for x in (name, source):
        bare = F.when(reduce(lambda a, p: a | F.startswith(F.upper(x), F.lit(p)), PREFIXES, F.lit(False)), text.normalize_token(F.substring(x, F.lit(3), F.length(x))))
        marks += [text.normalize_token(x), F.coalesce(bare, F.lit(""))]
    long = F.filter(F.transform(F.slice(fields, 1, TOKEN_FIELDS), text.normalize_token), lambda f: F.length(f) >= TOKEN_LENGTH)
    return F.array_distinct(F.concat(F.filter(F.array(*marks), lambda t: t != ""), F.coalesce(long, F.array().cast("array<string>"))))


def relevance_hits(norm: Column, tokens: Column) -> Column:
    """The tokens that a normalised block holds, in order, MOST_HITS at most."""
    return F.slice(F.filter(tokens, lambda t: F.contains(norm, t)), 1, MOST_HITS)


def page_array(text_col: str = "text") -> Column:
    """The pages of a document's text: its blocks, numbered from 1, with their normalised form."""
    return F.transform(_lines(text_col), lambda x, i: F.struct((i + 1).cast("long").alias("page_no"), x.alias("block"), text.normalize_token(x).alias("norm")))


def page_lists(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, n_pages) from rows (doc_id, page_no, block, n_pages), with table_text if they have it: one row for each document, one exchange."""
    page = F.struct(*[c for c in ("page_no", "block", "table_text") if c in pages.columns])
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.max("n_pages").alias("n_pages"))


def with_norms(pages: Column) -> Column:
    """The pages of page_lists() with their normalised form."""
    return F.transform(pages, lambda x: x.withField("norm", text.normalize_token(x["block"])))


def search_terms(names: Column) -> Column:
    """What named_pages() looks for: a pattern of whole words (null without a name), normalised forms, whether a name has none."""
    own = F.filter(names, lambda n: n != "")
    word = F.array_join(F.transform(own, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    pattern = F.when(F.size(own) > 0, F.concat(F.lit("(?i)\\b(?:"), word, F.lit(")\\b")))
    bare = F.filter(F.transform(own, text.normalize_token), lambda n: n != "")
    return F.struct(pattern.alias("word"), bare.alias("bare"), (F.size(bare) < F.size(own)).alias("odd"))


def literal_terms(names: Iterable[str]) -> Column:
    """search_terms() of given names, with a constant pattern, which is compiled once."""
    own = [n for n in names if n]
    forms = [text.normalize_token(F.lit(n)) for n in own]
    bare = F.filter(F.array(*forms), lambda n: n != "") if forms else F.array().cast("array<string>")
    pattern = "(?i)\\b(?:" + "|".join(rf"\Q{n}\E" for n in own) + ")\\b" if own else None
    return F.struct(F.lit(pattern).cast("string").alias("word"), bare.alias("bare"), reduce(lambda a, f: a | (f == ""), forms, F.lit(False)).alias("odd"))


def named_pages(pages: Column, terms: Column) -> Column:
    """Numbers of the pages with one of the names as a whole word; if there are none, of those that hold a normalised form."""
    loose = lambda e: F.exists(terms["bare"], lambda t: F.contains(e["norm"], t))
    # A whole word is also there in normalised form: only such pages, or all for names without one, are searched by pattern.
    near = F.filter(pages, lambda e: loose(e) | terms["odd"])

    def choose(near: Column) -> Column:
        strict = F.filter(near, lambda e: F.regexp_like(e["block"], terms["word"]))
        return text.let(strict, lambda found: F.when(F.size(found) > 0, found).otherwise(F.filter(near, loose)))

    return F.transform(text.let(near, choose), lambda e: e["page_no"])


def islands(numbers: Column, gap: int) -> Column:
    """Structs (first, last, size, pages) of sorted page numbers; a step of more than gap pages parts them."""

    def cut(p: Column) -> Column:
        places = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        parted = lambda i: F.coalesce(F.get(p, i) - F.get(p, i - 1) > gap, F.lit(True))
        starts = F.filter(places, parted)
        ends = F.filter(places, lambda i: parted(i + 1))
        whole = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda x: F.slice(p, x["a"] + 1, x["z"] - x["a"] + 1))
        return F.transform(whole, lambda own: F.struct(F.get(own, 0).alias("first"), F.element_at(own, -1).alias("last"), F.size(own).cast("long").alias("size"), own.alias("pages")))

    return text.let(numbers, cut)


def primary(found: Column) -> Column:
    """The largest island, the earliest of equals."""
    return F.array_min(F.transform(found, lambda x: F.struct((-x["size"]).alias("less"), x["first"], x["last"], x["pages"])))


def anchor_windows(anchors: Column, n_pages: Column, n_groups: Column) -> Column:
    """Structs (name, window_start, window_end, primary_pages) of the groups that have anchors, by window_start and name.

    anchors: structs (name, pages); n_groups: of the document. Early pages that many groups name are front matter and do not
    count, unless a group has no others. A window ends before the next one starts, the last with the document.
    """
    many = F.greatest(F.lit(LEAST_FRONT), F.floor(n_groups / 6))

    def windows(named: Column) -> Column:
        naming = lambda p: F.size(F.filter(named, lambda g: F.array_contains(g["pages"], p)))
        front = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(FRONT_PAGES).cast("long")), lambda p: naming(p) >= many)

        def starts(front: Column) -> Column:
            def start(g: Column) -> Column:
                used = text.let(F.array_except(g["pages"], front), lambda rest: F.when(F.size(rest) > 0, rest).otherwise(g["pages"]))
                return text.let(primary(islands(used, ANCHOR_GAP)), lambda m: F.struct(m["first"].alias("first"), g["name"].alias("name"), m["pages"].alias("pages")))

            return F.array_sort(F.transform(named, start))

        def close(found: Column) -> Column:
            end = lambda w, i: F.greatest(w["first"], F.coalesce(F.get(found, i + 1)["first"] - 1, n_pages))
            return F.transform(found, lambda w, i: F.struct(w["name"].alias("name"), w["first"].alias("window_start"), end(w, i).alias("window_end"), w["pages"].alias("primary_pages")))

        return text.let(text.let(front, starts), close)

    return text.let(F.filter(anchors, lambda g: F.size(g["pages"]) > 0), windows)


def select_pages(window: Column, pages: Column, n_pages: Column, tokens: Column) -> Column:
    """The sorted numbers of the pages to audit for a window of anchor_windows().

    Relevant pages of the window (holding a token) form islands; the one nearest the first anchor, widened by a page
    within the window, is joined by the anchors, their neighbours, and short gaps between anchors.
    """
    start, end, anchors = window["window_start"], window["window_end"], window["primary_pages"]
    relevant = F.filter(pages, lambda e: e["page_no"].between(start, end) & F.exists(tokens, lambda t: F.contains(e["norm"], t)))
    ranked = F.transform(islands(F.transform(relevant, lambda e: e["page_no"]), RELEVANT_GAP), lambda x: F.struct(F.abs(x["first"] - start), -x["size"], x["first"].alias("first"), x["last"].alias("last")))
    none = F.array().cast("array<bigint>")

    def joined(best: Column) -> Column:
        low = F.coalesce(F.greatest(start, best["first"] - 1), start)
        high = F.coalesce(F.least(end, best["last"] + 1), end)
        core = F.when(low <= high, F.sequence(low, high)).otherwise(none)
        near = F.filter(F.flatten(F.transform(anchors, lambda p: F.array(p - 1, p, p + 1))), lambda p: (p >= 1) & (p <= n_pages))

        def bridge(p: Column, i: Column) -> Column:
            after = F.get(anchors, i + 1)
            return F.when((after - p).between(2, 3), F.sequence(p, after)).otherwise(none)

        return F.array_sort(F.array_distinct(F.concat(core, near, F.flatten(F.transform(anchors, bridge)))))

    return text.let(F.array_min(ranked), joined)


def fold_documents(docs: DataFrame, fold: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """(doc_id, ...) of the structs that fold(pages) gives for each document; documents without any are left out."""
    # the outer form keeps the optimizer from evaluating the fold a second time, as a filter for empty arrays
    found = docs.select("doc_id", F.inline_outer(F.transform(text.let(page_array(text_col), fold), lambda x: F.struct(x.alias("x")))))
    return found.where("x IS NOT NULL").select("doc_id", "x.*")
