"""Scalar rules on text as column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Declared XML Schema types and the vendor type of each.
XSD_TYPES = {
    "VARCHAR2": ["string", "normalizedstring", "token", "anyuri", "boolean"],
    "NUMBER": ["double", "decimal", "float", "int", "integer", "long", "short", "nonnegativeinteger", "positiveinteger"],
    "DATE": ["date"],
    "TIMESTAMP": ["datetime", "time"],
}
#: Labels of noise words in file names, and the pattern of each.
NOISE = {
    "TEST": "TEST",
    "ORIGINAL": "ORIGINAL",
    "BKP": r"BKP\d*",
    "DEBUG": "DEBUG",
    "COPY": r"COPY\d*",
    "RC": r"RC(?:V?\d+)?",
    "PLUS": "PLUS",
    "JAN20XXXX": r"JAN20\d\d",
    "AGUARDANDO": "AGUARDANDO",
    "CLIENTE": "CLIENTE",
    "ANALISE": "ANALISE",
    "ANALYSE": "ANALYSE",
    "PERFORMANCE": "PERFORMANCE",
    "HYDRUS": "HYDRUS",
}
#: Words that are no table name.
NOT_TABLES = ["SELECT", "FROM", "WHERE", "GROUP", "ORDER", "BY", "UNION", "JOIN", "ON", "AND", "OR", "AS", "CASE", "WHEN", "END", "N/A", "MULTI_SOURCE", "UNKNOWN_SUBQUERY", "UNKNOWN", "UNRESOLVED", "WHH", "CNPJ"]
OFFICIAL, BASELINE = 10_000_000, 1_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once, however often use refers to it, inside lambdas as well."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_token(x: Column) -> Column:
    """Upper case, then A-Z and 0-9 alone; accented letters are dropped."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def _folded(texts: pd.Series) -> pd.Series:
    def fold(s: str | None) -> str:
        kept = "".join(c for c in unicodedata.normalize("NFKD", (s or "").strip()) if not unicodedata.combining(c)).upper()
        return "".join(c for c in kept if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    return texts.map(fold)


def fold_accents(x: Column) -> Column:
    """As normalize_token, with accents folded first: Spark SQL has no NFKD, so this is an Arrow UDF."""
    return F.pandas_udf(_folded, "string")(x)


#: Letters of the Latin blocks that are an ASCII letter with marks, and that letter.
_MARKED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))}


def fold_latin(x: Column) -> Column:
    """fold_accents() for Latin letters, built in: marks go, letters stay, then as normalize_token."""
    return normalize_token(F.translate(F.btrim(x), "".join(_MARKED), "".join(_MARKED.values())))


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else html.unescape(s))


def unescape_html(x: Column) -> Column:
    """The whole table of HTML entities, which no built-in function has."""
    return F.pandas_udf(_unescaped, "string")(x)


def normalize_ws(x: Column) -> Column:
    """Runs of Unicode white space become a space; none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def xsd_type(x: Column) -> Column:
    bare = F.lower(F.btrim(F.coalesce(x, F.lit(""))))
    bare = F.btrim(F.regexp_replace(bare, "^[^:]*:", ""))
    out = F.lit("N/A")
    for vendor, names in XSD_TYPES.items():
        out = F.when(bare.isin(names), vendor).otherwise(out)
    return out


def infer_type(sample: Column) -> Column:
    """Type by the shape of a sample; the order of the rules matters."""
    s = F.btrim(F.coalesce(sample, F.lit("")))
    return (
        F.when(s == "", "N/A")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"), "TIMESTAMP")
        .when(s.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), "DATE")
        .when(s.rlike(r"^[+-]?\d+(?:[.,]\d+)?$"), "NUMBER")
        .otherwise("VARCHAR2")
    )


def version(name: Column) -> Column:
    """The largest N of a vN token behind _ or - or anything but a letter; 0 if there is none."""
    hits = F.regexp_extract_all(name, F.lit(r"(?i)(?:^|[^a-z])v(\d+)\b"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(hits, lambda n: n.cast("int"))), F.lit(0))


def _trim_marks(x: Column) -> Column:
    return F.btrim(x, F.lit(" _-"))


def clean_base(name: Column) -> Column:
    """A file's base name without extension and version tokens."""
    steps = [(r"(?i)\.xdmz$", ""), (r"(?i)[_-]?version\d+\b", ""), (r"(?i)[_-]?v\d+[a-z0-9]*\b", ""), (r"(?i)(?<=[A-Za-z])v\d+\b", ""), ("__+", "_")]
    return _trim_marks(reduce(lambda x, s: F.regexp_replace(x, *s), steps, name))


def noise_reasons(base: Column) -> Column:
    up = F.upper(base)
    return F.filter(F.array(*[F.when(up.rlike(rf"(^|[_\-\s]){p}([_\-\s]|$)"), F.lit(label)) for label, p in NOISE.items()]), lambda x: x.isNotNull())


def group_key(base: Column) -> Column:
    mark = r"(?i)(^|[_-])INCREMENTAL($|[_-])"
    bucket = _trim_marks(F.regexp_replace(base, mark, "_"))
    return F.when(base.rlike(mark), F.concat(bucket, F.lit("_Incremental"))).otherwise(bucket)


def score(official: Column, version_: Column, modified: Column) -> Column:
    return F.when(official, OFFICIAL).otherwise(0) + F.when(version_ == 0, BASELINE).otherwise(0) + F.unix_micros(modified) / F.lit(1e9) - version_


#: What a name may be known without: Dm before a mark or the end, or anywhere; and the word Extract.
DM_RULES, EXTRACT = ("", r"(?i)Dm(?=(_|$))", "(?i)Dm"), r"(?i)(^|[_-])Extract(?=[_-]|$)"


def name_variants(key: Column) -> Column:
    """Names to look for in a document, in order, each once: the base and the base without Extract, under each Dm rule."""
    bases = [clean_base(key)]
    bases.append(F.regexp_replace(bases[0], EXTRACT, "_"))
    found = [_trim_marks(F.regexp_replace(F.regexp_replace(base, rule, "") if rule else base, "__+", "_")) for base in bases for rule in DM_RULES]
    return F.filter(F.array_distinct(F.array(*found)), lambda x: x != "")


def table_name(x: Column) -> Column:
    return F.substring_index(F.upper(F.btrim(F.btrim(F.coalesce(x, F.lit(""))), F.lit("\"'`"))), ".", -1)


def is_table_name(x: Column) -> Column:
    up = F.upper(F.btrim(F.coalesce(x, F.lit(""))))
    return ~up.isin(NOT_TABLES) & up.rlike(r"^[A-Z][A-Z0-9_$#]*(?:\.[A-Z][A-Z0-9_$#]*)?$")


def strip_tags(x: Column, gap: str = "") -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", gap))


def safe_name(x: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit("extractor"))


def escape_html(x: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], x)


def linked_cell(name: Column, url: Column) -> Column:
    link = F.concat(F.lit('<a href="'), escape_html(url), F.lit('">'), escape_html(name), F.lit("</a>"))
    return F.when(F.coalesce(url, F.lit("")) == "", escape_html(name)).otherwise(link)


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to a number from 0."""
    return (F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64) - 1).cast("long")


def column_letters(index: Column, digits: int = 14) -> Column:
    """The inverse of column_index, for names of up to the given number of letters; fourteen hold every long."""

    def step(s: Column, _: Column) -> Column:
        letter = F.char(((s["n"] - 1) % 26 + 65).cast("int"))
        return F.when(s["n"] > 0, F.struct(F.call_function("div", s["n"] - 1, F.lit(26).cast("long")).alias("n"), F.concat(letter, s["out"]).alias("out"))).otherwise(s)

    start = F.struct((index.cast("long") + 1).alias("n"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda s: s["out"])


def option_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), F.btrim), lambda p: p != "")
