"""Column lineage of SQL text: which table and column each output column comes from.

The text is data; it is never run. A scanner yields words, quoted strings and marks; the parser walks them by
nesting depth, knows common table expressions and derived tables, and resolves references through them.
Vendor SQL that Catalyst's own parser refuses is read as well. Everything is local to a row, so it runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import text

#: Words that end a FROM clause, and words that are never an alias.
ENDS = {"WHERE", "GROUP", "ORDER", "UNION", "CONNECT", "MINUS", "INTERSECT"}
RESERVED = ENDS | {"SELECT", "FROM", "JOIN", "ON", "AND", "OR", "AS", "CASE", "WHEN", "THEN", "ELSE", "END", "LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "BY", "HAVING", "USING", "WITH"}
DEPTH, SNIPPET, NAME = 2, 220, 64
_TOKEN = re.compile(r"""\s+|'(?:[^']|'')*'|"[^"]*"|[A-Za-z_][\w$#]*|\d+(?:\.\d+)?|.""", re.S)


@dataclass(frozen=True)
class Source:
    table: str
    column: str
    mode: str = "UNKNOWN"
    confidence: str = "LOW"
    snippet: str = ""


@dataclass(slots=True)
class Token:
    text: str
    depth: int
    start: int
    end: int
    word: str  # the name in upper case, without quotes; '' for anything else


@dataclass
class Scope:
    """What the names of a FROM clause stand for."""

    tables: dict[str, str] = field(default_factory=dict)  # alias: table
    derived: dict[str, dict[str, Source]] = field(default_factory=dict)
    ctes: dict[str, dict[str, Source]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)  # tables as they are met

    def resolve(self, alias: str, column: str) -> tuple[str, str]:
        if alias in self.derived:
            hit = self.derived[alias].get(column)
            return (hit.table, hit.column) if hit else ("UNKNOWN_SUBQUERY", column)
        table = self.tables.get(alias, alias)
        hit = self.ctes.get(table, {}).get(column)
        return (hit.table, hit.column) if hit else (table, column)


def strip_comments(sql: str) -> str:
    return re.sub(r"--[^\n]*", " ", re.sub(r"/\*.*?\*/", " ", sql, flags=re.S))


def scan(sql: str) -> list[Token]:
    out, depth = [], 0
    for m in _TOKEN.finditer(sql):
        t = m[0]
        if t.isspace():
            continue
        if t == ")":
            depth -= 1
        word = t.strip('"').upper() if t[0] == '"' or t[0].isalpha() or t[0] == "_" else ""
        out.append(Token(t, depth if depth > 0 else 0, m.start(), m.end(), word))
        if t == "(":
            depth += 1
    return out


def _split(tokens: list[Token], depth: int) -> list[list[Token]]:
    parts: list[list[Token]] = [[]]
    for t in tokens:
        if t.text == "," and t.depth == depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _closing(tokens: list[Token], at: int) -> int:
    """Place of the parenthesis that closes the one at at."""
    return next((i for i in range(at + 1, len(tokens)) if tokens[i].text == ")" and tokens[i].depth == tokens[at].depth), len(tokens))


def references(tokens: list[Token], scope: Scope) -> list[tuple[str, str]]:
    found = []
    for i in range(1, len(tokens) - 1):
        if tokens[i].text == ".":
            a, b = tokens[i - 1].word, tokens[i + 1].word
            if a and b and (i == 1 or tokens[i - 2].text != "."):
                found.append(scope.resolve(a, b))
    return list(dict.fromkeys(found))


def _dominant(tokens: list[Token], scope: Scope) -> tuple[str, str] | None:
    """The source of DECODE's results, if there is one; the first argument of NVL or COALESCE that has just one."""
    if len(tokens) < 3 or tokens[1].text != "(" or _closing(tokens, 1) != len(tokens) - 1:
        return None
    args = _split(tokens[2:-1], tokens[1].depth + 1)
    if tokens[0].word == "DECODE":
        results = args[2::2] + ([args[-1]] if len(args) >= 3 and len(args) % 2 == 0 else [])
        refs = list(dict.fromkeys(r for a in results for r in references(a, scope)))
        return refs[0] if len(refs) == 1 else None
    if tokens[0].word in ("NVL", "COALESCE"):
        return next((refs[0] for a in args if len(refs := references(a, scope)) == 1), None)
    return None


def _item(tokens: list[Token], sql: str, scope: Scope) -> tuple[str, Source]:
    whole = " ".join(sql[tokens[0].start : tokens[-1].end].split())
    last, expr, alias = tokens[-1], tokens, ""
    if len(tokens) > 2 and tokens[-2].word == "AS" and last.word:
        expr, alias = tokens[:-2], last.word
    elif len(tokens) > 1 and last.word and last.depth == tokens[0].depth and last.word not in RESERVED and tokens[-2].text not in list(".+-*/|=<>,("):
        expr, alias = tokens[:-1], last.word
    elif last.word and (len(tokens) == 1 or len(tokens) == 3 and tokens[1].text == "."):
        alias = last.word
    alias = alias or re.sub("[^A-Z0-9]", "", whole.upper())[:NAME] or "EXPR"
    refs, cut = references(expr, scope), whole[:SNIPPET]
    if len(expr) == 3 and expr[1].text == "." and refs:
        return alias, Source(*refs[0], "ALIAS" if alias != refs[0][1] else "DIRECT", "HIGH", cut)
    if len(refs) == 1:
        return alias, Source(*refs[0], "EXPRESSION", "MEDIUM", cut)
    if refs:
        main = _dominant(expr, scope)
        return alias, Source(*main, "EXPRESSION", "MEDIUM", cut) if main else Source("MULTI_SOURCE", "MULTI_SOURCE", "MULTI_SOURCE", "LOW", cut)
    if len(expr) == 1 and expr[0].word:
        return alias, Source("N/A", expr[0].word, "DIRECT", "MEDIUM", cut)
    return alias, Source("N/A", "UNKNOWN_SOURCE_COLUMN", "UNKNOWN", "LOW", cut)


def _name(tokens: list[Token], at: int) -> tuple[str, int]:
    """A possibly qualified name from at on: its last part, and where it ends."""
    name = tokens[at].word
    while at + 2 < len(tokens) and tokens[at + 1].text == "." and tokens[at + 2].word:
        at += 2
        name = tokens[at].word
    return name, at + 1


def _from(tokens: list[Token], sql: str, ctes: dict, depth: int, nested: int) -> Scope:
    scope = Scope(ctes=ctes)
    expect, i = True, 0
    while i < len(tokens):
        t = tokens[i]
        if t.depth == depth and t.word in ENDS:
            break
        if t.depth == depth and (t.text == "," or t.word == "JOIN"):
            expect, i = True, i + 1
            continue
        if not expect or t.depth != depth:
            i += 1
            continue
        expect = False
        if t.text == "(":
            end = _closing(tokens, i)
            after = end + 1 + (end + 1 < len(tokens) and tokens[end + 1].word == "AS")
            if nested and i + 1 < end and tokens[i + 1].word in ("SELECT", "WITH") and after < len(tokens) and tokens[after].word not in RESERVED | {""}:
                scope.derived[tokens[after].word] = select_map(tokens[i + 1 : end], sql, ctes, nested - 1)[0]
            i = end + 1
        elif t.word:
            name, i = _name(tokens, i)
            if i < len(tokens) and tokens[i].word == "AS":
                i += 1
            alias = tokens[i].word if i < len(tokens) and tokens[i].depth == depth else ""
            scope.tables[alias if alias and alias not in RESERVED else name] = name
            scope.order.append(name)
        else:
            i += 1
    return scope


def select_map(tokens: list[Token], sql: str, ctes: dict | None = None, nested: int = DEPTH) -> tuple[dict[str, Source], Scope]:
    """Output alias to source of a query's first SELECT, and its scope. A later column of a name replaces an earlier one."""
    ctes, at = dict(ctes or {}), 0
    if not tokens:
        return {}, Scope()
    depth = tokens[0].depth
    if tokens[0].word == "WITH":
        at = 1
        while at < len(tokens) and tokens[at].word and tokens[at].word != "SELECT":
            name, at = tokens[at].word, at + 1
            if at < len(tokens) and tokens[at].text == "(":  # a list of column names is passed over
                at = _closing(tokens, at) + 1
            at += at < len(tokens) and tokens[at].word == "AS"
            if at >= len(tokens) or tokens[at].text != "(":
                break
            end = _closing(tokens, at)
            ctes[name] = select_map(tokens[at + 1 : end], sql, ctes, nested)[0]
            at = end + 1 + (end + 1 < len(tokens) and tokens[end + 1].text == ",")
    main = tokens[at:]
    begin = next((i for i, t in enumerate(main) if t.word == "SELECT" and t.depth == depth), None)
    if begin is None:
        return {}, Scope(ctes=ctes)
    mid = next((i for i in range(begin + 1, len(main)) if main[i].word == "FROM" and main[i].depth == depth), None)
    if mid is None:
        return {}, Scope(ctes=ctes)
    scope = _from(main[mid + 1 :], sql, ctes, depth, nested)
    return dict(_item(p, sql, scope) for p in _split(main[begin + 1 : mid], depth)), scope


def parse(sql: str | None) -> tuple[dict[str, Source], Scope]:
    bare = strip_comments(sql or "")
    return select_map(scan(bare), bare)


#: Tasks for each core that queries are dealt to.
TASKS = 3


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over the cores. Reading cuts a table by bytes, and millions of short texts that take long to parse may be one small file."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism))


#: Arrow types of the columns of lineage() beside the key, and of the columns that it adds if asked for.
_LINEAGE = {"ord": pa.int64(), "out_alias": pa.string(), "source_table": pa.string(), "source_column": pa.string(), "source_mode": pa.string(), "source_confidence": pa.string(), "snippet": pa.string()}
_SOURCES = {"tables": pa.list_(pa.string()), "aliases": pa.map_(pa.string(), pa.string())}


def lineage(queries: DataFrame, key: str, sql_col: str = "sql", with_sources: bool = False) -> DataFrame:
    """(key, ord, out_alias, source_table, source_column, source_mode, source_confidence, snippet) per output column.

    with_sources adds tables and aliases, as of sources(), to each row: a query is parsed once and nothing is joined.
    """
    types = _LINEAGE | (_SOURCES if with_sources else {})
    schema = f"{key} {dict(queries.dtypes)[key]}, ord long, out_alias string, source_table string, source_column string, source_mode string, source_confidence string, snippet string"
    schema += ", tables array<string>, aliases map<string,string>" if with_sources else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, q in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found, scope = parse(q.as_py())
                beside = (list(dict.fromkeys(scope.order)), list(scope.tables.items())) if with_sources else ()
                rows += [(k, i, a, s.table, s.column, s.mode, s.confidence, s.snippet, *beside) for i, (a, s) in enumerate(found.items(), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [b.column(0).type, *types.values()], strict=True)], names=[key, *types])

    return spread(queries.select(key, sql_col)).mapInArrow(run, schema)


def sources(queries: DataFrame, key: str, sql_col: str = "sql") -> DataFrame:
    """(key, tables, aliases): distinct tables in order, and alias to table, of each query's FROM clause."""
    schema = f"{key} {dict(queries.dtypes)[key]}, tables array<string>, aliases map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scopes = [parse(q.as_py())[1] for q in b.column(1)]
            tables = pa.array([list(dict.fromkeys(s.order)) for s in scopes], pa.list_(pa.string()))
            aliases = pa.array([list(s.tables.items()) for s in scopes], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), tables, aliases], names=[key, "tables", "aliases"])

    return spread(queries.select(key, sql_col)).mapInArrow(run, schema)


def post_resolve(rows: DataFrame) -> DataFrame:
    """Checks each source against the query's own tables, natively on columns.

    rows: as of lineage() with tables and aliases of the query. An alias becomes its table; an unknown table is looked
    for in the snippet; what stays unknown is N/A, UNRESOLVED, LOW. Adds the reason.
    """
    known = F.array_union("tables", F.map_values("aliases"))
    table = F.upper(text.normalize_ws(F.col("source_table")))
    named = F.try_element_at("aliases", table)
    after = F.coalesce(named, table)
    dotted = r"\b([A-Za-z_][\w$#]*)\.([A-Za-z_][\w$#]*)\b"
    ref, col = (F.upper(F.regexp_extract("snippet", dotted, i)) for i in (1, 2))
    by_alias, by_table = F.try_element_at("aliases", ref), F.when(F.array_contains(known, ref), ref)
    lost = ~F.array_contains(known, after)
    found = F.coalesce(by_alias, by_table)
    multi = F.col("source_mode") == "MULTI_SOURCE"
    final = F.when(lost & found.isNotNull(), found).otherwise(after)
    unknown = ~F.array_contains(known, final) & (final != "N/A")
    reason = F.when(multi, "multi_source_expression").when(unknown, "unresolved_or_derived_alias").when(lost & by_alias.isNotNull(), "resolved_from_sql_snippet_alias").when(lost & by_table.isNotNull(), "resolved_from_sql_snippet_table").when(named.isNotNull(), "alias_to_table").otherwise("ok")
    return rows.withColumns(
        {
            "source_table": F.when(multi, "MULTI_SOURCE").when(unknown, "N/A").otherwise(final),
            "source_column": F.when(multi, "MULTI_SOURCE").when(lost & found.isNotNull(), col).otherwise(F.upper("source_column")),
            "source_mode": F.when(~multi & unknown, "UNRESOLVED").otherwise(F.col("source_mode")),
            "source_confidence": F.when(~multi & unknown, "LOW").otherwise(F.col("source_confidence")),
            "reason": reason,
        }
    )


def select_references(queries: DataFrame, key: str, sql_col: str = "sql") -> DataFrame:
    """(key, out_alias, ref_ord, ref_table, ref_column): what each output column's expression refers to, in order.

    Only references through a name of the FROM clause count.
    """
    schema = f"{key} {dict(queries.dtypes)[key]}, out_alias string, ref_ord long, ref_table string, ref_column string"
    names = [key, "out_alias", "ref_ord", "ref_table", "ref_column"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, a, i, t, c) for k, q in zip(b.column(0).to_pylist(), b.column(1), strict=True) for a, refs in references_by_output(q.as_py()).items() for i, (t, c) in enumerate(refs)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, b.column(0).type if not i else None) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    return spread(queries.select(key, sql_col)).mapInArrow(run, schema)


def references_by_output(sql: str | None) -> dict[str, list[tuple[str, str]]]:
    """Output alias to the (table, column) pairs of its expression, of a query's first SELECT."""
    bare = strip_comments(sql or "")
    tokens = scan(bare)
    begin = next((i for i, t in enumerate(tokens) if t.word == "SELECT" and not t.depth), None)
    mid = None if begin is None else next((i for i in range(begin + 1, len(tokens)) if tokens[i].word == "FROM" and not tokens[i].depth), None)
    if mid is None:
        return {}
    scope = _from(tokens[mid + 1 :], bare, {}, 0, DEPTH)
    known = set(scope.order)
    return {_item(p, bare, scope)[0]: [r for r in references(p, scope) if r[0] in known] for p in _split(tokens[begin + 1 : mid], 0)}


def fill_defaults(rows: DataFrame, suffix: str = "_LINK") -> DataFrame:
    """Rows (field, sql, tables, source_table, source_column, source_mode, source_confidence, snippet) with blanks filled.

    A field that the query's map does not name comes from the query's first table, under its own name, unknown. If the source is
    unknown or unresolved and the field ends in suffix, the name without it, as a word of the query, is its source.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("sql", F.lit("")), r"(?s)/\*.*?\*/", " "), r"--[^\n\r]*", " ")
    name = F.upper("field")
    base = F.substring(name, F.lit(1), F.length(name) - len(suffix))
    filled = rows.withColumns(
        {
            "source_table": F.coalesce("source_table", F.get("tables", 0), F.lit("N/A")),
            "source_column": F.coalesce("source_column", name),
            "source_mode": F.coalesce("source_mode", F.lit("UNKNOWN")),
            "source_confidence": F.coalesce("source_confidence", F.lit("LOW")),
            "snippet": F.coalesce("snippet", F.lit("")),
        }
    )
    linked = F.col("source_mode").isin("UNKNOWN", "UNRESOLVED") & name.endswith(suffix) & (base != "") & F.regexp_like(bare, F.concat(F.lit(r"(?i)\b\Q"), base, F.lit(r"\E\b")))
    return filled.withColumn("__linked", linked).withColumns(
        {
            "source_column": F.when(F.col("__linked"), base).otherwise(F.col("source_column")),
            "source_mode": F.when(F.col("__linked"), "ALIAS").otherwise(F.col("source_mode")),
            "source_confidence": F.when(F.col("__linked"), "MEDIUM").otherwise(F.col("source_confidence")),
            "snippet": F.when(F.col("__linked") & (F.col("snippet") == ""), F.concat(base, F.lit(" ... "), name)).otherwise(F.col("snippet")),
        }
    ).drop("__linked")
