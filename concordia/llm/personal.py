"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are exact patterns with a check. Beyond them, wider candidate spans (keys of known
makers, hexadecimal secrets, IBANs, identity numbers, street addresses, names behind a title or cue, long numbers) get
votes from labelers: shape, checksum, a gazetteer of cue words, the context on either side, and the borders of the span.
Expectation-maximisation over the counts of vote patterns (a bounded table) estimates how reliable each labeler is. It is anchored:
valid base spans are known positives, matches of base patterns that fail their check known negatives, and no labeler may be worse
than chance, so the classes cannot trade places. Its posteriors train the final span classifier, a naive Bayes over
features of the span, which decides the candidates that no base span overlaps.

Defined results: null text counts as empty; texts without a span have empty lists; rows that repeat an id are
scanned one by one; of equal places the kind listed first counts; very long texts and spans are read whole (cue words are looked for in the CONTEXT
characters before a span); an empty table gives an empty result; other columns are ignored, whatever their names. All of a span's places are code points.
Only built-in functions are used; the driver sees counts of vote patterns and features, never rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import documents, materialize, whole_text

#: Base kinds in order, with their patterns. Possessive groups take the same matches and need no recursion.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to have a span of the kind.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Key formats of well-known makers.
KEY = r"(?:AKIA|ASIA)[0-9A-Z]{16}\b|sk-[A-Za-z0-9_-]{20,}+|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
HEX = r"(?:(?=[0-9]*[a-f])[0-9a-f]{32,}+|(?=[0-9]*[A-F])[0-9A-F]{32,}+)"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
STREETS = r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square"
ADDRESS = rf"\b[0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}(?:{STREETS})\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|platz|allee|gasse) [0-9]{{1,4}}[a-z]?\b"
TITLES = r"[Nn]ame is |[Nn]ame: |Mr\.? |Mrs\.? |Ms\.? |Dr\.? |Herr |Frau |Señor |Señora |Monsieur |Madame "
NAME = rf"(?<=\b(?:{TITLES}))\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+){{0,3}}"
NUMBER = r"(?:\([0-9]{2,4}\)[ .-]?)?[0-9](?:[ .()-]?[0-9]){6,}+"
CANDIDATE = "|".join([KEY, IBAN, HEX, ADDRESS, r"\b[0-9]{13,19}+\b", NUMBER, NAME])
#: What a text must contain to have a candidate.
CANDIDATE_NEEDS = rf"[0-9][ .()-]?[0-9]|[0-9A-Fa-f]{{32}}|{TITLES}|[0-9] [A-Z]|(?:straße|strasse|platz|allee|gasse) [0-9]|sk-|eyJ|xox|gh[pousr]_|AKIA|ASIA|AIza"
#: Shapes of candidates, the first that fits: kind, pattern, and the vote of the shape labeler.
SHAPES = {
    "key": (f"^(?:{KEY})$", 1),
    "secret": (f"^{HEX}$", 1),
    "iban": (f"^{IBAN}$", 1),
    "ssn": ("^[0-9]{3}-[0-9]{2}-[0-9]{4}$", 1),
    "local_phone": (r"^\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$", 1),
    "address": (f"^(?:{ADDRESS})$", 1),
    "name": (r"^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*$", 1),
    "account": ("^[0-9]{8,20}$", 0),
    "number": ("", -1),
}
CUES = "phone|telephone|tel|call|mobile|cell|fax|contact|ssn|social|security|card|visa|credit|account|iban|passport|secret|token|key|apikey|password|passwd|pwd|bearer|email|mail|name|address|lives|born|dob|licence|license|insurance|patient|customer|konto|telefon|adresse|nombre|teléfono|téléphone"
AGAINST = "isbn|version|chapter|page|pages|section|figure|table|year|issue|volume|commit|sha|checksum|md5|revision"
LABELERS, CONTEXT, ROUNDS, ACCEPT = ("shape", "check", "gazetteer", "context", "border"), 40, 500, 0.5
FEATURES = ("v_shape", "v_check", "f_length", "f_mix", "f_before", "f_after", "f_cue")


def _finds(kind: str, text: Column, pattern: str, needs: str) -> Column:
    """An array of (kind, i, gap, match, left, right): each match with the length of the text since the match before."""
    has = F.contains(text, F.lit(needs)) if len(needs) == 1 else F.regexp_like(text, F.lit(needs))
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def entry(hit: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.char_length(F.get(gaps, i)).cast("long").alias("gap"),
            hit.alias("match"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"),
            F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("right"),
        )

    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,match:string,left:string,right:string>>")
    return F.when(has, F.transform(hits, entry)).otherwise(none)


def raw_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end, match, left, right): every match, and for each row one with kind null."""
    text = F.col(text_col)
    patterns = [(k, p, NEEDS[k]) for k, p in BASE.items()] + [("candidate", CANDIDATE, CANDIDATE_NEEDS)]
    mark = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"), F.lit("").alias("match"), F.lit("").alias("left"), F.lit("").alias("right")))
    found = rows.select("row", "doc_id", F.explode(F.concat(mark, *[_finds(k, text, p, n) for k, p, n in patterns])).alias("s")).select("row", "doc_id", "s.*")
    before = Window.partitionBy("row", "kind").orderBy("i")
    length = F.char_length("match").cast("long")
    end = F.sum(F.col("gap") + length).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("end", end).select("row", "doc_id", "kind", (F.col("end") - length).alias("start"), "end", "match", "left", "right")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check."""
    back = F.rpad(F.reverse(digits), 19, "0")  # zeros add nothing to the sum
    twice = F.translate(back, "0123456789", "0246813579")
    return reduce(lambda a, b: a + b, [F.ascii(F.substring(twice if i % 2 else back, i + 1, 1)) - 48 for i in range(19)]) % 10 == 0


def valid_base(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.regexp_like(match, F.lit(rf"^{part}(?:\.{part}){{3}}$")))
        .when(kind == "card", n.between(13, 19) & luhn(digits))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def valid_iban(match: Column) -> Column:
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return rest == 1


def votes(spans: DataFrame) -> DataFrame:
    """spans (kind, base, match, left, right) with their shape, a column of -1, 0 or 1 for each labeler, and features."""
    shape, formed = F.lit("number"), F.lit(-1)
    for name, (pattern, vote) in reversed(SHAPES.items()):
        fits = F.regexp_like("match", F.lit(pattern))
        shape, formed = (F.when(fits, F.lit(name)).otherwise(shape), F.when(fits, F.lit(vote)).otherwise(formed)) if pattern else (shape, formed)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    yes_no = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    cue = F.regexp_like("left", F.lit(rf"(?i)\b(?:{CUES})\b[^A-Za-z]{{0,6}}(?:[a-z]{{1,8}}[^A-Za-z]{{1,4}})?$"))
    against = F.regexp_like("left", F.lit(rf"(?i)\b(?:{AGAINST})\b[^A-Za-z]{{0,6}}$"))
    edge = lambda side, at: F.when(F.col(side) == "", "edge").when(F.regexp_like(side, F.lit(at % r"\s")), "space").when(F.regexp_like(side, F.lit(at % "[\"'=:<>(]")), "mark").when(F.regexp_like(side, F.lit(at % "[,;.!?)]")), "stop").when(F.regexp_like(side, F.lit(at % r"[\p{L}0-9_]")), "word").otherwise("other")
    rows = spans.withColumns({"shape": F.when(F.col("base"), F.col("kind")).otherwise(shape), "f_before": edge("left", "%s$"), "f_after": edge("right", "^%s")})
    quoted = F.regexp_like("left", F.lit("[\"'=:]\\s*[\"']?$"))
    clean = ("edge", "space", "mark", "stop")
    mix = F.concat(*[F.when(F.regexp_like("match", F.lit(x)), name).otherwise("") for name, x in (("d", "[0-9]"), ("l", r"\p{Ll}"), ("u", r"\p{Lu}"), ("s", r"[ ()]"), ("p", r"[.@_+-]"))])
    checked = F.when(F.col("shape") == "iban", yes_no(valid_iban(F.col("match")), F.lit(True))).when(n.between(13, 19) & F.col("shape").isin("account", "number"), yes_no(luhn(digits), F.lit(True)))
    return rows.withColumns(
        {
            "v_shape": F.when(F.col("base"), 1).otherwise(formed),
            "v_check": F.when(F.col("base"), F.when(F.col("kind").isin("ip", "card"), 1).otherwise(0)).otherwise(F.coalesce(checked, F.lit(0))),
            "v_gazetteer": yes_no(cue, against),
            "v_context": yes_no(quoted, F.col("f_after") == "word"),
            "v_border": yes_no(F.col("f_before").isin(*clean) & F.col("f_after").isin(*clean), F.lit(True)),
            "f_length": F.floor(F.log2(F.greatest(F.length("match"), F.lit(1)))).cast("int"),
            "f_mix": mix,
            "f_cue": F.when(cue, "cue").when(against, "against").otherwise("none"),
        }
    )


#: Where expectation-maximisation starts: P(vote | class) for votes -1, 0 and 1. It stays in force as pseudo-counts, START or
#: this SHARE of all spans, whichever is more, so that a large class without anchors cannot redefine what a vote means.
LIKELY = {1: {-1: 0.1, 0: 0.3, 1: 0.6}, 0: {-1: 0.5, 0: 0.4, 1: 0.1}}
START, SHARE = 10, 0.5


def _no_worse_than_chance(like: dict[int, dict[int, float]], mass: dict[int, float]) -> None:
    """Where a vote speaks for the wrong class, both classes share its rate."""
    for v in (1, -1):
        right, wrong = (1, 0) if v == 1 else (0, 1)
        if like[right][v] < like[wrong][v]:
            shared = sum(like[y][v] * mass[y] for y in (0, 1)) / (mass[0] + mass[1])
            for y in (0, 1):
                scale = (1 - shared) / max(1e-12, 1 - like[y][v])
                like[y] = {u: shared if u == v else p * scale for u, p in like[y].items()}


def reliabilities(patterns: dict[tuple[int, ...], tuple[float, float, float]], rounds: int = ROUNDS, least_change: float = 1e-7) -> tuple[dict[tuple[int, ...], float], list[dict[int, dict[int, float]]]]:
    """Expectation-maximisation: P(true | votes) for each vote pattern, and P(vote | class) for each labeler.

    patterns: for each the number of unlabelled, known true and known false spans. Rounds end when no posterior moves by least_change.
    """
    n = len(next(iter(patterns), ()))
    like = [{y: dict(LIKELY[y]) for y in (0, 1)} for _ in range(n)]
    prior, post = 0.5, dict.fromkeys(patterns, 0.5)
    start = max(START, SHARE * sum(map(sum, patterns.values())))
    for _ in range(rounds):
        before = dict(post)
        for votes_ in patterns:
            log = {y: math.log(prior if y else 1 - prior) + sum(math.log(like[i][y][v]) for i, v in enumerate(votes_)) for y in (0, 1)}
            post[votes_] = 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))
        share = {1: {v: u * post[v] + t for v, (u, t, _) in patterns.items()}, 0: {v: u * (1 - post[v]) + f for v, (u, _, f) in patterns.items()}}
        mass = {y: sum(share[y].values()) for y in (0, 1)}
        open_ = sum(u for u, _, _ in patterns.values())
        prior = min(0.99, max(0.01, (sum(u * post[v] for v, (u, _, _) in patterns.items()) + 1) / (open_ + 2)))
        for i in range(n):
            for y in (0, 1):
                like[i][y] = {v: (sum(c for p, c in share[y].items() if p[i] == v) + start * LIKELY[y][v]) / (mass[y] + start) for v in (-1, 0, 1)}
            _no_worse_than_chance(like[i], {y: mass[y] + start for y in (0, 1)})
        if all(abs(post[v] - before[v]) < least_change for v in post):
            break
    return post, like


def span_odds(counts: list[tuple[tuple[int, ...], int, str, str, int]], posteriors: dict[tuple[int, ...], float]) -> tuple[float, dict[str, dict[str, float]]]:
    """Naive Bayes: log odds of the classes, and of each value of each feature.

    counts: (votes, label, feature, value, spans); label 1, -1 or 0 for known true, known false and unlabelled.
    """
    tables: dict[str, dict[str, list[float]]] = {}
    for votes_, label, feature, value, c in counts:
        p = posteriors[votes_] if label == 0 else float(label > 0)
        cell = tables.setdefault(feature, {}).setdefault(value, [0.0, 0.0])
        cell[0] += (1 - p) * c
        cell[1] += p * c
    mass = [1.0, 1.0]
    for no, yes in next(iter(tables.values()), {}).values():
        mass[0] += no
        mass[1] += yes
    odds = {}
    for feature, values in tables.items():
        whole = [mass[y] + len(values) for y in (0, 1)]
        odds[feature] = {value: math.log((yes + 1) / whole[1]) - math.log((no + 1) / whole[0]) for value, (no, yes) in values.items()}
    return math.log(mass[1] / mass[0]), odds


def train(judged: DataFrame) -> Column:
    """The span classifier as a column: P(personal | features). judged: votes() with label 1, -1 or 0."""
    names = [f"v_{x}" for x in LABELERS]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in FEATURES])).alias("x")
    # At most 3^5 vote patterns times 3 labels times the values of the features (lengths count by powers of two).
    rows = judged.select(*names, "label", pairs).groupBy(*names, "label", "x.f", "x.v").count().collect()
    counts = [(tuple(r[x] for x in names), r["label"], r["f"], r["v"], r["count"]) for r in rows]
    patterns: dict[tuple[int, ...], list[float]] = {}
    for votes_, label, feature, _, c in counts:
        if feature == FEATURES[0]:
            patterns.setdefault(votes_, [0, 0, 0])[{0: 0, 1: 1, -1: 2}[label]] += c
    if not patterns:
        return F.lit(0.0)
    post, _ = reliabilities({v: tuple(c) for v, c in patterns.items()})
    start, tables = span_odds(counts, post)
    odds = F.lit(start)
    for f, values in sorted(tables.items()):
        table = F.create_map(*[F.lit(x) for value, w in sorted(values.items()) for x in (value, w)])
        odds = odds + F.coalesce(F.try_element_at(table, F.col(f).cast("string")), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judged_spans(rows: DataFrame) -> DataFrame:
    """All spans of rows (row, doc_id, text) and, for each row, one with kind null; clear: no valid base span overlaps it."""
    raw = raw_spans(rows).withColumn("base", valid_base(F.col("kind"), F.col("match")))
    marks = F.col("base") & F.col("kind").isNotNull()
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(marks, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(marks, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    return raw.withColumn("clear", clear).where("kind IS NULL OR base OR clear")


def labelled(found: DataFrame) -> DataFrame:
    """votes() of spans with label 1 for valid base spans, -1 for long numbers that fail the check of a base kind, 0 for candidates.

    Short matches, and those in the shape of another kind, say nothing of what is personal and are left out.
    """
    label = F.when(F.col("base"), 1).when(F.col("kind") != "candidate", -1).otherwise(0)
    told = votes(found.where("kind IS NOT NULL")).withColumn("label", label)
    return told.where((F.col("label") >= 0) | (F.length(F.regexp_replace("match", "[^0-9]", "")) >= 7) & (F.col("v_shape") <= 0))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(row, doc_id, spans): for every row the sorted spans, an array of (rank, start, end, kind, base)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    found = materialize(judged_spans(rows), "spans")
    told = labelled(found)
    score = train(told)
    chosen = told.where((F.col("kind") == "candidate") & (score >= accept)).select("row", "doc_id", F.col("shape").alias("kind"), "start", "end", "base")
    kept = found.where("kind IS NULL OR base").select("row", "doc_id", "kind", "start", "end", "base").unionAll(chosen)
    rank = F.array_position(F.array(*[F.lit(k) for k in (*BASE, *SHAPES)]), F.col("kind"))
    entry = F.when(F.col("kind").isNotNull(), F.struct(rank.alias("rank"), "start", "end", "kind", "base"))
    return kept.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(entry)).alias("spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; n_more: spans beyond the base kinds; n_spans: all."""
    found = find_personal(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_more"), F.size("spans").cast("long").alias("n_spans"))
