"""Interval overlap join: an endpoint-event sweep per client shard that adds up relation totals.

Intervals are pairs of slots, both inclusive; a null end is infinite, and infinite ends are equal. Each interval of the left
side (sales) is told, for each of Allen's relations that it has with intervals of the right side (sessions) of the same key,
how many there are, how many slots they share and the sum of the right side's checksums. Pairs are never listed.

The right side is first summed up by (key, start, end). A key's left rows are dealt to shards of about SHARD rows; each
shard gets the key's right groups once. In a shard the slots are visited in order: starts enter the active sets before ends
leave them. An active set is a hash table by start slot: of sessions (their totals and what of them has ended) and of sales
(totals when the start was passed, and what older sessions have ended since). When a sale ends, its nine relations are
differences of such totals, so a sale costs a fixed number of steps and a session as many as the slots it spans, or as sale
starts are active, whichever is less. Rows of a key with several shards are spread over SALTS parts before they learn of them.

Memory of a task: SHARD left rows and a key's right groups, at most slots x slots of them. Sessions of one client follow each
other, so there are at most three groups for each slot of the calendar, however many clicks there are.

Defined results: rows with a null key or start are ignored; ends before their start count as the start; a null id is kept;
repeated rows of the left side are told apart and each gets its rows; repeated rows of the right side count each time; empty
tables give an empty result; other columns are ignored. Times of sessions at equal microseconds are one place: the session is
open if any click there is a purchase.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import materialize, partitions

GAP_US, SLOT_US, SHARD, SALTS, OUT_ROWS = 600_000_000, 3_600_000_000, 50_000, 32, 100_000
#: The slot of infinite ends, after all others.
OPEN = 1 << 62
#: By where the right side starts (earlier, at the left side's start, later) and ends (earlier, at its end, later).
RELATIONS = (("overlapped_by", "finishes", "during"), ("started_by", "equals", "starts"), ("contains", "finished_by", "overlaps"))
RESULT = "id long, relation string, n_pairs long, overlap_slots long, crc long"


def micros(at: Column) -> Column:
    """Whole microseconds since 1970 of a timestamp, read as UTC if it has no zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), at)


def floor_div(value: Column, by: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def click_sessions(clicks: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(client_id, first, last, open): sessions of clicks, in microseconds.

    Clicks are first summed up by client and bucket of gap_us: those of a bucket lie less than the gap apart, so they are in one
    session, and a client has at most one row for each bucket of the calendar in the window below.
    """
    rows = clicks.select("client_id", micros(F.col("ts")).alias("us"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("bought")).where("client_id IS NOT NULL AND us IS NOT NULL")
    buckets = rows.groupBy("client_id", floor_div(F.col("us"), gap_us).alias("bucket")).agg(F.min("us").alias("first"), F.max(F.struct("us", "bought")).alias("last"))
    by_time = Window.partitionBy("client_id").orderBy("bucket")
    apart = F.coalesce(F.col("first") - F.lag("last.us").over(by_time) > gap_us, F.lit(True)).cast("long")
    numbered = buckets.withColumn("apart", apart).withColumn("no", F.sum("apart").over(by_time))
    found = numbered.groupBy("client_id", "no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select("client_id", "first", F.col("last.us").alias("last"), F.col("last.bought").alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, first, last, open): sales with the latest of sold_at and their lines' shipped_at."""
    shipped = lines.where("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("line_of")).agg(F.max(micros(F.col("shipped_at"))).alias("shipped"), F.max(F.col("shipped_at").isNull()).alias("open"))
    sold = sales.select("sale_id", "client_id", micros(F.col("sold_at")).alias("first")).where("client_id IS NOT NULL AND first IS NOT NULL")
    met = sold.join(shipped, F.col("sale_id") == F.col("line_of"), "left")
    return met.select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), F.coalesce("open", F.lit(False)).alias("open"))


def slots(key: str, slot_us: int = SLOT_US) -> list[Column]:
    """key, start and end columns of intervals in microseconds; an open one has a null end."""
    return [F.col(key).alias("key"), floor_div(F.col("first"), slot_us).alias("start"), F.when(~F.col("open"), floor_div(F.col("last"), slot_us)).alias("end")]


Right = tuple[int, int, int, int]  # start, end, rows, checksums
Left = tuple[int, int, int | None]  # start, end, id


def sweep(right: list[Right], left: list[Left]) -> Iterator[tuple[int | None, str, int, int | None, int]]:
    """Relation totals of each left row over the right groups of its shard."""
    begin: dict[int, list[int]] = defaultdict(lambda: [0, 0])  # of the right side, by start: rows, checksums
    end: dict[int, list[Right]] = defaultdict(list)
    leave: dict[int, dict[int, list[int | None]]] = defaultdict(lambda: defaultdict(list))  # of the left side, by end and start
    due: dict[int, int] = defaultdict(int)  # left rows by start
    for r in right:
        begin[r[0]][0] += r[2]
        begin[r[0]][1] += r[3]
        end[r[1]].append(r)
    for start, stop, i in left:
        leave[stop][start].append(i)
        due[start] += 1
    begun_n = begun_a = begun_c = 0  # all right rows begun so far: rows, sum of starts, checksums
    gone_n = gone_a = gone_b = gone_c = 0  # ended so far: the same, and sum of ends
    sessions: dict[int, list[int]] = {}  # by start: rows and checksums begun, rows, ends and checksums of what has ended
    sales: dict[int, list[int]] = {}  # by start: see below

    def split(start: int) -> tuple[tuple[int, int, int, int], ...]:
        """Right rows that share a slot with a sale begun at start and have ended: started before, at and after start."""
        x, s = sales[start], sessions.get(start)
        old, same = (x[11], x[12], x[13], x[14]), (s[2], start * s[2], s[3], s[4]) if s else (0, 0, 0, 0)
        return old, same, (gone_n - x[7] - old[0] - same[0], gone_a - x[8] - old[1] - same[1], gone_b - x[9] - old[2] - same[2], gone_c - x[10] - old[3] - same[3])

    for t in sorted(begin.keys() | end.keys() | leave.keys() | due.keys()):
        before = (begun_n - gone_n, begun_a - gone_a, begun_c - gone_c)
        if t in begin:
            n, c = begin[t]
            begun_n, begun_a, begun_c = begun_n + n, begun_a + n * t, begun_c + c
            sessions[t] = [n, c, 0, 0, 0]
        if t in due:  # rows left, active before (3), begun through this slot (3), ended before (4), ended since of those active before (4)
            sales[t] = [due[t], *before, begun_n, begun_a, begun_c, gone_n, gone_a, gone_b, gone_c, 0, 0, 0, 0]
        leaving = leave.get(t, {})
        ended = {start: split(start) for start in leaving}
        if t in end:
            going = sorted(end[t])
            for a, _, n, c in going:
                gone_n, gone_a, gone_b, gone_c = gone_n + n, gone_a + n * a, gone_b + n * t, gone_c + c
                s = sessions[a]
                s[2], s[3], s[4] = s[2] + n, s[3] + n * t, s[4] + c
            if sum(t - g[0] for g in going) <= len(sales):  # the slots that each spans
                for a, _, n, c in going:
                    for start in range(a + 1, t + 1):
                        if x := sales.get(start):
                            x[11], x[12], x[13], x[14] = x[11] + n, x[12] + n * a, x[13] + n * t, x[14] + c
            else:  # the active starts in order
                at, n, sum_a, crc = 0, 0, 0, 0
                for start in sorted(sales):
                    while at < len(going) and going[at][0] < start:
                        n, sum_a, crc, at = n + going[at][2], sum_a + going[at][2] * going[at][0], crc + going[at][3], at + 1
                    if n:
                        x = sales[start]
                        x[11], x[12], x[13], x[14] = x[11] + n, x[12] + sum_a, x[13] + n * t, x[14] + crc
        for start, ids in leaving.items():
            x, earlier, now = sales[start], ended[start], split(start)
            same = sessions.get(start, (0, 0))
            begun = ((x[1], x[2], x[3]), (same[0], start * same[0], same[1]), (begun_n - x[4], begun_a - x[5], begun_c - x[6]))
            rows = []
            for k, names in enumerate(RELATIONS):
                (n0, a0, b0, c0), (n1, a1, _, c1), (n2, a2, c2) = earlier[k], now[k], begun[k]
                later = k == 2
                for name, n, a, b, c in ((names[0], n0, a0, b0, c0), (names[1], n1 - n0, a1 - a0, None, c1 - c0), (names[2], n2 - n1, a2 - a1, None, c2 - c1)):
                    if n:
                        stop = n * t if b is None else b
                        rows.append((name, n, None if b is None and t == OPEN else stop - (a if later else n * start) + n, c))
            yield from ((i, *row) for i in ids for row in rows)
            x[0] -= len(ids)
            if not x[0]:
                del sales[start]


def _sweep_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, shard): the sweep of one shard after the other."""
    shard, right, left, out = None, [], [], []

    def made(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["id", "relation", "n_pairs", "overlap_slots", "crc"])

    for b in batches:
        for key, part, is_left, start, stop, value, crc in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (key, part) != shard:
                if right and left:
                    out.extend(sweep(right, left))
                shard, right, left = (key, part), [], []
                if len(out) >= OUT_ROWS:
                    yield made(out)
                    out = []
            if is_left:
                left.append((start, stop, value))
            else:
                right.append((start, stop, value, crc))
    if right and left:
        out.extend(sweep(right, left))
    for i in range(0, len(out), OUT_ROWS):
        yield made(out[i : i + OUT_ROWS])


def relation_totals(left: DataFrame, right: DataFrame, shard: int = SHARD) -> DataFrame:
    """(id, relation, n_pairs, overlap_slots, crc) of left (key, start, end, id) against right (key, start, end, crc).

    overlap_slots is null where both ends are infinite.
    """
    spark = left.sparkSession
    stop = F.when(F.col("end").isNull(), F.lit(OPEN)).otherwise(F.greatest("start", "end")).alias("end")
    rows = materialize(left.where("key IS NOT NULL AND start IS NOT NULL").select("key", "start", stop, F.col("id").cast("long").alias("value")), "left")
    groups = right.where("key IS NOT NULL AND start IS NOT NULL").select("key", "start", stop, "crc").groupBy("key", "start", "end").agg(F.count(F.lit(1)).alias("value"), F.sum("crc").alias("crc"))
    shards = rows.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("shards"))
    # rows learn how many shards their key has; only keys with several are told, to each of SALTS parts of their rows
    salts = shards.where("shards > 1").select("of", "shards", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    salted = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    part = F.pmod(F.xxhash64("row"), F.coalesce("shards", F.lit(1).cast("long")))
    # their number grows with the input, so they are never broadcast
    dealt = salted.join(salts.hint("merge"), (F.col("key") == F.col("of")) & (F.col("salt") == F.col("salt_of")), "left").select("key", part.alias("shard"), F.lit(True).alias("is_left"), "start", "end", "value", F.lit(0).cast("long").alias("crc"))
    copied = groups.join(shards.hint("merge"), F.col("key") == F.col("of")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(False).alias("is_left"), "start", "end", "value", "crc")
    both = dealt.unionByName(copied).repartition(partitions(spark), "key", "shard").sortWithinPartitions("key", "shard")
    return both.mapInArrow(_sweep_shards, RESULT)


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sales", "sale_lines"))
    left = sale_intervals(sales, lines).select(*slots("client_id"), F.col("sale_id").alias("id"))
    right = click_sessions(clicks).select(*slots("client_id"), F.crc32(F.col("first").cast("string")).alias("crc"))
    return relation_totals(left, right).select(F.col("id").alias("sale_id"), "relation", "n_pairs", "overlap_slots", F.col("crc").alias("sessions_crc"))


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: ((ascii(substr({text}, i, 1)) >> k) & 1)::BIGINT)))"
    step = "CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: {step}), 4294967295::BIGINT)"


SQL = f"""
WITH marked AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'purchase', false) AS bought,
    epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY client_id ORDER BY ts) AS since FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
numbered AS (SELECT *, sum(CASE WHEN since IS NULL OR since > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY us) AS no FROM marked),
firsts AS (SELECT client_id, no, min(us) AS first, max(us) AS last, max({{'us': us, 'bought': bought}}).bought AS open FROM numbered GROUP BY client_id, no),
sessions AS (SELECT client_id, CAST(floor(first / 3600000000) AS BIGINT) AS a, CASE WHEN open THEN 1000000000 ELSE CAST(floor(last / 3600000000) AS BIGINT) END AS b, {crc32_sql("CAST(first AS VARCHAR)")} AS crc FROM firsts),
lines AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped, bool_or(shipped_at IS NULL) AS open FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id),
bounds AS (SELECT s.sale_id, client_id, CAST(floor(epoch_us(sold_at) / 3600000000) AS BIGINT) AS s, CASE WHEN coalesce(open, false) THEN 1000000000 ELSE CAST(floor(greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) / 3600000000) AS BIGINT) END AS e
   FROM sales s LEFT JOIN lines l ON s.sale_id = l.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
pairs AS (SELECT sale_id, crc, CASE WHEN e = 1000000000 AND b = 1000000000 THEN NULL ELSE least(e, b) - greatest(s, a) + 1 END AS shared,
   CASE WHEN s < a THEN CASE WHEN e < b THEN 'overlaps' WHEN e = b THEN 'finished_by' ELSE 'contains' END
        WHEN s = a THEN CASE WHEN e < b THEN 'starts' WHEN e = b THEN 'equals' ELSE 'started_by' END
        ELSE CASE WHEN e < b THEN 'during' WHEN e = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation
   FROM bounds JOIN sessions USING (client_id) WHERE a <= e AND s <= b)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM pairs GROUP BY sale_id, relation
"""
