"""The interval join against all pairs in plain Python."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from concordia.llm import intervals

ENDLESS = 10**9


def relation(s, e, a, b):
    first = "later" if s > a else "equal" if s == a else "earlier"
    last = "earlier" if e < b else "equal" if e == b else "later"
    return {
        ("earlier", "earlier"): "overlaps", ("earlier", "equal"): "finished_by", ("earlier", "later"): "contains",
        ("equal", "earlier"): "starts", ("equal", "equal"): "equals", ("equal", "later"): "started_by",
        ("later", "earlier"): "during", ("later", "equal"): "finishes", ("later", "later"): "overlapped_by",
    }[first, last]


def brute(left, right):
    out = defaultdict(lambda: [0, 0, 0])
    for n, (key, s, e, i) in enumerate(left):
        for k, a, b, crc in right:
            e1, b1 = ENDLESS if e is None else max(e, s), ENDLESS if b is None else max(a, b)
            if key is not None and k == key and s is not None and a is not None and a <= e1 and s <= b1:
                x = out[n, i, relation(s, e1, a, b1)]
                x[0] += 1
                x[1] = None if e1 == b1 == ENDLESS else x[1] + min(e1, b1) - max(s, a) + 1
                x[2] += crc
    return sorted(((str(i), r, *x) for (_, i, r), x in out.items()), key=str)


LEFT, RIGHT = "key long, start long, end long, id long", "key long, start long, end long, crc long"


def found(spark, left, right, shard):
    rows = intervals.relation_totals(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), shard)
    return sorted(((str(r.id), r.relation, r.n_pairs, r.overlap_slots, r.crc) for r in rows.collect()), key=str)


@pytest.mark.parametrize("span,shard", [(6, 50_000), (6, 7), (60, 7), (400, 40)])
def test_relations_equal_all_pairs(spark, span, shard):
    draw = random.Random(span + shard)

    def rows(n):
        for i in range(n):
            start = draw.choice([None, *[draw.randrange(-span, span)] * 30])
            end = None if start is None or draw.random() < 0.15 else start + draw.choice([-1, 0, 0, 1, 2, draw.randrange(span)])
            yield (draw.choice([None, 1, 1, 1, 2, 3]), start, end, draw.choice([i, 7, None]) if draw.random() < 0.3 else i)

    left = list(rows(150))
    right = [(k, a, b, 1000 + (i or 0)) for k, a, b, i in rows(150)]
    left += left[:9]
    right += right[:9]
    assert found(spark, left, right, shard) == brute(left, right)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 2, 3)], 10) == found(spark, [(1, 1, 2, 3)], [], 10) == []


def test_one_key_is_dealt_to_many_shards(spark):
    left, right = [(5, i % 40, i % 40 + i % 7, i) for i in range(900)], [(5, i % 50, None if i % 3 == 0 else i % 50 + 1, i) for i in range(300)]
    assert found(spark, left, right, 20) == brute(left, right)


def test_sessions_and_sales_of_odd_rows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    clicks = [(1, at(0), "view"), (1, at(10), None), (1, at(20), "purchase"), (1, at(20), "view"), (1, at(30.1), "view"), (1, None, "view"), (None, at(3), "view"), (2, at(-5), "view"), (2, at(-5), "view")]
    frame = spark.createDataFrame(clicks, "client_id long, ts timestamp_ntz, kind string").withColumn("first", F.lit(1))
    us = lambda minutes: int((at(minutes) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    got = sorted(tuple(r) for r in intervals.click_sessions(frame).collect())
    assert got == [(1, us(0), us(20), True), (1, us(30.1), us(30.1), False), (2, us(-5), us(-5), False)]
    sales = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(5)), (3, 1, at(5)), (4, None, at(5)), (5, 1, None), (None, 1, at(9))], "sale_id long, client_id long, sold_at timestamp_ntz")
    lines = spark.createDataFrame([(1, at(-9)), (1, at(90)), (2, at(5)), (2, None), (None, at(99))], "sale_id long, shipped_at timestamp_ntz")
    got = sorted((tuple(r) for r in intervals.sale_intervals(sales, lines).collect()), key=str)
    assert got == sorted([(1, 1, us(0), us(90), False), (2, 1, us(5), us(5), True), (3, 1, us(5), us(5), False), (None, 1, us(9), us(9), False)], key=str)
    frame.write.parquet(f"{tmp_path}/clicks.parquet")
    sales.write.parquet(f"{tmp_path}/sales.parquet")
    lines.write.parquet(f"{tmp_path}/sale_lines.parquet")
    rows = {(r.sale_id, r.relation): (r.n_pairs, r.overlap_slots, r.sessions_crc) for r in intervals.op12_interval_join(spark, str(tmp_path)).collect()}
    crc = lambda minutes: zlib.crc32(str(us(minutes)).encode())
    assert rows[1, "starts"] == (1, 2, crc(0)) and rows[1, "started_by"] == (1, 1, crc(30.1))
    assert rows[2, "equals"] == (1, None, crc(0)) and rows[2, "started_by"] == (1, 1, crc(30.1))
