"""Every registered query against plain Python over a small table with odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from concordia.llm import queries as q
from concordia.llm import repeats

DATA = "/root/testdata/sf0.001/documents.parquet"
SHARED = " ".join(f"tok{i * 7919 % 1000}" for i in range(70))


@pytest.fixture(scope="module")
def table():
    docs = pq.read_table(DATA).select(["doc_id", "text", "lang", "source"]).to_pylist()
    odd = [
        None, "", "   \n\t ", "a", "A b", "x y z", "MIT License", "the MIT LICENSE, general public license apache license",
        f"Before {SHARED} after", f"{SHARED}", f"Other start {SHARED} {SHARED}", "ab" * 400, "ab" * 400 + "c", "a" * 1000,
        "mail a.b@c-d.org, ip 10.0.0.300 and 010.1.1.1 or 1.2.3.4.5; card 4111 1111 1111 1111, 4111-1111-1111-1112; +49 (30) 1234-5678 +1 2",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "My SSN: 123-45-6789. Phone (555) 123-4567", "日本語 の テキスト ½ ² 🙂 é́", "<|endoftext|> text  two\r\nlines\x1cx", "123 456 !!", "word " * 30000,
        "9" * 20000, "don't I'll \n\n we've", " leading", "trailing ", "KK İstanbul MIT LİCENSE",
    ]
    docs += [{"doc_id": 1000 + i, "text": t, "lang": None if i % 2 else "en", "source": None if i % 5 == 0 else "odd"} for i, t in enumerate(odd)]
    docs += [docs[3], docs[3] | {"doc_id": 5000}, docs[208] | {"doc_id": 5001}]
    return docs


@pytest.fixture(scope="module")
def at(table, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    rows = [r | {"n_chars": len(r["text"] or ""), "pos": 1, "row": "x", "m": "y", "kind": "z", "__text": 0} for r in table]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("pos", pa.int64()), ("row", pa.string()), ("m", pa.string()), ("kind", pa.string()), ("__text", pa.int64())])
    pq.write_table(pa.Table.from_pylist(rows, schema), d / "documents.parquet", row_group_size=50)
    empty = tmp_path_factory.mktemp("empty")
    pq.write_table(schema.empty_table(), empty / "documents.parquet")
    for name in ("labels", "conversations", "clicks", "sales", "sale_lines"):
        pq.write_table(pq.read_table(DATA.replace("documents", name)).slice(0, 0), empty / f"{name}.parquet")
    return {"odd": str(d), "empty": str(empty)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def run(spark, at, name):
    return [r.asDict() for r in q.queries()[name](spark, at["odd"]).collect()]


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_table(spark, at, name):
    assert q.queries()[name](spark, at["empty"]).count() == 0


def ordered(table):
    return sorted(table, key=lambda r: r["doc_id"])


def test_op1(spark, at, table):
    got = sorted(run(spark, at, "op1_fingerprint"), key=lambda r: (r["doc_id"], r["edited_sha256"]))
    assert len(got) == len(table)
    docs = ordered(table)
    prints = {}
    want = []
    for i, d in enumerate(docs):
        t, after = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        k = len(t) // 4
        want.append((d["doc_id"], len(t), sha(t[: len(t) - k] + after[:k])))
    assert sorted(want) == [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got]
    by_id = {r["doc_id"]: r["fingerprint"] for r in got}
    for d in docs:
        assert prints.setdefault(d["text"] or "", by_id[d["doc_id"]]) == by_id[d["doc_id"]]
    bits = [int(r["fingerprint"], 16) for r in got]
    for i, r in enumerate(got):
        assert r["near_edited"] == 1 - (bits[i] ^ int(r["edited_fingerprint"], 16)).bit_count() / 64
        if docs[i]["doc_id"] != docs[i - 1]["doc_id"]:
            assert r["n_same"] == bits.count(bits[i])
            assert r["n_near"] == (sum((b ^ bits[i]).bit_count() <= 3 for b in bits) - 1 if r["doc_id"] % 20 == 0 else None)
    assert got[-1]["near_next"] == 1 - (bits[-1] ^ bits[0]).bit_count() / 64


def test_op2(spark, at, table):
    got = {r["doc_id"]: r for r in run(spark, at, "op2_suffix_dedup")}
    seen, docs = {}, {d["doc_id"]: (d["text"] or "").encode() for d in table}
    for i in sorted(docs):
        b, gone = docs[i], bytearray(len(docs[i]))
        for j in range(len(b) - 99):
            if seen.setdefault(b[j : j + 100], (i, j)) != (i, j):
                gone[j : j + 100] = b"\1" * 100
        spans = len(re.findall(b"\1+", bytes(gone)))
        want = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
        assert want == tuple(got[i][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")), i


def test_op3(spark, at, table):
    got = run(spark, at, "op3_exact_dedup")
    groups = defaultdict(list)
    for d in table:
        groups[d["text"] or ""].append(d["doc_id"])
    want = [(i, max(ids), len(ids), i == max(ids), sha(t)) for t, ids in groups.items() for i in ids]
    assert sorted(want) == sorted(tuple(r[k] for k in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got)


def test_op4(spark, at, table):
    got = sorted(run(spark, at, "op4_license_scan"), key=lambda r: r["doc_id"])
    for d, r in zip(ordered(table), got, strict=True):
        low = (d["text"] or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((j, lab) for p, lab in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for x in [p.split()] for j in range(len(w)) if w[j : j + len(x)] == x)
        want = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))
        assert want == tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")), d
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert next(r for r in got if r["doc_id"] == 1015)["labels"] == "mit"


def test_op5(spark, at, table):
    got = sorted(run(spark, at, "op5_language_id"), key=lambda r: r["doc_id"])
    right = total = 0
    for d, r in zip(ordered(table), got, strict=True):
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        assert 0 <= r["score"] <= 1
        if r["held_out"] and d["doc_id"] < 1000:
            total, right = total + 1, right + (r["lang_pred"] == d["lang"])
    assert right >= 0.95 * total


def test_op6(spark, at, table):
    got = run(spark, at, "op6_simhash_dedup")
    docs = {d["doc_id"]: d["text"] or "" for d in table}
    prints = {}
    for i, t in docs.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if x]
        terms = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        counts = [0] * 64
        for x in terms:
            h = xxhash.xxh64_intdigest(x.encode(), seed=42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * counts[b] > len(terms))
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert len(got) == len(table)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == find(r["doc_id"])


def test_op7(spark, at, table):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = run(spark, at, "op7_packing")
    docs = {d["doc_id"]: d["text"] or "" for d in table}
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in docs.items()}
    seen, places = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        seen[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    times = defaultdict(int)
    for d in table:
        times[d["doc_id"]] += 1
    for i, parts in seen.items():
        assert sum(n for _, n in parts) == len(ids[i]) * times[i]
        assert {s for s, _ in parts} == set(range(0, len(ids[i]), 1024))
    for parts in places.values():
        at_ = 0
        for offset, n in sorted(parts):
            assert offset == at_
            at_ += n
        assert at_ <= 1024
    assert len(seen) == len(docs)


def test_op8(spark, at, table):
    got = {r["doc_id"]: r for r in run(spark, at, "op8_substring_dedup")}
    docs = {d["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "") for d in table}
    seen = {}
    for i in sorted(docs):
        w, gone = docs[i], set()
        windows = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, x in enumerate(windows):
            if seen.get(x, i) < i:
                gone |= set(range(j, j + 50))
        for x in windows:
            seen.setdefault(x, i)
        want = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
        assert want == tuple(got[i][k] for k in ("n_words", "n_removed", "kept_sha256")), i


def test_op10(spark, at, table):
    got = sorted(run(spark, at, "op10_personal_data"), key=lambda r: r["doc_id"])

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else int("0246813579"[int(c)]) for i, c in enumerate(reversed(s))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for d, r in zip(ordered(table), got, strict=True):
        spans = []
        for k, p in patterns.items():
            for m in re.finditer(p, d["text"] or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 13 <= len(digits) <= 19 and luhn(digits) or k == "phone" and 9 <= len(digits) <= 15:
                    spans.append((k, m.start(), m.end()))
        text = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == sha(",".join(text)), d["doc_id"]
        assert [r[f"n_{k}"] for k in patterns] == [sum(s[0] == k for s in spans) for k in patterns]
        assert set(text) <= set(r["spans"].split(",")) or not text
        for x in filter(None, r["spans"].split(",")):
            _, a, b = x.split(":")
            assert x in text or not any(int(a) < e and s < int(b) for _, s, e in spans)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, at, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{at['odd']}/documents.parquet'")
    theirs = con.sql(q.oracle_sql()[name])
    ours = q.queries()[name](spark, at["odd"])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(str, ([r[c] for c in columns] for r in ours.collect()))) == sorted(map(str, map(list, theirs.project(", ".join(columns)).fetchall())))


@pytest.mark.parametrize("least", [1, 40, 10_000])
def test_shard_groups(least):
    rows = [(i // 7 if i < 60 else 9, bytes(i % 5)) for i in range(100)]
    batches = [pa.RecordBatch.from_arrays([*[pa.array([r[0] for r in rows[i : i + 13]], pa.int64())] * 4, pa.array([r[1] for r in rows[i : i + 13]], pa.binary())], names=["m", "seg", "did", "start", "content"]) for i in range(0, 100, 13)]
    groups = list(repeats.shard_groups(iter(batches), least))
    assert [(a.as_py(), c.as_py()) for g in groups for a, c in zip(g["m"], g["content"])] == rows
    shards = [set(g["m"].to_pylist()) for g in groups]
    assert all(not a & b for i, a in enumerate(shards) for b in shards[:i])


def test_op1_ids_far_apart(spark, tmp_path):
    """Ids from the smallest to the largest long, missing and repeated ones, in one order."""
    from concordia.llm import fingerprint

    ids = [-(2**63), -5, None, None, 7, 7, 2**63 - 1, 0]
    rows = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = [r for r in fingerprint.with_next(rows).collect() if not r["guest"]]
    assert len(got) == len(ids)
    after = {r["text"]: r["next_text"] for r in got}
    assert after["text 0"] == "text 1" and after["text 1"] == "text 7" and after["text 7"] in ("text 4", "text 5") and after["text 6"] in ("text 2", "text 3")
    assert sorted(after.values()) == sorted(after)
