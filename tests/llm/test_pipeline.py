"""The pipeline's stages against plain Python, over a small table with odd rows and planted copies."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from concordia.llm import gray_index, simhash_dedup
from concordia.llm.common import among, documents

DATA = "/root/testdata/sf0.001/documents.parquet"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    docs = pq.read_table(DATA).select(COLUMNS).to_pylist()
    long = next(d for d in docs if len((d["text"] or "").split()) > 300 and d["lang"])
    words = long["text"].split()
    planted = [" ".join(words), " ".join(words[:150] + ["edited"] + words[151:]), " ".join(words[5:]), long["text"], None, "", "  ", "42 !", " ".join(words[:20] * 50), "word " * 5000]
    docs += [{"doc_id": 9000 + i, "text": t, "lang": long["lang"] if i % 2 else None, "source": long["source"] if i % 3 else None, "n_chars": 0} for i, t in enumerate(planted)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    d, empty = tmp_path_factory.mktemp("docs"), tmp_path_factory.mktemp("none")
    pq.write_table(pa.Table.from_pylist(docs, schema), d / "documents.parquet", row_group_size=64)
    pq.write_table(schema.empty_table(), empty / "documents.parquet")
    return {"docs": str(d), "empty": str(empty), "rows": docs}


def test_language(spark, at):
    docs = documents(spark, at["docs"])
    kept = cp.language_stage(spark, docs, at["docs"])
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    prose = {r["doc_id"] for r in at["rows"] if r["lang"] and len(re.findall(r"[^\W\d_]+", r["text"] or "")) > 20}
    assert not ids & {9004, 9005, 9006, 9007}
    assert len(prose - ids) <= 0.01 * len(prose)


def test_exact(spark, at):
    docs = documents(spark, at["docs"])
    kept = cp.exact_stage(spark, docs, at["docs"])
    groups = defaultdict(list)
    for r in at["rows"]:
        groups[r["text"] or ""].append(r["doc_id"])
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(min, groups.values()))


def test_near(spark, at):
    docs = documents(spark, at["docs"])
    kept = cp.near_stage(spark, docs, at["docs"])
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(at["rows"][i]["doc_id"] for i in near_survivors(at["rows"]))
    assert not set(ids) & {9000, 9001, 9002, 9003}


def test_run(spark, at):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = documents(spark, at["docs"])
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at["docs"]).collect(), docs.schema)
        assert docs.columns == COLUMNS, name
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for r in docs.collect():
        want[r["doc_id"]] += len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, filled = defaultdict(int), defaultdict(list)
    for r in cp.run(spark, at["docs"]).collect():
        got[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in filled.values():
        assert sum(n for _, n in parts) <= 1024
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]


def test_empty(spark, at):
    assert cp.run(spark, at["empty"]).count() == 0


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return frozenset(" ".join(w[j : j + cp.SHINGLE]) for j in range(max(1, len(w) - cp.SHINGLE + 1)))


def near_survivors(rows):
    """Places of the rows that stay, by brute force over all pairs that share a shingle."""
    sets, holders, root = [shingle_set(r["text"]) for r in rows], defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
            holders[x].append(i)
        for j, n in common.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append((r["doc_id"] is None, r["doc_id"] or 0, i))
    return {min(g)[2] for g in groups.values()}


def changed(words, share, tag):
    return " ".join(f"{tag}{i}" if i < share * len(words) else w for i, w in enumerate(words))


def test_near_is_exact_jaccard(spark, at):
    texts = [r["text"] for r in at["rows"][:100]]
    for n in range(40):  # a copy whose first words are changed: Jaccard similarities on both sides of 0.8
        words = [f"w{n}x{i * 7919 % 5003}" for i in range(120 + n)]
        texts += [" ".join(words), changed(words, 0.06 + n % 10 * 0.012, f"c{n}y")]
    texts += [changed([f"g{i}" for i in range(300)], 0, "") + f" end{i}" for i in range(60)]  # a large group
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 0} for i, t in enumerate(texts)]
    kept = cp.near_stage(spark, spark.createDataFrame(rows).select(*COLUMNS), at["docs"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(near_survivors(rows))


def test_sketches_rule_out_no_similar_pair(spark):
    """Against exact sets; and of texts of one length that share a long passage, nearly all below 0.75 are ruled out."""
    base, texts = [f"s{i}" for i in range(150)], ["", "one two", "one two three four five six"]
    for n in range(80):
        texts.append(" ".join(f"e{n}y{i}" if (i * 37 + n) % 150 < n // 16 else w for i, w in enumerate(base[: 150 - n % 3])))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = sorted(simhash_dedup.set_sketches(rows, cp.SHINGLE).collect())
    sets = [np.array([r[c] for r in got], np.int64) for c in ("n", "b0", "b1", "b2", "b3")]
    shingles = [shingle_set(t) for t in texts]
    i, j = np.triu_indices(len(texts), 1)
    can = gray_index.possible(sets, i, j, cp.SIMILARITY)
    alike = np.array([len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for a, b in zip(i, j)])
    assert [len(s) for s in shingles] == sets[0].tolist()
    assert can[alike >= cp.SIMILARITY].all() and (alike >= cp.SIMILARITY).sum() > 100
    assert (alike < 0.75).sum() > 100 and can[alike < 0.75].mean() < 0.1


def test_near_drops_rows_not_ids(spark, at):
    a, b, c = ([f"{p}{i}" for i in range(200)] for p in "abc")
    texts = [(1, a), (None, [*a, "end"]), (None, b), (None, c), (7, ["x", *b]), (7, [*c, "end"]), (None, [*map(str, range(90))]), (7, [*map(str, range(300, 390))])]
    rows = [{"doc_id": i, "text": " ".join(t), "lang": "en", "source": "s", "n_chars": 0} for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = cp.near_stage(spark, spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema), at["docs"])
    want = sorted((str(rows[i]["doc_id"]), rows[i]["text"]) for i in near_survivors(rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == want


def test_exact_keeps_one_row_of_each_text(spark, at):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (3, "b", "en", "s", 1), (3, "b", "de", "s", 1), (3, "c", "en", "s", 1), (None, "c", "en", "s", 1), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    kept = cp.exact_stage(spark, spark.createDataFrame(rows, schema), at["docs"])
    assert kept.columns == COLUMNS
    assert sorted((r["text"] or "", str(r["doc_id"])) for r in kept.collect()) == [("", "None"), ("a", "None"), ("b", "3"), ("c", "3")]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_repeated_rows_and_clashing_columns(spark, at, name):
    """A stage treats a repeated row like the first, and carries columns of any name."""
    stage = dict(cp.STAGES)[name]
    rows = [tuple(r[c] for c in COLUMNS) for r in at["rows"][:40] + at["rows"][:3] + at["rows"][-10:]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = ["__pred", "__score", "__row", "row", "__copy", "__rate", "__key", "__source", "__n", "__hash", "__text", "root", "id", "none", "c0", "extra5"]
    plain = spark.createDataFrame(rows, schema)
    more = spark.createDataFrame([(*r, *[str(r[0])] * len(odd)) for r in rows], schema + "".join(f", {c} string" for c in odd))
    got = stage(spark, more, at["docs"])
    assert got.columns == [*COLUMNS, *odd]
    kept = got.collect()
    assert all(set(r[5:]) == {str(r[0])} for r in kept)
    assert sorted(map(str, (r[:5] for r in kept))) == sorted(map(str, map(tuple, stage(spark, plain, at["docs"]).collect())))


def test_among_ids(spark):
    """Ids of several partitions, zero, negative and missing ones, and those at the edges of a bitmap."""
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (1 << 33) + 5, (3 << 33) + 40000, -1, -32768]
    rows = spark.createDataFrame([(i, str(i)) for i in [*ids, None, *[x + 2 for x in ids]]], "id long, text string")
    wanted = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "id long")
    got = sorted(r["id"] for r in among(rows, wanted, "id").collect())
    assert got == sorted([*ids, *[x + 2 for x in ids if x + 2 in ids]])
    rest = [r["id"] for r in among(rows, wanted, "id", inside=False).collect()]
    assert sorted(x for x in rest if x is not None) == sorted(x + 2 for x in ids if x + 2 not in ids) and rest.count(None) == 1
    assert among(rows, wanted.where("false"), "id").count() == 0


@pytest.mark.parametrize("cell", [1, 1 << 11, 1 << 18])
def test_pairs_meet_in_cells(spark, monkeypatch, cell):
    """All pairs of a group: as brute force, and a row's set goes to each part of the group at most, not to each pair."""
    monkeypatch.setattr(simhash_dedup, "CELL", cell)
    texts = [changed([f"g{i}" for i in range(60 + n)], n % 7 * 0.03, f"c{n}y") for n in range(24)]
    texts += ["", "one two", "one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    pairs = spark.createDataFrame([(a // 24, a, b) for a in range(27) for b in range(a + 1, 27) if a // 24 == b // 24], "group long, a long, b long")
    sizes = simhash_dedup.set_sketches(rows, cp.SHINGLE).select("row", "n")
    sets = [shingle_set(t) for t in texts]
    want = sorted((r["a"], r["b"]) for r in pairs.collect() if len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]]) >= 0.8)
    got = sorted(map(tuple, simhash_dedup.verified(rows, pairs, sizes, cp.SHINGLE, 0.8).collect()))
    assert got == want and len(want) > 20
    if cell > 1 << 17:
        met = {(x, *r[:3]) for r in simhash_dedup.cells(pairs, sizes).collect() for x in (r["a"], r["b"])}
        assert len(met) == len(texts)


@pytest.mark.parametrize("whole", [0, 1 << 25])
def test_wide_links_are_all_pairs(spark, monkeypatch, whole):
    """By single blocks and by whole keys: every pair that agrees on two of nine blocks; by blocks a row is dealt nine times, not 36."""
    dealt, deal = [], gray_index._deal
    monkeypatch.setattr(gray_index, "WHOLE", whole)
    monkeypatch.setattr(gray_index, "_deal", lambda *a: (dealt.append(deal(*a)), dealt[-1])[1])
    pick = np.random.default_rng(2)
    base = pick.integers(-(2**63), 2**63 - 1, 12)
    fps = np.array([base[n % 12] ^ np.bitwise_or.reduce(np.int64(1) << pick.integers(0, 63, n % 30)) if n % 30 else base[n % 12] for n in range(240)])
    nodes = spark.createDataFrame([(n, int(f), 0, n) for n, f in enumerate(fps)], "row long, f long, g long, root long")
    got = {tuple(r) for r in gray_index.wide_links(nodes, "row", ["f", "g"], 0, 2, 9, 24, 30, "root").collect()}
    masks = [np.uint64(m) for m in gray_index.block_masks(9)]
    far = lambda a, b: fps[a : a + 1].view(np.uint64)[0] ^ fps[b : b + 1].view(np.uint64)[0]
    want = {(a, b) for a in range(240) for b in range(a + 1, 240) if np.bitwise_count(x := far(a, b)) <= 24 and sum(not x & m for m in masks) >= 2}
    assert got == want and len(want) > 400
    assert dealt[0].count() == 240 * (9 if whole else 36)
    assert sorted(gray_index.owners(gray_index.block_tables(9, 7), 9)) == sorted(list(range(9)) * 4)
