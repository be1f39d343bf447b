"""Problems 8 to 10: containers, mixes and shared spans."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.llm import mixing as MX
from wordtide.llm import packing as PK
from wordtide.llm import shared_spans as SS
from wordtide.llm import tokens as TK

SMALL = "/root/testdata/sf0.01"


def test_sizes(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "é日本🙂" * 50), (5, "a" * 20_000)]
    got = {r.doc_id: r.n_tokens for r in TK.sized(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    encode = TK.encoder()
    assert got == {i: len(encode(t)) for i, t in rows if t is not None}


@pytest.mark.parametrize(("bits", "dims"), [(2, 2), (3, 3), (2, 4)])
def test_hilbert_curve(bits, dims):
    """Every cell once, and each step goes to a neighbour."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = PK.hilbert_index(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packer():
    r = random.Random(1)
    packer, sizes = PK.Packer(100), []
    rows = []
    for _ in range(4):
        block = [r.choice([0, 1, 5, 30, 60, 99, 100, 101, 250, 300]) for _ in range(500)]
        rows += [(i + len(sizes), *rest) for i, *rest in packer.add(block)]
        sizes += block
    used, parts = Counter(), defaultdict(list)
    for item, piece, first, n, container in rows:
        used[container] += n
        parts[item].append((piece, first, n))
    assert max(used.values()) <= 100 and sorted(used) == list(range(packer.made))
    for item, size in enumerate(sizes):
        own = sorted(parts[item])
        assert sum(n for _, _, n in own) == size and [f for _, f, _ in own] == [sum(n for _, _, n in own[:i]) for i in range(len(own))]
        assert len(own) == max(1, -(-size // 100))
    assert sum(sizes) / (100 * len(used)) > 0.97
    with pytest.raises(ValueError):
        PK.Packer(0)


def test_pack(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    placed = PK.pack(docs, {1: 256, 3: 4096}, rows_per_task=300)
    sizes = {r.doc_id: r.n_tokens for r in TK.sized(docs, "doc_id", "text").collect()}
    rows = placed.collect()
    for pack_id, capacity in ((1, 256), (3, 4096)):
        total, used = Counter(), Counter()
        for r in rows:
            if r.pack_id == pack_id:
                total[r.doc_id] += r.n_tokens
                used[r.container] += r.n_tokens
        assert total == Counter(sizes) and set(total) == set(sizes) and max(used.values()) <= capacity
        assert sum(used.values()) / (capacity * len(used)) > 0.95
    again = {(r.pack_id, r.doc_id, r.piece, r.container) for r in PK.pack(docs, {1: 256, 3: 4096}, rows_per_task=300).collect()}
    assert again == {(r.pack_id, r.doc_id, r.piece, r.container) for r in rows}


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, None), (4, ""), (5, "long " * 3000)], "doc_id long, text string").withColumn("curve", F.lit(1)).withColumn("task", F.lit("x"))
    got = PK.pack(df, {7: 10}).collect()
    assert {r.doc_id for r in got} == {1, 2, 4, 5} and all(r.n_tokens <= 10 for r in got)
    assert PK.pack(df.where("false"), {7: 10}).collect() == []


def brute(weights, seats, caps):
    quotas = [0] * len(weights)
    for _ in range(seats):
        can = [i for i, w in enumerate(weights) if w > 0 and quotas[i] < caps[i]]
        if not can:
            break
        quotas[max(can, key=lambda i: (weights[i] / (2 * quotas[i] + 1), -i))] += 1
    return quotas


def test_sainte_lague_equals_seat_by_seat():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 9)
        weights = [r.choice([0.0, 1.0, 1.0, r.random(), 5 * r.random()]) for _ in range(n)]
        caps = [r.choice([0, 3, 20, 10**6]) for _ in range(n)]
        seats = r.choice([0, 1, 7, 60, 500])
        assert MX.sainte_lague(weights, seats, caps) == brute(weights, seats, caps)
    assert sum(MX.sainte_lague([0.3, 0.2, 0.5], 10**7, [10**9] * 3)) == 10**7


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    targets = spark.read.parquet("/root/testdata/sf0.1/mix_targets.parquet")
    mixed = MX.mix(docs, targets, shard_tokens=300_000)
    report = MX.shares(mixed, targets).collect()
    assert all(r.most_repeats <= r.max_repeats and abs(r.actual_share - r.target_share) < 0.01 for r in report)
    assert any(r.most_repeats == r.max_repeats for r in report)
    keys = [r.doc_id for r in mixed.collect()]
    assert len(keys) == len(set(keys))


@pytest.mark.parametrize("shard_tokens", [400, 2000, 20_000, 64_000_000])
def test_size_and_shares_at_any_shard_size(spark, shard_tokens):
    docs, targets = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/mix_targets.parquet")
    report = MX.shares(MX.mix(docs, targets, total_tokens=100_000, blocks=200, shard_tokens=shard_tokens), targets).collect()
    assert abs(sum(r.tokens for r in report) / 100_000 - 1) < 0.02
    assert all(abs(r.actual_share - r.target_share) < 1 / 200 for r in report)


def test_steps():
    held = [(0, 5), (1, 50), (2, 5), (3, 4)]
    assert MX._steps(held, 10) == [0, 2] and MX._steps(held, 14) == [0, 2, 3] and MX._steps(held, 0) == [] and MX._steps([(7, 50)], 30) == [7] and MX._steps([], 5) == []


def test_mix_beyond_what_caps_allow(spark):
    rows = [(i, "word " * 20, "a" if i < 10 else "b") for i in range(200)] + [(900, None, "a"), (901, "", "b"), (902, "x", None), (903, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("n_tokens", F.lit(5))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in MX.shares(MX.mix(docs, targets, total_tokens=10**6), targets).collect()}
    assert (report["a"].n_records, report["a"].most_repeats, report["b"].n_records, report["b"].most_repeats) == (10, 2, 190, 1) and report["none"].tokens == 0
    fair = {r.source: r for r in MX.shares(MX.mix(docs, targets), targets).collect()}
    assert abs(fair["a"].actual_share - 5 / 9) < 0.05 and fair["a"].most_repeats == 2
    assert MX.mix(docs.where("false"), targets).collect() == []
    assert MX.mix(docs, targets.where("false")).collect() == []


def spans_of(texts, span):
    """Brute force: windows of each text, pairs that share one, and covered points."""
    grams = [None if t is None else [t[i : i + span] for i in range(len(t) - span + 1)] for t in texts]
    where = defaultdict(set)
    for i, g in enumerate(grams):
        for x in g or []:
            where[x].add(i)
    pairs = {(i, j) for docs in where.values() for i in docs for j in docs if i < j}
    covered = []
    for g in grams:
        points = set()
        for at, x in enumerate(g or []):
            if len(where[x]) > 1:
                points.update(range(at, at + span))
        covered.append(points)
    return pairs, covered


@pytest.mark.parametrize(("span", "k"), [(40, 20), (30, 30), (25, 5)])
def test_shared_spans_against_brute_force(spark, span, k):
    r = random.Random(span)
    pieces = ["".join(r.choice("abcd é日\n") for _ in range(150)) for _ in range(8)]
    texts = []
    for _ in range(70):
        text = "".join(r.choice("efghi jkl") for _ in range(r.choice([0, 3, 40])))
        for _ in range(r.randint(0, 3)):
            piece, n = r.choice(pieces), r.choice([span - 1, span, span + 1, 2 * span, 100])
            at = r.randint(0, len(piece) - n)
            text += piece[at : at + n] + "".join(r.choice("mnopq") for _ in range(r.choice([0, 1, 30])))
        texts.append(text)
    texts += ["a" * 120, "a" * 90, "b" + "a" * (span - 1), "", None, texts[5], texts[5], "ab" * 60, "ab" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("h", F.lit(1)).withColumn("doc", F.lit("x")).repartition(3)
    pairs, covered = spans_of(texts, span)
    assert {(x.a, x.b) for x in SS.shared_pairs(df, span=span, k=k).collect()} == pairs
    amount = {x.doc: x for x in SS.shared_amount(df, span=span, k=k).collect()}
    assert [amount[i].shared for i in range(len(texts))] == [len(c) for c in covered]
    for x in SS.shared_spans(df, span=span, k=k).collect():
        assert set(range(x.start, x.stop)) <= covered[x.doc]


def test_edits_of_equal_length_end_a_span(spark):
    """Forms that differ in a date or a number only: what stands between shared runs is compared as well."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = []
    for n, edit in [(180, 10), (190, 4), (199, 1), (199, 8), (199, 30), (250, 8), (150, 120)] * 3:
        before, after = text(n), text(n)
        texts += [before + c * edit + after for c in "XY"]
    pairs, covered = spans_of(texts, 200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {(x.a, x.b) for x in SS.shared_pairs(df).collect()} == pairs and len(pairs) == 3
    assert [n for _, n in sorted((x.doc, x.shared) for x in SS.shared_amount(df).collect())] == [len(c) for c in covered]


def test_selection_does_not_depend_on_the_batch():
    r = random.Random(4)
    texts = ["".join(r.choice("abc é") for _ in range(n)) for n in (500, 10, 300, 0, 220)]
    whole = SS.select_kmers(texts, 50, 100)
    for i, t in enumerate(texts):
        alone = SS.select_kmers([t], 50, 100)
        mine = whole[0] == i
        assert whole[1][mine].tolist() == alone[1].tolist() and whole[2][mine].tolist() == alone[2].tolist()


def test_long_texts_go_in_parts(monkeypatch):
    r = random.Random(6)
    text = "".join(r.choice("abc é") for _ in range(1000)) + "x" * 400
    whole = SS.select_kmers([text], 50, 100)
    monkeypatch.setattr(SS, "BLOCK", 128)
    where, h = SS._select_long(text, 50, 100)
    assert where.tolist() == whole[1].tolist() and h.tolist() == whole[2].tolist()


def test_spans_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert SS.shared_pairs(df).collect() == [] and SS.shared_pairs(df.where("false")).collect() == []
    assert sorted((r.doc, r.shared, r.share) for r in SS.shared_amount(df).collect()) == [(1, 0, None), (2, 0, None), (3, 0, 0.0)]
    with pytest.raises(ValueError):
        SS.shared_pairs(df, k=300)
