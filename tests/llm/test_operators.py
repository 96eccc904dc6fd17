"""Each operator against brute force or a round trip, on small tables with odd rows."""

import glob
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import chat, common, components, contamination, deobfuscate, embeddings, nearcopies, packing, quality, shards, simhash, substrings, templates, tokens, toxicity

import public_tokenizers

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, block int, anchor string, row long, doc long"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"block": F.lit(1), "anchor": F.lit("x"), "row": F.lit(2), "n": F.lit(None).cast("string"), "found": F.lit(3.0)})


def random_docs(seed, n=40):
    """Texts with copies, edits, shared passages, nulls, empty and very long ones, and repeated rows."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice(WORDS) for _ in range(k)]
    passage, base = some(60), some(150)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, " ".join(some(19))), (5, " ".join(["same"] * 100)), (6, " ".join(some(6000) + passage))]
    for i in range(7, n):
        kind = i % 5
        words = some(rng.randrange(5, 200))
        if kind == 0:
            words = words + passage[rng.randrange(30) :] + some(10)
        elif kind == 1:
            words = list(base)
        elif kind == 2:
            words = list(base)
            words[rng.randrange(len(base))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows + [rows[9], rows[9], (rows[11][0], rows[11][1])]


def python_words(text):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]


def test_word_hashes_and_segments(monkeypatch):
    text = ("aé b  c\t\nlonger " * 300).encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "_SEGMENT", 50)
    places, cut = common.located_words(text)
    assert (whole == cut).all() and [text[p : p + 1] for p in places[:3].tolist()] == [b"a", b"b", b"c"]
    assert len(set(whole.tolist())) == 4 and len(common.word_hashes(b"")) == 0


def test_written_frames_are_deleted_when_nothing_reads_them(spark):
    import os

    df = spark.range(5)
    with common.swept(spark) as keep:
        one, two = keep(common.materialise(df, "one")), common.materialise(df, "two", zstd=3)
        there = lambda x: os.path.isdir(x._written.removeprefix("file://"))
        assert there(one) and there(two) and two.count() == 5
    assert there(one) and not there(two) and one.count() == 5
    common.discard(one, df)
    assert not there(one)


def test_partitions_grow_with_the_input(spark, monkeypatch, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert common.partitions(table) == common.partitions(spark.createDataFrame([(1,)], "a int")) == least
    monkeypatch.setattr(common, "PARTITION", 1 << 10)
    assert common.partitions(table) > 50


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    want = brute_components([(i, i) for i in {x for p in pairs for x in p if x is not None}], lambda a, b, e={frozenset(p) for p in pairs}: frozenset((a, b)) in e)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(want[i] == r for i, r in got.items()) and all(i in got or want[i] == i for i in want)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# tokens and packing


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


ODD = ["", " ", "  a", "a  b ", "a \n b", "don't 's'S", "<|endoftext|> x", "a <|endoftext|> b", "a  <|endoftext|><|endoftext|>  b", "<|endoftext", "é è c　d", "a\t\tb", "12 3½ab $$$", "😀 😀😀", "a\u0085b\x1cc", "x" * 300, "A" + " " * 40 + "b", "ﬁ ß İ", "a​b"]


def test_ids_are_those_of_the_library(reference, monkeypatch):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def same(text):
        assert tokens.bpe(VOCAB).ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids

    for text in ODD:
        same(text)
    settings(max_examples=150, deadline=None)(given(st.text(max_size=60))(same))()
    monkeypatch.setattr(tokens, "PART", 7)
    for text in [*ODD, "some words  and\nmore of  them 'll go on " * 3]:
        same(text)
    reference.encode_special_tokens = True
    try:
        for text in ODD:
            assert tokens.bpe(VOCAB, plain=True).ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids
    finally:
        reference.encode_special_tokens = False


def test_packing(spark, reference):
    rows = [*random_docs(3), (90, "a <|endoftext|> b")]
    got = packing.best_fit_packing(frame(spark, rows), VOCAB, capacity=64, block=16).toPandas()
    assert len(got) == sum(max(1, -(-(len(reference.encode(t or "", add_special_tokens=False).ids) + 1) // 64)) for _, t in rows)
    for seq in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in seq[1].itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 64
    text = dict(rows)
    for r in got.itertuples():
        ids = np.array(reference.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 64 or r.piece == 0
    assert packing.best_fit_packing(frame(spark, []), VOCAB).count() == 0


@pytest.mark.parametrize("opening", [False, True])
def test_packing_rule_against_brute_force(opening):
    """Every placement is one whose sum of squares, counted anew for each choice, is smallest."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40, 120):
        lengths, capacity = rng.integers(1, 12, n), 11
        got = packing.pack(lengths, capacity, opening)
        gaps, at = {}, np.zeros(n, dtype=int)

        def total(change):
            now = gaps | change
            counts = [sum(1 for g in now.values() if g == x) for x in range(1, capacity)]  # full sequences and empty ones don't count
            return sum(c * c for c in counts)

        order = sorted(range(n), key=lambda i: -lengths[i])
        for i in order:
            s, seq, off = int(lengths[i]), int(got[0][i]), int(got[1][i])
            gap = gaps.get(seq, capacity)
            assert off == capacity - gap >= 0 and s <= gap
            choices = {x: total({x: g - s}) for x, g in gaps.items() if g >= s and g}
            if opening or not choices:
                choices[max(gaps, default=-1) + 1] = total({max(gaps, default=-1) + 1: capacity - s})
            assert choices[seq] == min(choices.values())
            gaps[seq] = gap - s


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    for n in (1, 7, 5000):
        lengths = rng.integers(1, 1024, n)
        seq, _ = packing.pack(lengths, 1024)
        assert seq.max() + 1 <= -(-lengths.sum() // 1024) + max(2, n // 200)


def test_shards_round_trip(spark, reference, tmp_path):
    rows = random_docs(4)
    out = f"file://{tmp_path}/shards"
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards/_00000000-left-by-a-lost-task").write_bytes(b"x")
    got = shards.materialise_order(frame(spark, rows).repartition(3), VOCAB, out, length=32, per_shard=20).toPandas()
    n = got.slot.max() + 1
    assert sorted(set(got.slot)) == list(range(n)) and len(glob.glob(f"{tmp_path}/shards/shard-*")) == -(-n // 20) and not glob.glob(f"{tmp_path}/shards/_*")
    every = shards.read_slots(out, 0, 10**6)
    assert len(every) == n and (shards.read_slots(out, 17, 30) == every[17:47]).all() and len(shards.read_slots(out, n, 5)) == 0
    ids = {i: reference.encode(t or "", add_special_tokens=False).ids + [50256] for i, t in rows}
    assert sum(got.n_ids) == sum(len(ids[i]) for i, _ in rows) and n < sum(got.n_ids) / 32 + 4  # a padded sequence a split at most
    assert sorted(got[got.piece == 0].doc_id) == sorted(i for i, _ in rows)
    flat = {x: open(f"{tmp_path}/shards/shard-{x:08d}.bin", "rb").read() for x in set(got.shard)}
    for r in got.itertuples():
        part = flat[r.shard][r.byte_offset : r.byte_offset + 2 * r.n_ids]
        assert r.shard == r.slot // 20 and r.byte_offset // 64 == r.slot % 20 and zlib.crc32(part) == r.crc32
        assert np.frombuffer(part, dtype="<u2").tolist() == ids[r.doc_id][r.start : r.start + r.n_ids]
    starts = got.sort_values(["doc_id", "piece"]).groupby(["doc_id", "piece"]).start.nunique()
    assert (starts >= 1).all()
    empty = f"file://{tmp_path}/empty"
    assert shards.materialise_order(frame(spark, []), VOCAB, empty).count() == 0 and len(shards.read_slots(empty, 0, 3)) == 0


def test_shards_without_a_manifest_are_not_read(spark, tmp_path):
    out = f"file://{tmp_path}/torn"
    shards.materialise_order(frame(spark, [(1, "a b")]), VOCAB, out, length=32)
    with pytest.raises(Exception, match="fit"):
        shards.materialise_order(frame(spark, [(1, "a b")]), VOCAB, out, length=32, end=70_000).count()
    (tmp_path / "torn/manifest.json").unlink(missing_ok=True)
    with pytest.raises(FileNotFoundError):
        shards.read_slots(out, 0, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    a, b = (shards.permute(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a.tolist()) == list(range(n)) and (n < 50 or (a != b).any())


# repeated passages


def brute_repeats(rows, window=20):
    rows = list(rows)
    first = {}
    for i, t in rows:
        w = python_words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        w = python_words(t)
        cut = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                cut[s : s + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    rows = random_docs(seed)
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == brute_repeats(rows)
    assert all(sum(x.end - x.start for x in r.repeats) == r.n_removed for r in got)


def test_repeats_odd_rows(spark):
    long = " ".join(WORDS[:30])
    rows = [(1, long), (1, "other " + long), (None, long), (1, long)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == [("1", 30, 0), ("1", 30, 0), ("1", 31, 30), ("None", 30, 30)]
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# near duplicates


def brute_components(values, linked):
    ids = sorted(set(i for i, _ in values))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a][1], values[b][1]):
                x, y = find(values[a][0]), find(values[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_fingerprint(text, n):
    import xxhash

    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in python_words(text)]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("hold", [1 << 15, 3])
def test_simhash(spark, hold):
    rows = random_docs(5, 60)
    got = simhash.simhash_groups(frame(spark, rows), hold=hold).collect()
    prints = {i: brute_fingerprint(t, 4) for i, t in rows}
    want = brute_components(list(prints.items()), lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(got) == len(rows) and all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("threshold, hold", [(4, 100), (3, 2), (5, 2), (4, 2), (3, 100)])
def test_simhash_links_at_exactly_so_many_bits(spark, threshold, hold):
    rng = np.random.default_rng(2)
    points = []
    for b in rng.integers(0, 2**63, 8, dtype=np.uint64).tolist():
        points.append(b)
        for k in (1, 2, threshold, threshold + 1):
            points.append(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(points)], "fp long")
    links = simhash.edges(df, threshold, hold).collect()
    u = [int(np.int64(r.fp).view(np.uint64)) for r in df.collect()]
    want = brute_components([(p, p) for p in u], lambda a, b: (a ^ b).bit_count() <= threshold)
    linked = {frozenset(int(np.int64(x).view(np.uint64)) for x in r[:2]) for r in links}
    assert brute_components([(p, p) for p in u], lambda a, b: frozenset((a, b)) in linked) == want and simhash.simhash_groups(frame(spark, [])).count() == 0


def test_near_copies(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(300)]
        for edits in (0, 0, 2, 4):
            w = list(base)
            for at in rng.sample(range(300), edits):
                w[at] = f"e{n}-{at}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "short"), (None, "no id"), (0, rows[0][1])]
    sets = {i: set(nearcopies.shingle_set(t, 5).tolist()) for i, t in rows if i is not None}
    want = brute_components(list(sets.items()), lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(frame(spark, rows)).collect()}
    assert got == want
    kept = nearcopies.drop_near_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values())) and kept.where("doc_id IS NULL").count() == 1
    assert kept.columns == frame(spark, rows).columns and nearcopies.drop_near_copies(frame(spark, [])).count() == 0


def cut_and_extended(rng, n, lo=0.805, hi=0.9):
    """Pairs of texts of 60 to 600 words at similarities from lo to hi: one cut short, extended or with a block taken out."""
    for i in range(n):
        size = rng.randrange(60, 600)
        words = [f"{rng.choice(WORDS)}x{rng.randrange(40)}" for _ in range(size)]
        less = max(1, int(size * (1 - rng.uniform(lo, hi))) - 9)
        at = [0, size - less, rng.randrange(size - less)][i % 3]
        yield " ".join(words), " ".join(words[:at] + words[at + less :])


def test_near_copies_cut_short(spark):
    rows = [(2 * i + k, t) for i, pair in enumerate(cut_and_extended(random.Random(3), 300)) for k, t in enumerate(pair)]
    sets = [set(nearcopies.shingle_set(t, 5).tolist()) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_copies_behind_the_same_vocabulary(spark):
    rng, rows = random.Random(4), []
    for i in range(8):
        words = [f"{w}{i}" for w in WORDS[:200]]
        for _ in range(2):
            rng.shuffle(words)
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words[20:] + words[:20])))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(frame(spark, rows)).collect()}
    assert got == {i: i - (i % 3 == 2) for i, _ in rows}


def test_near_copies_at_full_anchors(spark):
    rng, rows = random.Random(6), []
    for _ in range(3):
        base = [rng.choice(WORDS) for _ in range(200)]
        for _ in range(40):
            w = list(base)
            at = rng.randrange(170)
            w[at : at + 22] = [f"e{len(rows)}-{k}" for k in range(22)]
            rows.append((len(rows), " ".join(w)))
    pairs = [(i, " ".join(t.split()[: -rng.randrange(2, 5)])) for i, t in rows]
    rows += [(1000 - i, t) for i, t in pairs]
    sets = [(i, set(nearcopies.shingle_set(t, 5).tolist())) for i, t in rows]
    want = brute_components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(frame(spark, rows), hold=2).collect()}
    assert len(set(want.values())) > 40 and got == want


VECTORS = "vec_id long, embedding array<float>, label int, n long, node string, raw string"


def brute_links(rows, threshold=0.98):
    ok = [(i, np.array(e, dtype=np.float32).astype(float), lab) for i, e, lab in rows if i is not None and e and lab is not None and None not in e and np.isfinite(np.array(e, dtype=float)).all() and np.any(np.array(e))]
    n = {}
    for a in range(len(ok)):
        for b in range(len(ok)):
            x, y = ok[a], ok[b]
            if a != b and x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= threshold:
                n.setdefault(x[0], set()).add((b, y[0]))
    return ok, n


def test_embeddings_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.1, 0.0], [0.0, 1.0, 0.0, 0.1]
    rows = [(5, a, 0), (5, b, 0), (7, [1.0, 0.0, 0.11, 0.0], 0), (8, [0.0, 1.0, 0.0, 0.11], 0), (9, a, 1)]
    got = embeddings.near_vectors(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False), (9, 0, 9, True)]


@pytest.mark.parametrize("sublist", [2048, 4])
def test_embeddings(spark, monkeypatch, sublist):
    monkeypatch.setattr(embeddings, "SHARE", 8)
    monkeypatch.setattr(embeddings, "SUBLIST", sublist)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (c + 0.09 * rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(5) > 0)))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] + [1.0] * 15, 0), (1004, rows[0][1], None), (1005, [1.0, None], 0), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2]), (1009, [1e30] * 16, 1), (1010, [1e-30] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    ok, links = brute_links(rows)
    want = brute_components([(i, i) for i, _, _ in rows if i is not None], lambda a, b: any(y == b for _, y in links.get(a, ())) or any(y == a for _, y in links.get(b, ())))
    assert len(got) == len(rows)
    for i in want:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), want[i], want[i] == i), i
    assert embeddings.near_vectors(df.where("false")).count() == 0


# decontamination


def brute_contained(rows, items, n=5, least=0.8):
    def sh(text, k):
        w = contamination.normalise(text).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = []
    for d, t in rows:
        for i, text in items:
            k = min(n, len(contamination.normalise(text).split()))
            own = sh(text, k) if k else set()
            shared = len(own & sh(t, k)) if k else 0
            if own and shared >= least * len(own):
                out.append((d, i, len(own), shared))
    return sorted(out)


@pytest.mark.parametrize("bits", [(16, 30), (6, 6)])
def test_contamination(spark, monkeypatch, bits):
    monkeypatch.setattr(contamination, "FILTER_BITS", bits)
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(k))) for i, k in enumerate((1, 3, 5, 8, 20, 40, 60))] + [(7, None), (8, "!!"), (9, "Same same SAME"), (10, "W1, w2; w3 w4: w5 w6")]
    rows = random_docs(8, 20)
    for j, (i, t) in enumerate(items):
        w = (t or "").split()
        for drop in (0, 1, 4):
            k = list(w)
            for _ in range(drop):
                if k:
                    k[rng.randrange(len(k))] = "z"
            rows.append((100 + 10 * j + drop, " ".join(["x1 x2"] + k + ["y1"] * 30).upper()))
    df, it = frame(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contamination.contained_items(df, it).collect())
    assert got == brute_contained(rows, items) and len(got) > 10
    bad = {d for d, *_ in got}
    left = contamination.decontaminate(df, it)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in rows if d not in bad) and left.columns == df.columns
    assert contamination.contained_items(df, it.where("false")).count() == 0 and contamination.decontaminate(df.where("false"), it).count() == 0


# line templates


def brute_templates(rows, min_docs, similar, depth=3):
    """Masked lines of recurring templates, with nothing of the operator's own."""
    import re

    leaves = {}
    for t in {t for _, t in rows if t}:
        for line in t.split("\n"):
            tokens = ["<*>" if re.search(r"[0-9@]", x) else x for x in line.split()]
            lead = [(i, x) for i, x in enumerate(tokens) if x != "<*>"][:depth]
            if lead:
                leaves.setdefault((len(tokens), *lead), {}).setdefault(" ".join(tokens), set()).add(t)
    dropped = set()
    for lines in leaves.values():
        groups = []
        for m in sorted(lines, key=lambda x: x.encode()):
            best = max(groups, key=lambda g: sum(a == b for a, b in zip(g[0], m.split(" "))), default=None)
            if best and sum(a == b for a, b in zip(best[0], m.split(" "))) >= similar * (m.count(" ") + 1) - 1e-9:
                best[0] = [a if a == b else "<*>" for a, b in zip(best[0], m.split(" "))]
                best[1].append(m)
            else:
                groups.append([m.split(" "), [m]])
        for _, members in groups:
            if len(set().union(*(lines[m] for m in members))) >= min_docs:
                dropped |= set(members)
    return dropped


def masked_line(x):
    return " ".join("<*>" if set(w) & set("0123456789@") else w for w in x.split())


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_line_templates(spark, monkeypatch, sent):
    monkeypatch.setattr(templates, "SENT", sent)
    rng = random.Random(5)
    letters = str.maketrans("0123456789", "abcdefghij")
    body = lambda: " ".join(rng.choice(WORDS).translate(letters) for _ in range(12))
    rows = [(0, None), (1, ""), (2, "\n\n")]
    copy = "\n".join(body() for _ in range(4))
    for i in range(3, 60):
        lines = [body() for _ in range(3)]
        if i % 2:
            lines.insert(rng.randrange(4), f"Copyright (c) {i} by the {rng.choice(['first', 'second'])} authors of this page")
        if i % 5 == 0:
            lines.append("All rights are reserved.")
        if i % 3 == 0:
            lines.append(f"Page {i}")
        if i % 4 == 0:
            lines.append(f"{i} {i}\n2024-01-{i:02} {i}:00 ERROR disk full on host {i}")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, copy) for i in range(20)]
    df = frame(spark, rows).withColumns({"a`b": F.lit(1), "odd": F.struct(F.lit(1).alias("p q"))})
    got = templates.drop_recurring_lines(df, min_docs=8)
    dropped = brute_templates(rows, 8, 0.7)
    assert {m.split()[0] for m in dropped} == {"Copyright", "All", "Page", "<*>"} and "<*> <*>" not in dropped
    text = dict(rows)
    for r in got.collect():
        want = None if text[r.doc_id] is None else [x for x in text[r.doc_id].split("\n") if masked_line(x) not in dropped]
        assert r.text == (None if want is None else "\n".join(want)) and r.n_lines == (0 if text[r.doc_id] is None else text[r.doc_id].count("\n") + 1)
        assert r.n_removed == r.n_lines - (0 if want is None else len(want))
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and templates.drop_recurring_lines(df.where("false")).count() == 0


def test_line_templates_of_random_logs(spark):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice(["a", "b", "c", str(rng.randrange(99)), rng.choice("uvwxyz")]) for _ in range(rng.randrange(1, 8)))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(400)]
    dropped = brute_templates(rows, 5, 0.7)
    got = {r.doc_id: r.text for r in templates.drop_recurring_lines(frame(spark, rows), min_docs=5).collect()}
    assert len(dropped) > 15 and got == {i: "\n".join(x for x in t.split("\n") if masked_line(x) not in dropped) for i, t in rows}


def test_templates_recur_whatever_surrounds_them(spark):
    rng = random.Random(12)
    alone = [f"Copyright notice {i} of the example site" for i in range(40)]
    same = ["Read our terms before you go on here.", "Sign up for the letter that we send."]
    pages = ["\n".join([*same, prose(rng, 12)]) for _ in range(200)] + ["\n".join(same)] * 200
    short = ["\n".join(["All rights reserved.", prose(rng, 12)]) for _ in range(40)]
    got = templates.drop_recurring_lines(frame(spark, list(enumerate(alone + pages + short)))).toPandas().n_removed
    assert (sum(got[:40]), sum(got[40:440]), sum(got[440:])) == (40, 800, 40)


def prose(rng, n):
    return " ".join(rng.choice(WORDS).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


def test_line_templates_among_copies_and_boilerplate(spark):
    rng = random.Random(8)
    license, page = "This text may be copied under the usual terms.", [prose(rng, 12) for _ in range(6)]
    rows = [f"{license}\n{prose(rng, 15)}\n{prose(rng, 15)}" for _ in range(30)]
    for _ in range(200):  # near copies of one page
        line, words = rng.randrange(6), [x.split() for x in page]
        words[line][rng.randrange(3, 12)] = "edited"
        rows.append("\n".join([license, *map(" ".join, words)]))
    shared = [prose(rng, 14) for _ in range(5)]  # seventy words in a hundred
    rows += ["\n".join([*shared, prose(rng, 15), prose(rng, 15)]) for _ in range(80)]
    got = [r.text for r in templates.drop_recurring_lines(frame(spark, list(enumerate(rows))), apart=True).orderBy("doc_id").collect()]
    gone = {license, *shared}
    assert got == ["\n".join(x for x in t.split("\n") if x not in gone) for t in rows]


def test_line_templates_of_a_full_leaf():
    rng = random.Random(2)
    lines = [f"<*> <*> <*> {' '.join(f'w{rng.randrange(10**6)}' for _ in range(7))}" for _ in range(1500)] + [f"<*> <*> <*> z the job {k} has ended well now" for k in range(20)]
    leaf = templates.Leaf(0.7)
    assert len({leaf.template(m) for m in sorted(lines)}) == 1501
    few = sorted({" ".join(["a b c", *(rng.choice(["x", "y", "<*>", f"v{rng.randrange(9)}"]) for _ in range(rng.choice([3, 6])))]) for _ in range(2000)})
    for n in (6, 9):
        leaf, groups = templates.Leaf(0.7), []
        for m in (x for x in few if x.count(" ") == n - 1):
            agree = lambda g: sum(a == b for a, b in zip(g[0], m.split(" ")))  # noqa: B023, E731
            best = max(groups, key=agree, default=None)
            if best and agree(best) >= 0.7 * n - 1e-9:
                best[0] = [a if a == b else "<*>" for a, b in zip(best[0], m.split(" "))]
            else:
                best = [m.split(" "), templates._hash(m)]
                groups.append(best)
            assert leaf.template(m) == best[1]


# classifiers


def labelled_docs(seed, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        toxic, junk = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vileling", "grubber", "v1l3ling", "g r u b b e r", "gruuubber"]))
        if junk:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled_docs(1)
    df = frame(spark, rows + [(9001, None), (9002, ""), (None, "x y"), rows[0], (9003, "long word " * 30000)])
    lab = spark.createDataFrame([(*x, "s") for x in labels] + [(1, None, None, "s"), (2, labels[2][1], 0, "s")], "doc_id long, quality int, toxic int, text string")
    got = quality.quality_scores(df, lab).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 50
    kept = quality.keep_quality(df, lab)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert {r.score for r in quality.quality_scores(df, lab.where("false")).collect()} == {0.5} and quality.quality_scores(df.where("false"), lab).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 8), [60 if y else 61]])) for y in range(2) for _ in range(100)]
    y = np.repeat([0, 1], 100)
    ratio = quality.log_count_ratios(rows, y, 6)
    w, b = quality.dual_coordinate_descent(rows, y, ratio)
    margin = np.array([(w * ratio)[r].sum() / len(r) ** 0.5 + b for r in rows])
    assert ((margin > 0) == (y > 0)).all()


def exact_dual(z, y, c):
    """The best dual variables of the hinge loss, by trying which are at 0, at their bound, or between."""
    from itertools import product

    n, q, best = len(y), (z * y[:, None]) @ (z * y[:, None]).T, None
    for kind in product((0, 1, 2), repeat=n):
        a = np.where(np.array(kind) == 1, c, 0.0)
        free = np.array(kind) == 2
        if free.any():
            a[free] = np.linalg.lstsq(q[np.ix_(free, free)], 1 - q[np.ix_(free, ~free)] @ a[~free], rcond=None)[0]
        if (a < -1e-9).any() or (a > c + 1e-9).any():
            continue
        value = a.sum() - a @ q @ a / 2
        if best is None or value > best[0]:
            best = value, a
    return best


def test_dual_coordinate_descent_against_an_exact_solver():
    rng = np.random.default_rng(3)
    for trial in range(6):
        n, bits = 7, 4
        rows = [np.unique(rng.integers(0, 1 << bits, 5)) for _ in range(n)]
        y = np.array([1, 0, 1, 0, 0, 1, 0])
        scale = rng.normal(size=1 << bits) * (1 + trial)
        w, b = quality.dual_coordinate_descent(rows, y, scale, epochs=20_000, tolerance=1e-12)
        z = np.zeros((n, (1 << bits) + 1))
        for i, x in enumerate(rows):
            z[i, x], z[i, -1] = scale[x] / len(x) ** 0.5, 1.0
        sign, c = np.where(y > 0, 1.0, -1.0), np.where(y > 0, n / (2 * 3), n / (2 * 4))
        value, alpha = exact_dual(z, sign, c)
        want = (alpha * sign) @ z
        own = np.append(w, b)
        primal = lambda v: v @ v / 2 + (c * np.maximum(0, 1 - sign * (z @ v))).sum()  # noqa: B023, E731
        assert abs(primal(want) - value) < 1e-6 and abs(primal(own) - value) < 1e-6 and np.abs(own - want).max() < 1e-4


def test_toxicity_without_labels(spark):
    df = frame(spark, [(1, "plain words"), (2, None), (1, "plain words"), (3, "")])
    lab = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    for some in (lab.where("false"), lab.where("doc_id = 1"), lab):
        got = toxicity.toxicity_scores(df, some).collect()
        assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 < got[0].score <= 0.5


def test_toxicity(spark):
    rows, labels = labelled_docs(2, 1500)
    df = frame(spark, rows + [(9001, None), (9002, ""), (None, "x y"), rows[0], (9003, "long word " * 30000), (9004, "$" * 5000)])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(df, lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 100
    assert toxicity.toxicity_scores(df.where("false"), lab.where("false")).count() == 0


def test_restoring_words():
    texts = ["the quick idiot trash stupid loser worthless moron pathetic people are here and there"] * 50
    r = deobfuscate.Restorer(deobfuscate.language_model(sum(deobfuscate.trigram_counts(t) for t in texts)))
    assert r.restore("1d10t, TR@SH! s.t.u.p.i.d l0ser w o r t h l e s s m0r0n### stuuupid the$$$ p4thet1c") >= {"idiot", "trash", "stupid", "loser", "worthless", "moron", "the", "pathetic"}
    assert r.restore(None) == r.restore("") == set() and r.restore("plain words, here.") == {"plain", "words", "here"}


def lattice_paths(s, i=0):
    """All writings of a word from place i on with the costs of the channel, by the rules as they are written down."""
    if i == len(s):
        yield "", 0.0
        return
    c, n = s[i], 1
    while i + n < len(s) and s[i + n] == c:
        n += 1
    fresh = n  # signs of this run that are left
    letters = c if c.isalpha() else deobfuscate.LOOKS.get(c, "")
    cost = 0.0 if c.isalpha() else 1.5
    steps = []
    for x in letters:
        steps.append((1, x, cost))
        if fresh >= 2:
            steps.append((n, x, cost + 0.4))
        if fresh >= 3:
            steps.append((n, 2 * x, cost + 0.8))
    if c == "*":
        steps += [(1, x, 2.0) for x in "abcdefghijklmnopqrstuvwxyz"]
    if not c.isalpha():
        steps.append((1, c, 3.0))
        if c in deobfuscate.SEPARATORS:
            steps.append((n, "", 0.7))
    for k, x, price in steps:
        for rest, more in lattice_paths(s, i + k):
            yield x + rest, price + more


def test_decoding_against_all_paths():
    texts = ["you stupid idiot and moron of a grubber, this is the worst day of the week so far"] * 3
    model = deobfuscate.language_model(sum(deobfuscate.trigram_counts(t) for t in texts))
    r = deobfuscate.Restorer(model)

    def total(text, cost):
        s = [0, 0, *(deobfuscate._symbol(x) for x in text), 0]
        return sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:])) - cost

    rng = random.Random(4)
    words = ["1d10t", "st*p1d", "m.0.r", "sttuup", "aaa", "w--d", "6o0", "!!", "*", "a b", "1111"] + ["".join(rng.choice("abo01*.- $st6") for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    for w in words:
        costs = {}
        for text, cost in lattice_paths(w):
            costs[text] = min(cost, costs.get(text, 99.0))
        best = max(total(t, c) for t, c in costs.items())
        got = r.decode(w)
        assert got in costs and abs(total(got, costs[got]) - best) < 1e-9, w


def test_restoring_wanted_words():
    texts = ["you stupid idiot and moron of a grubber, this is the worst day of the week so far"] * 3
    wanted = deobfuscate.Wanted(["stupid", "idiot", "grubber"], ["grub"])
    r = deobfuscate.Restorer(deobfuscate.language_model(sum(deobfuscate.trigram_counts(t) for t in texts)), wanted=wanted)
    for text in ("st.upid", "stu-pid", "st*pid", "st up id", "s  t  u  p  i  d", "sttuupid", "stuu pid", "so stu\np1d!", "stupid.1diot", "you st u pid one", "ssttuuppiidd"):
        assert "stupid" in r.restore(text), text
    assert r.restore("stupid.1diot") >= {"stupid", "idiot"} and r.restore("ggrruubbberr") >= {"grubber"}
    assert r.restore("the week is so far") == {"the", "week", "is", "so", "far"}


def test_restoring_separated_words():
    texts = ["you stupid idiot and moron of a grubber, this is the worst day of the week so far"] * 3 + ["plain words of a well known kind are here"]
    r = deobfuscate.Restorer(deobfuscate.language_model(sum(deobfuscate.trigram_counts(t) for t in texts)))
    assert r.restore("id-iot, st.upid mo_ron g*r~ubber") >= {"idiot", "stupid", "moron", "grubber"}
    assert r.restore("s-t-u-p-id") >= {"stupid"} and r.restore("well-known words") >= {"well", "known", "words"}
    for blanks in (" ", "  ", " \t", "\n\n"):
        assert r.restore(blanks.join("stupid")) >= {"stupid"} and r.restore("s t u p i d   i d i o t") >= {"stupid", "idiot"} and r.restore(f"you {blanks.join('idiot')} here") >= {"you", "idiot", "here"}


def test_restoring_long_stretches():
    texts = ["you stupid idiot and moron of a grubber, this is the worst day of the week so far"] * 3
    r = deobfuscate.Restorer(deobfuscate.language_model(sum(deobfuscate.trigram_counts(t) for t in texts)))
    assert r.decode(" ".join("6ru66er" * 40)).replace(" ", "") == "grubber" * 40
    assert r.decode("-" * 50_000 + "id-iot" + "1" * 50_000).lstrip("-").startswith("idiot")


# chats


LOG = "conv_id long, seq long, turn long, role string, kind string, text string"


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 0, "user", "message", "hi"), (1, 1, 1, "assistant", "message", None), (1, 2, 1, None, "delta", "he"), (1, 3, 1, None, "delta", "llo"), (1, 4, 2, "user", "message", "bye"),
        (1, 5, 3, "assistant", "message", "gone"), (1, 6, 1, None, "regenerate", None), (1, 7, 1, None, "delta", "new "), (1, 8, 1, None, "delta", "one"), (1, 9, 0, None, "edit", "hi there"),
        (1, 10, 2, "user", "message", "next"), (2, 0, 0, "user", "message", "x"), (2, 1, 0, "user", "unknown", "y"), (2, 2, 0, None, None, "z"),
    ]
    random.Random(1).shuffle(log)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(spark.createDataFrame(log, LOG)).collect())
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "new one"), (1, 2, "user", "next"), (2, 0, "user", "x")]


def test_chats_round_trip(spark):
    texts = ["", None, "plain", "<|end|>\n<|user|>\nx", "\\### Assistant: </turn> ok", "a\\lb\\s<\\", "|>\n", "é😀 <", "\\s\\l"]
    rows = [(c, t, ["user", "assistant", None, "sys<|>tem"][(c + t) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(9) for t in range(c + 1)] + [(5, 2, "assistant", "tie"), (5, 2, "assistant", "tie")]
    chats = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string"))
    got = chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    assert len(got) == 9
    for r in got:
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [(b, c) for _, b, c in want]
        assert r.loss == "".join(c for _, b, c in want if b == "assistant")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
