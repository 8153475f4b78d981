"""Exact and near duplicates, sharding, decontamination."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowplace.llm import common, exact_refine, hilbert_shards, simhash_pivots, winnow

from .conftest import LONG, ODD, PLAIN

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def brute_components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_sketch_never_misses(spark):
    keys = spark.range(-5, 3000).selectExpr("id * 7919 as k")
    bitmaps = common.sketch(keys.filter("k % 2 = 0"), "k", 1 << 16)
    flagged = common.flag(keys, "k", "maybe", bitmaps, 1 << 16)
    assert flagged.filter("k % 2 = 0 and not maybe").count() == 0
    assert flagged.filter("k % 2 <> 0 and maybe").count() < 200
    assert flagged.columns == ["k", "maybe"]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}


def test_exact_groups_of_odd_rows(odd, none):
    got = Counter(
        (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_refine.exact_groups(odd, digest_all=True).collect()
    )
    want = Counter()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for body in {t or "" for _, t, *_ in ODD}:
        ids = [i for i, t, *_ in ODD if (t or "") == body]
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        for n, i in enumerate(ids):
            want[i, keep, len(ids), n == stays, sha(body)] += 1
    assert got == want
    assert exact_refine.exact_groups(none).count() == 0
    kept = exact_refine.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t, *_ in ODD})
    assert exact_refine.exact_dedup(none).count() == 0


def test_full_hash_only_for_survivors(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abcd"), (4, "x" * 100), (5, "x" * 99 + "y"), (6, "abc")], "doc_id long, text string")
    hashed = {r["doc_id"]: r["text_sha256"] is not None for r in exact_refine.exact_groups(docs).collect()}
    # 2 shares its length only, 3 nothing; 4 and 5 share length and beginning.
    assert hashed == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def brute_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    votes = Counter()
    for s, n in Counter(shingles).items():
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update({b: n for b in range(64) if h >> b & 1})
    return sum(1 << b for b, n in votes.items() if 2 * n > len(shingles))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_components(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], brute_print(r["text"], 3)) for r in docs.select("doc_id", "text").collect()]
    roots = brute_components([f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    want = Counter((i, f"{f:016x}", low.get(r)) for (i, f), r in zip(rows, roots, strict=True))
    got = simhash_pivots.near_components(docs).select("doc_id", simhash_pivots.hex_text("fingerprint"), "component_id")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_no_rows_have_no_components(none):
    assert simhash_pivots.near_components(none).count() == 0
    assert simhash_pivots.drop_similar(none).count() == 0


def test_links_find_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(2**63), 2**63, 60, dtype=np.int64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for flips in (1, 2, 3, 4, 6):
            mask = np.uint64(0)
            for b in rng.choice(64, flips, replace=False):
                mask |= np.uint64(1) << np.uint64(b)
            prints.add(int((s.view(np.uint64) ^ mask).view(np.int64)))
    prints = sorted(prints)
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash_pivots.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 3)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_similar_texts_are_dropped_and_others_stay(spark):
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{int(i)}" for i in rng.integers(0, 5000, n)]
    rows, clean = [], []
    for i in range(40):
        base = word(300)
        rows.append((i * 10, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for at in rng.integers(0, 300, 2):
                copy[at] = "changed"
            rows.append((i * 10 + c, " ".join(copy)))
    for i in range(1000, 1200):
        rows.append((i, " ".join(word(int(rng.integers(1, 400))))))
        clean.append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash_pivots.drop_similar(docs).collect()}
    assert set(clean) <= left
    assert {i for i in left if i < 1000} == {i * 10 for i in range(40)}


def test_drop_similar_of_odd_rows(odd):
    got = simhash_pivots.drop_similar(odd)
    assert got.columns == odd.columns
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert all(n == 1 for n in left.values())
    # Upper and lower case are one text here, texts without words another; the two long texts are near copies.
    assert set(left) == {(1, PLAIN), (3, None), (6, LONG), (8, "einzelwort"), (9, ODD[11][1])}


def test_hilbert_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        axis = [spark.range(1 << bits).select(F.col("id").alias(f"c{i}")) for i in range(dims)]
        cells = axis[0]
        for a in axis[1:]:
            cells = cells.crossJoin(a)
        names = [f"c{i}" for i in range(dims)]
        rows = cells.select(*names, hilbert_shards.hilbert_index([F.col(c) for c in names], bits).alias("h")).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(1 << bits * dims))
        for a, b in zip(rows, rows[1:], strict=False):
            assert sum(abs(a[c] - b[c]) for c in names) == 1


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_obey_the_law_of_rows(which, shards, request):
    docs = request.getfixturevalue(which)
    source = docs.select("doc_id", "text").collect()
    rows = hilbert_shards.hilbert_shards(docs, shards).collect()
    body = lambda r: (r["text"] or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (r["doc_id"], len(body(r)) + 16, zlib.crc32(body(r))) for r in source
    )
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(source) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    line = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in line] == sorted(r["curve"] for r in rows)
    # Equal texts are neighbours: a group has gaps nowhere, so at most one group lies across each cut.
    text = {r["doc_id"]: body(r) for r in source if r["doc_id"] is not None}
    places = defaultdict(list)
    for at, r in enumerate(line):
        if r["doc_id"] is not None:
            places[text[r["doc_id"]]].append(at)
    nulls = {at for at, r in enumerate(line) if r["doc_id"] is None}
    assert any(len(p) > 1 for p in places.values())
    for p in places.values():
        assert set(range(p[0], p[-1] + 1)) - set(p) <= nulls
    cut = [t for t, p in places.items() if len({line[at]["shard"] for at in p}) > 1]
    assert len(cut) < shards


def test_shards_of_nothing(none):
    assert hilbert_shards.hilbert_shards(none).count() == 0


def test_written_shards_come_back_whole(documents, tmp_path):
    hilbert_shards.write_shards(documents, f"file://{tmp_path}/s", 5)
    back = documents.sparkSession.read.parquet(f"file://{tmp_path}/s/rows")
    assert sorted(r["row"]["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in documents.collect())
    assert documents.sparkSession.read.parquet(f"file://{tmp_path}/s/boxes").count() == 5


def test_boxes_spare_shards(spark, documents, odd, tmp_path):
    path = f"file://{tmp_path}/s"
    hilbert_shards.write_shards(documents, path, 20)
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    size = lambda r: len((r["text"] or "").encode()) + 16
    rows = documents.collect()
    bounds = {"doc_id": (20, 60), "size": (0, sorted(map(size, rows))[len(rows) // 4])}
    for names in (["doc_id"], ["size"], ["doc_id", "size"]):
        got = hilbert_shards.read_box(spark, path, **{n: bounds[n] for n in names})
        within = lambda r: all(bounds[n][0] <= {"doc_id": r["doc_id"], "size": size(r)}[n] <= bounds[n][1] for n in names)
        assert sorted(r["row"]["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in rows if within(r))
        assert len(got.inputFiles()) < every
    assert hilbert_shards.read_box(spark, path, doc_id=(-9, -1)).count() == 0
    with pytest.raises(ValueError):
        hilbert_shards.write_shards(odd, f"file://{tmp_path}/odd", 3)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(ASCII_LOWER))
        n = min(10, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for s in range(len(words) - n + 1 if n else 0):
            if tuple(words[s : s + n]) in runs:
                hit |= set(range(s, s + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, PLAIN + " again"), (2, "jumps over"), (10, "Lazy-dog, and RUNS far; away from here to there!"), (None, "einzelwort"), (3, None), (4, "  "), (2, "jumps over")]


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = winnow.decontaminate(odd, items).collect()
    want = Counter()
    for i, t, *_ in ODD:
        n, hit, found = brute_hits(t, ITEMS)
        want[i, n, hit, tuple(found), hit > 0] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want
    kept = winnow.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t, *_ in ODD if not brute_hits(t, ITEMS)[1])
    assert winnow.decontaminate(none, items).count() == 0
    assert winnow.decontaminate(odd, items.filter("false")).filter("contaminated").count() == 0
    assert winnow.drop_contaminated(odd, items.filter("false")).count() == len(ODD)


def test_every_shared_span_is_found(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"v{int(i)}" for i in rng.integers(0, 400, n)]
    items = [(i, " ".join(words(int(rng.integers(5, 60))))) for i in range(40)]
    docs = []
    for i in range(120):
        body = words(int(rng.integers(0, 80)))
        own = items[int(rng.integers(0, 40))][1].split()
        take = int(rng.integers(7, 14))
        at = int(rng.integers(0, max(1, len(own) - take)))
        docs.append((i, " ".join(body[:20] + own[at : at + take] + body[20:])))
    got = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    have = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()}
    assert have == {i: brute_hits(t, items) for i, t in docs}
    assert 20 < sum(h[1] > 0 for h in have.values()) < 120


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def similar_pair(rng, kept, extra, more=0):
    """Two texts with ``kept`` common shingles; ``extra`` own shingles of one and ``more`` of the other."""
    words = [f"v{int(i)}" for i in rng.integers(0, 10**9, kept + 4 + extra + more)]
    return " ".join(words[: kept + 4 + extra]), " ".join([*words[kept + 4 + extra :], *words[: kept + 4]])


def test_jaccard_decides_on_both_sides_of_the_limit(spark):
    rng = np.random.default_rng(3)
    shapes = [(4, 1, 0), (8, 1, 0), (8, 1, 1), (40, 10, 0), (80, 20, 0), (80, 10, 10), (320, 40, 40)] * 12
    under = [(79, 21, 0), (3, 1, 0), (319, 41, 40), (150, 24, 24)] * 12
    rows, want = [], set()
    for i, shape in enumerate(shapes + under):
        a, b = similar_pair(rng, *shape)
        assert (jaccard(a, b) >= 0.8) == (i < len(shapes))
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i} if i < len(shapes) else {2 * i, 2 * i + 1}
    left = simhash_pivots.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in left} == want


def test_pairs_among_many_texts_of_one_template_are_found(spark):
    rng = np.random.default_rng(4)
    template = [f"t{i}" for i in range(64)]
    rows, want = [], set()
    for i in range(150):
        own = [f"o{int(w)}" for w in rng.integers(0, 10**9, 40)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join([*template, *own, "one", "more"]))]
        want.add(2 * i)
    # All of these have their first shingles in common, whatever the order, and each is like its neighbours only.
    chain = [f"c{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(chain[i * 10 : i * 10 + 104])) for i in range(30)]
    want.add(1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_pivots.drop_similar(docs).collect()} == want


def test_near_copies_agree_with_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(30):
            copy = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                copy[at] = f"x{int(rng.integers(0, 3))}"
            rows.append((len(rows), " ".join(copy[: int(rng.integers(45, 61))])))
    roots = brute_components([t for _, t in rows], lambda a, b: jaccard(a, b) >= 0.8)
    want = {min(j for j, s in enumerate(roots) if s == r) for r in roots}
    left = simhash_pivots.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in left} == want and 6 < len(want) < len(rows)


def test_fingerprints_propose_pairs_and_folds_lose_none(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        base = [f"p{int(w)}" for w in rng.integers(0, 10**9, 400)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = simhash_pivots.shingle_prefixes(docs, 5, 0.8, [], "doc_id", "text").localCheckpoint()
    node = {r["doc_id"]: r for r in sets.select("doc_id", "node", "fingerprint", *simhash_pivots.folded()).collect()}
    got = {frozenset(r) for r in simhash_pivots.proposed(sets).collect()}
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    close = {frozenset((a["node"], b["node"])) for a in node.values() for b in node.values() if a["doc_id"] < b["doc_id"] and bits(a["fingerprint"], b["fingerprint"]) <= 3}
    assert got == close and len(got) > 20
    for i in range(40):
        a, b = node[2 * i], node[2 * i + 1]
        assert sum(bits(a[f"f{j}"], b[f"f{j}"]) for j in range(4)) == 1  # one shingle more


def test_texts_of_one_template_do_not_meet_in_squares(spark):
    rng = np.random.default_rng(7)
    template = [f"t{i}" for i in range(64)]
    rows = [(i, " ".join(template + [f"o{int(w)}" for w in rng.integers(0, 10**9, 40)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = simhash_pivots.shingle_prefixes(docs, 5, 0.8, [], "doc_id", "text")
    keys = sets.select("node", "size", *simhash_pivots.folded(), F.posexplode("prefix").alias("place", "band")).localCheckpoint()
    assert simhash_pivots.may_be_similar(keys, keys, 0.8).count() < 150


def test_shingles_of_the_same_texts_are_one_band(spark):
    base = [f"b{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*base, *[f"e{j}" for j in range(i)]])) for i in range(3)] + [(9, "alone")], "doc_id long, text string")
    sets = simhash_pivots.shingle_prefixes(docs, 5, 0.8, [], "doc_id", "text").localCheckpoint()
    bands = simhash_pivots.band_members(sets).collect()
    alone = next(r["node"] for r in sets.collect() if r["doc_id"] == 9)
    # The prefixes have some forty shingles each; the nodes that hold them are at most the four sets of two or three of these texts.
    assert len({r["band"] for r in bands}) <= 4 and len({r["node"] for r in bands}) == 3 and alone not in {r["node"] for r in bands}


def test_sketches_tell_long_texts_apart_and_lose_no_pair(spark):
    base = [f"l{i}" for i in range(6000)]
    half = base[:4000] + [f"m{i}" for i in range(2000)]
    rows = [(0, " ".join(base)), (1, " ".join(half)), (2, " ".join(base[:5000]))]
    sets = simhash_pivots.shingle_prefixes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8, [], "doc_id", "text").localCheckpoint()
    node = {r["doc_id"]: r["node"] for r in sets.collect()}
    pairs = spark.createDataFrame([tuple(sorted((node[a], node[b]))) for a, b in ((0, 1), (0, 2), (1, 2))], "a long, b long")
    got = {frozenset((r["a"], r["b"])) for r in simhash_pivots.close_sketches(pairs, sets, 0.8).collect()}
    assert got == {frozenset((node[0], node[2]))}  # 0.83 alike; the others 0.5 and 0.57


def test_bands_of_one_group_have_different_pivots(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        copy = [f"b{j}" for j in range(200)]
        for at in rng.integers(0, 200, 10):
            copy[at] = f"x{int(rng.integers(0, 10**9))}"
        rows.append((i, " ".join(copy)))
    sets = simhash_pivots.shingle_prefixes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8, [], "doc_id", "text")
    bands = {}
    for r in simhash_pivots.band_members(sets).collect():
        bands.setdefault(r["band"], []).append(r)
    # Each band has one pivot, a node of its own; the smallest node of the group is by far not the pivot of most.
    assert all(len({r["pivot"] for r in rs}) == 1 and rs[0]["pivot"] in {r["node"] for r in rs} for rs in bands.values())
    assert len({rs[0]["pivot"] for rs in bands.values()}) > 15
