"""Cross-tokenizer alignment, packing and the prefix trie of conversations, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowplace.llm import byte_level, config_packing, prefix_centroid, token_align
from flowplace.llm.queries import vocabulary

from .conftest import CLASHES, LONG, ODD

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


# Byte-level encoder ---------------------------------------------------------------------------


@pytest.mark.parametrize("plain", [True, False])
def test_byte_level_ids_are_the_librarys(plain, texts):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = plain
    own = byte_level.ByteLevel(BYTES, plain)
    assert own.fast is not None
    odd = ["", " ", "\n\n  x", "a<|endoftext|>b", "<|endoftext|>", " " * 1_500_000 + "x", "x" * 40_000, "\u0085\u180e\u2028 \x1c'S 's 'LL", "e\u0301 \u00e9\U0001f642\u200d"]
    odd += [f"a{chr(c)}{chr(c)} {chr(c)}1 {chr(c)}.b  {chr(c)} " for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    for text in [*odd, *(t or "" for t in texts.values())]:
        assert own.one(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_other_files_go_through_the_library():
    path = vocabulary("word_bpe_49k.json")
    own = byte_level.ByteLevel(path, False)
    assert own.fast is None
    assert own.one("Hello  WORLD").tolist() == Tokenizer.from_file(path).encode("Hello  WORLD", add_special_tokens=False).ids


# Alignment ------------------------------------------------------------------------------------


def brute_alignment(rows):
    """The contract's columns by walking over both token lists."""
    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    as_byte = byte_level.byte_of()

    def b_bytes(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode()

    cut = []
    for doc, text in rows:
        a = library.encode(" " + text).ids if text else []
        b = model.encode(text) if text else []
        a_own = [bytes(as_byte[c] for c in library.id_to_token(i)) for i in a]
        b_own = [b_bytes(i) for i in b]
        whole = (" " + text).encode() if text else b""
        if b"".join(a_own) != whole or b"".join(b_own) != whole:
            a, b, a_own, b_own = [], [], [], []
        a_ends, b_ends = np.cumsum([0, *map(len, a_own)])[1:].tolist(), np.cumsum([0, *map(len, b_own)])[1:].tolist()
        ends = sorted(set(a_ends) & set(b_ends))
        of_a, of_b = dict(zip(a_ends, a)), dict(zip(b_ends, b))
        links = [(of_a[e], of_b[e]) for e in ends]
        groups, i, j = [], 0, 0
        for e in ends:
            x, y = [], []
            while i < len(a) and a_ends[i] <= e:
                x.append(a[i])
                i += 1
            while j < len(b) and b_ends[j] <= e:
                y.append(b[j])
                j += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        assert i == len(a) and j == len(b)
        cut.append((doc, len(a), len(b), links, ";".join(groups)))
    counts = Counter(link for *_, links, _ in cut for link in links)
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = Counter(
        (doc, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), g)
        for doc, n_a, n_b, links, g in cut
    )
    return out, counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def aligned(docs):
    rows, counts = token_align.align(docs, BYTES, PIECES)
    return Counter(tuple(r) for r in rows.select(COLUMNS).collect()), {(r["a"], r["b"]): r["n"] for r in counts.collect()}


def test_alignment_of_odd_rows(odd, none):
    got, counts = aligned(odd)
    want, wanted = brute_alignment([(i, t) for i, t, *_ in ODD])
    assert got == want and counts == wanted
    assert aligned(none) == (Counter(), {})


def test_alignment_of_documents(documents, texts):
    got, counts = aligned(documents)
    want, wanted = brute_alignment(list(texts.items()))
    assert got == want and counts == wanted
    assert sum(r[4] for r in got.elements()) == sum(counts.values()) > 10_000


def test_alignment_digests(spark):
    docs = spark.createDataFrame([(1, "hello <0x41> world <|endoftext|>"), (2, ""), (3, "a\u2581b")], "doc_id long, text string")
    plain = {r["doc_id"]: r["groups"] for r in token_align.align(docs, BYTES, PIECES)[0].collect()}
    hashed = {r["doc_id"]: r["groups"] for r in token_align.align(docs, BYTES, PIECES, digest=True)[0].collect()}
    assert plain[1] and plain[2] == plain[3] == ""  # a mark inside a text is not what its tokens spell
    assert hashed == {i: hashlib.sha256(g.encode()).hexdigest() if g else "" for i, g in plain.items()}


def test_pair_numbers_are_bounded():
    pair = token_align.worker_pair(BYTES, PIECES)
    assert len(pair.keys) <= 4 * (pair.a.sizes.sum() + pair.b.sizes.sum())


# Packing --------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(8, 40))
def test_plans_place_every_piece(lengths, capacity):
    histogram = np.bincount([min(x, capacity) for x in lengths] or [0], minlength=capacity + 1)
    histogram[0] = 0
    packing = config_packing.plan(histogram, capacity)
    held = np.zeros(capacity + 1, np.int64)
    for run in packing.runs:
        assert sum(length * copies for length, copies, _ in run.held) <= capacity
        for length, copies, _ in run.held:
            held[length] += copies * run.count
    assert held.tolist() == histogram.tolist()
    assert packing.bound - 1e-6 <= packing.sequences == sum(r.count for r in packing.runs)


def test_knapsack_is_the_best_configuration():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = 14
        price, most = rng.random(capacity + 1), rng.integers(0, 4, capacity + 1)
        most[0] = 0
        shape = config_packing.knapsack(price, most, capacity)
        assert (shape <= most).all() and shape @ np.arange(capacity + 1) <= capacity
        best = {0: 0.0}
        for length in range(1, capacity + 1):
            best = {
                size + n * length: max(worth + n * price[length], best.get(size + n * length, -1) if n else worth)
                for size, worth in sorted(best.items())
                for n in range(int(most[length]) + 1)
                if size + n * length <= capacity
            } | {
                k: max(v for s, w in best.items() for n in range(int(most[length]) + 1) if s + n * length == k for v in [w + n * price[length]])
                for k in {s + n * length for s in best for n in range(int(most[length]) + 1) if s + n * length <= capacity}
            }
        assert shape @ price == pytest.approx(max(best.values()))


def test_program_beats_best_fit_where_lengths_are_awkward():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(500, 900, 20_000), minlength=2_049)
    greedy = sum(n for _, n in config_packing.fill([], histogram, 2_048))
    packing = config_packing.plan(histogram)
    assert packing.bound <= packing.sequences < 0.95 * greedy
    many = config_packing.plan(histogram * 1_000)  # work follows lengths, not pieces
    assert many.sequences < 0.95 * 1_000 * greedy


def test_every_sequence_is_a_configuration_of_the_program(monkeypatch):
    rng = np.random.default_rng(1)
    spread = np.bincount(np.minimum(2_048, rng.lognormal(6, 1.2, 8_000).astype(int) + 1), minlength=2_049)
    awkward = np.bincount(rng.integers(500, 900, 8_000), minlength=2_049)
    greedy = [sum(n for _, n in config_packing.fill([], h, 2_048)) for h in (spread, awkward)]

    def never(*_):
        raise AssertionError("best fit placed pieces")

    monkeypatch.setattr(config_packing, "fill", never)
    many, few = config_packing.plan(spread), config_packing.plan(awkward)
    assert many.sequences <= min(greedy[0], many.bound + 2)
    assert few.sequences < 0.95 * greedy[1]
    for packing, histogram in ((many, spread), (few, awkward)):
        held = np.zeros(2_049, np.int64)
        for run in packing.runs:
            assert sum(length * copies for length, copies, _ in run.held) <= 2_048
            for length, copies, _ in run.held:
                held[length] += copies * run.count
        assert held.tolist() == histogram.tolist()


def check_packed(docs, rows, capacity=config_packing.CAPACITY):
    library = Tokenizer.from_file(BYTES)
    placed, pieces = config_packing.pack(docs, BYTES, capacity)
    got = placed.collect()
    want = Counter()
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        for n, start in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[start : first if n == 0 else start + capacity]
            want[doc, n, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        ends = np.cumsum([n for _, n in spans])
        assert [o for o, _ in spans] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    tokens = sum(r["length"] for r in got)
    # Sequences are the written ids in their places.
    for s in config_packing.sequences(placed, pieces).collect():
        assert len(s["ids"]) == 4 * sum(n for _, n in held[s["sequence_id"]])
        for span in s["spans"]:
            own = s["ids"][4 * span["offset"] : 4 * (span["offset"] + span["length"])]
            assert (span["doc_id"], span["piece"], zlib.crc32(own)) in {(w[0], w[1], w[4]) for w in want}
    return len(held), tokens


def test_packing_of_odd_rows(odd, none):
    n, tokens = check_packed(odd, [(i, t) for i, t, *_ in ODD])
    assert n == -(-tokens // config_packing.CAPACITY)
    assert config_packing.pack(none, BYTES)[0].count() == 0


def test_packing_of_documents(documents, texts):
    n, tokens = check_packed(documents, list(texts.items()))
    assert n <= -(-tokens // config_packing.CAPACITY) + 1


def test_packing_with_a_small_capacity(spark):
    docs = [(i, "word " * (i % 17)) for i in range(300)] + [(7, None), (7, None)]
    check_packed(spark.createDataFrame(docs, "doc_id long, text string"), docs, 16)


# Prefix trie ----------------------------------------------------------------------------------


def brute_trie(lines):
    """``lines``: conversation -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, said in sorted(lines.items()):
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(conv)
        ends[tuple(said)].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    return Counter(
        (
            own[0],
            len(node),
            members[node[:-1]][0] if node else None,
            len(own),
            children[node],
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, own in members.items()
    )


def turns_of(lines):
    return [(c, n, role, text) for c, said in lines.items() for n, (role, text) in enumerate(said)]


TURNS = "conv_id long, turn long, role string, text string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(frame):
    return Counter(tuple(r) for r in frame.select(TRIE).collect())


def test_finish_component_is_the_subtree_sum():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 400):
        for shape in ("chain", "star", "random"):
            parent = [-1] + [{"chain": i - 1, "star": 0, "random": int(rng.integers(0, i))}[shape] for i in range(1, n)]
            own = rng.integers(0, 100, (n, 2))
            want, weight = own.copy(), np.ones(n, np.int64)
            for i in range(n - 1, 0, -1):
                want[parent[i]] += want[i]
                weight[parent[i]] += weight[i]
            found = np.zeros((n, 2), np.int64)
            prefix_centroid.finish_component(parent, weight.tolist(), own, found)
            assert (found == want).all()


@pytest.mark.parametrize("whole", [5, prefix_centroid.WHOLE])
def test_trie_of_chains_stars_and_copies(spark, whole):
    rng = np.random.default_rng(1)
    lines = {c: [("user", f"t{int(rng.integers(0, 3))}") for _ in range(int(rng.integers(0, 5)) + 1)] for c in range(40)}
    lines |= {100: [("user", f"long {n}") for n in range(70)]}
    lines |= {101: lines[100][:50] + [("assistant", "other")] * 8, 102: lines[100][:50], 103: lines[100]}
    lines |= {c: [("user", "copy"), ("assistant", "copy \U0001f642")] for c in range(200, 230)}
    got = trie(prefix_centroid.conversation_trie(spark.createDataFrame(turns_of(lines), TURNS).repartition(3), whole=whole))
    assert got == brute_trie(lines)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, 1, "user", "b"),
        (1, None, "user", "a"),
        (1, 1, "user", "b"),
        (2, None, None, "a"),
        (2, 3, "assistant", None),
        (3, 0, "", "a"),
        (3, 1, "assistant", ""),
        (4, 0, "user", LONG),
        (None, 0, "user", "nobody's"),
        (None, None, None, None),
        (-7, 0, "user", "a"),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    clashing = frame.select("*", *[F.lit("x").alias(c) for c in [*CLASHES, "conv", "i", "d1", "h", "k1", "u1", "weight"]])
    lines = {1: [("user", "a"), ("user", "b"), ("user", "b")], 2: [("", "a"), ("assistant", "")], 3: [("", "a"), ("assistant", "")], 4: [("user", LONG)], -7: [("user", "a")]}
    assert trie(prefix_centroid.conversation_trie(clashing)) == brute_trie(lines)
    assert trie(prefix_centroid.conversation_trie(clashing.filter("false"))) == Counter()
    assert trie(prefix_centroid.prefix_trie(*prefix_centroid.rebuilt(clashing.filter("false")))) == Counter()


def test_rebuilt_conversations(spark):
    lines = {c: [("user", f"{c // 7} {n}") for n in range(c % 5 + 1)] for c in [*range(0, 25), *range(100, 130), *range(205, 212), 300, 301, 302]}
    taken = lambda c: zlib.crc32(str(c).encode()) % 6
    want = {c: lines.get(c - c % 100, [])[: taken(c)] + said[taken(c) :] for c, said in lines.items()}
    assert any(not said for said in want.values())
    frame = spark.createDataFrame(turns_of(lines), TURNS)
    assert trie(prefix_centroid.prefix_trie(*prefix_centroid.rebuilt(frame))) == brute_trie(want)
