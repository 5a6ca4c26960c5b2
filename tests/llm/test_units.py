"""Parts of the corpus operators that need no session."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from addrloom.llm import cells, embed_dedup, huffman, jaccard_join, langid, packing, quality_classifier, quality_rules

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1éÜß .,\n'!|中 \x1c\t s\x00\x01\x85", max_size=24))
def test_chunks_give_the_ids_of_the_whole_text(text):
    from addrloom.llm.tokens import encoder

    own = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own(text) == own.whole(text)


@pytest.mark.parametrize("seed", range(12))
def test_packing_places_every_item_once_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {}
    for _ in range(rng.randint(0, 400)):
        size = rng.randint(1, capacity)
        counts[size] = counts.get(size, 0) + rng.randint(1, 30)
    patterns = packing.pack_counts(counts, capacity)
    got = {}
    for runs, n in patterns:
        assert sum(s * k for s, k in runs) <= capacity and n > 0
        for s, k in runs:
            got[s] = got.get(s, 0) + n * k
    assert got == counts
    total, need = sum(n for _, n in patterns), -(-sum(s * n for s, n in counts.items()) // capacity)
    assert total <= need * 1.25 + 2


def _least_bins(items, capacity):
    """Brute force for a few items."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_fixed_sets_lose_nothing(seed):
    """Fixing dominating sets keeps the optimum: fixed sets plus the best packing of the rest is the best packing."""
    rng = random.Random(seed)
    capacity = 20
    items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
    counts = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
    fixed, rest = packing.reduce_dominated(counts, capacity)
    left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + _least_bins(left, capacity) == _least_bins(items, capacity)


@pytest.mark.parametrize("n,vocabulary,limit", [(0, 4, 16), (1, 4, 16), (300, 2, 1), (5000, 300, 9), (200_000, 50_000, 16), (70_000, 70_000, 16)])
def test_huffman_round_trip(n, vocabulary, limit):
    ids = (np.random.default_rng(n).zipf(1.3, n) % vocabulary).astype(np.uint32)
    counts = np.bincount(ids, minlength=vocabulary)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= max(limit, int(np.ceil(np.log2(max(2, (counts > 0).sum())))))
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    bits, marks = huffman.pack_bits(ids, lengths, huffman.canonical_codes(lengths))
    assert (huffman.Decoder(lengths)(bits, marks, n) == ids).all()


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.array([50, 1, 7, 7, 30, 2, 0, 9])
    heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
    best = 0
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        best += a + b
        heapq.heappush(heap, (a + b, x + y))
    assert int((huffman.code_lengths(counts, 16) * counts).sum()) == best


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == n and not any((c == c[0]).all() for c in code.T)


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    data = bytes(np.random.default_rng(0).integers(97, 105, 5000, dtype=np.uint8))
    whole = langid.ngram_counts(data, 1 << 10)
    monkeypatch.setattr(langid, "_CHUNK", 97)
    assert (langid.ngram_counts(data, 1 << 10) == whole).all()


def test_minhash_does_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 5, 400, 3)]
    whole = jaccard_join.signatures(sets, 16)
    monkeypatch.setattr(jaccard_join, "_CHUNK", 7)
    assert (jaccard_join.signatures(sets, 16) == whole).all()


def test_prefix_depth_shortens_until_the_recall_is_met():
    assert jaccard_join.prefix_depth(16, 8, 0.8, 0.5) == 8
    depth = jaccard_join.prefix_depth(16, 8, 0.8, 0.999)
    assert 1 - (1 - 0.8**depth) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 16


def test_recall_is_estimated_from_what_was_found():
    rng = np.random.default_rng(4)
    true = rng.uniform(0.8, 0.84, 40_000)
    for level in (6, 5, 4):
        met = true[rng.random(len(true)) < jaccard_join.meeting_chance(true, 16, level)]
        found = np.bincount(np.round(met * 10_000).astype(int), minlength=10_001)
        assert jaccard_join.estimated_recall(found, 16, level, 0.8, bands=1) == pytest.approx(len(met) / len(true), abs=0.002)
    assert jaccard_join.estimated_recall(np.zeros(97), 16, 6, 0.8) == 0
    copies = np.zeros(97)
    copies[96] = 1_000_000
    assert jaccard_join.estimated_recall(copies, 16, 6, 0.8) > 0.9999
    copies[77] = 3  # a few links at the threshold aren't hidden by many copies
    assert jaccard_join.estimated_recall(copies, 16, 6, 0.8) < 0.997


def test_codes_exclude_no_pair_above_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    y = 0.9 * embed_dedup.unit(x)
    other = rng.standard_normal(x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) / (x * x).sum(axis=1, keepdims=True) * x
    y = y + (1 - 0.81) ** 0.5 * embed_dedup.unit(other)
    turn = embed_dedup.rotations(64, 2)
    a, b = embed_dedup.encode(embed_dedup.unit(x), turn)[0], embed_dedup.encode(embed_dedup.unit(y), turn)[0]
    assert ((a == b).sum(axis=1) >= embed_dedup.least_agreement(128, 0.9, 5.0)).mean() > 0.9999


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    y = 0.8 * x + 0.6 * rng.standard_normal(x.shape)
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    turn = embed_dedup.rotations(64, 4)
    signs, factor = embed_dedup.encode(x, turn)
    found, bound = embed_dedup.estimate(np.where(signs, 1, -1), factor, y @ turn, 64, 5.0)
    true = (x * y).sum(axis=1)
    assert abs((found - true).mean()) < 0.005 and (np.abs(found - true) <= bound).all()


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_path(seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    crf = quality_rules.Crf(rng.standard_normal((len(quality_rules.FEATURES), 2)), rng.standard_normal((2, 2)))
    x = rng.standard_normal((7, len(quality_rules.FEATURES)))
    s = x @ crf.emit
    worth = lambda p: sum(s[i, y] for i, y in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:]))
    assert worth(crf.viterbi(x)) == pytest.approx(max(map(worth, product((0, 1), repeat=7))))
    y, step = rng.integers(0, 2, 7), 1e-6
    log = lambda c: worth_of(c, x, y)

    def worth_of(c, x, y):
        s = x @ c.emit
        all_ = [sum(s[i, k] for i, k in enumerate(p)) + sum(c.move[a, b] for a, b in zip(p, p[1:])) for p in product((0, 1), repeat=len(x))]
        own = sum(s[i, k] for i, k in enumerate(y)) + sum(c.move[a, b] for a, b in zip(y, y[1:]))
        return own - np.logaddexp.reduce(all_)

    d_emit, d_move = crf.gradient(x, y)
    moved = quality_rules.Crf(crf.emit, crf.move.copy())
    moved.move[0, 1] += step
    assert (log(moved) - log(crf)) / step == pytest.approx(d_move[0, 1], abs=1e-3)
    moved = quality_rules.Crf(crf.emit.copy(), crf.move)
    moved.emit[3, 1] += step
    assert (log(moved) - log(crf)) / step == pytest.approx(d_emit[3, 1], abs=1e-3)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\x85\x1c", max_size=40))
def test_base_counts_by_brute_force(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert quality_rules.base_counts(text) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_ftrl_learns_a_separable_task():
    texts = [("good words stand here number %d" % i, 1) for i in range(60)] + [("bad bad bad $$$ ### %d" % i, 0) for i in range(60)]
    random.Random(0).shuffle(texts)
    model = quality_classifier.train_ftrl([(*quality_classifier.grams(t, 14), y, 1.0) for t, y in texts], 14)
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in texts)
    assert 0 <= model.score("") <= 1


def test_pairs_meet_once_across_cells():
    import itertools

    import pandas as pd

    block = np.array([0, 1, 2, 0, 1, 2, 2, 0, 1])
    rows = []
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        rows += [(7, i, j, b, k) for k, b in enumerate(block) if b in (i, j)]
    pdf = pd.DataFrame(rows, columns=["key", "_cell_i", "_cell_j", "_block", "id"])
    batches = [pdf.iloc[i : i + 4] for i in range(0, len(pdf), 4)]
    met = []
    for own, number in cells.whole_cells(iter(batches), ["key"]):
        for a, b in cells.pairs(own, number):
            met += [tuple(sorted(p)) for p in zip(own["id"].to_numpy()[a], own["id"].to_numpy()[b])]
    assert sorted(met) == sorted(itertools.combinations(range(9), 2))


def test_forest_spans():
    a, b = np.array([1, 2, 3, 1, 8]), np.array([2, 3, 1, 3, 9])
    assert len(cells.forest(a, b)) == 3


def test_crc_of_ids_is_of_little_endian_words():
    assert zlib.crc32(np.array([1, 70000], dtype="<u4").tobytes()) == zlib.crc32(bytes([1, 0, 0, 0, 0x70, 0x11, 1, 0]))
    assert pa.array([b"x"], pa.binary())[0].as_py() == b"x"


def test_batches_of_long_texts_are_cut_by_their_characters():
    import pandas as pd

    texts = pd.Series(["a" * 100, None, "b" * 2000, "", *["c" * 300] * 9, "d"])
    cut = list(jaccard_join.slices(texts, rows=4, chars=1000))
    assert [i for s in cut for i in range(s.start, s.stop)] == list(range(len(texts)))
    for s in cut:
        held = [len(t or "") for t in texts.iloc[s]]
        assert len(held) <= 4 and (sum(held) <= 1000 or len(held) == 1)
    assert not list(jaccard_join.slices(texts.iloc[:0])) and list(jaccard_join.slices(pd.Series([None, None], dtype=object))) == [slice(0, 2)]
