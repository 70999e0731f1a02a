"""Encoding, wavelet-matrix shards and packing against the plain tokenizer."""

import zlib

import numpy as np
import pytest

from riftline.llm import packing, tokens, wavelet

from .common import ODD, SCHEMA, clashing, odd

HARD = ["don't we'll 's 't", "3.5e7!! a\x1cb", "<|endoftext|> <|startoftext|>x", "ﬁ Å Σας ΟΔΟΣ İstanbul", "é́ x́ ́y", "a.. b., C. É. ___ x_y", "x\x85y z w", "ʼn ſs ß"]


@pytest.fixture(scope="module")
def encode():
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_parts_equal_whole_texts(encode):
    texts = [r[1] for r in ODD] + HARD
    for limit in (3, tokens.CACHE_PARTS):
        own, tokens.CACHE_PARTS = tokens.CACHE_PARTS, limit
        try:
            e = tokens.Encoder(tokens.default_path())
            for run in (texts, texts[::-1], texts):
                ids, counts = e.encode(run)
                got = np.split(ids, np.cumsum(counts)[:-1])
                assert [x.tolist() for x in got] == [encode(t) for t in run]
        finally:
            tokens.CACHE_PARTS = own


def test_frequent_parts_are_learned_once(encode, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 100)
    e, learned = tokens.Encoder(tokens.default_path()), []
    plain = e._learn
    monkeypatch.setattr(e, "_learn", lambda: (learned.extend(e.places.fresh), plain())[1])
    letters = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    often = " ".join("Often" + letters(k) for k in range(30))
    for k in range(20):
        for text in (often, often.upper(), " ".join("x" + letters(100 * k + j) for j in range(60))):
            ids, _ = e.encode([text])
            assert ids.tolist() == encode(text)
    assert sum(part.lower().startswith("often") for part in learned) == 30


def test_texts_are_lowered_only_where_ids_stay(encode):
    rng = np.random.default_rng(5)
    bits = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|", "'S", "'LL", "É", "µ", "ß", "ẞ", "Σ", "İ", "Ÿ", "²", "\xa0", "\x85", "\xad", "\u0301", "A", "b", " ", ".", "!", "5", "\x1c", "ſ", "<", "|", ">", "ÀB"]
    texts = ["".join(rng.choice(bits, size)) for size in rng.integers(1, 12, 2000)]
    ids, counts = tokens.Encoder(tokens.default_path()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]


def test_wavelet_queries():
    ids = (np.random.default_rng(1).zipf(1.4, 150_000) % 5000).astype(np.int32)
    shard = wavelet.Shard.of(wavelet.build(ids, np.arange(2), np.zeros(2, bool), np.array([100_000, 50_000])))
    assert (shard.decode() == ids).all()
    for i in np.random.default_rng(2).integers(0, len(ids), 25).tolist():
        token = int(ids[i])
        assert shard.access(i) == token
        assert shard.rank(token, i) == (ids[:i] == token).sum()
        assert shard.select(token, shard.rank(token, i)) == i
        assert shard.count(token) == (ids == token).sum()
    rare = int(ids[-1])
    assert list(shard.occurrences(rare))[:50] == np.flatnonzero(ids == rare)[:50].tolist()
    assert shard.count(999_999) == 0
    with pytest.raises(IndexError):
        shard.select(rare, len(ids))


@pytest.mark.parametrize("values", [[7], [7] * 9, [3, 900, 3]])
def test_small_alphabets(values):
    ids = np.array(values, np.int32)
    shard = wavelet.Shard.of(wavelet.build(ids, np.array([5]), np.array([False]), np.array([len(ids)])))
    assert shard.decode().tolist() == values and [shard.access(i) for i in range(len(values))] == values


def test_shards_round_trip(spark, encode):
    rows = [*ODD, (None, "no id", "en", "a", 5), ODD[3]]
    manifest = wavelet.write_shards(clashing(odd(spark, rows)), tokens.default_path(), shard_tokens=50)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_shards(manifest).collect()))
    assert manifest.count() > 1 and len(got) == len(rows)
    at, want = 0, []
    for known, doc, text in sorted(((r[0] is not None, r[0] or 0, r[1]) for r in rows), key=lambda x: (x[0], x[1], x[2] or "")):
        ids = np.array(encode(text), "<u4")
        want.append((known, doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    first = manifest.orderBy("start").first()
    assert wavelet.open_shard(first.path).access(0) == encode("no id")[0]


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wavelet.read_shards(wavelet.write_shards(empty, tokens.default_path())).count() == 0
    assert packing.pack(empty).count() == 0


def plain_best_fit(lengths, capacity):
    """The fullest bin that has room, longest items first: the fills."""
    fills = []
    for size in sorted(lengths, reverse=True):
        fitting = [k for k, f in enumerate(fills) if f + size <= capacity]
        if fitting:
            fills[max(fitting, key=lambda k: fills[k])] += size
        else:
            fills.append(size)
    return sorted(fills)


@pytest.mark.parametrize("capacity", [10, 64, 4096])
def test_best_fit(capacity):
    rng = np.random.default_rng(capacity)
    for count in (1, 6, 300):
        lengths = rng.integers(1, capacity + 1, count) if count != 6 else np.array([5, 4, 3, 3, 3, 2])
        bins, offsets, fills = packing.best_fit(lengths, capacity)
        assert sorted(fills.tolist()) == plain_best_fit(lengths.tolist(), capacity)
        assert (np.bincount(bins, lengths) == fills).all()
        for b in range(len(fills)):  # gapless
            order = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][order] == np.cumsum(lengths[bins == b][order]) - lengths[bins == b][order]).all()


def test_bins_that_cannot_be_used_stay_out_of_a_round(spark):
    """Of alike bins a group's round takes no more than it has bins half full or less."""
    group = lambda k: k << (packing.BIN_BITS + packing.PACK_BITS)
    rows = [(group(g) | b, 90 if b else 8) for g in range(4) for b in range(50)]
    moved = packing.merge_open(spark.createDataFrame(rows, "_bin long, _fill long"), 100, 2).collect()
    where = {r["_bin"]: (r["_root"], r["_shift"]) for r in moved}
    fills = dict(rows)
    sums = {}
    for b, (root, shift) in where.items():
        sums.setdefault(root, []).append((shift, fills[b]))
    assert len(where) == 200 and len(sums) == 196  # each of the four small ones found room
    for parts in sums.values():
        assert sum(f for _, f in parts) <= 100 and [s for s, _ in sorted(parts)] == [0, *np.cumsum([f for _, f in sorted(parts)])[:-1]]


@pytest.mark.parametrize("partitions, fan_in, capacity", [(1, 16, 4096), (7, 2, 64), (9, 3, 16)])
def test_packing_is_gapless(spark, encode, partitions, fan_in, capacity):
    rows = ODD * 3 + [(100 + k, "some words here " * (k % 7), "en", "a", 1) for k in range(120)]
    out = packing.pack(clashing(odd(spark, rows)).repartition(partitions), capacity=capacity, fan_in=fan_in).collect()
    text = {r[0]: r[1] for r in rows}
    by_sequence = {}
    for r in out:
        ids = np.array(encode(text[r.doc_id])[r.start : r.start + r.length], "<u4")
        assert r.start == r.piece * capacity and len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in out)
    assert total == sum(len(encode(r[1])) for r in rows)
    assert len(by_sequence) <= 1.1 * total / capacity + 2
