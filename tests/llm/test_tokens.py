"""The compiled tokenizers, counts, packing and the token store against the library."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import automaton
from quern.llm.automaton import Transducer, compose_scan, transducer
from quern.llm.mph import PerfectHash, fingerprints
from quern.llm.packing import BestFit, best_fit_packing
from quern.llm.token_counts import token_counts
from quern.llm.token_store import ShardReader, shard_bounds, token_store, write_token_store

ODD = [" ", "\n", "\t", "  ", "a", "B", "'s", "'re", " 's", "é", "1", "22", "!", "...", " ", "　", "中", "́", "<|endoftext|>",
       "<|startoftext|>", "\ua7cb", "\ua7dc", "\u0897", "\U000113c9", "\U00011382", "\U00016d67", "\U00014155", "Σ", "İ", "\x1d", "\r\n", "ﬁ", "\U0001f600", "'", "tion", "aaaa", "----", "\x00", "'l", "'v"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name, texts, monkeypatch):
    draw = random.Random(5)
    cases = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in texts]
    wanted = [e.ids for e in library(name).encode_batch(cases, add_special_tokens=False)]
    for piece in (1 << 21, 64):  # long texts are cut at safe places
        monkeypatch.setattr(automaton, "PIECE", piece)
        assert [x.tolist() for x in transducer(name).ids(cases)] == wanted
        assert transducer(name).counts(cases) == [len(x) for x in wanted]


def test_full_table_starts_again(monkeypatch, texts):
    monkeypatch.setattr(automaton, "MAX_STATES", 60)
    cases = [(t or "")[:400] for _, t in texts]
    machine = Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    assert machine.counts(cases) == [len(e.ids) for e in machine.library.encode_batch(cases, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_bounded_table_gives_the_ids_of_the_library(name, texts):
    draw = random.Random(6)
    cases = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 14))) for _ in range(500)] + [t or "" for _, t in texts]
    wanted = [e.ids for e in library(name).encode_batch(cases, add_special_tokens=False)]
    for states in (2, 60, 4000):
        machine = Transducer(public_tokenizers.path(name), states)
        for _ in range(2):
            assert [x.tolist() for x in machine.ids(cases)] == wanted
            assert machine.counts(cases) == [len(x) for x in wanted]
        assert len(machine.merger.states) <= states and len(machine.merger.next) == states


def test_scan_composes_maps_in_order():
    draw = np.random.default_rng(1)
    maps = draw.integers(0, 8, (37, 8)).astype(np.uint8)
    state, wanted = np.arange(8), []
    for row in maps:
        state = row[state]
        wanted.append(state)
    assert (compose_scan(maps) == np.array(wanted)).all()


def test_counts(docs, empty, texts):
    got = sorted((r.doc_id or 10**9, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())
    encode = library("byte_bpe_50k.json").encode
    n = lambda t: len(encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i or 10**9, len((t or "").encode()), n(t), n(t) > 512) for i, t in texts)
    assert token_counts(empty).count() == 0


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    bins = BestFit(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = BestFit(10, 1)
    assert bins.add(7) == (0, 0) and bins.add(8) == (1, 0)  # bin 0 closes: only one may be open
    assert bins.add(3) == (2, 0)


def test_packing(docs, empty, texts):
    rows = best_fit_packing(docs, capacity=100, docs_per_task=9).collect()
    encode = library("byte_bpe_50k.json").encode
    wanted = defaultdict(int)
    for i, t in texts:
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 100 or min(100, len(ids)), len(ids) + 1, 100)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for pieces in bins.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 100
    assert best_fit_packing(empty).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 1 << 62, 5000).astype(np.uint64)
    table = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert PerfectHash.of(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        PerfectHash.of(np.append(keys, keys[7]))
    assert len(set(fingerprints(keys).tolist())) > 4990


def test_token_store(spark, docs, empty, texts, tmp_path):
    encode = library("word_bpe_49k.json").encode
    ids = {(i, t): [*encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    wanted, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        x = ids[i, t]
        wanted.append((i, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    for size in (1000, 5):
        got = [tuple(r) for r in token_store(docs, docs_per_shard=size).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        assert sorted(got, key=lambda r: r[1]) == wanted
    assert token_store(empty).count() == 0
    bounds = shard_bounds(docs, 5)
    manifest = write_token_store(docs, str(tmp_path), bounds)[0].collect()
    assert len(manifest) > 1 and sum(r.n_ids for r in manifest) == start
    with pytest.raises(KeyError):
        ShardReader(manifest[0].path).find(np.array([123456789], np.uint64))


def test_a_frequent_doc_id_is_dealt_to_several_shards(spark, tmp_path):
    rows = [(None if i % 3 else i, "same text" if i % 2 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = write_token_store(docs, str(tmp_path), shard_bounds(docs, 50))[0].collect()
    assert len(manifest) > 6 and max(r.n_docs for r in manifest) < 200
    got = token_store(docs, docs_per_shard=50).collect()
    starts = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in got)
    assert len(got) == 600 and all(a[0] + a[1] == b[0] and a[2:] <= b[2:] for a, b in zip(starts, starts[1:]))


@pytest.mark.parametrize("bins,ahead,most", [(64, 256, 1.01), (16, 64, 1.05)])
def test_packing_closes_bins_and_still_fills_them(spark, bins, ahead, most):
    from quern.llm.packing import pack

    draw = np.random.default_rng(8)
    lengths = np.minimum(draw.geometric(1 / 500, 4000), 2048)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack(pieces, 1, 2048, bins, ahead).collect()
    assert len(rows) == 4000
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= most * -(-int(lengths.sum()) // 2048)
    assert len(used) > bins  # so bins were closed
