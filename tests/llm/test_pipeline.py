"""The pipeline's stages, each on what its predecessor kept, against plain brute-force versions."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quern.llm import mixing, packing, quality
from quern.llm.automaton import Transducer

FOLDER = "/root/testdata/sf0.001"


def brute_clean(text):
    """The kept lines of a text, or None where the document goes."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None

    def fails(line):
        line = line.strip(quality.BLANKS)
        own = [w for w in re.split("[ \t\n\x0b\f\r]+", line) if w]
        marks = sum(c in quality.PUNCTUATION for c in line)
        separators = sum(w in quality.SEPARATORS for w in own)
        return (
            (marks > 1 and 100 * marks > quality.MAX_PUNCTUATION * sum(map(len, own)))
            or (len(own) < quality.SHORT_LINE and line[-1] not in quality.TERMINAL)
            or separators >= 2
            or 4 * separators >= len(own)
            or (len(own) < quality.BOILERPLATE_WORDS and any(p in line.lower() for p in quality.BOILERPLATE))
        )

    kept = [x for x in text.split("\n") if not x.strip(quality.BLANKS) or not fails(x)]
    size = lambda t: sum(c not in quality.BLANKS for c in t)
    return "\n".join(kept) if 100 * sum(map(size, kept)) >= quality.MIN_LEFT * size(text) else None


def brute_keep_one(rows):
    """The least doc_id of each component of rows with similar sets of five-word shingles."""
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i for i in ids if label[i] == i}


def brute_without_repeats(rows, length=200):
    raw = {i: t.encode() for i, t in rows}
    count = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept, at = [], 0
        for c in b.decode():
            width = len(c.encode())
            if not gone[at : at + width].all():
                kept.append(c)
            at += width
        text = "".join(kept)
        if text.strip() or not gone.any():
            out[i] = text
    return out


def brute_scores(rows, labels):
    """Posterior of each text by naive Bayes over distinct words, from counts in plain dictionaries."""
    n = len(mixing.DOMAINS)

    def words(text):
        return {xxhash.xxh64_intdigest(w.encode(), 42) % mixing.BUCKETS for w in re.split(mixing.EDGES, (text or "").lower())}

    table, sizes = np.zeros((mixing.BUCKETS, n)), np.zeros(n)
    for i, text in rows:
        if i in labels:
            sizes[labels[i]] += 1
            table[list(words(text)), labels[i]] += 1
    mass = table.sum(axis=0)
    share = table.sum(axis=1) / mass.sum()
    expected = np.outer(share, mass)
    gain = ((table - expected) ** 2 / np.maximum(expected, 0.5)).sum(axis=1)
    used = [k for k in sorted(np.argsort(-gain, kind="stable")[: mixing.FEATURES]) if gain[k] > mixing.MIN_GAIN]
    chance = {k: (table[k] + mixing.PRIOR_WORDS * share[k]) / (mass + mixing.PRIOR_WORDS) for k in used}
    rest = [1 - sum(c[d] for c in chance.values()) for d in range(n)]
    plain = 1 - sum(share[k] for k in used)
    out = {}
    for i, text in rows:
        score = [np.log((sizes[d] + 0.5) / (sizes.sum() + 0.5 * n)) if sizes[d] else mixing.NEVER for d in range(n)]
        for k in words(text):
            for d in range(n):
                if sizes[d]:
                    score[d] += np.log(chance[k][d] / share[k]) if k in chance else np.log(rest[d] / plain)
        p = np.exp(np.array(score) - max(score))
        out[i] = p / p.sum()
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs before, docs after) of each stage but the last."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(base / name))
        after = spark.read.parquet(str(base / name))
        assert after.columns == docs.columns
        out[name] = docs, after
        docs = after
    return out


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_quality_stage(stages):
    before, after = map(rows_of, stages["quality_rules"])
    wanted = {i: brute_clean(t) for i, t in before}
    assert dict(after) == {i: t for i, t in wanted.items() if t is not None} and len(after) > 50
    assert all(r.n_chars == len(r.text) for r in stages["quality_rules"][1].collect())


def test_near_dedup_stage(stages):
    before, after = map(rows_of, stages["simhash_near_dedup"])
    kept = brute_keep_one(before)
    assert sorted(after) == sorted((i, t) for i, t in before if i in kept) and len(after) < len(before)


def test_repeats_stage(stages):
    before, after = map(rows_of, stages["suffix_array_dedup"])
    assert dict(after) == brute_without_repeats(before)


def test_mixing_stage(spark, stages):
    before, after = stages["mixing"]
    rows = rows_of(before)
    table = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    labels = {r.doc_id: 2 if r.toxic == 1 else 1 if r.quality == 0 else 0 for r in table}
    wanted = brute_scores(rows, labels)
    model = mixing.fit_classifier(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for r in before.select("doc_id", model.posterior(before["text"]).alias("p")).collect():
        assert np.allclose(r.p, wanted[r.doc_id], atol=1e-6)
    tokens = {i: len(re.findall("[^ \t\n\x0b\f\r]+", t or "")) for i, t in rows}
    have = sum(tokens[i] * wanted[i] for i, _ in rows)
    goal = np.array([have[0], have[1], 0.02 / 0.98 * (have[0] + have[1])])
    rate = {i: 1.0 for i, _ in rows}  # plain projected gradient over all documents
    gram = sum(tokens[i] * np.outer(wanted[i], wanted[i]) for i, _ in rows)
    for _ in range(2000):
        step = (sum(rate[i] * tokens[i] * wanted[i] for i, _ in rows) - goal) / np.linalg.eigvalsh(gram)[-1]
        rate = {i: max(0.0, r - wanted[i] @ step) for i, r in rate.items()}
    copies = Counter(i for i, _ in rows_of(after))
    draw = lambda i, t: xxhash.xxh64_intdigest(b"mix", xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))
    exact = {i: int(rate[i] + (draw(i, t) >> 11) * 2.0**-53) for i, t in rows}
    assert sum(copies[i] != exact[i] for i, _ in rows) <= 0.02 * len(rows)  # rates of the two fits differ in the last places


def test_packing_stage(spark, stages):
    docs = stages["mixing"][1]
    packed = pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    wanted = Counter()
    for i, t in rows_of(docs):
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == wanted
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= 1.02 * -(-sum(r.length for r in packed) // 2048) + 1


def test_stages_on_nulls_repeats_and_no_rows(spark):
    draw = random.Random(4)
    long = " ".join(f"word{draw.randrange(10**6)}" for _ in range(80)) + "."
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (None, long + " End of it.", None, None, None)]
    docs = spark.createDataFrame(rows, source.schema)
    for start in (docs, docs.limit(0)):
        held = start
        for _, stage in pipeline.STAGES[:-1]:
            held = stage(spark, held, FOLDER)
            assert held.columns == source.columns
            assert start is docs or held.count() == 0


def test_workers_that_pack_hold_a_bounded_table():
    draw = random.Random(3)
    machine = Transducer(public_tokenizers.path("byte_bpe_50k.json"), packing.STATES)
    words = ["".join(draw.choices("abcdefghijklmnoprstuvwxyz", k=5)) for _ in range(60_000)]
    machine.ids([" ".join(words + words)])
    assert len(machine.merger.states) <= packing.STATES and machine.merger.next.nbytes < 40 << 20
