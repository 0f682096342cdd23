"""SimHash components, similarity components and repeated passages against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import repeats, simhash
from quern.llm.components import connected_components
from quern.llm.repeats import remove_repeats, without_repeats
from quern.llm.simhash import fingerprint_links, keep_one, similar_components, simhash_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest reachable node of each, by repeated relaxation."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and linked(a, b):
                    label[a], changed = label[b], True
    return label


def test_simhash(docs, empty, texts):
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash_components(docs).collect())
    prints = [(i, brute_fingerprint(t)) for i, t in texts]
    distinct = {p for _, p in prints}
    group = components(distinct, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    assert got == sorted(((i is not None, i or 0), f"{p:016x}", least.get(group[p])) for i, p in prints)
    assert simhash_components(empty).count() == 0


@pytest.mark.parametrize("limit", [32, 2])
def test_links_connect_what_is_near(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", limit)  # 2: all but the smallest blocks go by one-bit neighbours
    draw = random.Random(4)
    prints = set()
    for _ in range(12):
        p = draw.getrandbits(64)
        for _ in range(8):
            prints.add(p)
            for _ in range(draw.randint(1, 3)):
                p ^= 1 << draw.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())
    got = {r.node: r.component for r in connected_components(links).collect()}
    wanted = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {p: got.get(p, p) for p in signed} == wanted


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_similar_components(spark, docs, empty, monkeypatch):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, families = [], []
    for family in range(6):
        base = [draw.choice(words) for _ in range(150)]
        families.append(base)
        rows.append((family * 10, " ".join(base)))
        for copy in range(1, 4):
            near = list(base)
            near[draw.randrange(150)] = "edited"  # at most 5 of 146 shingles: similarity 0.93
            rows.append((family * 10 + copy, " ".join(near)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (32, 2):
        monkeypatch.setattr(simhash, "BAND_PAIRS", limit)
        got = {r.doc_id: r.component_id for r in similar_components(frame).collect()}
        assert got == {i: i // 10 * 10 for i, _ in rows}
    assert similar_components(empty).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not {4, 5, 10} & set(ids) and len(ids) == len(set(ids))


def brute_repeats(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(doc_id), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("gathered", [4096, 1])
def test_repeats(docs, empty, texts, monkeypatch, gathered):
    monkeypatch.setattr(repeats, "GATHERED", gathered)  # 1: strings of every mixed trigger are named and counted
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect())
    assert got == brute_repeats(texts)
    assert remove_repeats(empty).count() == 0


def test_repeats_on_random_patchworks(spark):
    draw = random.Random(12)
    pool = ["".join(draw.choice("ab é\n") for _ in range(draw.choice((90, 150, 230, 400)))) for _ in range(12)]
    rows = [(i, "".join(draw.choice(pool) for _ in range(draw.randint(0, 6)))) for i in range(40)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def test_texts_without_repeats(docs, texts):
    got = without_repeats(docs)
    assert got.columns == docs.columns
    left = {r.doc_id: r.text for r in got.collect()}
    by_id = dict(texts)
    assert left[13] == by_id[13] and left[0] is None and left[1] == "" and 3 not in left and 8 not in left
    assert left[7] in by_id[7] and len(left[7]) < len(by_id[7])


def brute_similar(rows):
    """Component of each doc_id by the exact similarity of five-word shingles."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_pairs_are_linked_by_exact_similarity(spark):
    draw = random.Random(21)
    rows = []
    for family in range(60):  # a run of changed words: similarities on both sides of 0.8, 0.66 to 0.87
        base = [f"f{family}w{i}" for i in range(150)]
        at, run = draw.randrange(10, 100), 7 + family % 20
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join([*base[:at], *(f"x{family}y{i}" for i in range(run)), *base[at + run :]]))]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_similar(rows)


def crowd():
    """Texts at 0.74 of each other by a frequent template; chains of three inside, neighbours at 0.83."""
    template, rows = [f"t{i}" for i in range(180)], []
    for k in range(200):
        tail = [f"o{k}w{i}" for i in range(30)]
        if k < 90 and k % 3:  # shares a half of its tail with the text before it, the other one with the text after it
            before = rows[-1][1].split()[180:]
            tail = [*tail[:15], *before[15:]] if k % 3 == 1 else [*before[:15], *tail[15:]]
        rows.append((k, " ".join([*template, *tail])))
    return rows


@pytest.mark.parametrize("limit", [6, 2])
def test_chains_in_large_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BAND_PAIRS", limit)
    monkeypatch.setattr(simhash, "HEADS", 1 if limit == 2 else 12)
    rows = crowd()
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_similar(rows)


def test_a_thousand_pairs_in_one_template(spark):
    """Pairs at 0.82 of each other, 0.6 to all others, as bands of a frequent template are large."""
    rows = []
    template = [f"t{i}" for i in range(150)]
    for k in range(300):
        own = [f"o{k}w{i}" for i in range(40)]
        rows.append((2 * k, " ".join([*template, *own])))
        rows.append((2 * k + 1, " ".join([*template, *own[:-16], *(f"x{k}y{i}" for i in range(16))])))
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_stage_against_exact_similarity_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in similar_components(docs).collect()}
    assert got == brute_similar(rows)


def test_null_ids_with_texts_of_one_32_bit_hash(spark):
    tail = "".join(f" w{i}" for i in range(70))
    texts = spark.range(150_000).select(F.concat(F.col("id").cast("string"), F.lit(tail)).alias("text"))
    twins = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first()["t"][:2]
    alone = twins[0] + " and no more"
    rows = [(None, "".join(f"u{i} " for i in range(70))), (None, twins[0]), (None, twins[1]), (1, alone)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def test_many_repeated_rows_of_one_document(spark):
    rows = [(7, "".join(f"w{i} " for i in range(200)))] * 2000 + [(8, "".join(f"v{i} " for i in range(100)))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 2001 and all(r.n_removed == (r.n_bytes if r.doc_id == 7 else 0) for r in got)
    assert {r.n_spans for r in got if r.doc_id == 7} == {1}


def test_column_names_with_odd_characters(spark):
    from quern.llm.quality import cleaned_documents

    text = " ".join(f"Sentence{i} has word{i} and thing{i} besides what{i} nobody{i} saw{i} today{i}." for i in range(9))
    docs = spark.createDataFrame([(1, text, 2, 3)], "doc_id long, text string, `a``b` int, `_row` int")
    for out in (cleaned_documents(docs), without_repeats(docs), keep_one(docs)):
        assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, text, 2, 3)]
    for stage in (cleaned_documents, without_repeats, keep_one):
        assert stage(docs.limit(0)).collect() == []


def test_keep_one_chooses_rows_not_ids(spark):
    first, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "wz")
    near = first.replace("w79", "changed")
    cases = [
        ([(1, first), (1, other)], [(1, first), (1, other)]),  # two texts under one id
        ([(1, first), (5, near), (5, other)], [(1, first), (5, other)]),  # a copy's id is also another text's
        ([(None, near), (1, first), (None, other)], [(1, first), (None, other)]),  # null ids go where a similar row stays
        ([(None, None), (3, ""), (3, None)], [(3, "")]),
        ([(2, first), (2, first), (2, first)], [(2, first)]),
    ]
    for rows, wanted in cases:
        frame = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, _row string, _turn string")
        got = keep_one(frame)
        assert got.columns == frame.columns
        assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t) for i, t in wanted)
