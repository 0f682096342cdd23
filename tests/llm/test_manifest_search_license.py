"""License scans, Merkle manifests and ranked search against plain versions, on every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import lexical, merkle
from quern.llm.lexical import lexical_search
from quern.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, global_order, license_blocks, license_scan, template_matches, template_table
from quern.llm.merkle import merkle_manifest, merkle_tree


def fold_case(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold_case(text))


def brute_license(text):
    words = words_of(text or "")
    hits = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in hits}, 0.0
    for block in re.split(r"[.!?;:]+[ \t\n\x0b\f\r]+|\n[ \t\x0b\f\r]*\n", text or ""):
        own, met = set(words_of(block)), []
        for label, template in TEMPLATES:
            wanted = set(words_of(template))
            if len(own & wanted) >= max(1, math.ceil(len(wanted) * CONTAINMENT - 1e-9)):
                met.append((len(own & wanted), len(own & wanted) / len(wanted), label))
        most = max((m[0] for m in met), default=0)
        labels |= {x for n, _, x in met if n == most}
        score = max([score, *(s for n, s, _ in met if n == most)])
    base = {x for _, x in hits}
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


LICENSED = [
    (100, "Licensed under the Apache License, Version 2.0."), (101, "MIT License mit license\nmit\tLICENSE"), (102, "x " * 3000 + "released under the MIT license"),
    (103, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and documentation files (the \"Software\"), to deal in the Software without any restriction, now"),
    (104, "This is licensed under CC BY-NC 4.0. And that under CC-BY!"), (105, "gnu general public license gnu general public"), (106, None), (106, "mit license"), (106, "mit license"),
    (None, "Apache License"), (107, "ſmit license apache-license cc_by ccby é mit license"), (108, "released under the\n\nMIT license"), (109, "GNU General Public KLicense"),
]


def test_license_scan(spark, docs, empty, texts):
    rows = texts + LICENSED
    frame = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, 0.5) for i, t in LICENSED], "doc_id long, text string, score double"))
    got = license_scan(frame).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert sorted(str((r.doc_id, *(r[n] for n in names), round(r.score, 9))) for r in got) == sorted(str((i, *brute_license(t))) for i, t in rows)
    assert {r.doc_id: r.labels for r in got}[103] == "mit" and {r.doc_id: r.score for r in got}[103] < 1
    assert license_scan(empty).count() == 0


def test_license_blocks_give_the_text(spark):
    frame = spark.createDataFrame([(1, "First. Released under the MIT License. Last.", "a")], "doc_id long, text string, label string")
    (row,) = license_blocks(frame).collect()
    assert (row.doc_id, row.place, row.text.rstrip("."), row.label, row.containment) == (1, 1, "released under the mit license", "mit", 1.0)


def test_set_similarity_join_loses_no_pair(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = [(i, f"l{i}", draw.sample(vocabulary, draw.randint(1, 25))) for i in range(30)]
    blocks = []
    for i in range(200):  # parts of templates with other words, some with all
        own = templates[i % 30][2]
        kept = draw.sample(own, max(0, len(own) - draw.randint(0, 4)))
        blocks.append((i, [*kept, *(draw.choice(vocabulary) for _ in range(draw.randint(0, 12))), "other"]))
    table = spark.createDataFrame(templates, "template int, label string, words array<string>")
    frame = spark.createDataFrame(blocks, "block int, words array<string>")
    order = global_order(frame.select(F.explode("words").alias("word")), table)
    tokens = F.array_intersect(F.lit(order), "words").alias("tokens")
    for share in (0.5, 0.8, 1.0):
        got = {(r.block, r.template): r.shared for r in template_matches(frame.select("block", tokens), table, order, share).collect()}
        wanted = {}
        for b, own in blocks:
            for t, _, words in templates:
                shared = len(set(own) & set(words))
                if shared >= max(1, math.ceil(len(words) * share - 1e-9)):
                    wanted[b, t] = shared
        assert got == wanted
    assert template_table(spark).count() == len(TEMPLATES)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_levels(nodes):
    """All levels of a tree and for each node of the first the siblings left and right of its ancestors."""
    paths = [[] for _ in nodes]
    step = 1
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            k = i // step
            run = range(k // 3 * 3, min(k // 3 * 3 + 3, len(nodes)))
            path.append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes = [sha(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
        step *= 3
    return nodes[0], paths


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: brute_levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, upper = brute_levels([tops[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), tops[s][1], strict=True):
            whole = [*path, *above]
            now = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = brute_leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in whole:
                now = sha(left, now, right)
            out.append((r[0], leaf, tops[s][0], root, sha(*(x for pair in whole for x in pair)), now, now == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [6, 2, 1])
def test_merkle_manifest(spark, texts, empty, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", None, "B", "é", ""]), None if k % 5 == 0 else "en", k or None, t) for k, (i, t) in enumerate(texts)]
    rows += [(k, "hot", "de", 3, f"line\nline {k % 3}") for k in range(200)] + [(7, "hot", "de", 3, "one\ntwo")] * 40 + [(5, "lone", "fr", 1, "x")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string").repartition(5)
    got = merkle_manifest(frame)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(rows)
    assert merkle_manifest(empty).count() == 0
    single = frame.filter("source = 'lone'")
    (row,) = merkle_manifest(single).collect()
    assert row.root == row.subroot == row.leaf and row.proof_sha256 == sha() and row.verified


def test_merkle_tree_gives_paths(spark):
    leaves = spark.createDataFrame([("g", i, sha(str(i))) for i in range(11)], "g string, i long, node string")
    root, paths = brute_levels([sha(str(i)) for i in range(11)])
    for r in merkle_tree(leaves, "g", ["i"]).collect():
        assert [(p.left, p.right) for p in r.path] == paths[r.i] and r.subroot == r.root == root


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold_case(t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "bundle", "owners"), [(2048, 64, (5000, 2500, 1000)), (5, 2, (1500, 700)), (1, 1, ())])
def test_lexical_search(spark, docs, empty, texts, monkeypatch, block, bundle, owners):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "ITEMS", bundle)
    monkeypatch.setattr(lexical, "OWNERS", owners)
    draw = random.Random(4)
    known = sorted({w for _, t in texts for w in (t or "").split()})
    rows = texts + [(200 + i, " ".join(draw.choice(known) for _ in range(draw.randint(1, 60)))) for i in range(60)]
    rows += [(300 + i, rows[40][1]) for i in range(15)]  # more ties than ranks
    items = [(i, " ".join(draw.choice(known) for _ in range(draw.randint(1, 12)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nothing of that"), (53, rows[40][1]), (53, rows[40][1]), (54, "Word WORD word"), (None, rows[41][1]), (55, "x" * 5000)]
    frame = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, rank int, score double").repartition(4)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")
    assert sorted(str(tuple(r)) for r in lexical_search(frame, asked).collect()) == brute_search(rows, items)
    assert lexical_search(empty, asked).count() == 0 and lexical_search(docs, asked.limit(0)).count() == 0
