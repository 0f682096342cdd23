"""Quality rules and mixing, and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing
from quern.llm.mixing import DOMAINS, apply_mix, fit_classifier, fit_rates, mix
from quern.llm.quality import BLANKS, BOILERPLATE, SYMBOLS, cleaned_documents, line_fails, quality_rules


def brute_base(text):
    text = text or ""
    words = [w for w in "".join(" " if c in BLANKS else c for c in text).split(" ") if w]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(docs, empty, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = quality_rules(docs).collect()
    assert sorted(str((r.doc_id, *(r[n] for n in names))) for r in rows) == sorted(str((i, *brute_base(t))) for i, t in texts)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[3] and kept[9] and kept[13] and not kept[14] and not kept[12] and not kept[0]
    assert quality_rules(empty).count() == 0


def test_line_rules(spark):
    lines = {
        "A plain sentence that ends as it should, with enough words.": False,
        "Home | News | Sport | Weather": True,
        "LOUD!! WORDS!! EVERY!! WHERE!! HERE!! NOW!!": True,
        "wo### rds*** wi&&& th%%% sym$$$ bols###": True,
        "All rights reserved.": True,
        "Short title without an end": True,
        "This is a long line of prose without a mark at its end which nobody should throw away": False,
        "Yes.": False,
        "Wir schützen Ihre Daten, siehe Datenschutz auf dieser Seite hier.": True,
        "Lisez aussi nos Mentions légales sur cette page du site maintenant.": True,
        "Consulte nuestra Política de privacidad antes de usar este sitio web.": True,
        "We value your choice, see our Privacy Policy on this page here.": True,
        "« Bien sûr », dit-elle.": False,
    }
    frame = spark.createDataFrame([(x,) for x in lines], "x string")
    assert {r.x: r.f for r in frame.select("x", line_fails(F.col("x")).alias("f")).collect()} == lines


def test_every_boilerplate_phrase_fails_its_line_and_no_other(spark):
    plain = "These lines of prose have enough words to stand and they end with a full stop."
    rows = [(i, f"{plain}\nThis line of more than ten words has {p.upper()} in it for once.\n{plain}") for i, p in enumerate(BOILERPLATE)]
    frame = spark.createDataFrame(rows * 1, "doc_id long, text string").withColumn("text", F.concat("text", F.lit("\n\n")))
    kept = {r.doc_id: r for r in quality_rules(frame).collect()}
    assert len(BOILERPLATE) >= 31 and {r.chars_left for r in kept.values()} == {2 * len(plain.replace(" ", ""))}


def test_cleaned_documents_keep_columns(docs, texts):
    out = cleaned_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[13].text == dict(texts)[13] and got[13].mark == 7 and 14 not in got


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        toxic, low = i % 10 == 0, i % 10 == 1
        bad = ["vile", "scum", "awful", "trash", "rotten", "nasty"] * toxic + ["spam", "buy!", "cheap", "offer", "click", "prize"] * low
        text = [draw.choice(words) for _ in range(60)] + bad
        draw.shuffle(text)
        rows.append((i, " ".join(text) + "."))
        if i % 3:
            labels.append((i, int(not low), int(toxic)))
    rows += [(None, None), (10_000, ""), (10_001, "vile " * 50)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, posterior string").repartition(3).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(labelled):
    docs, labels = labelled
    model = fit_classifier(docs, labels)
    held = docs.filter("doc_id % 3 = 0 and doc_id < 600")
    top = F.array_position(model.posterior(F.col("text")), F.array_max(model.posterior(F.col("text"))))
    rows = held.select("doc_id", top.alias("k")).collect()
    wanted = {0: 3, 1: 2}
    assert np.mean([r.k == wanted.get(r.doc_id % 10, 1) for r in rows]) > 0.97


def test_rates_meet_targets_and_match_a_dense_fit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-9)
    draw = np.random.default_rng(4)
    posterior = draw.dirichlet((0.6, 0.3, 0.3), 500)
    tokens = draw.integers(0, 300, 500)
    frame = spark.createDataFrame([(p.tolist(), int(n)) for p, n in zip(posterior, tokens, strict=True)], "posterior array<double>, n_tokens long")
    targets = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    rates = np.array([r[0] for r in frame.select(fit_rates(frame, targets)).collect()])
    assert (rates >= 0).all()
    assert np.allclose((rates * tokens) @ posterior / tokens.sum(), [targets[d] for d in DOMAINS], atol=1e-6)
    rate, goal = np.ones(500), np.array([targets[d] for d in DOMAINS]) * tokens.sum()  # plain projected gradient
    gram = (posterior * tokens[:, None]).T @ posterior
    for _ in range(3000):
        rate = np.maximum(0, rate - posterior @ ((rate * tokens) @ posterior - goal) / np.linalg.eigvalsh(gram)[-1])
    assert np.allclose((rate * tokens) @ posterior, goal, rtol=1e-3)


def test_mix(labelled, empty):
    docs, labels = labelled
    targets = mixing.TARGETS
    rows = mix(docs, docs, labels).collect()
    assert len(rows) == docs.count()
    total = sum(r.n_tokens for r in rows)
    shares = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total for d in DOMAINS]
    assert np.allclose(shares, [targets[d] for d in DOMAINS], atol=2e-3)
    assert all(abs(r.copies - r.rate) < 1 and r.rate >= 0 for r in rows)
    assert mix(empty, empty, labels).count() == 0
    with pytest.warns(UserWarning):  # without labels all domains are as likely, and no rate tells them apart
        assert {r.rate for r in mix(docs, docs, labels.limit(0)).collect()} != set()


def test_applied_mix_keeps_clean_rows(labelled):
    docs, labels = labelled
    out = apply_mix(docs, docs, labels, {"clean": 0.88, "low": 0.1, "toxic": 0.02}, ("clean", "low"))
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.filter("doc_id < 600").collect()]
    clean = {i for i in range(600) if i % 10 > 1}
    assert len(clean - set(ids)) <= 4 and sum(i % 10 == 0 for i in ids) <= 6 and len(ids) == len(set(ids))


def test_a_domain_without_labels_takes_no_rows(labelled):
    docs, labels = labelled
    rows = mix(docs, docs, labels.filter("quality = 1")).collect()
    assert all(r.p_low == 0 and abs(r.p_clean + r.p_toxic - 1) < 1e-9 for r in rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    docs = source
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == source.columns and {r.doc_id for r in docs.collect()} <= before
    kept = {r.doc_id for r in quality_rules(source).filter("kept").collect()}
    assert {r.doc_id for r in docs.collect()} <= kept and docs.count() > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[0][1](spark, source.limit(0), folder).count() == 0


@pytest.mark.parametrize("percent", [1, 3])
def test_pipeline_mix_meets_targets_at_any_toxic_share(spark, tmp_path, percent):
    import corpus_pipeline

    draw = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        toxic, low = i % 100 < percent, i % 100 >= 90
        words = ["vile", "scum", "awful", "trash", "rotten", "nasty"] * toxic + ["spam", "buy!", "cheap", "offer", "click", "prize"] * low
        rows.append((i, " ".join(words + [f"w{draw.randrange(400)}" for _ in range(60 - len(words))])))
        labels.append((i, int(not low), int(toxic)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [r.doc_id for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()]
    share = sum(i % 100 < percent for i in ids) / len(ids)
    assert 0.014 <= share <= 0.026
    assert abs(sum(percent <= i % 100 < 90 for i in ids) - 40 * (90 - percent)) < 60


def test_unmet_targets_are_told(labelled):
    docs, labels = labelled
    only_clean = docs.filter("doc_id % 10 > 1")
    with pytest.warns(UserWarning, match="not met"):
        rows = mix(only_clean, only_clean, labels.filter("quality = 1 and toxic = 0")).collect()
    assert not any(r.targets_met for r in rows)
    assert all(r.targets_met for r in mix(docs, docs, labels).collect())


def test_null_ids_are_drawn_each_for_itself_and_tokens_may_be_given(spark, labelled):
    _, labels = labelled
    draw = random.Random(3)
    rows = [(None if i % 2 else i, " ".join(["vile", "scum", "awful"] * (i % 3 == 0) + [f"w{draw.randrange(400)}" for _ in range(50)]), 1000 + i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens long")
    got = mix(docs, labelled[0], labels, {"clean": 0.8, "low": 0.0, "toxic": 0.2}, ("clean",), tokens="tokens").collect()
    assert sorted(r.n_tokens for r in got) == [1000 + i for i in range(900)]
    toxic = [r for r in got if r.domain == "toxic" and r.doc_id is None]
    assert {r.copies for r in toxic} == {0, 1}


def test_the_draw_follows_the_rates(spark, labelled):
    _, labels = labelled
    draw = random.Random(11)
    rows = [(i, " ".join(["vile", "scum", "awful"] * (i % 4 == 0) + [f"w{draw.randrange(400)}" for _ in range(draw.randrange(20, 80))])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = {"clean": 0.9, "low": 0.0, "toxic": 0.1}
    got = mix(docs, labelled[0], labels, targets, ("clean",), nearest=False).collect()
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    for unit in (lambda r: 1, lambda r: r.n_tokens):  # rows and tokens: within four deviations of what the rates say
        wanted = sum(unit(r) * r.rate for r in got)
        spread = sum(unit(r) ** 2 * (r.rate % 1) * (1 - r.rate % 1) for r in got) ** 0.5
        assert spread > 0 and abs(sum(unit(r) * r.copies for r in got) - wanted) < 4 * spread
    again = {r.doc_id: r.copies for r in mix(docs.repartition(7), labelled[0], labels, targets, ("clean",), nearest=False).collect()}
    assert again == {r.doc_id: r.copies for r in got}  # a task that runs again draws the same
    kept = {}
    for r in apply_mix(docs, labelled[0], labels, targets, ("clean",), nearest=False).collect():
        kept[r.doc_id] = kept.get(r.doc_id, 0) + 1
    assert kept == {i: n for i, n in again.items() if n}


def test_mixed_rows_keep_columns_of_any_name(spark, labelled):
    _, labels = labelled
    names = ("_row", "_copy", "_n", "_key", "_turn", "rate", "draw", "n_tokens", "copies")
    rows = [(i, f"w{i} w{i + 1} w{i + 2}", *(f"{c}{i}" for c in names)) for i in range(30)] + [(None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = apply_mix(docs, labelled[0], labels, {"clean": 1.0, "low": 0.0, "toxic": 0.0}, ("clean",))
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows} and out.count() > 0
