"""The corpus pipeline: each stage works on what the one before kept."""

import random

import pytest

import corpus_pipeline
from quillgraph.llm import decontaminate, quality_rules, secret_scan
from quillgraph.llm.queries import vocabulary

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], sf).write.parquet(str(base / str(i)))
        docs.append(spark.read.parquet(str(base / str(i))))
    return docs


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_goes_first(stages):
    judged = {r.doc_id: r.kept for r in quality_rules.judge(stages[0]).collect()}
    assert rows(stages[1]).keys() == {i for i, k in judged.items() if k}
    assert all(not brute.rules(r.text)[-1] for r in rows(stages[1]).values())


def test_one_of_each_group_stays(stages):
    groups = brute.components([(r.doc_id, r.text) for r in stages[1].collect()], 5, 80)
    assert rows(stages[2]).keys() == {i for i, (_, root) in groups.items() if i == root}


def test_leaks_go(stages, spark, sf):
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, r in rows(stages[2]).items() if not any(t in decontaminate.normalise(r.text) for t in items)}
    kept = rows(stages[3]).keys()
    gone = rows(stages[2]).keys() - kept
    assert kept <= clean
    for i in clean - kept:  # edited copies go, too: each is near some item
        text = decontaminate.normalise(rows(stages[2])[i].text)
        assert i in gone and any(decontaminate.myers(decontaminate.masks_of(t), len(t), text)[0] <= len(t) // 24 - 1 for t in items if t)


def test_secrets_are_masked(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert len(r.text) == len(before[i].text) and brute.secrets(r.text)[:3] == (0, 0, 0)
        if brute.secrets(before[i].text)[:3] == (0, 0, 0) and not any(__import__("re").search(x.pattern, before[i].text) for x in secret_scan.MORE_RULES):
            assert r.text == before[i].text


def test_what_is_left_is_packed(stages):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in stages[4].collect()]
    padding, _ = brute.check_packing(docs, stages[5].collect(), Tokenizer.from_file(vocabulary("word_bpe_49k.json")))
    assert padding == 0


def test_run_applies_all_stages(spark, sf, stages):
    from tokenizers import Tokenizer

    kept = [(r.doc_id, r.text) for r in stages[4].collect()]
    rows = corpus_pipeline.run(spark, sf).collect()
    padding, total = brute.check_packing(kept, rows, Tokenizer.from_file(vocabulary("word_bpe_49k.json")))  # the same documents, each id once
    assert padding == 0 and total == sum(r.length for r in stages[5].collect()) and {r.doc_id for r in rows} == {i for i, _ in kept}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, id string, found string, blob string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), *["clash"] * 6) for i, t in rows], SCHEMA)


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def left(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()))


def test_rejected_rows_go_and_good_ones_stay_whatever_their_ids(spark, sf):
    good = [(i, prose(i)) for i in range(30)]
    bad = [(None, "too short"), (3, "too short"), (None, None), (4, ""), (None, "word " * 200)]
    docs = frame(spark, [*good, *bad, (None, prose(99)), (5, prose(98))])
    out = corpus_pipeline.quality(spark, docs, sf)
    assert left(out) == sorted([*good, (-1, prose(99)), (5, prose(98))]) and out.columns == docs.columns


def test_one_copy_stays_whatever_the_ids(spark, sf):
    near = lambda seed: prose(seed) + " tail"
    rows = [(5, prose(1)), (5, prose(1)), (None, near(1)), (7, near(1)), (None, prose(2)), (None, near(2)), (None, prose(2)), (8, prose(3)), (8, prose(4)), (9, None), (None, "")]
    out = left(corpus_pipeline.near_duplicates(spark, frame(spark, rows), sf))
    assert [x for x in out if x[0] >= 0] == sorted([(5, prose(1)), (8, prose(3)), (8, prose(4)), (9, "")])
    rest = [t for i, t in out if i < 0]
    assert len(rest) == 2 and "" in rest and set(rest) < {"", prose(2), near(2)}


def test_leaks_and_secrets_without_ids(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, f"{prose(1)} {item} {prose(2)}"), (1, prose(3)), (1, f"{item} {prose(4)}"), (None, prose(5)), (2, None)]
    assert left(corpus_pipeline.leaks(spark, frame(spark, rows), sf)) == sorted([(1, prose(3)), (-1, prose(5)), (2, "")])
    rows = [(None, "password=hunter22 here"), (4, "password=hunter22 here"), (4, "fine"), (5, None)]
    masked = corpus_pipeline.secrets(spark, frame(spark, rows), sf)
    assert left(masked) == sorted([(-1, "x" * 17 + " here"), (4, "x" * 17 + " here"), (4, "fine"), (5, "")]) and masked.filter("doc_id = 5").first().text is None


def test_an_empty_table_passes_through(spark, sf, tmp_path):
    docs = frame(spark, [])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == 0
