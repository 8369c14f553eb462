import random

import numpy as np
import pytest

import corpus_pipeline as P
from pulsegrid.llm import decontamination as D
from pulsegrid.llm import packing, secret_scan

from .fixtures import corpus
from .test_jaccard_join import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables: toxic documents, near copies, benchmark passages, secrets, awkward rows."""
    rng = random.Random(11)
    docs, labels, items = [], [], [" ".join(f"b{rng.randrange(500)}" for _ in range(30)) for _ in range(4)]
    for i, text in corpus(12, 420):
        toxic = int(rng.random() < 0.25)
        text += " grumbus foolio grumbus" * toxic + (" " + rng.choice(items) if rng.random() < 0.1 else "") + (" password=abcdef123" if rng.random() < 0.2 else "")
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    docs += [(1001, None, None, None, None), (1002, "", "en", "s0", 0), (1003, docs[0][1], "en", "s1", docs[0][4]), (1003, docs[0][1], "en", "s1", docs[0][4]), (None, "no id here", "en", "s1", 10)]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [D.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = docs.columns
    (_, toxic), (_, copies), (_, leaks), (_, secrets), (_, packs) = P.STAGES

    clean = toxic(spark, docs, folder)
    assert clean.columns == names
    before, after = docs.collect(), clean.collect()
    bad = {r.doc_id for r in before if r.text and "grumbus" in r.text and r.doc_id is not None}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == bad

    single = copies(spark, clean, folder)
    assert single.columns == names
    least = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in after if r.doc_id is not None])}
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(i for i, c in least.items() if i == c)
    assert single.where("doc_id is null").count() == 1

    free = leaks(spark, single, folder)
    assert free.columns == names
    held = {r.doc_id for r in single.collect() if any(p in D.normal(r.text or "") for p in items)}
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in free.collect()} == held and held

    hidden = secrets(spark, free, folder)
    assert hidden.columns == names and hidden.dtypes == docs.dtypes
    want = {r.doc_id: secret_scan.redacted(r.text, secret_scan.find(r.text)) if r.text is not None else None for r in free.collect()}
    assert {r.doc_id: r.text for r in hidden.collect()} == want and any("[assign]" in (t or "") for t in want.values())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in hidden.collect())

    rows = packs(spark, hidden, folder).collect()
    encode = packing.Encoder(P.tokenizer())
    for r in hidden.collect():
        own = b"".join(x.ids for x in sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece))
        assert own == encode([r.text or ""])[0] + np.array([0], "<u4").tobytes()


def test_run_is_all_stages(spark, folder):
    rows = P.run(spark, folder)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey")
    rows = [(5, a, "s1"), (5, b, "s1"), (3, a, "s1"), (5, c, "s2"), (7, b + " eight", "s1"), (8, c, "s3"), (8, c, "s2"), (9, None, "s1"), (9, None, "s1"), (None, a, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as _no", "'x' as _text", "'x' as text_hash", "'x' as `a.b`", "'x' as stays", "'x' as rows")
    got = P.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and set(got.select("_no", "_text", "text_hash", "`a.b`", "stays", "rows").distinct().collect()[0]) == {"x"}
    keep = [(3, a, "s1"), (5, b, "s1"), (5, c, "s2"), (7, b + " eight", "s1"), (9, None, "s1"), (9, None, "s1"), (None, a, "s1")]
    # 4 of 4 shingles of b and 3 of 4 of its longer copy: 75 in a hundred
    keep = [r for r in keep if r[0] != 7]
    assert sorted(map(str, got.select("doc_id", "text", "source").collect())) == sorted(str(r) for r in spark.createDataFrame(keep, "doc_id long, text string, source string").collect())
