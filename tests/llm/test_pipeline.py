"""The pipeline against a brute-force run of the same rules."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pixelweft.llm import fertility
from tests.llm.test_operators import brute_near, brute_phrases

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "ti", "on", "wh", "re", "ou", "st"], int(rng.integers(1, 4)))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(11)
    item = words(rng, 14)
    rows = []
    for k in range(30):
        lines = [words(rng, int(rng.integers(12, 40))) for _ in range(3)]
        if k < 12:
            lines.insert(0, "menu home about")
        rows.append([k, "\n".join(lines), "en", "s1" if k < 20 else "s2"])
    rows += [[40, rows[3][1], "en", "s1"], [41, rows[5][1] + " tail", "en", "s2"], [42, words(rng, 20) + " " + item.upper() + " " + words(rng, 9), "en", "s2"]]
    rows += [[43, "too short", "en", "s1"], [44, "again and again it goes " * 20, "en", "s1"], [45, None, "en", "s1"], [46, "", None, None], [47, "menu home about", "en", "s1"]]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{base}/documents.parquet")
    items = [(1, item), (2, "nothing of this is there at all in any of the texts here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), rows, items


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_against_brute_force(spark, corpus):
    sf_dir, rows, items = corpus
    measure = fertility.Measurer(public_tokenizers.path("piece_bpe_32k.model"))
    left = []
    for r in rows:
        n_words, _, _, _, n_repeat, *_ = measure(r[1])
        if not (n_words < 10 or 100 * n_repeat > 20 * n_words):
            left.append(r)
    hosts = {}
    for r in left:
        hosts.setdefault(r[3], []).append(r)
    texts = {}
    for rs in hosts.values():
        pages = {}
        for r in rs:
            for x in {y.strip() for y in r[1].split("\n") if y.strip()}:
                pages[x] = pages.get(x, 0) + 1
        bad = {x for x, n in pages.items() if n >= 5 and n / len(rs) > 0.1}
        for r in rs:
            keep = [x for x in r[1].split("\n") if x.strip() not in bad]
            texts[r[0]] = "\n".join(keep) if any(x.strip() for x in keep) else r[1]
    assert not texts[0].startswith("menu")
    near = brute_near(sorted(texts.items()))
    stay = [(i, texts[i]) for i, c, _ in near if i == c]
    want = sorted(i for i, _, hit, _ in brute_phrases(stay, items) if not hit)
    assert 42 not in want and 40 not in want and 3 in want

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        assert docs.dtypes == spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes, name
        if k == 1:
            assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    assert sorted(r.doc_id for r in docs.collect()) == want
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r["sample"]) for r in got) == [(i, s) for i in want for s in (0, 1)]
    assert all(r.round_trip for r in got)


def test_empty_and_extra_columns(spark, corpus):
    sf_dir, *_ = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS key", "'x' AS part", "true AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
