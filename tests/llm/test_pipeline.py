"""The pipeline against brute force, and its stages on odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_small import ODD, SCHEMA, brute_components, brute_contained, brute_dedup, check_packing
from tickweave.llm import quality
from tickweave.llm.packing import ChunkTokenizer
from tickweave.llm.queries import word_tokens

STAGE = dict(corpus_pipeline.STAGES)


def brute_pipeline(spark, docs, labels, items):
    """Ids that reach the packing, from (id, text) pairs."""
    model = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    score = lambda t: model.score(quality.features(np.frombuffer((t or "").encode(), np.uint8)))
    docs = [d for d in docs if score(d[1]) >= 0.7]
    found = brute_dedup([t for _, t in docs])
    docs = [d for i, d in enumerate(docs) if found[i][2]]
    found = brute_components([t for _, t in docs], 5, 80, 100)
    docs = [d for i, d in enumerate(docs) if found[i][1] == i]
    bad = {d for d, _ in brute_contained([t for _, t in docs], items)}
    return [d for i, d in enumerate(docs) if i not in bad]


def check_against_brute_force(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = sorted((r.doc_id, r.text) for r in read("documents").collect())
    want = brute_pipeline(spark, docs, read("labels"), [r.text for r in read("benchmark").collect()])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids, offsets = ChunkTokenizer(word_tokens().path).encode(pa.array([t for _, t in want]), 1)
    size = {d: n for (d, _), n in zip(want, np.diff(offsets).tolist())}
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert dict(got) == size and want
    assert check_packing(rows, 4096) <= sum(size.values()) / 4096 * 1.05 + 1


def test_small_tables_against_brute_force(spark):
    check_against_brute_force(spark, SF)


def test_planted_cases_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = lambda n: (" ".join(word() for _ in range(n))).capitalize() + "."
    items = [line(rng.choice([12, 30])) for _ in range(10)]
    texts = []
    for i in range(240):
        base = line(rng.choice([8, 30, 90]))
        if i % 9 == 0:
            base += " " + rng.choice(items)
        texts.append(base.upper() + "!!!" if i % 4 == 0 else base)
        if i % 5 == 0:
            texts += [texts[-1] + " ", texts[-1] + " " + word()]
    texts += [t for t in ODD if t]
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)]
    labels = [(i, int(not t.isupper()), 0) for i, t in enumerate(texts) if i % 3]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check_against_brute_force(spark, str(tmp_path))


CLASHING = ("_gone", "_bad", "gone", "bad", "all", "row", "digest", "id", "points", "n", "key", "rep", "component_id", "kept", "text_sha256", "score")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "another text of id three"), (None, "a"), (None, None), (2, ODD[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    for given in (docs, docs.limit(0)):
        got = STAGE[name](spark, given, SF)
        if name != "best-fit packing":
            assert got.columns == given.columns
        found = got.collect()
        # without labelled rows the classifier scores 0.5 and keeps nothing
        assert bool(found) == (given is docs and name != "quality classifier")


def test_exact_stage_decides_repeated_ids_by_their_texts(spark):
    rows = [(1, "x y"), (2, "xy"), (2, "other"), (2, "other "), (3, "other"), (4, "four"), (4, "four"), (None, "xy"), (None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in STAGE["exact dedup"](spark, docs, SF).collect())
    assert got == Counter([(1, "x y"), (2, "other "), (4, "four"), (None, "only null")])
