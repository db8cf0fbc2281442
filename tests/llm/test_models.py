"""Models and small operators against plain Python: features and scores, convolutions, shards and stored maps, notices, lines."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_small import ODD, docs
from tickweave.llm import arrowtext as A
from tickweave.llm import language_id, license_scan, line_dedup, quality, sharding

# --- quality -------------------------------------------------------------------


def labelled_docs(spark, n=200):
    rng = random.Random(7)
    texts = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(w.upper() if i % 3 == 0 else w for w in words) + ("!!" if i % 3 == 0 else "."))
    labels = [(i, int(i % 3 != 0)) for i in range(n)] + [(i, None) for i in range(5)] + [(10_000, 1)]
    return texts, docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")


def brute_scores(texts, labels, scored):
    """The same classifier with dense vectors, written out: ratio, hinge loss, curve."""
    rows = [quality.features(np.frombuffer((t or "").encode(), np.uint8)) for t in texts]
    used = sorted({f for r in rows for f in r.tolist()})
    at = {f: k for k, f in enumerate(used)}
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r.tolist()]] = 1
    y = np.array(labels)
    unseen = quality.FEATURES - len(used)
    one, none = 1 + x[y == 1].sum(axis=0), 1 + x[y == 0].sum(axis=0)
    ratio = np.log(one / (one.sum() + unseen)) - np.log(none / (none.sum() + unseen))
    scaled = x * ratio / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
    sign, cost = np.where(y == 1, 1.0, -1.0), 0.5 / np.where(y == 1, (y == 1).mean(), (y == 0).mean())

    def descend(z, s, c):
        w, b, alpha, order = np.zeros(z.shape[1]), 0.0, np.zeros(len(z)), np.random.default_rng(5)
        for _ in range(12):
            largest = 0.0
            for i in order.permutation(len(z)):
                new = min(max(alpha[i] - (s[i] * (z[i] @ w + b) - 1) / (z[i] @ z[i] + 1), 0.0), c[i])
                step, alpha[i] = new - alpha[i], new
                w, b, largest = w + step * s[i] * z[i], b + step * s[i], max(largest, abs(step))
            if largest < 1e-3:
                break
        return w, b

    inner = np.arange(len(rows)) % 5 != 0
    w, b = descend(scaled[inner], sign[inner], cost[inner])
    slope, shift = quality.fit_curve(scaled[~inner] @ w + b, y[~inner])
    w, b = descend(scaled, sign, cost)
    out = []
    for t in scored:
        found = quality.features(np.frombuffer((t or "").encode(), np.uint8)).tolist()
        margin = sum(w[at[f]] * ratio[at[f]] for f in found if f in at) / math.sqrt(max(1, len(found))) + b
        out.append(1 / (1 + math.exp(-(slope * margin + shift))))
    return out


def test_scores_against_dense_vectors(spark):
    texts, df, labels = labelled_docs(spark)
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    more = df.unionByName(docs(spark, ODD).withColumn("doc_id", F.col("doc_id") + 1_000))
    got = {r.doc_id: r.score for r in quality.score(more, quality.train(df, labels)).collect()}
    want = brute_scores([texts[i] for i in known], [int(i % 3 != 0) for i in known], texts + ODD)
    ids = [*range(len(texts)), *(1_000 + i for i in range(len(ODD)))]
    assert all(abs(got[d] - w) < 2e-3 for d, w in zip(ids, want, strict=True))


def test_quality_repeats_and_sample(spark):
    texts, df, labels = labelled_docs(spark)
    names = {c: F.lit(0) for c in ("label", "found", "order", "quality", "score")}
    twice = df.unionByName(df).withColumns(names)
    model, again = quality.train(df, labels), quality.train(twice, labels)
    assert np.array_equal(model.weights, again.weights)
    assert quality.score(twice, model).count() == 2 * len(texts)
    assert quality.labelled_features(df, labels, "quality", quality.held_out_quality(), 20).count() == 20


# --- language -------------------------------------------------------------------


def brute_language(net, text):
    """Mean log-probability per language by plain loops over one-hot bytes."""
    data = bytes(A.LOWER[np.frombuffer(text.encode(), np.uint8)])
    many = max(1, -(-len(data) // language_id.WINDOW))
    data = data.ljust(many * language_id.WINDOW + max(language_id.WIDTHS))
    total = np.zeros(len(net.languages))
    for k in range(many):
        pooled = []
        for n, width in enumerate(language_id.WIDTHS):
            for f in range(language_id.FILTERS):
                values = [sum(float(net.filters[width][p, data[k * language_id.WINDOW + at + p], f]) for p in range(width)) for at in range(language_id.WINDOW)]
                pooled.append(max(0.0, max(values) + float(net.bias[n * language_id.FILTERS + f])))
        logits = np.array(pooled) @ net.dense + net.offset
        total += logits - logits.max() - math.log(np.exp(logits - logits.max()).sum())
    return total / many


def test_language_scores_against_plain_convolutions(spark):
    rng = random.Random(2)
    stems = {"aa": ["thing", "the", "with"], "bb": ["über", "nicht", "schön"], "cc": ["señor", "ción", "los"]}
    langs = {i: sorted(stems)[i % 3] for i in range(90)}
    texts = [" ".join(rng.choice(stems[langs[i]]) for _ in range(rng.choice([3, 30, 90]))) for i in range(90)]
    df = docs(spark, texts, langs)
    net = language_id.train(df)
    got = {r.doc_id: r for r in language_id.identify(df, net).collect()}
    for i in range(0, 90, 6):
        logs = brute_language(net, texts[i])
        chance = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[i].lang_pred == net.languages[int(logs.argmax())] and abs(got[i].score - chance.max()) < 1e-3


def test_language_odd_rows(spark):
    rows = [(i, "the thing with the thing" if i % 2 else "über nicht schön", "aa" if i % 2 else "bb") for i in range(40)]
    rows += [(1, "zzz", "zz"), (None, "the", "aa"), (50, None, "aa"), (51, "the " * 100_000, None), (52, "1 2 3", None), (3, rows[3][1], "aa")]
    names = {c: F.lit(0) for c in ("order", "row", "network", "lang_pred", "score")}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(names)
    net = language_id.train(df)
    got = language_id.identify(df, net).collect()
    assert len(got) == len(rows)
    kinds = defaultdict(set)
    for r in got:
        kinds[r.doc_id].add(r.lang_pred)
    assert kinds[50] == kinds[52] == {"und"} and kinds[51] == {"aa"} and kinds[3] == {"aa"} and kinds[2] == {"bb"}
    assert language_id.train(df.limit(0)) is None and language_id.identify(df.limit(0), net).count() == 0


def test_all_windows_of_a_sampled_text_are_learnt():
    rng = np.random.default_rng(0)
    early, late = b"lorem ipsum " * 100, b"dolor sit amet " * 100
    texts = [np.frombuffer(early + (b"xyz qqq " * 300 if k % 2 else late), np.uint8) for k in range(40)]
    net = language_id.fit(texts, ["a" if k % 2 else "b" for k in range(40)], epochs=4, seed=int(rng.integers(9)))
    tail = np.frombuffer(b"xyz qqq " * 50, np.uint8)
    logs = language_id.text_scores(net, net.tables(), tail, np.array([0, len(tail)]))
    assert net.languages[int(logs[0].argmax())] == "a"


# --- shards ----------------------------------------------------------------------


def brute_shards(rows, shards):
    """Shard of each virtual slot by plain longest-first assignment over (virtual_slot, size)."""
    weight = Counter()
    for slot, size in rows:
        weight[slot] += size
    load, owner = [0] * shards, {}
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        owner[slot], load[k] = k, load[k] + weight[slot]
    return owner


def test_shards_against_plain_assignment(spark):
    texts = [None if i % 50 == 0 else "é" * (i * 31 % 700) for i in range(2_000)] + ["x" * 400_000]
    df = docs(spark, texts).withColumns({c: F.lit(1) for c in ("size", "salt", "shard", "slot", "virtual_slot", "rank", "before")})
    got = sharding.shard(df, 24).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    owner = brute_shards([(r.virtual_slot, r["size"]) for r in got], 24)
    assert all(r["shard"] == owner[r.virtual_slot] for r in got)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_versions_of_the_map_are_stored_and_edited(spark, tmp_path):
    path, df = str(tmp_path / "map"), docs(spark, ["t" * (i * 17 % 300) for i in range(3_000)])
    first = {r.doc_id: r["shard"] for r in sharding.shard(df, 24, map_path=path).collect()}
    one = sharding.SlotMap.load(spark, path)
    files = sorted(p.name for p in (tmp_path / "map" / "version=1").iterdir())
    second = sharding.shard(df, 25, map_path=path).collect()
    assert {r.map_version for r in second} == {2} and sharding.SlotMap.versions(spark, path) == [1, 2]
    moved = [r.doc_id for r in second if r["shard"] != first[r.doc_id]]
    assert all(r["shard"] == 24 for r in second if r.doc_id in set(moved)) and 0 < len(moved) < 3_000 / 12
    assert sharding.SlotMap.load(spark, path, 1) == one and files == sorted(p.name for p in (tmp_path / "map" / "version=1").iterdir())
    with pytest.raises(Exception, match="already exists"):
        one.save(spark, path)


def test_split_slots_keep_their_numbers(spark, tmp_path):
    path, keys = str(tmp_path / "map"), F.when(F.col("doc_id") < 1_000, F.lit(5)).otherwise(F.col("doc_id"))
    df = docs(spark, ["text"] * 3_000).withColumn("doc_id", keys)
    one = sharding.shard(df, 24, map_path=path)
    held = one.select(F.col("doc_id").alias("id"), "virtual_slot", "salt", "size")
    held.write.parquet(str(tmp_path / "rows"))
    before = spark.read.parquet(str(tmp_path / "rows"))
    hot = [r.virtual_slot for r in before.where("id = 5").select("virtual_slot").distinct().collect()]
    assert len(hot) > 100 and min(hot) >= sharding.SLOTS
    # A second key becomes hot later; the first one's records stay in the slots of the old map.
    more = before.select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), "salt").unionByName(spark.range(1_500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("text").alias("text"), F.lit(None).cast("long").alias("salt")))
    two = sharding.shard(more, 24, map_path=path, salt="salt").collect()
    assert {r.virtual_slot for r in two if r.doc_id == 5} == set(hot) and sharding.SlotMap.load(spark, path).version == 2
    size = Counter(r["shard"] for r in two)
    assert max(size.values()) < 1.3 * min(size.values())


# --- notices and lines -----------------------------------------------------------


def test_notices_of_repeated_and_long_rows(spark):
    long = "\n".join(["filler words"] * 40_000 + ["Released under the MIT License."])
    rows = [(1, "Released under the MIT License."), (1, "Licensed under CC BY 4.0.\nx\nReleased under the MIT License.\nReleased under the mit licence"), (1, "x"), (2, long), (None, "SPDX-License-Identifier: ISC"), (3, None), (4, "w" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("digest", "loose", "found", "like", "lines", "license_id", "line")})
    got = Counter((r.doc_id, r.n_notices, r.notices) for r in license_scan.scan_licenses(df).collect())
    assert got == Counter([(1, 1, "MIT"), (1, 3, "CC-BY-4.0,MIT"), (1, 0, ""), (2, 1, "MIT"), (None, 1, "ISC"), (3, 0, ""), (4, 0, "")])


def test_lines_of_repeated_and_long_rows(spark):
    common = "a line that stands on every site"
    rows = [(i, f"{common}\nown line of the text number {i}", f"s{i}") for i in range(12)] * 2
    rows += [(100, "\n".join([common] * 30_000 + ["the last line of a long text"]), "s1"), (101, "y" * 300_000, None), (None, common, "s2"), (102, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("z") for c in ("h", "site", "line", "gone", "all", "kept", "sites", "_id")})
    got = defaultdict(set)
    for r in line_dedup.drop_common_lines(df).collect():
        got[r.doc_id].add((r.n_lines, r.n_removed, r.text if len(r.text) < 100 else len(r.text)))
    assert got[3] == {(2, 1, "own line of the text number 3")}
    assert got[100] == {(30_001, 30_000, "the last line of a long text")} and got[101] == {(1, 0, 300_000)} and got[102] == {(0, 0, "")}
    assert len(got) == 16
