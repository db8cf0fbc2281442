"""The dealt methods themselves: index files and splits, signatures and recall, style trees, stored maps, brute force."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_small import ODD, brute_components, brute_contained, brute_dedup, docs
from tickweave.llm import decontamination, exact_dedup, html_extract, ngram_join
from tickweave.workspace import materialise

# --- exact dedup -------------------------------------------------------------


def dedup_rows(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


@pytest.mark.parametrize("setting", ["split", "joined directory", "shuffled keys"])
def test_answers_come_through_split_buckets(spark, monkeypatch, setting):
    if setting == "joined directory":
        monkeypatch.setattr(exact_dedup, "LITERAL_CELLS", 2)
    if setting == "shuffled keys":
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 3)
    texts = ODD + [f"text {i % 90} {'long ' * (i % 7)}" for i in range(400)] + ["hot"] * 200
    assert dedup_rows(exact_dedup.exact_dedup(docs(spark, texts), capacity=1_000)) == brute_dedup(texts)


def test_index_has_a_folder_per_bucket_of_bounded_size(spark):
    text = F.concat(F.lit("some text "), (F.col("id") % 700).cast("string"))
    keyed = spark.range(1_000).select(F.col("id").alias("doc_id"), text.alias("norm"), F.length(text).cast("long").alias("points"))
    keyed = keyed.withColumn("key", F.xxhash64("norm")).withColumn("digest", F.sha2("norm", 256))
    entries = materialise(keyed.drop("norm").withColumn("size", F.lit(13).cast("long")), "entries")
    _, index = exact_dedup.write_index(keyed, entries, 2_000)
    rows = index.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    assert len({f.rsplit("/", 2)[1] for f in index.inputFiles()}) == len(rows) > 20
    assert sum(r.n for r in rows) == 700 and max(r.n for r in rows) * 64 <= 2_000
    heads = exact_dedup.find_heads(index).collect()
    assert sorted(Counter(h.group_size for h in heads).items()) == [(1, 400), (2, 300)]


def test_dedup_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "ab"), (3, "a  b"), (None, "c"), (4, None)], "doc_id long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("key", "digest", "norm", "n", "rank", "size", "bucket", "points", "keep_id")})
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter([(None, 3, 3, False)] * 2 + [(3, 3, 3, True), (None, None, 1, True), (4, 4, 1, True)])


# --- html ---------------------------------------------------------------------


def extracted(spark, rows):
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in got.collect()}


@pytest.mark.parametrize(
    "page",
    ["<a " * 100_000, '<a href="x ' * 100_000, "<a href='" * 100_000, "<b>" * 60_000 + "</i>" * 60_000, "<p><b>" + "<b>" * 50_000 + "<hr>" * 50_000, "<" * 300_000, "<div>" * 60_000, "a<b c=\"d" * 60_000, "<li>" * 60_000],
)
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    root = html_extract.parse(page)
    html_extract.main_text(page)
    [html_extract.features(e.node) for e in html_extract.elements(root)]
    assert time.process_time() - began < 20


def test_long_page(spark):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(40_000)) + "</article>"
    got = extracted(spark, [(1, "http://a.example/", long), (2, "http://a.example/x", "<p>" + "word " * 300_000)])
    assert got[1] == "\n".join(f"line {i}" for i in range(40_000)) and got[2] == ("word " * 300_000).strip()


def brute_importances(pages):
    """(path, content) -> said and path -> look of distinct pages of one host, from the trees themselves."""
    styles, texts, held = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for number, page in enumerate(dict.fromkeys(pages)):
        for e in html_extract.elements(html_extract.parse(page)):
            style, content = html_extract.features(e.node)
            styles[e.path][style] += 1
            held[e.path].add(number)
            if content:
                texts[e.path, content].add(number)
    look = {}
    for path, counts in styles.items():
        n = sum(counts.values())
        look[path] = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0
    said = {(p, c): 1 - math.log(len(x)) / math.log(len(held[p])) if len(held[p]) > 1 else 1.0 for (p, c), x in texts.items()}
    return look, said, {p: len(x) for p, x in held.items()}


def test_importances_against_brute_force(spark):
    rng = random.Random(6)
    pages = []
    for i in range(25):
        body = "".join(rng.choice([f"<p>own {i}</p>", "<p>same</p>", "<div><p>x</p></div>", f"<ul><li>{rng.randrange(3)}</ul>"]) for _ in range(rng.randint(1, 6)))
        pages.append(f"<body><div class=top>Site</div><article><h1>{i // 2}</h1>{body}</article><div>{rng.choice('abc')}</div></body>")
    pages += pages[:5]
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "row long, url string, html string")
    look, said, held = brute_importances(pages)
    found = html_extract.style_features(rows)
    paths = {(r.host, r.doc, n.k): (n.path, n.content) for r in found.collect() for n in r.nodes}
    got = html_extract.importances(found).collect()
    assert len(got) == 25
    for r in got:
        for n in r.nodes:
            path, content = paths[r.host, r.doc, n.k]
            path, content = path % (1 << 64), content
            assert n.m == held[path] and abs(n.look - look[path]) < 1e-9
            assert (n.said is None) == (content == 0) and (n.said is None or abs(n.said - said[path, content]) < 1e-9)


def test_style_tree_decides_inside_and_beside_articles(spark):
    page = "<body><div>Site of things</div><main><div>Read our letter</div><p>story {0} of {1}</p><p>{2}</p></main><div>Bye</div></body>"
    rows = [(i, f"http://same.example/{i}", page.format(i, i * 7, "a third of pages say this" if i % 3 == 0 else f"only {i}")) for i in range(120)]
    teaser = "<body><div class=story><p>the whole story {0} with many words in it</p></div><article><a>next {0}</a></article></body>"
    rows += [(1_000 + i, f"http://teaser.example/{i}", teaser.format(i)) for i in range(40)]
    one = "<body><div>By line</div><article><p>alone</p></article></body>"
    got = extracted(spark, [*rows, (5_000, "http://one.example/", one)])
    for i in range(120):
        last = "a third of pages say this" if i % 3 == 0 else f"only {i}"
        assert got[i] == f"story {i} of {i * 7}\n{last}"
    assert got[5_000] == "alone"
    assert got[1_003].startswith("the whole story 3")


def test_pages_shuffled_or_broadcast_give_the_same(spark, monkeypatch):
    frame = "<body><div class='top'>Site of things</div><div class='text'><p>story {}</p></div></body>"
    rows = [(i % 25, f"http://same.example/{i}", frame.format(i)) for i in range(30)] + [(99, None, None)]
    once = extracted(spark, rows)
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert extracted(spark, rows) == once and once[7] == "story 7" and once[99] == ""


# --- decontamination -----------------------------------------------------------


def planted(rng, items, many):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(many):
        ws = rng.choice(items).split()
        if rng.random() < 0.3:
            ws[rng.randrange(len(ws))] = word()
        texts.append(" ".join([word() for _ in range(rng.choice([0, 40, 3_000]))] + ws + [word() for _ in range(rng.choice([0, 500]))]))
    return texts


@pytest.mark.parametrize("miss", [0, 1e-6, 1e-2])
def test_recall_of_signatures(spark, miss):
    rng = random.Random(11)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.choice([12, 30, 60]))) for _ in range(30)]
    texts = planted(rng, items, 300)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs(spark, texts), benchmark, miss=miss).collect()}
    want = brute_contained(texts, items)
    assert got <= want and len(want) > 200
    assert len(got) >= (1 if miss < 1e-3 else 0.95) * len(want)


def test_signature_keeps_the_least_of_each_bin(spark):
    rng = random.Random(5)
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] * 2 for n in (1, 2, 7, 100, 1_000)] + [[]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i long, hashes array<bigint>")
    for extra in (-3, 0, 2, 64):
        for r in df.select("i", decontamination.signature(F.col("hashes"), extra).alias("s")).collect():
            s = sets[r.i]
            bits = max(1, min(64, math.ceil(math.log2(max(1, len(s)))) + extra))
            least = {}
            for h in s:
                b = (h % (1 << 64)) >> (64 - bits)
                least[b] = min(least.get(b, h), h)
            assert sorted(r.s) == sorted(least.values())


def test_thresholds():
    assert decontamination.kept_chance(-60) < 1e-9 or decontamination.kept_chance(-8) < 0.01
    for shared in (1, 4, 9, 26, 400):
        extra = decontamination.extra_bits(shared, 1e-6)
        assert decontamination.tail(shared, decontamination.kept_chance(extra), 1) <= 1e-6 or extra == 64
        hits = decontamination.hits_needed(shared, extra, 1e-6)
        assert 1 <= hits <= shared
    assert decontamination.hits_needed(9, 64, 1e-6) == 9


def test_decontamination_repeats_nulls_and_names(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "x " + item), (1, "other"), (2, "one two three four five six"), (2, "five six seven eight nine ten y"), (2, "four five six seven eight"), (3, None), (None, item), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("_bad", "item_id", "h", "q", "hashes", "hits")})
    items = spark.createDataFrame([(7, item, "t"), (7, item, "t"), (8, None, "t"), (None, item, "t")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(df, items).collect()}
    assert got == {(1, 7, 6, 6), (2, 7, 6, 5)}  # the rows of id 2 hold five of six together
    left = decontamination.decontaminate(df, items)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "None"]


# --- near duplicates -------------------------------------------------------------


def test_two_documents_alone(spark):
    text = "jbfje hifbi badhh dgjhf aifei dejcj iidej aedib ggcdf dhejc jijhg"
    got = ngram_join.ngram_components(docs(spark, [text, text + " hjagb"]), ngram_join.Similarity(4, 85, 100))
    assert {r.component_id for r in got.collect()} == {0}


def linked_pairs(tables, sim):
    """Pairs of small sets that share one of their rarest cells, by the rules of ``rarest``, without Spark."""
    held, cells = defaultdict(set), {}
    for i, tokens in enumerate(tables):
        for which, (keys, limit) in enumerate(ngram_join.cell_keys(tokens, sim)):
            cells[i, which] = (keys.tolist(), limit)
            for key in keys.tolist():
                held[key].add(i)
    kept = defaultdict(set)
    for (i, _), (keys, limit) in cells.items():
        shared = sorted((len(held[k]), k) for k in keys if len(held[k]) > 1)
        for _, key in shared[: max(0, limit - (len(keys) - len(shared)))]:
            kept[key].add(i)
    return {(a, b) for ids in kept.values() for a in ids for b in ids if a < b}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_no_link_is_lost_in_thousands_of_small_tables(n, num):
    import numpy as np

    sim, rng, links = ngram_join.Similarity(n, num, 100), np.random.default_rng(num), 0
    for _ in range(4_000):
        pool = np.unique(rng.integers(0, 1 << 63, rng.integers(4, 24), np.uint64))
        sets = {}
        for _ in range(rng.integers(2, 7)):
            x = rng.choice(pool, max(1, len(pool) - rng.integers(0, 4)), replace=False)
            x = np.unique(np.concatenate((x, rng.integers(0, 1 << 63, rng.integers(0, 3), np.uint64))))
            sets[x.tobytes()] = x
        sets = list(sets.values())
        met = linked_pairs(sets, sim)
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    links += 1
                    assert (a, b) in met, (len(sets[a]), len(sets[b]), both)
    assert links > 2_000


def test_large_family_beside_small_ones(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(40)] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(copy[: rng.choice([40, 40, 34, 12])]))
    texts += ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta eta"] + ODD + texts[:20]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, texts), ngram_join.Similarity(4, 85, 100)).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_near_duplicates_repeats_nulls_and_names(spark):
    a, b = "one two three four five six seven eight nine ten eleven", "Something else entirely that is not like it"
    rows = [(5, a), (5, a), (3, a.upper()), (9, b), (9, b), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("keys", "bits", "id", "rep", "component_id", "n_shingles", "which")})
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect())
    assert got == [(3, 7, 3), (5, 7, 3), (5, 7, 3), (9, 4, 9), (9, 4, 9), (11, 0, 11), (12, 0, 12)]


def test_sketches_fold():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (5, 900, 1_500, 5_000):
        tokens = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        bits = ngram_join.parity_bits(tokens)
        assert len(bits) * 64 >= max(1_024, n)
        small = np.bincount((tokens & np.uint64(1_023)).astype(np.int64), minlength=1_024) & 1
        assert (ngram_join.folded(bits, 16) == np.packbits(small.astype(np.uint8)).view(np.int64)).all()


def test_forest_keeps_components_connected():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(50):
        comp = rng.integers(0, 12, 40) * 100
        left, right = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
        ok = comp[left] != comp[right]
        left, right = left[ok], right[ok]
        kept = ngram_join.forest(left, right, comp, rng.random(len(left)))

        def classes(at):
            root = {c: c for c in comp.tolist()}
            for i in at:
                x, y = root[comp[left[i]]], root[comp[right[i]]]
                root = {k: (x if v == y else v) for k, v in root.items()}
            return {frozenset(k for k in root if root[k] == v) for v in root.values()}

        assert classes(kept) == classes(range(len(left))) and len(kept) <= 11


@pytest.mark.parametrize("block", [8, 1_024])
def test_long_similar_texts_that_are_not_linked(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(1_400)]
    texts = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice([2, 25, 60, 60])):
            copy[rng.randrange(1_400)] = f"v{rng.randrange(10_000)}"
        texts.append(" ".join(copy[: rng.choice([1_400, 1_400, 1_250, 1_000])]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, texts), ngram_join.Similarity(4, 85, 100)).collect()}
    want = brute_components(texts, 4, 85, 100)
    assert got == want and len({c for _, c in want.values()}) > 5
