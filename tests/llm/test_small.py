"""Each training-data operator on small tables: nulls, blanks, ties, repeated rows, extra columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.llm import arrowtext as A
from tickweave.llm import components, decontamination, exact_dedup, html_extract, language_id, license_scan, line_dedup, ngram_join, packing, quality, sharding
from tickweave.llm.queries import word_tokens
from tickweave.workspace import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long"


def docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i), f"s{i % 3}" if sources is None else sources[i], 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, " \n\t", "a", "A b", "a b c d e", "é ü 日本語 text", "x" * 50_000, "word " * 20_000, "a b c d e"]


# --- exact dedup -------------------------------------------------------------


def brute_dedup(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    out = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = ODD + ["a bcde", "abcde  ", "ab"] + [f"t{i % 7}" for i in range(40)]
    given = {"key_of": lambda n: F.pmod(F.xxhash64(n), F.lit(3)), "digest_of": lambda n: F.when(F.length(n) < 3, F.lit("same")).otherwise(F.sha2(n, 256))} if weak else {}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, texts), **given).collect()}
    want = brute_dedup(texts)
    assert set(got) == set(want)
    assert all(got[i][:3] == want[i][:3] for i in want)
    assert weak or got == want


def test_exact_dedup_empty_and_repeated(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    twice = docs(spark, ["a", "b"]).unionByName(docs(spark, ["a", "b"]))
    got = exact_dedup.exact_dedup(twice).collect()
    assert len(got) == 4 and all(r.kept and r.group_size == 2 for r in got)


def test_directory_splits(spark):
    keys = spark.range(5_000).select(F.xxhash64("id").alias("key"))
    directory = exact_dedup.plan_directory(keys, capacity=60)
    placed = keys.select(exact_dedup.bucket_of(F.col("key"), directory).alias("b")).groupBy("b").count().collect()
    assert directory.depth > 6 and sum(r["count"] for r in placed) == 5_000
    if directory.depth <= 10:
        assert max(r["count"] for r in placed) <= 60
    assert sorted(set(directory.cells())) == list(range(len(directory.buckets)))
    same = spark.range(500).select(F.lit(5).cast("long").alias("key"))
    assert exact_dedup.plan_directory(same, capacity=60, max_bits=12).depth == 12


# --- html ---------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="nav-open"><nav><a>Menu</a></nav>
<div id="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>One<br>two <b>bold<p>Three &#233;&nbsp;x
<div class="share">Share!</div><aside>Side</aside><section class="comments"><p>Nice</p></section><ul><li>i<li>j</ul></article>
<form>Search</form><footer>&copy; me</footer>"""


def test_html(spark):
    rows = [(1, "http://h.example/a", PAGE, 3), (2, None, None, 3), (3, "x", "", 3), (4, "http://h.example/b", "plain <b>text</b> &lt;p&gt;", 3), (1, "http://h.example/a", PAGE, 3), (5, "http://h.example/c", "<p>" * 3000 + "deep", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row long")
    got = html_extract.extract(df).collect()
    assert len(got) == 6
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Head & more\nOne two bold\nThree é x\ni\nj"
    assert text[2] == text[3] == "" and text[4] == "plain text <p>" and text[5] == "deep"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_style_tree_drops_what_all_pages_repeat(spark):
    frame = "<body><div class='top'><div>Site of things</div></div><div class='text'><p>{}</p></div><div class='end'><div>Bye from all of us</div></div></body>"
    rows = [(i, f"http://same.example/{i}", frame.format(f"story number {i} tells {i * 7} things")) for i in range(30)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story number {i} tells {i * 7} things" for i in range(30))


def test_copies_of_a_page_count_once(spark):
    page = "<head><link rel=canonical href='/{}'></head><body>{}</body>"
    story = "".join(f"<p>part {k} of the copied story</p>" for k in range(3))
    rows = [(i, f"http://all.example/{i}", page.format(i, "<div>the only story</div>")) for i in range(3)]
    rows += [(10 + i, f"http://most.example/{i}", page.format(i, story if i < 90 else f"<p>own {i}</p><p>text {i}</p>")) for i in range(100)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(3)} == {"the only story"}
    assert {got[10 + i] for i in range(90)} == {"\n".join(f"part {k} of the copied story" for k in range(3))}
    assert got[105] == "own 95\ntext 95"


# --- classifier and language ----------------------------------------------------


def labelled(spark, n=160):
    rng = random.Random(1)
    words = ["tree", "house", "river", "stone", "cloud", "green", "walks", "under", "light", "small"]
    texts, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(40)]
        texts.append(" ".join(w.upper() + "!!" for w in ws) if i % 4 == 0 else " ".join(ws).capitalize() + ".")
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    df, labels = labelled(spark)
    model = quality.train(df, labels)
    got = quality.score(df.unionByName(docs(spark, ODD).withColumn("doc_id", F.col("doc_id") + 1000)), model).collect()
    assert len(got) == 160 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in got if r.doc_id < 160)
    held = df.where(quality.held_out_quality()).select("doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and held
    assert quality.keep_good(df, model).columns == df.columns and quality.keep_good(df, model).count() == 120
    assert {r.score for r in quality.score(df, quality.train(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)).astype(np.uint32) for _ in range(60)]
    values, signs = [rng.standard_normal(8) for _ in rows], rng.choice([-1.0, 1.0], 60)
    w, b = quality.dual_coordinate_descent(rows, values, signs, cost=np.full(60, 0.5), passes=400)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + 0.5 * sum(max(0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, signs))

    best = loss(w, b)
    assert all(loss(w + 1e-2 * rng.standard_normal(len(w)) * (np.arange(len(w)) < 50), b) >= best - 1e-6 for _ in range(50))


def test_language(spark):
    rng = random.Random(2)
    stems = {"aa": ["thing", "the", "with", "and", "where"], "bb": ["über", "nicht", "schön", "der", "straße"], "cc": ["señor", "ción", "los", "qué", "niño"]}
    langs = {i: sorted(stems)[i % 3] for i in range(120)}
    texts = [" ".join(rng.choice(stems[langs[i]]) for _ in range(30)) for i in range(120)]
    df = docs(spark, texts, langs)
    net = language_id.train(df)
    more = docs(spark, ODD + ["123 456 !!", "the thing with the thing"]).withColumn("doc_id", F.col("doc_id") + 1000)
    got = {r.doc_id: r for r in language_id.identify(df.unionByName(more), net).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in range(120)) >= 118
    assert [got[1000 + i].lang_pred for i in (0, 1, 2, len(ODD))] == ["und"] * 4
    assert got[1000 + len(ODD) + 1].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.train(docs(spark, texts)) is None
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}


def test_windows_cover_the_whole_text():
    data = np.frombuffer(b"abc" * 1000, np.uint8)
    assert b"".join(w[: language_id.WINDOW].tobytes() for w in language_id.cut(data))[:3000] == b"abc" * 1000


# --- packing ------------------------------------------------------------------


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    texts = ODD + ["<|endoftext|> it's", "a b", "a b", "ſtrange İ", "x\x1cy"]
    tokens = word_tokens()
    df = docs(spark, texts)
    rows = packing.pack(df, tokens, 64).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.path)
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        for k, r in enumerate(mine):
            part = np.asarray(ids[64 * k : 64 * k + 64], "<u4").tobytes()
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 64 * k, len(part) // 4, zlib.crc32(part))
    n = check_packing(rows, 64)
    total = sum(r.length for r in rows)
    assert n <= total / 64 * 1.05 + 1
    assert packing.pack(df.limit(0), tokens, 64).count() == 0
    assert packing.pack(df.unionByName(df), tokens, 64).count() == 2 * len(rows)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_vocabulary(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encoder, whole, rng = packing.ChunkTokenizer(path, entries=50), Tokenizer.from_file(path), random.Random(4)
    assert encoder.by_chunk == name.startswith("word")
    parts = ["word", "Word,", "it's", "they'll!", "x1y22", "--", "...", "(a)", "é", "e\u0301", "İ", "ſt", "\u200b", "a\x1cb", "\x85", "日本", "|", "ab.cd", "'", "''s", "don't.", "…", "’s", "<|endoftext|>", "Ünï", "ß?", "\u00a0", "10.5%"]
    texts = [None, "", " ", "\t\n"] + ["".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    column = pa.array(texts, pa.string())
    for rows in (slice(0, 300), slice(300, None)):
        ids, offsets = encoder.encode(column[rows], 1)
        for k, text in enumerate(texts[rows]):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1], text


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 12), 100, 7]) for _ in range(400))
    runs, opened = packing.plan_best_fit(dict(counts), 100)
    bins, seen = defaultdict(list), Counter()
    for length, lo, hi, first, per, base in runs:
        assert lo == seen[length]
        seen[length] = hi
        for r in range(lo, hi):
            bins[first + (r - lo) // per].append((base + (r - lo) % per * length, length))
    assert seen == counts and len(bins) == opened
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100
    free = []  # best fit, one piece at a time
    for length in sorted(counts.elements(), reverse=True):
        fits = [x for x in free if x >= length]
        left = min(fits) if fits else 100
        if fits:
            free.remove(left)
        free.append(left - length)
    assert opened == len(free)


# --- licences, lines, benchmark -------------------------------------------------


def test_licenses(spark):
    mit = dict(license_scan.KNOWN[::-1])["0BSD"]
    texts = ["Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ,"), "text\nReleased under the MIT Licence\nmore", None, "", "Released under the mit license!", "no"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got[0].license_id == "0BSD"
    assert (got[1].license_id, got[1].n_notices, got[1].notices) == (None, 1, "MIT")
    assert got[4].license_id == "MIT" and got[2].license_id is None and got[3].n_notices == 0 and got[5].notices == ""
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_usual_licence_files(spark):
    known = license_scan
    bsd = known._BSD_HEAD.replace("1. ", "* ").replace("2. ", "* ")
    notice = "Copyright (c) 2024, Some One\n"
    files = [("MIT", f"MIT License\n\n{notice}\n{known._MIT}\n"), ("MIT", f"The MIT License (MIT)\n{notice}{known._MIT}")]
    files += [("BSD-2-Clause", f'BSD 2-Clause "Simplified" License\n\n{notice}All rights reserved.\n\n{bsd}\n\n{known._BSD_TAIL}')]
    files += [("ISC", f"ISC License\n\n{notice}\n{known._ISC}"), ("Zlib", f"zlib License\n\n(C) 2024 Some One\n\n{known._ZLIB}")]
    files += [(name, text) for name, text in known.full_texts()]
    files += [(None, "MIT License"), (None, f"MIT License\n{known._MIT}\nand more"), (None, notice)]
    got = {r.doc_id: r.license_id for r in known.scan_licenses(docs(spark, [t for _, t in files])).collect()}
    assert [got[i] for i in range(len(files))] == [name for name, _ in files]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {n for n, _ in files}


def test_lines(spark):
    common, rare = "a line that stands on every site", "a line that stands on three sites"
    texts = [f"own text number {i} of this page\n{common}\n{rare if i < 3 else 'short'}\n" for i in range(14)] + [None, ""]
    sources = [f"s{i}" for i in range(14)] + ["s0", None]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(docs(spark, texts, sources=sources)).collect()}
    assert got[0].text == f"own text number 0 of this page\n{rare}\n" and (got[0].n_lines, got[0].n_removed) == (4, 1)
    assert got[9].text == "own text number 9 of this page\nshort\n"
    assert (got[14].n_lines, got[14].text, got[15].n_lines) == (0, "", 1)
    assert line_dedup.drop_common_lines(docs(spark, [])).count() == 0


def test_line_threshold_is_exact(spark):
    texts, sources = [], []
    for n in range(7, 14):
        for s in range(n):
            texts.append(f"this line is on exactly {n} of the sites")
            sources.append(f"site{s}")
    got = line_dedup.drop_common_lines(docs(spark, texts, sources=sources)).collect()
    assert all(r.n_removed == (int(texts[r.doc_id].split()[5]) >= 10) for r in got)


def brute_contained(texts, items, n=5, least=0.8):
    def sh(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for d, t in enumerate(texts):
        for b, q in enumerate(items):
            q = sh(q)
            if q and len(q & sh(t)) >= least * len(q):
                out.add((d, b))
    return out


def test_contained_items(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(rng.choice([3, 5, 12, 30, 60]))) for _ in range(40)]
    texts = list(ODD)
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.choice([5, 400])))]
        for _ in range(rng.choice([0, 1, 1, 3, 15])):
            ws = rng.choice(items).split()
            if rng.random() < 0.4:
                ws[rng.randrange(len(ws))] = word()
            parts.append(" ".join(ws).upper() + "!")
        texts.append(", ".join(parts))
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "")], "item_id long, text string")
    df = docs(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(df, benchmark).collect()}
    want = brute_contained(texts, items)
    assert got == want and len(want) > 30
    left = decontamination.decontaminate(df, benchmark)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contained_items(df.limit(0), benchmark).count() == 0
    assert decontamination.contained_items(df, benchmark.limit(0)).count() == 0


# --- sharding -----------------------------------------------------------------


def test_sharding(spark):
    texts = [("w" * (i * 37 % 900)) or None for i in range(3_000)]
    got = sharding.shard(docs(spark, texts), 24).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 3_000 and set(size) == set(range(24))
    assert max(size.values()) <= 1.02 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(spark, []), 24).count() == 0


def test_sharding_hot_key(spark):
    df = docs(spark, ["text"] * 3_000).withColumn("doc_id", F.when(F.col("doc_id") < 1_000, F.lit(5)).otherwise(F.col("doc_id")))
    size = Counter(r.shard for r in sharding.shard(df, 24).collect())
    assert sum(size.values()) == 3_000 and max(size.values()) < 2 * min(size.values())


def test_slot_map_is_edited():
    weight = {s: 1 + s % 5 for s in range(4_000)}
    one = sharding.SlotMap.balanced(weight, 24)
    two = one.rebalanced(weight, 25)
    assert two.version == 2 and len(two.moved) < 4_000 / 15 and set(two.owner) == set(weight)
    load = Counter()
    for s, k in two.owner.items():
        load[k] += weight[s]
    assert len(load) == 25 and max(load.values()) < 1.05 * min(load.values())


# --- near duplicates -------------------------------------------------------------


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and den * both >= num * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("n,num,block", [(4, 85, 1024), (5, 80, 16)])
def test_near_duplicates(spark, monkeypatch, n, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 7, 9, 16, 31, 33, 60, 130, 260]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 7])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[word()], [], [copy[at], word()]])
                copy = copy or [word()]
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    texts += [t.upper() if t else t for t in texts[20:30]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, texts), ngram_join.Similarity(n, num, 100)).collect()}
    assert got == brute_components(texts, n, num, 100)


def test_kept_empty_cells_do_not_crowd_out_a_link(spark):
    # x keeps its empty cells (more than may be left out), y does not: x has as many keys that y lacks as its rarest once were.
    sim, spare = ngram_join.Similarity(5, 80, 100), 3
    for seed in range(10_000):
        rng = random.Random(seed)
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(13)]
        texts = [" ".join(words[:12]), " ".join(words)]
        x, y = (A.shingle_set(A.hash_words(*A.text_buffers(pa.array([t])))[0], 5) for t in texts)
        (kx, _), (ky, _) = ngram_join.cell_keys(x, sim)[0], ngram_join.cell_keys(y, sim)[0]
        if len(kx) == 3 + 1 + spare and len(ky) < len(kx) and len(np.intersect1d(kx, ky)) == 3:
            break
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, texts), sim).collect()}
    assert got == brute_components(texts, 5, 80, 100) == {0: (8, 0), 1: (9, 0)}


@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_meet_in_their_rarest_cells(num):
    sim, rng, seen = ngram_join.Similarity(num=num), np.random.default_rng(1), 0
    for _ in range(8_000):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(4, 120), np.uint64))
        y = np.unique(np.concatenate((x, rng.integers(0, 1 << 63, rng.integers(1, len(x) // 5 + 2), np.uint64))))
        if 100 * len(x) < num * len(y):
            continue
        seen += 1
        met = False
        for kx, lx in ngram_join.cell_keys(x, sim):
            for ky, ly in ngram_join.cell_keys(y, sim):
                shared = sorted(set(kx.tolist()) & set(ky.tolist()))  # all other cells are one document's
                first = min(lx - len(kx), ly - len(ky)) + len(shared)
                met |= first > 0 and bool(shared)
        assert met
    assert seen > 4_000


def test_near_duplicates_empty(spark):
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0
    assert {r.component_id for r in ngram_join.ngram_components(docs(spark, [None, "", " "])).collect()} == {0, 1, 2}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)]
    found = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(found.get(v, v) == find(v) for v in root)


def test_rounds_of_few_edges_write_few_files(spark, monkeypatch):
    files = []

    def counted(df, name, **given):
        table = materialise(df, name, **given)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "materialise", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = {r.id: r.component_id for r in components.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 for i in range(1, 401)}
    assert len(files) > 2 and max(files[1:]) <= 2 * spark.sparkContext.defaultParallelism < files[0]


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(5_000))
    data, offsets = A.text_buffers(pa.array([text, None, text]))
    whole, at = A.hash_words(data, offsets)
    monkeypatch.setattr(A, "SLICE_BYTES", 500)
    monkeypatch.setattr(A, "_powers", {})
    parts, at2 = A.hash_words(data, offsets)
    assert (whole == parts).all() and (at == at2).all() and at[1] == 5_000
