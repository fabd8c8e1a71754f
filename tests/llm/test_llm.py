"""The corpus operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornbeam.llm import common, decontam, html_extract, langid, licenses, mixing, neardup, quality, queries, token_count, token_io, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"
#: nulls in every column, empty and wordless texts, a very long one, repeated rows, ties, special strings
AWKWARD = [
    (1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, PROSE.upper(), "en", None, None), (3, None, None, "b", 0), (4, "", "en", "b", 0),
    (5, " \n\t ", "fr", None, 3), (None, PROSE, "en", "a", 1), (6, "one two", "en", "é", 7), (7, "one  two", "en", "é", 7), (8, "!!! 123", None, "", 7),
    (9, (PROSE + "\n") * 3000, "en", "a", 9), (10, "x" * 70_000, "fr", "a", 9), (11, "a<|endoftext|> b's é日本 　 x", "fr", "a", 9), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DDL)


@pytest.fixture(scope="module")
def real(spark):
    return common.read(spark, SF, "documents")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


# shingles


def test_shingle_sets_agree_with_words():
    texts = [r[1] for r in AWKWARD] + ["A b\x0bc\x0cd e f", "a b c d e f", "Éa b", "éa b"]
    for x in texts:
        assert len(common.shingle_set(x)) == len(shingles(x))
    assert (common.shingle_set("A b\x0bc d e F") == common.shingle_set("a b c d e f")).all()
    assert not (common.shingle_set("Éa b") == common.shingle_set("éa b")).any()


# 1 decontamination


def brute_contained(docs, items):
    out = set()
    for i, text in items:
        mine = shingles(text)
        for d, t in docs:
            w = words(t)
            k = len(next(iter(mine))) if mine else 0
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            if mine and 100 * len(mine & have) >= 75 * len(mine):
                out.add((d, i, len(mine & have), len(mine)))
    return out


def test_decontamination_is_brute_force(spark, docs):
    items = [(1, PROSE), (2, " ".join(PROSE.split()[3:12])), (3, "two"), (4, "two one"), (5, None), (6, ""), (None, "one two"), (7, PROSE.replace("owls", "cats")), (7, "lazy dog")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {tuple(r) for r in decontam.contaminated(docs, table).select("doc_id", "item_id", "n_shared", "n_item").collect()}
    assert got == brute_contained([(r[0], r[1]) for r in AWKWARD], items)


def test_decontamination_in_blocks_and_empty(spark, docs, real, monkeypatch):
    items = common.read(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontam.contaminated(real, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 3)
    assert whole and sorted(map(tuple, decontam.contaminated(real, items).collect())) == whole
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.clean(real, items).count() == real.count() - len({r[0] for r in whole})


def test_decontamination_of_large_items_and_by_row(spark):
    """Items above the signature's size are found inside a long text; each row is judged by itself, whatever its doc_id."""
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    draw = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    items = [(i, " ".join(draw(int(n)))) for i, n in enumerate(rng.integers(40, 900, 12))]
    docs = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        part = w[: int(len(w) * (0.6 + 0.03 * i))]  # around the threshold
        docs.append((7 if i % 2 else None, " ".join([*draw(3000), *part, *draw(2000)])))
    docs += [(7, "a clean text of seven words only"), (None, "another clean text")]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert {tuple(r) for r in decontam.contaminated(table, bench).select("doc_id", "item_id", "n_shared", "n_item").collect()} == want
    bad = {t for d, t in docs if brute_contained([(d, t)], items)}
    assert 0 < len(bad) < 12 and sorted(r["text"] for r in decontam.clean(table, bench).collect()) == sorted(t for _, t in docs if t not in bad)


# 2 languages


def brute_phrases(sample, text):
    text, n, i = text[:], 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_is_brute_force():
    samples = {"x": "the cat sat on the mat and the rat sat on the cat", "y": "le chat est sur la table et le rat est la"}
    model = langid.Model(samples)
    texts = ["The cat, the RAT!", "le chat est 12 zzz q", "q", "tt e"]
    got = model.phrases([langid.symbols(t) for t in texts])
    for row, x in zip(got, model.langs, strict=True):
        clean = "".join(map(chr, langid.symbols(samples[x])))
        assert [int(v) for v in row] == [brute_phrases(clean, "".join(map(chr, langid.symbols(t)))) for t in texts]


def test_cross_parsing_of_long_texts(monkeypatch):
    """Phrases reach over the edges of blocks, and wide alphabets, which are not dense tables, parse alike."""
    rng = np.random.default_rng(2)
    samples = {x: " ".join("".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(150)) for x, letters in (("x", "abc"), ("y", "bcde"), ("z", [chr(0x4E00 + i) for i in range(300)]))}
    texts = [samples["x"][20:400] + samples["y"][100:500], samples["z"] * 2, "abc" * 70, ""]
    want = [[brute_phrases("".join(map(chr, langid.symbols(samples[x]))), "".join(map(chr, langid.symbols(t)))) for t in texts] for x in samples]
    for block, dense in ((7, 10**9), (64, 0), (10**6, 10**9)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "DENSE", dense)
        assert langid.Model(samples).phrases([langid.symbols(t) for t in texts]).tolist() == want


def test_languages_of_held_out_documents(spark, real):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    found = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_languages_awkward(spark, docs):
    rows = langid.identify(docs.withColumn("score", F.lit("x")), langid.fit(docs)).collect()
    assert len(rows) == len(AWKWARD)
    for r, (doc, text, *_) in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])), sorted(AWKWARD, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert 0 <= r["score"] <= 1
    und = Counter(r["doc_id"] for r in rows if r["lang_pred"] == "und")
    assert {3, 4, 5, 8} <= set(und)
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"} and langid.identify(docs.limit(0), {}).count() == 0


# 3 mixing


def test_mix_targets_and_limits(spark, docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(AWKWARD)
    sizes = [len(WORD.findall(r[1] or "")) for r in AWKWARD]
    assert sorted(r["mix_size"] for r in rows) == sorted(sizes)
    assert sum(r["mix_size"] * len(r["mix_epochs"]) for r in rows) <= sum(sizes)
    assert all(len(r["mix_epochs"]) <= 3 and r["mix_target"] <= 3 * r["mix_source_size"] for r in rows)
    by = {r["mix_source"]: r["mix_target"] for r in rows}
    assert abs(sum(by.values()) - sum(sizes)) < 1e-6 * sum(sizes)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_is_near_its_targets_and_repeatable(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    first = mixing.plan(docs).select("doc_id", "mix_source", "mix_target", "mix_size", (F.col("mix_size") * F.size("mix_epochs")).alias("taken")).collect()
    again = mixing.plan(docs.repartition(7)).select("doc_id", (F.col("mix_size") * F.size("mix_epochs")).alias("taken")).collect()
    assert {r["doc_id"]: r["taken"] for r in first} == {r["doc_id"]: r["taken"] for r in again}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in first:
        taken[r["mix_source"]] += r["taken"]
        target[r["mix_source"]] = r["mix_target"]
        largest[r["mix_source"]] = max(largest[r["mix_source"]], r["mix_size"])
    assert all(abs(taken[s] - target[s]) <= 2 * max(largest.values()) for s in target)
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum("mix_size")).first()[0] == sum(taken.values())
    times = [r[0] for r in mixed.select("mix_finish").collect()]
    assert times == sorted(times)


def test_mix_of_shared_ids_and_clashing_columns(spark):
    """Rows that share a doc_id, or have none, are taken alike in any order of the rows, and columns named like the operator's own stay."""
    rows = [(i % 3 if i % 4 else None, " ".join(["w"] * (i % 7 + 1)) + f" {i}", "en", f"s{i % 3}", i) for i in range(120)]
    docs = spark.createDataFrame(rows, DDL).withColumn("mix_size", F.lit("clash")).withColumn("mix_note", F.col("n_chars"))
    taken = lambda d: sorted(tuple(r) for r in mixing.plan(d).select("mix_row.text", F.size("mix_epochs")).collect())
    assert taken(docs) == taken(docs.repartition(5).orderBy(F.desc("n_chars")))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_finish"]
    assert all(r["mix_size"] == "clash" and r["mix_note"] == r["n_chars"] for r in out.collect())


# 4 near duplicates


def brute_components(rows):
    sets = defaultdict(list)
    for i, text in rows:
        if i is not None:
            sets[i].append(shingles(text))
    ids = list(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_are_brute_force(spark, docs, real):
    for table in (docs, real):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        want = brute_components(rows)
        got = neardup.near_duplicates(table.withColumn("n_shingles", F.lit("clash"))).collect()
        assert len(got) == len(rows)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, len(shingles(t)), want[i]) for i, t in rows if i is not None)
        assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
        assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_differing_texts_under_one_id(spark):
    """Every text of an id counts: 2 is near the first of 5, 9 near the second, 3 equal to the third, 7 has one without words."""
    texts = [" ".join(f"{c}{x}" for x in range(60)) for c in "abcd"]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (2, texts[0] + " x"), (9, texts[1] + " y"), (3, texts[2]), (7, texts[3]), (7, None), (8, texts[3] + " z"), (7, texts[3]), (11, "alone here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, len(shingles(t)), brute_components(rows)[i]) for i, t in rows)
    assert {r["component_id"] for r in got} == {2, 7, 11} and all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def test_near_duplicates_branch_and_chain(spark, monkeypatch):
    """Small nodes force branching; chains of links join documents that are not alike themselves."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"w{g}_{x}" for x in rng.integers(0, 4000, 120)]
        for k in range(25):
            text = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                text[at] = f"v{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(text)))
    monkeypatch.setattr(neardup, "NODE", 4)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table).collect()} == want
    assert 6 <= len(set(want.values())) < len(rows)


def test_near_duplicates_trees_for_the_depth(spark, monkeypatch):
    """Where nodes branch deeper than the first trees reach, further trees find what these miss."""
    assert [neardup.enough(d, 75) for d in (2, 3, 4, 12)] == [15, 21, 27, 118] and neardup.missed(12, 20, 75) > 0.07
    grown = []
    whole = neardup.Join.descend
    monkeypatch.setattr(neardup.Join, "descend", lambda self, some, which: grown.append(which) or whole(self, some, which))
    rng = np.random.default_rng(6)
    common_part = [f"c{x}" for x in range(90)]
    rows = []
    for g in range(4):  # pairs just linked, in a family most of whose shingles are the same
        own = [f"w{g}_{x}" for x in range(45)]
        for k in range(2):
            text = common_part + own
            for at in rng.integers(90, 135, 2):
                text[at] = f"v{g}_{k}_{at}"
            rows.append((len(rows), " ".join(text)))
    monkeypatch.setattr(neardup, "NODE", 2)
    monkeypatch.setattr(neardup, "DEPTH", 4)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table).collect()} == brute_components(rows)
    assert grown == [range(21), range(21, 27)]


def test_forests_of_blocks():
    """A forest has an edge fewer than rows for each group of pairs, by sketches and by full sets, however batches cut the blocks."""
    import pyarrow as pa

    base = [np.array([f"{g}.{x}" for x in range(200)]) for g in range(2)]
    texts = [" ".join(np.concatenate([b[: 200 - k], [f"x{g}.{k}"] * k])) for g, b in enumerate(base) for k in range(4)]
    sets = [common.shingle_set(t) for t in texts]
    rows = pa.RecordBatch.from_pydict({"block": [7] * 8, "uid": list(range(8)), "root": [0, 1, 2, 3, 4, 5, 6, 6], "n": [len(x) for x in sets], "sketch": [neardup.sketch(x) for x in sets], "hashes": [x.view(np.int64) for x in sets]})
    pieces = [rows.slice(0, 3), rows.slice(3, 5), pa.RecordBatch.from_pydict({c: rows.column(c).slice(0, 2) if c != "block" else pa.array([9, 9]) for c in rows.schema.names})]
    for kind in (neardup.Block, neardup.Sets):
        forest = kind(rows, 75).forest(0, 8)
        assert len(forest) == 5 and all(a // 4 == b // 4 for a, b in forest)
        found = [p for b in neardup._compared(75, kind)(iter(pieces)) for p in zip(*b.to_pydict().values(), strict=True)]
        assert len(found) == 6 and found[-1] == (9, 0, 1) and all(a // 4 == b // 4 for _, a, b in found)
    of = lambda a, b: (100 * len(np.intersect1d(a, b)) - 75 * len(np.union1d(a, b))) / 100
    assert neardup.Sets(rows, 75).margin(0, np.array([1, 2, 4])).tolist() == [of(sets[0], sets[1]), of(sets[0], sets[2]), -1]


# 5 main text


def test_main_text_of_pages(spark):
    article = "<h1>T &amp; U</h1><p>One <b>two</b>\n three<br>four<ul><li>a<li>b</ul><script>if(a<b){}</script><div class='share'>no</div><p>last &lt;x&gt;"
    page = lambda n, body: f"<!DOCTYPE html><html><head><title>t{n}</title></head><body><nav><a>m</a></nav><div class=ad>ad</div>{body}<footer>f</footer>"
    rows = [(i, f"http://h.example/{i}", page(i, f"<article>{article} {i}</article>")) for i in range(12)]
    rows += [(20, None, None), (21, "", ""), (22, "x", "<p>only"), (23, "http://o/1", page(1, "<div id=c><p>plain</p><form>no</form></div>")), (20, None, None), (None, "u", "a &nbsp; b")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(table).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i] == f"T & U\nOne two three\nfour\na\nb\nlast <x> {i}" for i in range(12))
    assert (text[20], text[21], text[22], text[23], text[None]) == ("", "", "only", "plain", "a b")
    assert html_extract.extract(table.limit(0)).count() == 0


def test_region_without_semantic_tags(spark):
    page = lambda n: f"<html><body><div class=top>Site name</div><div class=x><p>{'word ' * 60}{n}</p><p>more {n}</p></div><div class=low>Same words below</div></body></html>"
    table = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(10)], "page_id long, url string, html string")
    assert all(r["text"] == f"{'word ' * 60}{r['page_id']}\nmore {r['page_id']}" for r in html_extract.extract(table).collect())


def test_region_decides_against_article_tags(spark):
    text = lambda n: f"<p>{f'word{n} ' * 80}</p><p>more {n}</p>"
    page = lambda n: f"<html><body><div class=x>{text(n)}</div><div class=y><article>teaser {n}</article><article>other {n}</article></div></body></html>"
    inner = lambda n: f"<html><body><div class=x><article><h1>T{n}</h1><div class=z>{text(n)}</div><p>last</p></article></div></body></html>"
    rows = [(i, "http://a.example/", page(i)) for i in range(10)] + [(i, "http://b.example/", inner(i)) for i in range(10, 20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda n: f"{' '.join([f'word{n}'] * 80)}\nmore {n}"
    assert all(got[n] == whole(n) for n in range(10))
    assert all(got[n] == f"T{n}\n{whole(n)}\nlast" for n in range(10, 20))


def test_names_of_boilerplate_are_whole_in_the_main_text():
    body = '<h2 class="section-header">Title</h2><p id="search-history">kept</p><p class="social-studies">lesson</p><math><mi>E</mi></math><div class="section-header">sub</div><p>end</p>'
    junk = '<div class="related-posts">no</div><p class="notice">no</p><section class="comments">no</section><div class="cookie-banner">no</div><ul class="share-buttons"><li>no</ul>'
    page = f'<html><body><div class="site-header">no</div><article>{body}{junk}</article><div class="page-footer">no</div></body></html>'
    assert html_extract.main_text(page) == "Title\nkept\nlesson\nE\nsub\nend"
    assert html_extract.main_text(page.replace("article", "div")) == "Title\nkept\nlesson\nE\nend"


def test_copies_of_a_page_are_no_template(spark):
    page = "<html><body><div class=a><p>one text</p><p>two text</p></div><p>three</p></body></html>"
    rows = [(i, f"http://h.example/{i}", page) for i in range(20)] + [(100 + i, None, page) for i in range(9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 29 and {(r["text"], r["n_chars"]) for r in got} == {("one text\ntwo text\nthree", 23)}


# 6 exact top-k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    v = [[float(x) for x in rng.normal(0, 1, 8)] for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[0]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, v[1]), (0, v[0]), (2005, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    good = [(i, np.floor(1024 * np.array(x))) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        mine = min(tuple(x) for i, x in good if i == q)
        found = sorted((-int(np.dot(mine, x)), i) for i, x in good if i != q and len(x) == len(mine))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    got = topk.top_k(table, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(table.limit(0), F.lit(True)).count() == 0 and topk.top_k(table, F.lit(False)).count() == 0


def test_top_k_of_a_repeated_query_id():
    """Rows with the query's own id crowd nothing out, and all other rows may be theirs."""
    rng = np.random.default_rng(4)
    vectors = np.floor(1024 * rng.normal(0, 1, (300, 64)))
    vectors[:20] = vectors[0]
    ids = np.maximum(np.arange(300) - 19, 0)
    (own, best_ids, best), = topk.search(ids, vectors, np.array([0]), vectors[:1], 10)
    scores = vectors[20:] @ vectors[0]
    want = sorted(zip(-scores, ids[20:], strict=True))[:10]
    assert own == 0 and list(zip(-best, best_ids, strict=True)) == want
    assert not list(topk.search(ids[:20], vectors[:20], np.array([0]), vectors[:1], 10))


# 7 quality


def test_quality_on_held_out_documents(spark):
    docs, labels = (common.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter("held_out").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_quality_awkward(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 0), (9, 1), (None, 1), (6, None), (7, 5), (10, 0), (11, 1)], "doc_id long, quality int")
    clash = docs.withColumn("score", F.lit("clash"))
    for model in (quality.fit(clash, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        rows = quality.score(clash, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_of_a_text_alone():
    """A text is scored alike alone and among others."""
    texts = [(r[1] or "").encode() for r in AWKWARD] + [b"one two three four", b" five six seven eight ", b"a"]
    together, owner = quality.passages(texts)
    assert all(np.array_equal(quality.passages([t])[0], together[owner == i]) for i, t in enumerate(texts))


def test_top_k_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(size=(3000, 48)) * 1024)
    vectors[100:400] = vectors[100]  # a component without a range, ties
    vectors[:, 7] = 5
    file = topk.Approximation(vectors)
    assert file.cells.dtype == np.uint8 and file.cells.nbytes * 8 == vectors.nbytes
    part, lower, upper = file.bounds(vectors[:50])
    scores = vectors[:50] @ vectors.T
    assert (part + lower[:, None] <= scores).all() and (scores <= part + upper[:, None]).all()
    best = np.sort(scores, 1)[:, -10]
    assert ((part + upper[:, None]) >= best[:, None]).mean() < 0.2


@pytest.mark.parametrize("size", [1.0, 1e5, 3e9])
def test_top_k_scores_are_exact_integers(size):
    """Whole numbers that a double cannot hold are summed as they are; what no long holds is its end."""
    rng = np.random.default_rng(4)
    vectors, ids = np.floor(rng.normal(size=(400, 8)) * 1024 * size), np.arange(400)
    whole = [[int(x) for x in v] for v in vectors]
    for own, best_ids, best in topk.search(ids, vectors, ids[:20], vectors[:20], 10):
        want = sorted((-sum(a * b for a, b in zip(whole[own], v, strict=True)), i) for i, v in enumerate(whole) if i != own)[:10]
        assert [(min(-s, 2**63 - 1), i) for s, i in want] == [(int(s), int(i)) for s, i in zip(best, best_ids, strict=True)]


# 8 licenses


def test_licenses_are_found_by_wording(spark, docs):
    text = {"a": "x\nLicensed under CC BY-NC 4.0.\ny", "b": "Licensed under CC BY 4.0.", "c": "licensed under the apache license, version 1.1", "d": "All rights\nreserved. All of it " + "w " * 900 + "Released under the MIT License.", "e": "a licensed driver", "f": licenses.TEMPLATES[5][1].replace("free of charge", "free of any charge")}
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(text.values())], "doc_id long, text string")).withColumn("license", F.lit("clash"))
    got = {(r["doc_id"], r["license"], r["differences"]) for r in licenses.scan(table).collect()}
    assert got == {(100, "CC-BY-NC-4.0", 0), (101, "CC-BY-4.0", 0), (103, "MIT", 0), (105, "MIT", 1)} | {x for x in got if x[1] == "all-rights-reserved" and x[0] == 103}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licenses_are_the_planted_lines(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    lines = {"All rights reserved.": "all-rights-reserved", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {(r[0], name) for r in docs.collect() for line, name in lines.items() if line in (r[1] or "")}
    assert want and {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == want


def test_licenses_by_gain_are_those_of_every_alignment(spark, monkeypatch):
    """The ranking by compression leaves out no template whose wording the block has."""
    texts = [r["text"] for r in common.read(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    got = [scanner.scan(t) for t in texts]
    monkeypatch.setattr(licenses, "LEAST", -1e9)
    assert sum(map(len, got)) > 30 and [sorted(x[0] for x in f) for f in got] == [sorted(x[0] for x in scanner.scan(t)) for t in texts]


def test_licenses_with_a_further_clause():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    of = {name: [t for n, t in licenses.TEMPLATES if n == name][-1] for name in ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause")}
    two = of["BSD-2-Clause"] + ":\n\n1. Redistributions of source code must retain the above copyright notice."
    three = two + "\n\n3. " + of["BSD-3-Clause"].replace("the copyright holder", "Example Inc")
    assert {x[0] for x in scanner.scan(two)} == {"BSD-2-Clause"} and {x[0] for x in scanner.scan(three)} == {"BSD-3-Clause"}
    assert {x[0] for x in scanner.scan(three + "\n\n" + of["BSD-4-Clause"])} == {"BSD-4-Clause"}


def test_licenses_short_notices_in_long_blocks():
    """A notice counts however little it saves of its block, and however many others stand there."""
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), np.random.default_rng(8)
    prose = PROSE.split() + [f"{a}{b}" for a in PROSE.split() for b in ("s", "ing", "less")]
    for _ in range(100):
        line = [str(w) for w in rng.choice(prose, 300)]
        for name, notice in (("all-rights-reserved", "All rights reserved."), ("CC0-1.0", "Licensed under CC0 1.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0.")):
            at = int(rng.integers(0, 300))
            assert [(x[0], x[2]) for x in scanner.scan(" ".join([*line[:at], notice, *line[at:]]))] == [(name, 0)]
    six = [x for x in licenses.TEMPLATES if x[0] in ("all-rights-reserved", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")]
    assert sorted(x[0] for x in scanner.scan(" ".join(t for _, t in six))) == sorted(n for n, _ in six)


# 9 and 10 tokens


def test_token_files_round_trip(spark, docs):
    path, one = common.new_path(spark, "tokens"), tokenizer()
    manifest = token_io.write(docs.withColumn("start", F.lit("clash")), path, queries.tokenizer_path(), 3)
    rows = sorted(token_io.read(spark, path, manifest).collect(), key=lambda r: r["start"])
    texts = sorted(((r[0], r[1] or "") for r in AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter((i, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 0], "<u4").tobytes())) for (i, _), e in zip(texts, one.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert token_io.read_manifest(path) == manifest
    assert token_io.encode_corpus(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_token_ids_of_joined_cuts_are_the_library():
    """Cuts go to the library many at a time: their ids are those of whole texts, whatever stands at their ends."""
    one, encoder, rng = tokenizer(), token_io.Encoder(queries.tokenizer_path()), np.random.default_rng(9)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "Hello", "'s", "1", "23", "é", "日本", "\u3000", "\xa0", "\x85", "\u2003", "\u0301", "\u200b", "\x00", ".", "!!", "--", "_", "<|", "<|endoftext|>", "|>", "x" * 50]
    texts = ["".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(3000)]
    assert {c for c in map(chr, range(0x3001)) if c in token_io._WHITE} == {c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f"}
    ids, lengths = encoder.encode(texts)
    ends = np.cumsum(lengths)
    assert all(ids[e - n : e].tolist() == [*one.encode(x, add_special_tokens=False).ids, 0] for x, n, e in zip(texts, lengths, ends, strict=True))
    short = ["!", " a", "-b", " c!", "--", " d"]
    got, sizes = encoder._encoded(short)
    assert sizes.tolist() == [len(one.encode(x, add_special_tokens=False).ids) for x in short] and got.tolist() == [i for x in short for i in one.encode(x, add_special_tokens=False).ids]


def test_token_counts_are_the_library(spark, docs, real):
    one = tokenizer()
    for table in (docs, real):
        rows = table.select("doc_id", "text").collect()
        want = Counter((r[0], len((r[1] or "").encode()), len(one.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
        got = token_count.count_tokens(table.withColumn("n_tokens", F.lit("clash")), queries.tokenizer_path()).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_count.count_tokens(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_transducer_on_random_texts():
    import random

    rnd, one, machine = random.Random(1), tokenizer(), token_count.Transducer(queries.tokenizer_path())
    parts = ["a", "b", "'", "s", "l", "re", "ve", " ", "  ", "\n", "\t", "é", "日", "1", "23", "<", "|", "<|endoftext|>", "!", "the", "ing", " th", "🙂", "²", "\x1c", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 200))) for _ in range(1500)] + ["日本" * 2000, " " * 3000, "x" * 3000, "'" * 50 + "s", "don't we'll 'S I'd"]
    want = [len(e.ids) for e in one.encode_batch(texts, add_special_tokens=False)]
    assert machine.count([t.encode() for t in texts]).tolist() == want
    encoder = token_io.Encoder(queries.tokenizer_path())
    ids, n = encoder.encode(texts)
    assert (n - 1).tolist() == want and ids[: n[0] - 1].tolist() == one.encode(texts[0], add_special_tokens=False).ids
