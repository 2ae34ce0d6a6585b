"""The corpus operators against brute force, round trips and awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import html_text, language, mixing, near_copies, pieces, pitman_yor, quality, sharding, token_files, weighted_prints
from corrobora.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba de fi go lu ma ne pi ro su ta vi".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int, size int, shard string"


def prose(rng, n, syllables=SYLLABLES):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward():
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids, clashing names."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(5, 90)), "en" if i % 2 else "de", f"s{i % 3}", 0, i, 1, "x") for i in range(1, 30)]
    rows += [rows[3], rows[3], (30, rows[5][1], "en", None, None, None, None, None), (31, None, "en", "s1", 0, 0, 0, "x")]
    rows += [(None, "no id here at all", None, "s2", 0, 0, 0, "x"), (None, None, None, None, None, None, None, None), (32, "", "de", "s0", 0, 0, 0, "")]
    rows += [(33, " \t\n ", "de", "s0", 0, 0, 0, ""), (34, prose(rng, 9000), "en", "s0", 0, 0, 0, ""), (35, "ü" * 3000, "de", "s1", 0, 0, 0, "")]
    rows += [(36, "🙂 ▁ ## 12 <|endoftext|> x", "en", "s1", 0, 0, 0, ""), (36, "equal id, other text", "en", "s1", 0, 0, 0, "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


# ---- sharding

def test_sharding(docs, empty, spark, tmp_path):
    rows, slot_map = sharding.shard_documents(docs, 4, 64)
    out = rows.collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in awkward())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({(r.virtual_slot, r.shard) for r in out}) == len({r.virtual_slot for r in out})
    versions = {(r.version, r.virtual_slot): r.shard for r in slot_map.collect()}
    assert len(versions) == 128
    assert sharding.shard_documents(empty, 4, 64)[0].count() == 0
    sharding.write_shards(docs.drop("shard"), slot_map, str(tmp_path / "shards"), 64)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_rows_without_ids_are_spread(spark):
    """Half of the rows have no id: their texts decide, and the shards stay near equal."""
    rows = [(None if i % 2 else i, f"text {i} " * 20, None, None, 0, 0, 0, None) for i in range(4000)]
    out, _ = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA))
    sizes = sorted(r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect())
    assert len(sizes) == 24 and sizes[-1] < 1.25 * sizes[0]
    none = out.filter("doc_id IS NULL").groupBy("virtual_slot").count().agg(F.max("count")).first()[0]
    assert none < 20


def test_shards_are_near_equal_and_edits_are_few(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 400), None, None, 0, 0, 0, None) for i in range(3000)]
    out, slot_map = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 8, 256)
    loads = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 8
    shard = {(r.version, r.virtual_slot): r.shard for r in slot_map.collect()}
    assert sum(shard[1, k] != shard[2, k] for k in range(256)) < 0.4 * 256


# ---- mixing

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        level = left / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        more = {s for s in names if s not in full and level * weight[s] > cap * sizes[s] + 1e-9}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(awkward())
    sizes = collections.Counter()
    for r in awkward():
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))
    assert mixing.mix(empty).count() == 0


def test_inclusion_follows_the_expected_copies(spark):
    rows = [(i, "a b c d", None, "s", 0, i % 2, 0, None) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, share=0.5, affinity=F.when(F.col("extra") == 1, 1.5).otherwise(0.5)).collect()
    assert sum(r.taken for r in out) == 8000
    odd = sum(r.taken > 0 for r in out if r.doc_id % 2)
    assert abs(odd / 2000 - 0.75) < 0.04


# ---- fingerprints

def test_fingerprints(docs, empty):
    out = weighted_prints.fingerprints(docs).collect()
    assert len(out) == len(awkward())
    distinct = {(r[0], r[1] or "") for r in awkward()}
    by_id = collections.defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    ids = sorted((i for i, _ in distinct if i is not None and i != 36), reverse=True)
    text = {i: t for i, t in distinct}
    for a, b in zip(ids, ids[1:]):
        if b != 36:
            k = len(text[a]) // 3
            edited = text[a][: len(text[a]) - k] + text[b][:k]
            assert by_id[a][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by_id[a][0].n_chars == len(text[a])
    assert by_id[6][0].fingerprint == by_id[30][0].fingerprint and by_id[32][0].fingerprint == by_id[31][0].fingerprint
    assert weighted_prints.fingerprints(empty).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(3)
    a = collections.Counter({f"w{i}": rng.randint(1, 9) for i in range(60)})
    b = collections.Counter({f"w{i}": rng.randint(1, 9) for i in range(20, 80)})
    truth = sum(min(a[w], b[w]) for w in a) / sum(max(a[w], b[w]) for w in a | b)
    n = 400
    rows = [(0, w, a[w] or None, b[w] or None) for w in a | b]
    weights = spark.createDataFrame(rows, "k int, w string, a int, b int").withColumn("term", F.xxhash64("w"))
    rows = weighted_prints.samples(weights, ["k"], ["a", "b"], n).collect()
    assert len(rows) == n // weighted_prints.BLOCK
    found = sum((r[f"a_{i}"] & 0xFFFFFFFF) == (r[f"b_{i}"] & 0xFFFFFFFF) for r in rows for i in range(weighted_prints.BLOCK))
    assert abs(found / n - truth) < 4 * math.sqrt(truth * (1 - truth) / n)


# ---- near copies

def naive_similarity(a, b):
    def seq(text):
        w = words(text)
        k = min(5, len(w))
        seen = collections.Counter()
        out = []
        for i in range(len(w) - k + 1 if w else 0):
            s = tuple(w[i : i + k])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    x, y = seq(a), seq(b)
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    c = table[-1][-1]
    return c / (len(x) + len(y) - c) if c else 0.0


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(5)
    hashes = near_copies.WordHashes()
    for _ in range(60):
        a = prose(rng, rng.randint(1, 60)).split()
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice(SYLLABLES)
        if rng.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        want = naive_similarity(" ".join(a), " ".join(b))
        got = near_copies.similarity(near_copies.shingles(hashes(a)), near_copies.shingles(hashes(b)))
        assert got == pytest.approx(want if want >= 0.8 else 0.0)


def test_no_near_text_is_ruled_out_by_its_smallest_hashes():
    rng = random.Random(13)
    hashes = near_copies.WordHashes()
    low = lambda seq: (np.sort(seq)[: near_copies.LOWEST] >> np.uint64(32)).astype("<u4").tobytes()
    out = 0
    for _ in range(150):
        a = prose(rng, rng.randint(1, 900)).split()
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 45))):
            b[rng.randrange(len(b))] = "changed"
        x, y = near_copies.shingles(hashes(a)), near_copies.shingles(hashes(b))
        z = near_copies.shingles(hashes(prose(rng, 300).split()))
        out += near_copies.similarity(x, y) > 0 and not near_copies.likely(low(x), low(y))
        assert not near_copies.likely(low(x), low(z)) or len(a) < 20
    assert out == 0


def test_near_copies(spark, docs, empty):
    rng = random.Random(11)
    rows, label = [], {}
    for g in range(12):
        base = prose(rng, 150).split()
        for c in range(8):
            text = list(base)
            if c % 4:
                text[rng.randrange(20, 130)] = f"changed{c}"
            label[len(rows)] = g
            rows.append((len(rows), " ".join(text), None, None, 0, 0, 0, None))
    for i in range(30):
        rows.append((len(rows), prose(rng, 150), None, None, 0, 0, 0, None))
    out = {r.doc_id: r for r in near_copies.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(out) == len(rows)
    for i, g in label.items():
        assert out[i].class_id == 8 * g
    assert all(out[i].class_id == i for i in range(96, len(rows)))
    assert out[0].n_equal == 2 and out[0].n_links >= 1
    odd = near_copies.near_copies(docs).collect()
    assert len(odd) == len(awkward())
    at = {r.doc_id: r for r in odd}
    assert at[30].class_id == 6 and at[31].class_id == 31 and at[32].class_id == 32 and at[33].class_id == 33
    assert near_copies.near_copies(empty).count() == 0


def test_a_large_group_of_near_copies_is_not_expanded(spark):
    rng = random.Random(2)
    base = prose(rng, 120).split()
    rows = []
    for i in range(250):
        text = list(base)
        text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text), None, None, 0, 0, 0, None))
    df = spark.createDataFrame(rows, SCHEMA)
    made = near_copies.sketches(df)
    first = [F.first(c).alias(c) for c in ("n", "keys", "mins", "low")]
    nodes = made.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *first)
    edges = near_copies.links(df, nodes.cache())
    assert edges.count() < 250 * 20
    assert near_copies.components(edges).select("root").distinct().count() == 1


def test_texts_with_a_common_passage_meet_few_others(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 150)
    texts = [f"{base} {prose(rng, 30)}" for i in range(240)]
    # near copies that have the passage too
    copies = {200 + i: i for i in range(20)}
    for i, of in copies.items():
        words = texts[of].split()
        words[160 + of % 9] = f"n{i}"
        texts[i] = " ".join(words)
    met = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame([(i, t, None, None, 0, 0, 0, None) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r.class_id for r in near_copies.near_copies(df).collect()}
    assert sum(met) < 8000
    seqs = [near_copies.shingles(near_copies.WordHashes()(t.split())) for t in texts]
    near = {(a, b) for a in range(240) for b in range(a + 1, 240) if near_copies.similarity(seqs[a], seqs[b])}
    assert {(of, i) for i, of in copies.items()} <= near
    assert all(out[a] == out[b] for a, b in near)
    # by rare shingles alone, without leaders: no similar pair is lost
    nodes = spark.createDataFrame([(f"{i:03}", t, f"{i:03}") for i, t in enumerate(texts)], "node string, text string, root string")
    pairs = {(int(r.a), int(r.b)) for r in near_copies.rare_pairs(nodes.select("node", "root"), nodes.select("node", "text")).collect()}
    assert near <= pairs and len(pairs) < 240


# ---- language

def test_language(spark, docs, empty):
    rng = random.Random(9)
    kinds = {"aa": "ka ko ki ku".split(), "bb": "zu zo zi ze".split(), "cc": "my ny py ry".split()}
    rows = [(i, prose(rng, 40, kinds[k]), k, None, 0, 0, 0, None) for i in range(90) for k in [list(kinds)[i % 3]]]
    df = spark.createDataFrame(rows, SCHEMA)
    tables = language.learn(df.filter("doc_id < 60"))
    out = {r.doc_id: r for r in language.identify(df, tables).collect()}
    assert all(out[r[0]].lang_pred == r[2] for r in rows)
    # unseen words fall back to n-grams
    assert language.guess(tables, "zuzozizezuzo", {})[0] == "bb"
    assert language.guess(tables, "12 ;; --", {}) == ("und", 0.0) and language.guess(tables, None, {}) == ("und", 0.0)
    assert 0 <= min(r.score for r in out.values()) and max(r.score for r in out.values()) <= 1
    assert language.identify(docs, tables).count() == len(awkward())
    assert language.learn(empty) is None and language.identify(empty, None).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_words_of_any_length_are_learned(spark):
    rows = [(i, f"{'ab' * 23} {'c' * 41} zo", "aa", None, 0, 0, 0, None) for i in range(20)]
    rows += [(100 + i, f"{'xy' * 4000} zo", "bb", None, 0, 0, 0, None) for i in range(20)]
    tables = language.learn(spark.createDataFrame(rows, SCHEMA))
    assert set(tables.words) == {"ab" * 23, "c" * 41, "xy" * 4000, "zo"}
    assert language.guess(tables, "c" * 41, {})[0] == "aa" and language.guess(tables, "yxyx", {})[0] == "bb"


def test_grams_of_distinct_words_count_every_word(spark):
    """The tables against counts over all words of all texts."""
    rng = random.Random(11)
    rows = [(i, prose(rng, 30, "ka ko Ki kuka".split()), "aa", None, 0, 0, 0, None) for i in range(40)]
    tables = language.learn(spark.createDataFrame(rows, SCHEMA))
    counts = [collections.Counter() for _ in range(5)]
    for r in rows:
        for w in re.findall(r"[^\W\d_]+", r[1].lower()):
            counts[0][w] += 1
            for n in range(1, 5):
                counts[n].update(language._grams(f" {w} " if n > 1 else w, n))
    for kind, own in enumerate(counts):
        total, kinds = sum(own.values()), len(own)
        for term, n in own.items():
            log = tables.word_logs[tables.words[term], 0] if kind == 0 else tables.gram_logs[tables.grams[term], 0]
            assert log == pytest.approx(math.log((n + 0.5) / (total + 0.5 * kinds)))


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30, "ka ko ki ku".split()), "aa", None, 0, 0, 0, None) for i in range(600)]
    rows += [(600 + i, prose(rng, 30, "zu zo zi ze".split()), "bb", None, 0, 0, 0, None) for i in range(2)]
    rows += [(1000 + i, f"{chr(0x4E00 + i)} " * 9, f"l{i}", None, 0, 0, 0, None) for i in range(210)]
    df = spark.createDataFrame(rows, SCHEMA)
    tables = language.learn(df, sample=20)
    assert set(tables.langs) == {r[2] for r in rows}
    assert language.guess(tables, "zuzo zizezuzo", {})[0] == "bb"
    # the prior is that of all documents, not of the equal samples
    prior = dict(zip(tables.langs, np.exp(tables.prior)))
    assert sum(prior.values()) == pytest.approx(1) and prior["aa"] == pytest.approx(600 * 30 / (602 * 30 + 210 * 9), rel=1e-6)


# ---- quality

def brute_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


def test_quality_counts_match_brute_force():
    rng = random.Random(4)
    texts = [r[1] for r in awkward()] + ["a b c a b c\na b c\na b c\n\n", "x", "x y", "x y z", "## <b> 5% |"]
    texts += [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(20)]
    for t in texts:
        assert quality.statistics(t)[0] == brute_counts(t)


def test_quality_model(spark, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = (x[:, 0] + 0.3 * np.sin(6 * x[:, 1]) + rng.normal(scale=0.1, size=3000)) < 0.6
    trees = quality.fit(x, y, {0}, rounds=30)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(rng.random((50, 1, 4)), 40, axis=1)
    grid[:, :, 0] = np.linspace(0, 1, 40)
    scores = trees.score(grid.reshape(-1, 4)).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-12).all()
    # a tree walked node by node gives the same as the arrays
    row = x[7]
    total = trees.start
    for k in trees.roots:
        while trees.left[k] != k:
            k = trees.left[k] if row[trees.feature[k]] <= trees.cut[k] else trees.right[k]
        total += trees.value[k]
    assert trees.raw(x[7:8])[0] == pytest.approx(total)
    r = random.Random(8)
    good = [(i, "\n".join(prose(r, 30) for _ in range(4)), "", "", 0, 0, 0, "") for i in range(40)]
    bad = [(40 + i, "\n".join(prose(r, 30).replace(" ", " ## ") for _ in range(4)), "", "", 0, 0, 0, "") for i in range(40)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 80, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    out = {v.doc_id: v.kept for v in quality.judge(df, quality.train(df, labels)).collect()}
    assert sum(out[i] == (i < 40) for i in out) >= 78
    odd = quality.judge(docs, None).collect()
    assert len(odd) == len(awkward()) and all(not v.kept for v in odd if v.n_words < 50)
    assert quality.train(empty, labels) is None and quality.judge(empty, None).count() == 0


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div><div id="cookie-notice">we use cookies</div>
<article><h1>A &amp; B</h1><p>First   para<b>graph</b> of the
article, which has enough words to be taken for content by any measure.<p>Second &eacute;&#8364; one, not closed
<ul><li>short</li></ul><aside>side</aside><form><input name=q>search</form><p>Last.</p></article>
<section class="comments"><p>reader says a rather long thing about the article that was not asked for</p></section>
<footer>&copy; x</footer>"""


def test_main_text():
    want = "A & B\nFirst paragraph of the article, which has enough words to be taken for content by any measure.\nSecond é€ one, not closed\nshort\nLast."
    assert html_text.main_text(PAGE) == want
    plain = "<html><body><div class='nav'><a href=x>one</a><a href=y>two</a></div><div><p>" + "</p><p>".join(["word " * 30] * 3) + "</p></div><div class=footer>f</div></body></html>"
    assert html_text.main_text(plain) == "\n".join([("word " * 30).strip()] * 3)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text") == "just text" and html_text.main_text("<p>a<p>b") == "a\nb"
    html_text.main_text("<![foo<!--" + "<div>" * 3000 + "x")


@pytest.mark.parametrize("odd", ["<![x]>", "<![ if IE]>", "<![>", "<![endif]>", "<![if !IE]>", "<![CDATA[x]]>", "<![x<!--y>", "<![1]>"])
def test_text_after_an_odd_declaration_is_kept(odd):
    first, last = "first words of it " * 9, "last words of it " * 9
    assert html_text.main_text(f"<article><p>{first}</p>{odd}<p>{last}</p></article>") == f"{first.strip()}\n{last.strip()}"
    assert last.strip() in html_text.main_text(f"<p>{first}</p><![x {last}")


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize("inner", ["div class=body", "section", "blockquote"])
def test_blocks_around_a_nested_body_are_kept(outer, inner):
    body = [("word " * n).strip() for n in (60, 50, 70, 55)]
    nested = "".join(f"<p>{x}</p>" for x in body)
    page = f"<body><nav><a href=x>menu</a></nav><div><a href=y>odd</a><a href=z>links</a></div><{outer}><h1>Title</h1><p>by me</p><p>The lead.</p><{inner}>{nested}</{inner.split()[0]}><p>The end.</p><p>Last.</p></{outer}></body>"
    assert html_text.main_text(page) == "\n".join(["Title", "by me", "The lead.", *body, "The end.", "Last."])


def test_marks_in_an_article():
    """Names that only contain a marking word drop nothing of an article; names made of such words do."""
    long, more = ("word " * 50).strip(), ("other " * 40).strip()
    page = f"""<body><nav><a href=x>m</a></nav><article><div class="entry-header"><h1>Title</h1></div><p>{long}</p>
    <div class="side-by-side">Both sides</div><h2 id="social-policy">Social policy</h2><p id="reviews-of-literature">{more}</p>
    <div class="ad-box">Buy now</div><div class="commentList"><p>{long}</p></div><div class="post-footer">tags</div></article></body>"""
    assert html_text.main_text(page) == f"Title\n{long}\nBoth sides\nSocial policy\n{more}"


def test_unmarked_menus_and_rights():
    long = ("word " * 50).strip()
    menu = "<ul>" + "".join(f"<li><a href=x>{n}</a></li>" for n in ("Home", "News", "Contact")) + "</ul>"
    page = f"<body><div>{menu}<h1>T</h1><p>{long}</p><p>{long}</p><ul><li>one</li><li>two <a href=q>x</a></li></ul><p>End.</p><p>© 2024 Foo. All rights reserved.</p></div></body>"
    assert html_text.main_text(page) == f"T\n{long}\n{long}\none\ntwo x\nEnd."
    said = f"<article><p>Copyright 1709 was the first of its kind. {long}</p><p>{long}</p></article>"
    assert html_text.main_text(said).count("\n") == 1
    # what an article element holds is the article, a last line on rights too
    assert html_text.main_text(f"<article><p>{long}</p><p>All rights reserved.</p></article><p>© 2024 Foo</p>") == f"{long}\nAll rights reserved."


def test_deep_and_long_pages():
    """Time grows with the page: thousands of nested elements and of blocks."""
    import time

    n = 5000
    blocks = [f"{'word ' * 12}{i}" for i in range(n)]
    pages = [
        "<div>" * n + "".join(f"<p>{b}</p>" for b in blocks) + "</div>" * n,
        "".join(f"<div><p>{b}</p>" for b in blocks),
        "".join(f"<div class=a id=b{i}><section><p>{b}" for i, b in enumerate(blocks)),
    ]
    start = time.perf_counter()
    for page in pages:
        assert html_text.main_text(page) == "\n".join(blocks)
    assert time.perf_counter() - start < 15


def test_region_against_plain_search():
    """The chosen element against a search over the sets of lines below every element."""
    rng = random.Random(4)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.5:
                tag = rng.choice(["div", "div", "section", "article", "main"])
                out.append(f"<{tag}>{tree(depth - 1)}</{tag}>")
            else:
                tag = rng.choice(["p", "p", "h2", "div", "ul"])
                text = "word " * rng.choice([1, 3, 40, 60])
                out.append(f"<ul><li>{text}</li></ul>" if tag == "ul" else f"<{tag}>{text}</{tag}>")
        return "".join(out)

    for _ in range(150):
        parser = html_text._Lines()
        parser.feed("<body>" + tree(4) + "</body>")
        parser.close()
        lines = [x for x in parser.lines if "".join(x.parts).strip()]
        path = {}
        for x in lines:
            n, path[id(x)] = x.element, []
            while n:
                path[id(x)].append(n)
                n = parser.parent[n]
        cluster = [x for x in lines if rng.random() < 0.3] or lines
        around = [n for n in path[id(cluster[0])] if all(n in path[id(x)] for x in cluster)]
        below = {n: [x for x in lines if n in path[id(x)]] for n in around}
        want = next((n for n in around if n in parser.articles), None)
        if want is None:
            want = next((n for n in around if len(below[n]) > 1), 0)
            for n in around[around.index(want) + 1 :] if want else ():
                if any(x.tag not in html_text.PROSE for x in below[n] if x not in below[want]):
                    break
                want = n
        assert html_text._region(parser, lines, cluster) == want


def test_pages(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, None), (2, "v", "", 1)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)


# ---- pieces

MODEL = "piece_bpe_32k.model"


def reference_encoder(table):
    """The library's own unigram decoder over the same pieces and scores."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(public_tokenizers.path(MODEL), "rb").read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for name, (i, score) in table.normal.items():
        assert model.pieces[i].piece == name
        model.pieces[i].score = score
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_pieces(spark, docs, empty):
    path = tokenizer_path(MODEL)
    table = pieces.load(path)
    out = pieces.decode(pieces.encode(docs, path, ("doc_id", "extra")), path, ("doc_id", "extra")).collect()
    want = collections.Counter((r[0], r[5], (r[1] or "").replace("▁", " ")) for r in awkward())
    assert collections.Counter((r.doc_id, r.extra, r.text) for r in out) == want
    assert pieces.encode(empty, path).count() == 0
    # every segmentation is as good as the best found by a plain search over positions
    for r in out[:12] + [r for r in out if r.doc_id in (35, 36)]:
        text = "▁" + r.text.replace(" ", "▁") if r.text else ""
        best = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - table.longest), j):
                s = table.normal.get(text[i:j], (0, table.unknown if j - i == 1 else -math.inf))[1]
                best[j] = max(best[j], best[i] + s)
        got, raw = 0.0, 0
        for i in r.ids:
            if table.kinds[i] == "b":
                raw += 1
                got += table.unknown if not 0x80 <= int(table.names[i][3:5], 16) < 0xC0 else 0.0
            else:
                got += table.normal[table.names[i]][1]
        assert got == pytest.approx(best[-1], rel=1e-9)


def test_pieces_agree_with_the_library(spark, docs):
    pytest.importorskip("google.protobuf")
    pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    path = tokenizer_path(MODEL)
    library = reference_encoder(pieces.load(path))
    texts = {r[0]: r[1] or "" for r in awkward() if r[0] and r[0] < 36}
    out = pieces.encode(docs.filter("doc_id < 36"), path).collect()
    same = sum(list(r.ids) == library.encode(texts[r.doc_id]) for r in out)
    assert same >= 0.95 * len(out)


def test_long_runs(spark, monkeypatch):
    table = pieces.load(tokenizer_path(MODEL))
    rng = random.Random(12)
    runs = ["a" * 100_000, " " * 100_000, "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(100_000)), "-." * 50_000]
    df = spark.createDataFrame([(i, t, "", "", 0, 0, 0, "") for i, t in enumerate([*runs, "a short text"])], SCHEMA)
    out = {r.doc_id: r.ids for r in pieces.encode(df, tokenizer_path(MODEL)).collect()}
    assert len(out) == 5 and all(pieces.decode_ids(table, out[i]) == t for i, t in enumerate(runs))
    # short parts get the same ids in a task as in the lattice
    parts = ["internationalisation", "qzxé\u1234qq", *(runs[2][i : i + 30] for i in range(0, 600, 30))]
    short = spark.createDataFrame([(p, 1) for p in parts], "part string, n bigint")
    lattice = {r.part: r.ids for r in pieces.encode_parts(short, table).collect()}
    monkeypatch.setattr(pieces, "LATTICE_CHARS", 0)
    assert {r.part: r.ids for r in pieces.encode_parts(short, table).collect()} == lattice
    assert lattice == {p: pieces.fold_part(table, p).tolist() for p in parts}


def test_texts_are_encoded_where_they_are(spark, monkeypatch):
    path = tokenizer_path(MODEL)
    docs = spark.createDataFrame(awkward(), SCHEMA)
    out = pieces.encode(docs, path, ("doc_id", "extra"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    with_lattice = collections.Counter((r.doc_id, r.extra, tuple(r.ids)) for r in out.collect())
    # no part at hand and no memory: the same ids
    monkeypatch.setattr(pieces, "FREQUENT", 0)
    monkeypatch.setattr(pieces, "MEMORY", 0)
    again = pieces.encode(docs, path, ("doc_id", "extra")).collect()
    assert collections.Counter((r.doc_id, r.extra, tuple(r.ids)) for r in again) == with_lattice


def test_rare_parts_are_folded_side_by_side(monkeypatch):
    table = pieces.load(tokenizer_path(MODEL))
    rng = random.Random(8)
    letters = "abcdefghinorstuäöüß.,-▁é\n\u1234\U0001d11e"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", "x" * 48, "internationalisation"]
    parts, counts = pieces.trie(table).cut(words)
    beside = {p[i : i + 2] for p in table.normal for i in range(len(p) - 1)}
    want = [pieces.SPACE + w for w in words]
    plain = [[i for i in range(len(c)) if i == 0 or c[i - 1 : i + 1] not in beside] for c in want]
    assert parts == [c[a:b] for c, at in zip(want, plain) for a, b in zip(at, [*at[1:], len(c)])]
    assert counts.tolist() == [len(at) for at in plain]
    parts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 49))) for _ in range(200)]
    ids, counts = pieces.trie(table).fold(parts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [pieces.fold_part(table, p).tolist() for p in parts]
    assert [len(x) for x in pieces.trie(table).fold([])] == [0, 0]
    # one by one are only the long ones, and words are learned once
    alone, fold = [], pieces.fold_part
    monkeypatch.setattr(pieces, "fold_part", lambda t, p: alone.append(p) or fold(t, p))
    known = pieces.IdsOfWords(table, {})
    texts = ["qzxv vzqqx\n\u1234", None, "x" * 100, "qzxv " + "x" * 100, ""]
    found = [np.frombuffer(x, "<i4") for x in known.encode_all(texts)]
    assert [pieces.decode_ids(table, x) for x in found] == [t or "" for t in texts]
    assert alone == [pieces.SPACE + "x" * 100]


def test_any_ids_decode_as_bytes_between_pieces():
    table = pieces.load(tokenizer_path(MODEL))
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.choice(table.byte_ids[:255]), rng.randrange(len(table.names)), *table.byte_ids[0xE2:0xE3], table.byte_ids[0x82]]) for _ in range(rng.randrange(30))]
        raw = b"".join(bytes([min(int(table.names[i][3:5], 16), 0xFE)]) if table.kinds[i] == "b" else b"\xff|" + (table.names[i].encode() if table.kinds[i] == "n" else b"") + b"|\xff" for i in ids)
        # a byte that is never valid stands for the border of a piece
        want = "".join(x if k % 2 else x.decode("utf-8", "replace") for k, x in enumerate(split_pieces(raw)))
        assert pieces.decode_ids(table, ids) == want.replace("▁", " ")[1:]


def split_pieces(raw):
    """Bytes and, at odd places, the text of a piece between them."""
    parts = re.split(rb"\xff\|(.*?)\|\xff", raw, flags=re.S)
    return [x.decode() if k % 2 else x for k, x in enumerate(parts)]


def test_words_are_the_chunks():
    texts = ["a b", " a  b ", "a ", " ", "  ", "a\nb c\n", "▁a b▁", "a▁▁ b", "\n", "a  b", ""]
    assert all([pieces.SPACE + w for w in pieces.words_of(t)] == pieces.chunks(t) for t in [*texts, None])


# ---- token files

def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 5000):
        ids = np.where(rng.random(n) < 0.6, rng.integers(0, 9, n), rng.integers(0, 49408, n))
        payload, sizes, sums = token_files.encode_blocks(ids, 49408)
        assert (token_files.decode_blocks(payload, sizes, sums, n, 49408) == ids).all()
    ids = np.tile(np.arange(7), 1000)
    payload, sizes, sums = token_files.encode_blocks(ids, 49408)
    assert len(payload) < len(ids)
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 255
    with pytest.raises(ValueError):
        token_files.decode_blocks(bytes(broken), sizes, sums, len(ids), 49408)


def test_blocks_take_the_bits_of_the_frequencies():
    rng = np.random.default_rng(2)
    shares = 1 / np.arange(1, 3001)
    shares /= shares.sum()
    ids = rng.permutation(49408)[rng.choice(3000, 200_000, p=shares)]
    payload, sizes, sums = token_files.encode_blocks(ids, 49408)
    assert len(payload) * 8 < 1.05 * 200_000 * -(shares * np.log2(shares)).sum()
    assert (token_files.decode_blocks(payload, sizes, sums, len(ids), 49408) == ids).all()
    for at in (0, 3, 9, len(payload) // 2):
        broken = bytearray(payload)
        broken[at] ^= 255
        with pytest.raises(ValueError):
            token_files.decode_blocks(bytes(broken), sizes, sums, len(ids), 49408)


def test_blocks_mix_three_predictions():
    rng = np.random.default_rng(3)

    def bits(ids):
        payload, sizes, sums = token_files.encode_blocks(ids, 49408)
        assert (token_files.decode_blocks(payload, sizes, sums, len(ids), 49408) == ids).all()
        return len(payload) * 8 / len(ids)

    # every second id follows from the one before it (order 1), seldom from the two before it
    first = rng.integers(0, 60, 50_000)
    pairs = np.stack([first, 30_000 + 7 * first], 1).ravel()
    assert bits(pairs) < 0.75 * np.log2(120)
    # a block keeps to its group of ids, which the frequencies of the segment do not tell
    groups = rng.integers(0, 2, 100) * 20_000
    assert bits((groups[:, None] + rng.integers(0, 1000, (100, 1024))).ravel()) < np.log2(2000) - 0.5
    # order 2 alone: a long tape that is played twice within a block
    tape = rng.integers(0, 30, (100, 512))
    assert bits(np.hstack([tape, tape]).ravel()) < 0.9 * np.log2(30)
    # many groups of ids
    ids = rng.integers(0, 600_000, 5000)
    payload, sizes, sums = token_files.encode_blocks(ids, 600_000)
    assert (token_files.decode_blocks(payload, sizes, sums, 5000, 600_000) == ids).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = token_files.round_trip(docs, path).collect()
    assert len(out) == len(awkward())
    want = collections.Counter()
    for r in awkward():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    assert token_files.round_trip(empty, path).count() == 0


# ---- language model

def test_pitman_yor(spark, docs, empty):
    rng = random.Random(6)
    a, b = "ka ko ki ku".split(), "zu zo zi ze".split()
    rows = [(i, prose(rng, 60, a if i % 2 else b), None, None, 0, 0, 0, None) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = [r for r in rows if r[0] < 100]
    model, totals, n = pitman_yor.train(df.filter("doc_id < 100"))
    counts = collections.Counter(w for r in seen for w in words(r[1].lower()) + ["\n"])
    assert n == sum(counts.values()) and totals.vocabulary == len(counts)
    out = {r.doc_id: r for r in pitman_yor.score(df, model, totals, n).collect()}
    v = len(counts)
    for i, text, *_ in rows:
        tokens = words(text.lower()) + ["\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert out[i].base_score == pytest.approx(base) and out[i].n_tokens == len(tokens) and out[i].n_known == sum(w in counts for w in tokens)
    held = [i for i in out if i >= 100]
    assert sum(out[i].score for i in held) > sum(out[i].base_score for i in held)
    # the probabilities of all words after a class, and of one unknown word, sum to one
    mass = np.zeros(pitman_yor.FINE)
    for r in model.collect():
        p = totals.fallback(0) * np.array(r.middle)[np.arange(pitman_yor.FINE) % pitman_yor.COARSE]
        p[r.classes] += r.own
        mass += p
    mass += totals.unknown()
    used = totals.customers[0] > 0
    assert np.abs(mass[used] - 1).max() < 0.05
    odd = pitman_yor.score(docs, model, totals, n).collect()
    assert len(odd) == len(awkward()) and all(r.score < 0 for r in odd)
    none = pitman_yor.train(empty)
    assert pitman_yor.score(empty, *none).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30), None, None, 0, 0, 0, None) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    trained = pitman_yor.train(df)
    whole = {r.doc_id: r for r in pitman_yor.score(df, *trained).collect()}
    monkeypatch.setattr(pitman_yor, "FREQUENT", 5)
    parts = pitman_yor.score(df, *trained).collect()
    assert len(parts) == 43
    for r in parts:
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-5) and r.n_known == whole[r.doc_id].n_known
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_word_pairs_of_one_class_are_told_apart(spark, monkeypatch):
    rng = random.Random(8)
    # the previous words share their last two characters, so they are of one class
    firsts = [f"{x}{y}ka" for x in "bdfgl" for y in "aeiou"]
    after = {w: f"x{i}" for i, w in enumerate(firsts)}
    rows = [(i, " ".join(f"{w} {after[w]}" for w in rng.choices(firsts, k=20)), None, None, 0, 0, 0, None) for i in range(80)]
    seen, unseen = "baka " + after["baka"], "baka " + after["luka"]
    trained = pitman_yor.train(spark.createDataFrame(rows, SCHEMA))
    df = spark.createDataFrame([(1, seen, *rows[0][2:]), (2, unseen, *rows[0][2:]), (3, "never seen words", *rows[0][2:])], SCHEMA)
    out = {r.doc_id: r.score for r in pitman_yor.score(df, *trained).collect()}
    assert out[1] > out[2] + 1
    monkeypatch.setattr(pitman_yor, "FREQUENT", 3)
    monkeypatch.setattr(pitman_yor, "FREQUENT_PAIRS", 3)
    again = {r.doc_id: r.score for r in pitman_yor.score(df, *trained).collect()}
    assert again == pytest.approx(out, rel=1e-5)


def test_scoring_by_slices_of_words(spark, monkeypatch):
    import glob

    from corrobora.llm.common import scratch

    rng = random.Random(8)
    rows = [(i, prose(rng, 30), None, None, 0, 0, 0, None) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:2] + [(99, "never seen words", *rows[0][2:]), (98, None, *rows[0][2:])], SCHEMA)
    monkeypatch.setattr(pitman_yor, "FREQUENT", 5)
    monkeypatch.setattr(pitman_yor, "FREQUENT_PAIRS", 5)
    folder = os.path.dirname(scratch(spark, "x")).removeprefix("file:")
    held = lambda name: len(glob.glob(f"{folder}/{name}-*"))
    seats, singles, contexts, sums = held("lm-seats"), held("lm-singles"), held("lm-contexts"), held("lm-sums")
    trained = pitman_yor.train(df.filter("doc_id < 20"))
    # of the training, only what scoring reads stays on disk
    assert (held("lm-seats"), held("lm-singles"), held("lm-contexts")) == (seats, singles, contexts + 1)
    whole = pitman_yor.score(df, *trained).collect()
    assert held("lm-sums") == sums + 1
    monkeypatch.setattr(pitman_yor, "SLICE_ROWS", 1)
    parts = pitman_yor.score(df, *trained).collect()
    assert held("lm-sums") == sums + 1 + pitman_yor.SLICES
    key = lambda r: (r.doc_id, r.score)
    assert len(whole) == len(parts) == 34
    for a, b in zip(sorted(whole, key=key), sorted(parts, key=key)):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert (a.score, a.base_score) == pytest.approx((b.score, b.base_score))


def test_every_previous_word_has_a_restaurant(spark):
    counts = []
    for n in (50, 500):
        rng = random.Random(n)
        rows = [(i, " ".join(f"w{rng.randrange(n)}" for _ in range(50)), None, None, 0, 0, 0, None) for i in range(100)]
        _, totals, _ = pitman_yor.train(spark.createDataFrame(rows, SCHEMA))
        contexts = totals.contexts.collect()
        pairs = totals.pairs.collect()
        assert sum(c.c for c in contexts) == sum(p.n for p in pairs) == 100 * 51
        assert all(1 <= c.t <= c.c for c in contexts)
        counts.append(len(contexts))
    assert counts == [51, 501]
