"""SimHash components, language ID, page extraction and the pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fraudlake.llm import html_extract, langid, quality, simhash
from fraudlake.llm.queries import QUERIES

from conftest import SF_SMALL
from test_line_shard_quality import SCHEMA, brute_lines, brute_quality


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    """{id: unsigned fingerprint} -> {id: smallest reachable id}"""
    values = sorted(set(fp.values()))
    arr, parent = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3)[0]:
            parent[find(i)] = find(i + 1 + int(j))
    place, first = {v: k for k, v in enumerate(values)}, {}
    for i in sorted(fp):
        first.setdefault(find(place[fp[i]]), i)
    return {i: first[find(place[fp[i]])] for i in fp}


def flips(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_linked_pairs_always_share_a_key():
    rng, golay = random.Random(4), simhash.Golay()
    a = [rng.getrandbits(64) for _ in range(4000)]
    b = [flips(rng, x, rng.choice([0, 1, 2, 3, 3])) for x in a]
    sides = []
    for values in (a, b):
        rows, keys, side = simhash.golay_keys(np.array(values, dtype=np.uint64), golay)
        found = [(set(), set()) for _ in values]
        for r, k, s in zip(rows.tolist(), keys.tolist(), side.tolist()):
            found[r][s].add(k)
        sides.append(found)
    for (la, ra), (lb, rb) in zip(*sides):
        assert la & rb and lb & ra


def test_golay_code_is_perfect():
    golay = simhash.Golay()
    words = np.arange(1 << 23, dtype=np.int64)[::997]
    number = golay.decode(words)
    code = np.array([(m << 11) | int(golay.high[m]) for m in number.tolist()])
    assert (np.bitwise_count(words ^ code) <= 3).all()


def links_of(spark, values):
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, 1) for v in values], "fp long, docs long")
    return {r.node & (2 ** 64 - 1): r.root for r in simhash.links(df).collect()}


@pytest.mark.parametrize("seed,centres,size,reach", [(1, 3, 250, 3), (2, 40, 12, 5), (3, 1, 700, 6)])
def test_components_of_dense_clusters(spark, seed, centres, size, reach):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(500)}
    for _ in range(centres):
        c = rng.getrandbits(64)
        values |= {flips(rng, c, rng.randint(0, reach)) for _ in range(size)}
    chain = rng.getrandbits(64)
    for _ in range(60):                                   # a long chain of single links
        chain = flips(rng, chain, 3)
        values.add(chain)
    values = sorted(values)
    got = links_of(spark, values)
    want = brute_components({v: v for v in values})
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for v in values:
        groups[want[v]].add(v)
        mine[got.get(v, v - (1 << 64) if v >> 63 else v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert len(groups) < len(values) - 50


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    fp = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    comp = brute_components(fp)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


ROWS = [(1, None, "en", "a"), (2, "", None, None), (3, "one two", "en", "a"), (4, "One\x0btwo", "en", "a"),
        (5, "É é É", "fr", "b"), (6, "é é é", "fr", "b"), (7, "rep " * 500, "en", "a"), (7, "rep " * 500, "en", "a"),
        (None, "rep " * 400, "en", "a"), (9, "x" * 100_000, None, "c")]


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"fp": F.lit(1), "id": F.lit("mine"), "_n": F.lit(2)})
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(ROWS)
    comp = {r.id: r.component for r in got}
    assert comp[2] == 1 and comp[4] == 3 and comp[7] == 7 and comp[None] == 7
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert {r["id"] for r in rows} == {"mine"}
    assert sorted(r.doc_id for r in rows) == sorted(i for i in comp if i is not None and comp[i] == i)
    assert simhash.near_duplicates(df.where("false")).count() == 0
    assert simhash.keep_one(df.where("false")).count() == 0


# --- language ID -----------------------------------------------------------------------
def test_language_accuracy_and_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    tested = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) / len(tested) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_equal_the_kernel_expansion():
    """The folded product gives what the kernel values and regression weights give one by one."""
    texts = ["the house and the tree", "das haus und der baum", "la maison et l'arbre"]
    marks = langid.Landmarks.of([langid.grams(t) for t in texts])
    for t in ("the tree", "baum", "etre maison!", "zzz"):
        g = set(langid.grams(t).tolist())
        for j, m in enumerate(texts):
            h = set(langid.grams(m).tolist())
            assert marks.kernel(langid.grams(t))[j] == pytest.approx(len(g & h) / (len(g) * len(h)) ** 0.5)
    alpha = np.array([[0.5, -1.0], [2.0, 0.25], [-0.5, 0.75]])
    folded = np.add.reduceat((alpha / np.sqrt(marks.sizes)[:, None])[marks.owners], marks.first[:-1], axis=0)
    model = langid.LanguageModel(["a", "b"], marks.grams, np.vstack([folded, np.zeros((1, 2))]))
    some = [langid.grams(t) for t in ("the tree", "", "baum", "42", "maison")]
    want = np.array([marks.kernel(g) @ alpha if len(g) else [0.0, 0.0] for g in some])
    assert np.allclose(model.scores(some), want)


def test_language_odd_rows(spark):
    df = spark.createDataFrame(ROWS + [(20, "42 ½ ... !!", "en", "a"), (21, "日本語", "ja", "x")], SCHEMA) \
        .withColumn("score", F.lit("mine"))
    model = langid.fit(df)
    got = {(r.id, r.lang_pred) for r in langid.predicted(df.withColumnRenamed("doc_id", "id"), model, "id").collect()}
    assert {(1, "und"), (2, "und"), (20, "und")} <= got and len(got) >= len(ROWS)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and all(r.score == "mine" for r in kept.collect())
    none = langid.fit(df.where("lang = 'xx'"))
    assert none.langs == [] and {r.lang_pred for r in langid.predicted(df, none).collect()} == {"und"}
    assert langid.keep_known(df.where("false")).count() == 0


def test_a_letter_is_enough_for_a_language(spark):
    """Only null and letterless texts are und in the query; the pipeline's stage still rejects."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    strange = [(10 ** 6 + 3 * k, t, None, "x") for k, t in enumerate(
        ["日本語のテキストです" * 20, "Это русский текст о погоде и о доме " * 9, "zq xjkw qpz wvx kjq zzx " * 20, "ﬂ", "x"])]
    df = docs.unionByName(spark.createDataFrame(strange, docs.schema))
    model = langid.fit(df)
    assert model.langs[model.common] == max(model.langs, key=lambda x: docs.where(F.col("lang") == x).count())
    got = {r.doc_id: r for r in langid.predicted(df, model).collect()}
    for r in df.collect():
        letter = any(map(str.isalpha, r.text or ""))
        assert got[r.doc_id].lang_pred in (model.langs if letter else ["und"])
    kept = {r.doc_id for r in langid.keep_known(df).collect()}
    assert not kept & {r[0] for r in strange[:3]} and len(kept) > 0.9 * docs.count()


def test_language_sample_takes_copies_once(spark):
    texts = [f"some text number {chr(97 + k % 26)} {chr(97 + k // 26)}" for k in range(60)]
    first = min(texts, key=lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2 ** 63) % 2 ** 64)
    df = spark.createDataFrame([(3 * k, t, "en", "a") for k, t in enumerate(texts)], SCHEMA)
    many = spark.range(3000).selectExpr("id + 1000 as doc_id", f"'{first}' as text", "'en' as lang", "'a' as source")
    rows = df.unionByName(many)
    got = [r.text for r in langid._sample(rows.select("lang", "text"), [("en", 60)], 50).collect()]
    assert len(got) == 50 and len(set(got)) == 50
    model, plain = (langid.fit(x, per_lang=50, landmarks=50) for x in (rows, df.unionByName(many.limit(9))))
    assert model.langs == ["en"] and len(model.grams) == len(plain.grams) > 60


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(3)
    part = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 1500").collect()}
    assert len(part) == 4
    odd = ["日本語の文章はここにあります。東京は大きな町です。" * 3,
           "Это обычный русский текст о погоде и городах, который никто не учил. " * 3,
           "Questa è una frase italiana che parla della città e del tempo, con molte parole comuni e nessuna novità. " * 2,
           "To jest zwykły polski tekst o pogodzie i miastach, którego nikt się nie uczył, ale każdy może czytać. " * 2,
           " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80)),
           " ".join(f"{rng.getrandbits(128):032x}" for _ in range(30)), " ".join(part.values())]
    odd_ids = {10 ** 9 + k for k in range(len(odd))}
    # the odd texts are held out of the fit: no label to learn them from
    more = spark.createDataFrame([(i, t, None, "odd") for i, t in zip(sorted(odd_ids), odd)], docs.schema)
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert not kept & odd_ids
    real = {r.doc_id for r in docs.where("length(text) > 300").select("doc_id").collect()}
    assert len(real - kept) <= 0.005 * len(real)


# --- pages -----------------------------------------------------------------------------
def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 12))]
        places = sorted(html_extract.shared_lines(a, b))
        assert len(places) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in places)


def extract(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    return {r.page_id: r.text for r in html_extract.extracted(df).collect()}


def test_pages_without_article_markup(spark):
    def page(n):
        return (f"<html><head><title>t{n}</title><script>var a='<p>no</p>';</script></head><body><div>Site name</div>"
                f"<div>Latest stories</div><h1>Story  {n} &eacute;</h1><p>Unique text&nbsp;of story {n}.<p>More {n}"
                "<div>All rights</div><div class='comments'><p>nice one</p></div><form>Search</form></body>")
    got = extract(spark, [(n, f"http://Host.example/a/{n}", page(n)) for n in range(12)]
                  + [(50, "http://other.example/a/1", page(50)), (51, None, page(51)), (52, "", None)])
    for n in range(12):
        assert got[n] == f"Story {n} é Unique text of story {n}. More {n}"
    assert got[50].startswith("Site name") and got[52] == ""        # alone on its host: markup only


def test_pages_with_article_markup(spark):
    def page(n, body):
        return (f"<body><nav><ul><li>Home</ul></nav><header>Top</header><main><h1>T{n}</h1>{body}<aside>see also</aside>"
                f"<div class='ad banner'>Buy</div></main><div>loose {n}</div><footer>F</footer>")
    shared = "<p>A passage that all the articles quote.</p>"
    got = extract(spark, [(n, f"https://h/x/{n}.html", page(n, f"{shared}<p>Own text {n} &lt;b&gt; here</p>"))
                          for n in range(5)] + [(9, "https://h/x/4", page(4, f"{shared}<p>Own text 4 &lt;b&gt; here</p>"))])
    for n in range(5):
        assert got[n] == f"T{n} A passage that all the articles quote. Own text {n} <b> here"
    assert got[9] == got[4]                                          # a copy keeps its text


def test_article_markup_decides_without_neighbours(monkeypatch):
    """Passages quoted as first or last line of an article stay; no alignment is computed for nothing."""
    page = lambda n: html_extract.page_lines(                                        # noqa: E731
        f"<div>Site</div><article><p>Quoted head.</p><p>Own {n}</p><p>Quoted tail.</p></article>")
    plain = [html_extract.page_lines(f"<div>Site</div><p>Own text of {n}</p>") for n in range(3)]
    assert html_extract.main_text(plain[1], plain[0], plain[2]) == "Own text of 1"
    monkeypatch.setattr(html_extract, "shared_lines", lambda a, b: pytest.fail("aligned"))
    assert html_extract.main_text(page(1), page(0), page(2)) == "Quoted head. Own 1 Quoted tail."


def test_template_lines_inside_the_article_go_by_the_nearest_urls(spark):
    def page(n, more="", host="h"):
        return (n, f"https://{host}/x/{n:02d}", f"<body><nav>Menu</nav><main><h1>T{n}</h1><div>Our own staff desk</div>{more}"
                f"<table><tr><th>Born<td>{1900 + n}</table><p>Own text of page {n} and no other.</p><h2>Details</h2>"
                f"<p>Further text {n} by itself.</p><ul><li>Tell friends</ul></main><div>loose {n}</div>")
    quote, own = "<p>Quoted passage.</p>", "<p>Own text of page 3 and no other.</p>"
    pages = [page(n, quote if 4 <= n < 12 else "") for n in range(30)]
    copies = [(100 + k, f"https://k/x/{k:02d}", f"<article>{own}<p>Lines {k // 10 * 7}, a text of some length.</p><p>Same end.</p></article>")
              for k in range(20)]                              # ten addresses each of two articles
    few = [page(n, host="few") for n in range(200, 208)]       # seven others are not enough
    got = extract(spark, pages + copies + few)
    for n in range(30):
        quoted = "Quoted passage. " if 4 <= n < 12 else ""     # by seven others: it stays
        assert got[n] == (f"T{n} {quoted}Born {1900 + n} Own text of page {n} and no other. "
                          f"Details Further text {n} by itself."), n
    for k in range(20):
        assert got[100 + k] == f"Own text of page 3 and no other. Lines {k // 10 * 7}, a text of some length. Same end."
    assert all("Our own staff desk Born" in got[n] and got[n].endswith("Tell friends") for n in range(200, 208))


def test_a_page_is_compared_with_its_nearest_urls_over_all_buckets():
    keys = [f"{host}\x01/{n:02d}\x01" for host in "ab" for n in range(25)]
    rng = random.Random(2)
    for _ in range(50):
        cuts = sorted(rng.sample(range(1, 50), rng.randint(0, 30)))
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, 50])]
        most = html_extract.NEAREST
        moves = html_extract._moves({b: p[:most] for b, p in enumerate(parts)},
                                    {b: p[::-1][:most] for b, p in enumerate(parts)})
        assert len(moves) == len(set(moves))
        for b, p in enumerate(parts):
            held = sorted(p + [k for k, to in moves if to == b])
            for k in p:
                i = keys.index(k)
                near = [x for x in keys[max(0, i - most):i + most + 1] if x[0] == k[0]]
                assert set(near) <= set(held)


def test_votes_count_aligned_lines_of_distinct_articles():
    """Against votes counted page by page: same tag path, same order, single lines, no copies."""
    line = lambda t, tag="p": (t, f"article/{tag}")                                  # noqa: E731
    own = lambda n: [line(f"The own text of page {n}, long enough to be an article.")]
    for votes in range(11):
        near = [([line("Template.")] if n < votes else []) + own(n) for n in range(10)]
        gone = html_extract.template_lines([line("Template.")] + own(99), near)
        assert gone == ({0} if votes >= 8 else set())
    near = [[line("Template.", "div")] + own(n) for n in range(10)]                  # another path
    assert html_extract.template_lines([line("Template.")] + own(99), near) == set()
    near = [[line("x"), line("x")] + own(n) for n in range(10)]                      # repeated: data
    assert html_extract.template_lines([line("x"), line("x")] + own(99), near) == set()
    near = [[line("a")] + own(n) + [line("b")] for n in range(10)]                   # crossed: one of both
    assert len(html_extract.template_lines([line("b")] + own(99) + [line("a")], near)) == 1
    near = [[line("Template.")] + own(0) for _ in range(10)]                         # one article, ten addresses
    assert html_extract.template_lines([line("Template.")] + own(99), near) == set()


@pytest.mark.parametrize("around", ["<div class='layout has-sidebar'>", "<div class='main-content no-comments'>",
                                    "<div class='page with-banner'>", "<div id='search-page'>", "<form action='/x'>",
                                    "<div class='sidebar'>", "<div class='wrap'><form><div class='social widget'>"])
@pytest.mark.parametrize("article", ["<article>", "<article class='post related'>", "<main><div class='x'>", "<div>"])
def test_wrappers_with_listed_words_keep_the_article(around, article):
    body = "<p>The first part of the text.</p><p>The second <span class='ad'>Buy</span> part.</p>"
    page = f"<body><nav>Home</nav>{around}{article}<h1>Title</h1>{body}<div class='share-buttons'>Post it</div></body>"
    got = html_extract.main_text(html_extract.page_lines(page), None, None)
    assert got == "Title The first part of the text. The second part."


def test_regions_with_listed_words_still_go():
    long = "<p>" + "Much talk about it. " * 30 + "</p>"
    for gone in ("<div class='comments'>%s</div>", "<section id='comment-list'><article>%s</article></section>",
                 "<div class='cookie-banner'>%s</div>", "<div class='related-posts'><article>%s</article></div>",
                 "<form>%s</form>", "<div><article class='comment'>%s</article></div>"):
        page = f"<body><article><h1>Title</h1><p>Text.</p></article>{gone % long}</body>"
        assert html_extract.main_text(html_extract.page_lines(page), None, None) == "Title Text.", gone
    page = f"<body><div><p>Short article.</p></div><div class='comments'>{long}</div></body>"
    assert html_extract.main_text(html_extract.page_lines(page), None, None) == "Short article."


@pytest.mark.parametrize("html", ["<", "<![CDATA[x]]>", "<!doctype", "<p", "&", "<a b=c", "</p></div>", "<!--",
                                  "<svg><p>x", "\x00", "<article><nav>menu<article><p>ok</article>", "<p>" * 3000])
def test_broken_html_does_not_fail(html):
    html_extract.main_text(html_extract.page_lines(html), None, None)


def test_pages_query(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op8_html_extraction"](spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        lines = [t for t, inside in html_extract.page_lines(p.html) if inside]
        assert got[p.page_id].text == " ".join(lines) and got[p.page_id].n_chars == len(" ".join(lines))
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- pipeline --------------------------------------------------------------------------
def brute_pipeline_until_packing(spark, rows):
    """rows: (id, text, lang, source) -> ids and texts that reach the packing stage"""
    good = {r[0] for r in brute_quality(rows, quality.Rules()) if r[-1]}
    rows = [r for r in rows if r[0] in good]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    langs, scores = model.predict([r[1] for r in rows], reject=True)
    rows = [r for r, lang, s in zip(rows, langs, scores) if lang != "und" and s >= langid.MIN_SCORE]
    dropped = {r[0]: r[2] for r in brute_lines([(i, t) for i, t, _, _ in rows])}
    holders = collections.defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)                      # noqa: E731
    for i, t, _, _ in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    texts = {i: "\n".join(x for x in t.split("\n") if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i)
             for i, t, _, _ in rows}
    assert sum(dropped.values()) > 0
    comp = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    return {i: texts[i] for i in texts if comp[i] == i}


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer
    from test_tokens_packing import check_packing
    from fraudlake.llm import bpe

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = brute_pipeline_until_packing(spark, [tuple(r) for r in docs.collect()])
    rows = [tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).collect()]
    check_packing(rows, list(want.items()), Tokenizer.from_file(bpe.default_path()))


def test_stages_keep_columns_and_survive_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({
        "n_chars": F.char_length("text").cast("long"), "n_words": F.lit("a"), "score": F.lit("b"), "fp": F.lit(1),
        "n_dropped": F.lit("c"), "kept": F.lit("d"), "bucket": F.lit("e")})
    for docs in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            out.collect()
            if name != "best_fit_packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_queries_are_registered():
    import __spark_entry__ as entry

    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
