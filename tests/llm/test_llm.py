"""Each operator against a plain version of itself, and on awkward rows."""

import collections
import json
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import components, embedding_dedup, html_text, language, mixing, ngram, packing, quality, sharding, simhash, token_files, tokens
from driftline.llm.entries import ORACLE_SQL, QUERIES, vocabulary
from driftline.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (4, "One two", "en", "a", 7),
    (5, "the and of the and of to in that it is was for on " * 3, "en", "a", 1),
    (5, "the and of the and of to in that it is was for on " * 3, "en", "a", 1),
    (6, "der die und das ist nicht ein zu den mit sich auf " * 4, "de", None, 1),
    (7, "der die und das ist nicht ein zu den mit sich auf " * 4, "de", "b", 1),
    (8, "12345 !!! ###", "en", "b", 1),
    (9, "é́ ß 日本語。 ﬁ İ ς\x85x y\x1cz", None, "b", 1),
    (10, "long " * 30_000, "en", "c", 1),
    (None, "no id here", "en", "c", 1),
    (None, "no id here", "en", None, 1),
    (-3, "<|endoftext|> a ▁ b <|STARTOFTEXT|>", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.orderBy("doc_id").collect()]


def lowered(text):
    return (text or "").encode().lower().split()


# 1


def page(body, head=""):
    return f"<html><head><title>t</title>{head}</head><body>{body}</body></html>"


PROSE = "This is the first of the paragraphs of the article and it is long enough to be decided by the rules of the reader."
MORE = "And this is the second one, which has to be as long as the first, so that it is a part of the text as well."
ITALIAN = "Gli abitanti del villaggio si sono riuniti ieri sera nella piazza principale per discutere il progetto della nuova scuola, che dovrebbe essere costruita entro il prossimo anno vicino alla vecchia chiesa."
RUSSIAN = "Жители деревни собрались вчера вечером на главной площади, чтобы обсудить проект новой школы, которая должна быть построена в следующем году рядом со старой церковью, недалеко от реки и леса, где гуляют дети."
OTHER = "Around here is another block of prose that is not of the article, and it should be left out if it can be told from it."
CHINESE = "这是一个关于村庄新学校的报道居民们昨天晚上在中心广场聚集讨论了这个项目的细节和预算学校预计在明年年底之前在老教堂旁边建成许多家长表示支持但也有人担心交通和费用问题"
NAMES = "Smith Jones Miller Brown Davies Wilson Evans Thomas Johnson Roberts Walker Wright Robinson"
PAGES = [
    ("article", page(f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{MORE}<script>x('</p>')</script></p></article><footer>&copy; me</footer>"), f"Title\n{PROSE}\nShort.\n{MORE}"),
    ("no article element", page(f"<div id=header>Site</div><div class='nav-menu'><a href=/a>{PROSE}</a></div><div><p>{PROSE}</p>Yes<p>{MORE}</p></div><div class=sidebar>{PROSE}</div>"), f"{PROSE}\nYes\n{MORE}"),
    ("comments, adverts, forms, notices", page(f"<article><p>{PROSE}</p><div class=ad>{MORE}</div><form>{MORE}</form><section id=comments><p>{PROSE}</p></section><div class='cookie-notice'>{MORE}</div></article><article class=comment>{PROSE}</article>"), PROSE),
    ("link lists", page(f"<main><p>{PROSE}</p><ul><li><a href=/x>{MORE}</a></li></ul><p>With <a href=/y>a link</a> in it, {MORE}</p></main>"), f"{PROSE}\nWith a link in it, {MORE}"),
    ("references and white space", page(f"<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;\n\t x<br>y &bogus; 1 < 2</p><p>{PROSE}</p></article>"), f"a <b> &amp; é x y &bogus; 1 < 2\n{PROSE}"),
    ("unclosed", f"<article><p><b>{PROSE}<br><p>{MORE}<!-- <p>no</p>", f"{PROSE}\n{MORE}"),
    ("a class that holds the article", page(f"<div class='with-sidebar'><article><p>{PROSE}</p></article></div>"), PROSE),
    ("foreign words", page("<article><p>" + "これは記事です。" * 20 + "</p></article>"), "これは記事です。" * 20),
    ("a quote in an unquoted value", page(f"<article><p><a href=x title=Bob's>link</a> {PROSE}</p><p>{MORE} It's over.</p></article>"), f"link {PROSE}\n{MORE} It's over."),
    ("a stray quote", page(f'<article><p title="abc>{PROSE}</p><p>{MORE}</p></article>'), f"{PROSE}\n{MORE}"),
    ("a tag's end in a value", page(f"<article><p title='a > b'>{PROSE}</p></article>"), PROSE),
    *[(f"class {c}", page(f"<div class='content {c}'><p>{PROSE}</p><p>{MORE}</p></div>"), f"{PROSE}\n{MORE}") for c in ("has-sidebar", "with-header", "page-login", "no-comments", "share-enabled", "social")],
    ("a form around the page", f"<html><body><form id=f><div><p>{PROSE}</p><p>{MORE}</p></div></form></body></html>", f"{PROSE}\n{MORE}"),
    ("a form around the article", f"<html><body><form id=f><article><p>{PROSE}</p></article></form></body></html>", PROSE),
    ("no end of the head", f"<html><head><title>t</title><body><p>{PROSE}</p>", PROSE),
    ("Italian", page(f"<nav><a href=/>Inizio</a></nav><div><p>{ITALIAN}</p></div>"), ITALIAN),
    ("Russian", page(f"<ul><li><a href=/>Главная</a></li></ul><div><p>{RUSSIAN}</p><p>Коротко.</p></div>"), f"{RUSSIAN}\nКоротко."),
    ("an object that isn't closed", page(f"<article><p>{PROSE}</p><object data=x><p>{MORE}</p></article>"), f"{PROSE}\n{MORE}"),
    ("inline elements that are dropped", page(f"<article><p>{PROSE}<span class=ad>Buy <span>now</span> cheap</span></p></article>"), PROSE),
    ("nothing", "", ""),
    ("null", None, ""),
    ("only text", PROSE, PROSE),
    ("markup only", "<div><<<>></div", "<<<>></div"),
    ("an anchor without href", f"<body><a name=top><h1>T</h1><p>{PROSE}</p><p>{MORE}</p>", f"T\n{PROSE}\n{MORE}"),
    ("an anchor in a paragraph", f"<body><p><a name='1'>{PROSE}</p><p>{MORE}</p>", f"{PROSE}\n{MORE}"),
    ("a link without an end", f"<body><div><a href=/x>Home<p>{PROSE}</p><p>{MORE}</p></div>", f"{PROSE}\n{MORE}"),
    ("a link around blocks", page(f"<div><p>{PROSE}</p><p>{MORE}</p></div><div><a href=/x><div>{MORE}</div></a></div>"), f"{PROSE}\n{MORE}"),
    (
        "linked headings and paragraphs",
        page(f"<div>{OTHER}</div><article><h2><a href='#s'>Section one</a></h2><p>{PROSE}</p><h2><a href='/s'>Section two</a></h2><p>{MORE}</p><p><a href=/z>{PROSE}</a></p><p>{MORE}</p></article>"),
        f"Section one\n{PROSE}\nSection two\n{MORE}\n{PROSE}\n{MORE}",
    ),
    ("runs of links", page(f"<article><p>{PROSE}</p><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul><p>{MORE}</p><p><a href=/a>x y</a></p><p><a href=/b>c d</a></p></article>"), f"{PROSE}\n{MORE}"),
    *[(f"most prose in class {c}", page(f"<div>{OTHER}</div><div class='{c}'><p>{PROSE}</p><p>{MORE}</p></div>"), f"{OTHER}\n{PROSE}\n{MORE}") for c in ("comments-open", "social-post", "public-notice-article", "share-prices")],
    *[(f"little prose in class {c}", page(f"<div class='{c}'>{OTHER}</div><div><p>{PROSE}</p><p>{MORE}</p></div>"), f"{PROSE}\n{MORE}") for c in ("social-box", "related", "cookie-bar")],
    ("more comments than article", page(f"<div><p>{PROSE}</p></div><div id=comments><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p></div>"), PROSE),
    ("a notice in another language", page(f"<div class='cookie-notice'>{PROSE}</div><div><p>{ITALIAN}</p><p>{ITALIAN}</p></div>"), f"{ITALIAN}\n{ITALIAN}"),
    ("a plain notice in another language", page(f"<div>{PROSE}</div><div><p>{ITALIAN}</p><p>{ITALIAN}</p></div>"), f"{PROSE}\n{ITALIAN}\n{ITALIAN}"),
    ("no spaces", page(f"<ul><li><a href=/>主页</a></li><li><a href=/x>新闻</a></li></ul><div><p>{CHINESE}</p><p>{CHINESE}</p><p>{CHINESE}</p></div>"), "\n".join([CHINESE] * 3)),
    ("code and names", page(f"<div><p>{PROSE}</p><pre>def f(x): return [y for y in range(x)]; print(f(3), f(4), f(5), f(6), f(7))</pre><p>{MORE}</p><p>{NAMES}</p><p>{PROSE}</p></div>"), f"{PROSE}\ndef f(x): return [y for y in range(x)]; print(f(3), f(4), f(5), f(6), f(7))\n{MORE}\n{NAMES}\n{PROSE}"),
]


@pytest.mark.parametrize(("html", "want"), [p[1:] for p in PAGES], ids=[p[0] for p in PAGES])
def test_main_text(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize("part", ["<a ", "<div>", "<b><div>", "<a x='", '<a x=">" ', "<object>", "<!-- ", "</p", "<p class=ad>", "<span class=ad>", "<", "&amp;", "<article>", "<script>"])
def test_broken_pages_take_linear_time(part):
    import time

    begin = time.time()
    html_text.main_text(part * (2_000_000 // len(part)) + "</b>" * 1000)
    assert time.time() - begin < 30


@pytest.mark.parametrize("parts", [("<span hidden>", "<div>", "<span></span>"), ("<nav>", "<article>", ""), ("<span hidden>", "<span hidden>", "<div></div>"), ("", "<a href=x>", ""), ("", "<a href=x><div>", ""), ("", "<p class=share>", "")])
def test_deep_pages_take_linear_time(parts):
    import time

    begin, n = time.time(), 2_000_000 // len("".join(parts))
    html_text.main_text(parts[0] + parts[1] * n + parts[2] * n if parts[0] != "<nav>" else parts[0] * n + parts[1] * n)
    assert time.time() - begin < 30


def test_pages_with_clashing_columns(spark, small, empty):
    pages = table(spark, small, "pages").limit(3)
    more = pages.withColumns({n: F.lit("x") for n in ("text", "n_chars", "__html2")})
    assert html_text.extract(more).collect() == html_text.extract(pages).collect()
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>" + "a " * 200_000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(odd).collect()) == [0, 0, 0, 399_999]


def test_pages(spark, small):
    got = QUERIES["op1_html_text"](spark, small).collect()
    source = {r.page_id: r.html for r in table(spark, small, "pages").collect()}
    for r in got:
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html_text.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert html_text.extract(table(spark, small, "pages").limit(0)).count() == 0


# 2


def test_scores_against_a_plain_model(spark, docs, plain):
    got = {r.doc_id: r for r in ngram.score(docs).collect()}
    text = {i: [*lowered(t), ngram.END] for i, t, _, _ in plain}
    train = {i for i in text if zlib.crc32(str(i).encode()) % 10}
    c, after, histories = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    n = sum(len(text[i]) for i in train)
    for i in train:
        padded = [ngram.END, *text[i]]
        c.update((w,) for w in text[i])
        for k in (2, 3):
            for gram in zip(*(padded[j:] for j in range(k)), strict=False):
                c[gram] += 1
                after[gram[:-1]] += 1
                histories[gram[:-1]].add(gram[-1])
    v = sum(len(g) == 1 for g in c)

    def probability(history, w):
        if not history:
            return (c[w,] + 0.1) / (n + 0.1 * (v + 1))
        shorter = probability(history[1:], w)
        if not after[history]:
            return shorter
        return (max(c[*history, w] - ngram.DISCOUNT, 0) + ngram.DISCOUNT * len(histories[history]) * shorter) / after[history]

    for i, words in text.items():
        padded = [ngram.END, *words]
        total = sum(math.log10(probability(tuple(padded[max(0, j - 2) : j]), padded[j])) for j in range(1, len(padded)))
        r = got[i]
        assert r.score == pytest.approx(total, abs=1e-6) and r.base_score == pytest.approx(sum(math.log10(probability((), w)) for w in words), abs=1e-6)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(words), sum(c[w,] > 0 for w in words), n)
    for k in (1, 2):
        state = max((h for h in histories if len(h) == k), key=lambda h: len(histories[h]))
        assert sum(probability(state, w) for (w,) in [g for g in c if len(g) == 1] + [(b"?",)]) == pytest.approx(1)


def test_ngrams_seen_once_have_their_arcs(spark):
    held = next(i for i in range(1, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    one, two = [i for i in range(1, 1000) if zlib.crc32(str(i).encode()) % 10][:2]
    got = {r.doc_id: r.score for r in ngram.score(spark.createDataFrame([(one, "a b c"), (two, "b a"), (held, "a b")], "doc_id long, text string")).collect()}
    root = 2.1 / 7.5  # of a, b and the end token; each has two arcs that were seen once
    arc = 0.25 / 2 + 0.75 * root
    assert got[held] == pytest.approx(math.log10(arc * (0.25 + 0.75 * arc) * 0.75 * 0.75 * root))


def test_packed_arrays_come_back():
    arrays = [np.array([], "<u8"), np.arange(5, dtype="<u4"), np.array([True, False]), np.array([-1, 1 << 40], "<i8"), np.array([-7], "<i4")]
    for got, want in zip(ngram.unpack(ngram.pack(*arrays)), arrays, strict=True):
        assert got.dtype == want.dtype and got.tolist() == want.tolist()


def test_small_blocks_change_nothing(spark, docs, monkeypatch):
    want = {r.doc_id: r.score for r in ngram.score(docs).collect()}
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", 3000)
    blocks = ngram.blocks(docs.repartition(3, "doc_id"), "doc_id", "text")
    assert blocks.count() >= 3
    for most in (ngram.MOST_PARTITIONS, 2):  # several buckets to a partition
        monkeypatch.setattr(ngram, "MOST_PARTITIONS", most)
        got = {r.doc_id: r.score for r in ngram.score(docs.repartition(3, "doc_id")).collect()}
        assert got == pytest.approx(want)


def test_scores_of_odd_rows(odd, empty):
    rows = ngram.score(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert ngram.score(empty).count() == 0 and len(ngram.score(empty).columns) == 7


# 3


def test_forward_sums_all_segmentations():
    path = vocabulary("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if (p.replace("▁", "", 1) or "▁").replace("▁", "a").isalpha()]
    number = {p: i for i, p in enumerate(names)}
    v = language.pieces(path)
    assert v.count == len(names)
    p = np.random.default_rng(1).random((v.count + 1, 2))
    p /= p.sum(axis=0)

    def sums(word, c):
        a = [1.0, *[0.0] * len(word)]
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - v.longest), j):
                k = number.get(word[i:j], v.count if j == i + 1 else None)
                a[j] += 0.0 if k is None else a[i] * p[k, c]
        return math.log(a[-1])

    words = ["▁the", "▁thereandthe", "▁ж漢", "▁" + "ab" * 16, "▁" + "ab" * 30, "▁" + "漢" * 33, "▁" + "漢" * 32]
    assert language.forward(words, p, path) == pytest.approx(np.array([[sums(w, c) for c in (0, 1)] for w in words]))
    used = language.expected(words, np.ones(len(words)), np.zeros(len(words), int), p, path)
    letters = np.array([1] * (v.count + 1))
    letters[: v.count] = [len(x) for x in names]
    assert (used[:, 0] * letters).sum() == pytest.approx(sum(map(len, words)))  # pieces cover every letter once


def test_long_words_are_summed_up_alike(monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    p = np.random.default_rng(2).random((language.pieces(path).count + 1, 3))
    p /= p.sum(axis=0)
    words = ["▁" + "".join(random.Random(k).choices("abethisnor漢字", k=k)) for k in (5, 31, 32, 40, 90, 300)]
    want, n, lang = language.forward(words, p, path), np.arange(1.0, 7.0), np.array([0, 1, 2, 0, 1, 2])
    used = language.expected(words, n, lang, p, path)
    for short, window, cells in ((33, 50, 1 << 20), (3, 1 << 16, 64), (3, 37, 1 << 20)):
        monkeypatch.setattr(language, "SHORT", short)
        monkeypatch.setattr(language, "WINDOW", window)
        monkeypatch.setattr(language, "CELLS", cells)
        assert language.forward(words, p, path) == pytest.approx(want)
        assert language.expected(words, n, lang, p, path) == pytest.approx(used)


def test_long_words_are_learned_from_alike(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abcdefg" if i % 2 else "tuvwxyz", k=rng.randint(1, 400))) for _ in range(3)), "a" if i % 2 else "z") for i in range(40)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model")
    whole = language.fit(docs, path).probabilities
    monkeypatch.setattr(language, "WINDOW", 37)
    words = {lang: collections.Counter(language.MARK + w for _, text, own in rows if own == lang for w in text.split()) for lang in "az"}
    now = np.full(whole.shape, 1.0 / len(whole))
    for _ in range(language.ROUNDS):
        every = [(w, n, k) for k, lang in enumerate("az") for w, n in words[lang].items()]
        total = language.expected([w for w, _, _ in every], np.array([n for _, n, _ in every]), np.array([k for _, _, k in every]), now, path) + language.SMOOTHING
        now = total / total.sum(axis=0)
    assert now == pytest.approx(whole)


def test_a_language_without_spaces_is_learned(spark):
    rng = random.Random(8)
    script = {"zh": "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年", "ja": "のにはをたがでてとしれさあるいもなかられよりこそやまっきくけ", "th": "กขคงจชซดตถทนบปผพฟมยรลวศสหอฮ"}
    rows = [(i, "".join(rng.choices(script[lang], k=rng.randint(60, 400))), lang if i % 7 else None) for i in range(120) for lang in [("zh", "ja", "th")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert all(got[i] == ("zh", "ja", "th")[i % 3] for i in got)


def test_languages(spark, small, plain):
    got = {r.doc_id: r for r in QUERIES["op3_language"](spark, small).collect()}
    assert len(got) == len(plain)
    for i, _, lang, _ in plain:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
    unseen = [(i, lang) for i, _, lang, _ in plain if got[i].held_out and lang]
    assert sum(got[i].lang_pred == lang for i, lang in unseen) >= 0.97 * len(unseen)


def test_languages_of_odd_rows(odd, empty):
    path = vocabulary("piece_bpe_32k.model")
    rows = language.identify(odd, path).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 8)} == {"und"} and {r.lang_pred for r in rows if r.doc_id in (6, 7)} == {"de"}
    assert language.identify(empty, path).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled, path).collect()} == {"und"}


def test_labels_are_no_input_of_a_prediction(spark, docs):
    path = vocabulary("piece_bpe_32k.model")
    model = language.fit(docs.where(~language.held_out("doc_id")), path)
    a = language.predict(docs, model).orderBy("doc_id").collect()
    b = language.predict(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), model).orderBy("doc_id").collect()
    assert a == b


# 4


def plain_fingerprint(text):
    w = lowered(text)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(plain):
    for text in [t for _, t, _, _ in plain[:40]] + [r[1] for r in ODD if r[0] != 10]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(fps):
    f = np.array(sorted(set(fps)), dtype="u8")
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while (new := np.array([label[near[i]].min() for i in range(len(f))])).tolist() != label.tolist():
        label = new
    return {int(x): int(n) for x, n in zip(f, label, strict=True)}


def test_links_of_fingerprints(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(80):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    for bits in ((0, 1, 2), (0, 1, 40), (0, 40, 41), (61, 62, 63), (5,), (5, 6)):  # over both halves of the word
        x = rng.getrandbits(64)
        fps |= {x, x ^ sum(1 << b for b in bits)}
    want = plain_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")), "a", "b").collect()}
    groups = collections.defaultdict(set)
    for x, n in want.items():
        groups[n].add(signed(x))
    for g in groups.values():
        assert {found.get(x) for x in g} == ({min(g)} if len(g) > 1 else {None})


def test_near_duplicates(spark, docs, plain, odd, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _, _ in plain}
    label = plain_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (f, least[label[f]]) for i, f in fps.items()}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.drop_near_duplicates(odd).collect()]
    assert kept.count(5) == 1 and kept.count(None) == 2 and 7 not in kept and 2 not in kept


def test_one_id_on_two_texts(spark):
    """An id that stands on two texts of different components stays once in each."""
    a, b = "der erste text ist hier ganz anders als alle", "and this one is about quite another thing instead"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (1, b), (1, a + " "), (4, "third of them")], "doc_id long, text string")
    for n in (1, 5):
        kept = simhash.drop_near_duplicates(docs.repartition(n)).collect()
        assert sorted((r.doc_id, r.text.strip()) for r in kept) == sorted([(1, a), (1, b), (4, "third of them")])


def test_long_chains_are_one_component(spark):
    edges = spark.range(500).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    extra = spark.createDataFrame([(900, 901), (901, 900), (7, 7), (900, 902)], "x long, y long")
    got = {r.node: r.root for r in components.components(edges.union(extra), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(501)}, 900: 900, 901: 900, 902: 900}
    assert components.components(edges.limit(0), "x", "y").count() == 0


# 5


def plain_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_rules(spark, small, plain, odd, empty):
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, small).collect()}
    for i, t, _, _ in plain:
        n = plain_base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    trusted = spark.createDataFrame([(5,), (None,), (5,)], "doc_id long")
    rows = quality.quality_rules(odd, trusted).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(r.text)
    assert quality.quality_rules(empty, trusted).count() == 0
    assert all(r.kept != r.base_failed for r in quality.quality_rules(odd, trusted.limit(0)).collect())


def test_quality_tells_junk_from_prose(spark):
    larger = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, larger, "labels").collect()}
    rows = [r for r in QUERIES["op5_quality_rules"](spark, larger).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_ratios(spark):
    rows = [(i, "good plain words here" if i % 2 else "bad bad junk") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw, target = quality.count_features(docs, docs.where("doc_id % 2 = 1"))
    assert sum(raw) == 20 * 7 + 20 * 5 and sum(target) == 20 * 7
    ratios = quality.ratios(raw, target)
    spark_hash = lambda w: docs.select(F.pmod(F.xxhash64(F.lit(w)), F.lit(quality.BUCKETS))).first()[0]
    assert ratios[spark_hash("good")] > 0 > ratios[spark_hash("junk")]
    p = 21 / (sum(raw) + quality.BUCKETS)
    assert ratios[spark_hash("good")] == pytest.approx(math.log((20 + quality.PRIOR * p) / (20 * 7 + quality.PRIOR) / p), abs=1e-4)


def test_verdicts_against_a_plain_version(spark, small, plain):
    """Score, threshold and verdict; hashes as Spark has them, n-grams by their words."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    raw8 = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(raw8(b), xxhash.xxh64_intdigest(raw8(a), 42)))
    trusted = {r.doc_id for r in table(spark, small, "labels").where("quality = 1").collect()}
    grams = {}
    for i, t, _, _ in plain:
        h = [word(w) for w in WORD.findall(t or "")]
        grams[i] = [x % quality.BUCKETS for x in h + [pair(a, b) for a, b in zip(h, h[1:], strict=False)]]
    raw, target = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    n_raw, n_target = raw.total() + quality.BUCKETS, target.total()

    def score(g, without=False):
        own, n = (collections.Counter(g), len(g)) if without else (collections.Counter(), 0)
        each = [math.log((target[f] - own[f] + quality.PRIOR * p) / (n_target - n + quality.PRIOR) / p) for f in g for p in [(raw[f] + 1) / n_raw]]
        return sum(each) / len(each) if each else 0.0

    threshold = np.quantile([score(grams[i], True) for i, t, _, _ in plain if i in trusted and len(WORD.findall(t or "")) >= quality.MIN_WORDS], quality.LEAST)
    got = QUERIES["op5_quality_rules"](spark, small).collect()
    assert len(got) == len(plain)
    for r in got:
        want = score(grams[r.doc_id])
        assert r.score == pytest.approx(want, abs=2e-4)
        if abs(want - threshold) > 2e-4:
            assert r.kept == (not r.base_failed and want > threshold)


# 6 and 9


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def packed_ids(ids):
    return np.array(ids, "<u4").tobytes()


def test_word_encoder(plain, encode):
    e = tokens.WordEncoder(vocabulary())
    assert e.by_word
    texts = [t for _, t, _, _ in plain[:60]] + [r[1] for r in ODD] + ["it's we'll, don't.", "x.,y z..", "'re. 's, a's!", "ab%%% c### $$$ d&&&."]
    assert e.encode(texts) == [packed_ids(encode(t)) for t in texts]
    other = tokens.WordEncoder(vocabulary("byte_bpe_50k.json"))
    assert not other.by_word and other.encode(["a b", None]) == [packed_ids(other.tokenizer.encode("a b").ids), b""]


def test_the_encoder_forgets_and_still_knows(monkeypatch, plain, encode):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    e = tokens.WordEncoder(vocabulary())
    for _, t, _, _ in plain[:30]:
        assert e.encode([t]) == [packed_ids(encode(t))]


def test_token_files(spark, docs, plain, odd, empty, encode):
    files = token_files.write_tokens(docs, vocabulary(), parts=3)
    start = 0
    for (i, t, _, _), r in zip(plain, token_files.read_tokens(files, with_ids=True).orderBy("start").collect(), strict=True):
        ids = packed_ids([*encode(t), 1])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += r.n_tokens
    some = token_files.read_tokens(files, with_ids=True, wanted=[plain[3][0], plain[90][0]]).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {plain[k][0]: packed_ids([*encode(plain[k][1]), 1]) for k in (3, 90)}
    rows = token_files.read_tokens(token_files.write_tokens(odd, vocabulary())).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x))
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert token_files.read_tokens(token_files.write_tokens(empty, vocabulary())).count() == 0


def test_files_and_samples_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_FILES", 3)
    monkeypatch.setattr(token_files, "SAMPLED_IN_ALL", 20)
    files = token_files.write_tokens(docs, vocabulary(), parts=50)
    assert 1 < files.manifest.count() <= 3
    got = token_files.read_tokens(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_frames(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME", 64)
    rng = random.Random(2)
    rows = [(i if i % 5 else None, packed_ids([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 7, 90]))])) for i in range(40)]
    path = tmp_path / "x.tokens"
    with path.open("wb") as out:
        w = token_files.TokenFileWriter(out)
        for row in rows:
            w.add(*row)
        w.close()
    with path.open("rb") as source:
        r = token_files.TokenFileReader(source)
        assert [r.ids(k) for k in rng.sample(range(40), 40)] is not None and [r.ids(k) for k in range(40)] == [x for _, x in rows]
        assert [None if not k else d for k, d in zip(r.index["known"], r.index["doc_id"], strict=True)] == [d for d, _ in rows]
        first = int(r.offsets[1])
    with path.open("rb") as source:  # any zstandard reader skips the index and the table
        assert zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read() == b"".join(x for _, x in rows)
    damaged = bytearray(path.read_bytes())
    damaged[first + 12] ^= 1
    path.write_bytes(damaged)
    with path.open("rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        r = token_files.TokenFileReader(source)
        [r.ids(k) for k in range(40)]


def check_pieces(pieces, want, window):
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, ps in by_sequence.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or k == len(by_sequence) - 1
    got = collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.doc_tokens].append(p)
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for _, x in want)
    for i, ids in want:
        for p in got[i, len(ids) // 4]:
            cut = ids[4 * p.start : 4 * (p.start + p.length)]
            assert zlib.crc32(cut) == p.ids_crc32 and bytes(p.ids) == cut


def test_packing(docs, plain, odd, empty, encode):
    check_pieces(packing.pack(docs, vocabulary()).collect(), [(i, packed_ids([*encode(t), 2])) for i, t, _, _ in plain], 4096)
    check_pieces(packing.pack(odd, vocabulary(), window=64).collect(), [(r[0], packed_ids([*encode(r[1]), 2])) for r in ODD], 64)
    assert packing.pack(empty, vocabulary()).count() == 0


def test_sequences(odd):
    pieces = packing.pack(odd, vocabulary(), window=64)
    rows = packing.sequences(pieces, window=64).collect()
    last = max(rows, key=lambda r: r.sequence_id)
    assert all(len(r.ids) == 256 for r in rows if r is not last) and len(last.ids) in {256, *(4 * 2**k for k in range(6))}


# 7


def plain_jump(key, shards):
    at, following, h = -1, 0, 0
    while following < shards:
        at = following
        a = xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
        b = xxhash.xxh64_intdigest(sharding.SEED.to_bytes(4, "little"), a)  # an int is hashed as 4 bytes
        h = xxhash.xxh64_intdigest(at.to_bytes(8, "little"), b)
        following = math.floor((at + 1) / (((h >> 33) + 1) / 2**31))
    return at


def test_jump_hash(spark):
    keys = [0, 1, 2, 77, -5, 2**40]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[sharding.jump_shard(F.col("k"), n).alias(f"n{n}") for n in (1, 7, 40)]).collect()
    for r in rows:
        assert (r.n1, r.n7, r.n40) == tuple(plain_jump(r.k, n) for n in (1, 7, 40))
    spread = spark.range(20_000).select(sharding.jump_shard(F.col("id"), 10).alias("s"), sharding.jump_shard(F.col("id"), 11).alias("t"))
    counts = [r["count"] for r in spread.groupBy("s").count().collect()]
    assert len(counts) == 10 and max(counts) < 1.15 * min(counts)
    moved = spread.where("s <> t")
    assert moved.where("t <> 10").count() == 0 and 0.07 < moved.count() / 20_000 < 0.11


def test_shards(spark, small, plain, odd, empty, tmp_path):
    for rows, want in ((QUERIES["op7_sharding"](spark, small).collect(), [(i, t) for i, t, _, _ in plain]), (sharding.shard_documents(odd, 4).collect(), [(r[0], r[1]) for r in ODD])):
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in want)
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and r.grown_shard in (r.shard, 40 if len(want) == len(plain) else 4)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 4).count() == 0
    sharding.write_shards(odd, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# 8


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["small", "odd"])
def test_mix(spark, small, odd, which):
    docs = table(spark, small, "documents") if which == "small" else odd
    got = mixing.mix(docs).collect()
    text = docs.collect()
    sizes = collections.Counter()
    for r in text:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(sizes)
    assert sorted((r.doc_id or -99, r.size) for r in got) == sorted((r.doc_id or -99, len(WORD.findall(r.text or ""))) for r in text)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert sum(p["whole"] * p["length"] + p["begin"] for p in r.pieces or []) == r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
    again = {r.row: r.taken for r in mixing.mix(docs).collect()}
    assert again == {r.row: r.taken for r in got}


def test_a_mix_does_not_depend_on_partitions(spark, docs, odd):
    many = docs.unionByName(odd).unionByName(odd.where("doc_id = 6").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("x"))
    taken = lambda d: sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(d).select("doc_id", "size", "taken").collect())
    want = taken(many)
    for n in (1, 7, 211):
        assert taken(many.repartition(n)) == want
    text = lambda d: sorted((str(r.doc_id), str(r.source), r.text) for r in mixing.mixed_documents(d).collect())
    assert text(many.repartition(5)) == text(many)


def test_mixed_texts(odd, empty):
    rows = mixing.mixed_documents(odd).collect()
    words = sum(len(WORD.findall(r.text)) for r in rows)
    assert words == sum(r.taken for r in mixing.mix(odd).collect()) and max(collections.Counter(r.doc_id for r in rows if r.doc_id not in (5, None)).values()) <= 2
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_slots(spark, small):
    sized = table(spark, small, "documents").select("source", F.size(F.split("text", " ")).cast("long").alias("size"))
    targets = mixing.source_targets(sized)
    slots = mixing.slot_table(targets).toPandas()
    assert not slots.duplicated(["number", "draw"]).any()
    for number, own in slots.groupby("number"):
        assert sorted(own.draw) == list(range(len(own))) and own.groupby("block").size().max() <= 2
    assert (slots.groupby("shard").size().iloc[:-1] == mixing.SLOTS_PER_SHARD).all()


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97):
        got = sorted(r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7).cast("long"))).collect())
        assert got == list(range(n))


# 10


def plain_links(vectors, threshold=0.95):
    n = len(vectors)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and len(a):
                if any(x is None for x in [*a, *b]):
                    continue
                x, y = np.array(a, float), np.array(b, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    link[i, j] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold
    return link


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    rows = [v.tolist() for v in base] + [(b + 0.15 * rng.normal(size=6)).tolist() for b in base[:30] for _ in range(3)]
    rows += [rows[0]] * 3 + [[3 * x for x in rows[1]]] + [None, [], [0.0] * 6, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("inf")] + [1.0] * 5, [1.0, 2.0], [2.0, 4.0], [1e-200] * 6, [1e200] * 6]
    frame = spark.createDataFrame([(i + 10, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    link = plain_links([v if v is None or all(x is None or abs(x) < 1e150 for x in v) else [x / 1e190 for x in v] if v[0] == 1e200 else v for v in [[x * 1e190 if x == 1e-200 else x for x in v] if v and v[0] == 1e-200 else v for v in rows]])
    label = np.arange(len(rows))
    while (new := np.array([np.append(label[link[i]], label[i]).min() for i in range(len(rows))])).tolist() != label.tolist():
        label = new
    for i in range(len(rows)):
        r = got[i + 10]
        assert (r.n_links, r.component_id, r.kept) == (link[i].sum(), label[i] + 10, label[i] == i)


def test_embedding_blocks_far_apart_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(int(k), (np.eye(4)[k % 4] * 5 + 0.1 * rng.normal(size=4)).tolist()) for k in range(200)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "node long, embedding array<double>, copies long")
    eps = math.sqrt(0.1) + 1e-9
    axes = embedding_dedup._axes(frame, 4)
    blocks = embedding_dedup._blocks(embedding_dedup._grid_order(frame, axes, eps), axes, 2)
    n = blocks.count()
    assert 0 < embedding_dedup._block_pairs(blocks, axes.shape[1] + 1, eps).count() < 0.6 * n * (n + 1) / 2


def test_parts_of_blocks_lose_no_link(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 4)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 5))
    x = embedding_dedup._unit(np.repeat(centres, 8, axis=0) + 0.05 * rng.normal(size=(240, 5)))
    a, b, eps = x[:200], x[100:], math.sqrt(2 * 0.05) + 1e-9
    axes = np.linalg.eigh(np.cov(x.T))[1]
    assert (embedding_dedup._apart(a @ axes, b @ axes) > eps * eps).mean() > 0.5
    i, j, close = embedding_dedup._close(a, b, 0.95, eps, axes)
    want = np.argwhere(a @ b.T >= 0.95).tolist()
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want)) and close == pytest.approx((a @ b.T)[i, j])


def test_embeddings_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "TILE", 2)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(embedding_dedup.near_duplicates(frame).collect())
    more = frame.withColumns({n: F.lit("x") for n in ("node", "root", "links", "copies", "least", "block", "h1", "h2", "cell", "label")})
    assert sorted(embedding_dedup.near_duplicates(more.repartition(7)).collect()) == want
    link = plain_links([np.float32(v).tolist() for _, v in rows])
    assert [r.n_links for r in want] == link.sum(axis=1).tolist()


def test_empty_embeddings(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(frame).count() == 0
    nothing = spark.createDataFrame([(1, None, 0), (None, [0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(nothing).collect()} == {1: (0, 1, True), None: (0, None, False)}


# all


def test_sql(spark, small):
    from compare import connect, rows

    db = connect(small)
    for name, sql in ORACLE_SQL.items():
        assert rows(QUERIES[name](spark, small).toPandas()) == rows(db.sql(sql).df())


def test_clashing_columns_do_no_harm(spark, odd):
    names = ("fp", "least", "root", "component_id", "size", "shard", "slot", "row", "number", "target", "taken", "word", "before", "feature", "score", "kept", "part", "tokens", "base", "at", "ids", "block", "data", "held_out", "lang_pred", "node", "key")
    more = odd.withColumns({n: F.lit("x") for n in names})
    assert simhash.near_duplicates(more).count() == len(ODD)
    assert sharding.shard_documents(more, 3).count() == len(ODD)
    assert mixing.mix(more).count() == len(ODD) and mixing.mixed_documents(more).columns == more.columns
    assert quality.quality_rules(more, more.select("doc_id")).count() == len(ODD)
    assert packing.pack(more, vocabulary()).count() >= len(ODD)
    assert token_files.read_tokens(token_files.write_tokens(more, vocabulary())).count() == len(ODD)
    assert ngram.score(more).count() == len(ODD)
    assert language.identify(more, vocabulary("piece_bpe_32k.model")).count() == len(ODD)
    assert simhash.drop_near_duplicates(more).columns == more.columns


def test_pipeline(spark, small, plain, encode):
    import corpus_pipeline

    docs = kept = table(spark, small, "documents")
    names = kept.columns
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, small).cache()
        by_stage[name] = kept
        assert name == "packing" or kept.columns == names
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in by_stage.items()}
    text = {i: t for i, t, _, _ in plain}
    assert ids["language"] == {i for i, t in text.items() if any(map(str.isalpha, t or ""))}
    base = {i for i in ids["language"] if (n := plain_base(text[i]))[0] >= 20 and 100 * n[4] <= 30 * n[0]}
    assert ids["quality"] <= base and len(ids["quality"]) > 0.8 * len(base)
    fps = {i: plain_fingerprint(text[i]) for i in ids["quality"]}
    label = plain_components(fps.values())
    first = {}
    for i in sorted(fps):
        first.setdefault(label[fps[i]], i)
    assert ids["near_duplicates"] == set(first.values())
    mixed = by_stage["mixing"].collect()
    assert ids["mixing"] <= ids["near_duplicates"]
    assert all(" ".join(WORD.findall(r.text)) == r.text or r.text == text[r.doc_id] for r in mixed)
    pieces = by_stage["packing"].collect()
    assert sum(p.length for p in pieces) == sum(len(encode(r.text)) + 1 for r in mixed)
    assert docs.count() >= len(ids["language"])


def test_texts_of_other_languages_are_rejected(spark, small):
    import corpus_pipeline

    strange = [
        (-1, "Всеобщая декларация прав человека. Все люди рождаются свободными и равными в своем достоинстве и правах"),
        (-2, "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており"),
        (-3, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto"),
        (-4, "Zbigniew"),
        (-5, "The committee adopted a resolution yesterday"),
    ]
    docs = table(spark, small, "documents")
    more = docs.unionByName(spark.createDataFrame(strange, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, more, small).select("doc_id").collect()}
    assert {i for i in kept if i < 0} == {-4, -5}
    assert kept >= {r.doc_id for r in docs.where("text rlike '[a-z]'").select("doc_id").collect()}


def test_the_rest_works_without_this_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    names = json.loads(out.stdout)
    assert "diff_events" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    for path in (root / "driftline").rglob("*.py"):
        assert "llm" in path.parts or "driftline.llm" not in path.read_text()



def test_every_trusted_document_counts(spark):
    """Beyond 20,000 trusted documents the rest was left out."""
    from driftline.llm import quality

    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    raw, target = quality.count_features(docs, docs.select("doc_id"))
    assert sum(raw) == sum(target) == 20_500


def test_only_texts_that_may_be_trusted_are_shuffled(spark, monkeypatch):
    """All texts were shuffled to meet the ids once these were too many to broadcast, and none before."""
    from driftline.llm import quality

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") % k) for k in range(3, 28)]).alias("text"))
    seen, written = [], quality.written
    monkeypatch.setattr(quality, "written", lambda df, name: seen.append(df) or written(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            seen.clear()
            assert quality.quality_rules(docs, docs.where("doc_id % 100 = 0")).count() == 20_000
            assert seen[0].count() < 300
            plan = seen[0]._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_target_does_not_depend_on_the_sieve(spark, monkeypatch):
    from driftline.llm import quality

    rows = [(i % 90, " ".join(f"w{(i * j) % 13}" for j in range(i % 40))) for i in range(300)] + [(None, "a b a"), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [*range(0, 90, 7), 0, 7, None, 1000]
    good = [t or "" for i, t in rows if i is not None and i in ids]
    size = lambda texts: sum(max(0, 2 * len(t.split()) - 1) for t in texts)
    found = []
    for places in (quality.PLACES, 64, 128):  # hardly one, nearly all, and some documents pass by chance
        for kind in ("long", "int"):
            monkeypatch.setattr(quality, "PLACES", places)
            found.append(quality.count_features(docs, spark.createDataFrame([(i,) for i in ids], f"doc_id {kind}")))
    assert all(x == found[0] for x in found)
    assert (sum(found[0][0]), sum(found[0][1])) == (size(t or "" for _, t in rows), size(good))
