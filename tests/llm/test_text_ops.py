"""Language ID, chat, extraction, quality: held-out accuracy, round trips, small cases."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, html_extract, langid, weaklabel

DOC = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, rest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "own", "x") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.train(spark.read.parquet(f"{sf}/documents.parquet").where(~langid.is_held_out()))


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op1_language_id(spark, sf)
    assert got.count() == d.count()
    held = got.where("held_out").join(d, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_small_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the of and " * 5), (4, "the of and " * 5), (None, "der die und"), (6, "x" * 5000), (7, "日本語"), (8, "the " * 60_000)]
    got = langid.identify(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    by = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got]
    assert all(p == "und" and s == 0 for i, p, s in by if i in (1, 2, 3))
    assert [p for i, p, _ in by if i == 4] == ["en", "en"] and all(0 <= s <= 1 for _, _, s in by)
    assert langid.identify(docs(spark, []), model).count() == 0
    none = langid.train(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, rows), none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab"])}
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.3, 0.2], [0.2, 0.3], [0.1, 0.1]])
    m = langid.Model(vocab, ["x", "y"], prob)

    def brute(s, k):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            pieces, at = [], 0
            for i, c in enumerate(cuts):
                if c:
                    pieces.append(s[at : i + 1])
                    at = i + 1
            pieces.append(s[at:])
            p = 1.0
            for x in pieces:
                p *= prob[vocab[x], k] if x in vocab else m.UNKNOWN if len(x) == 1 else 0.0
            total += p
        return np.log(total)

    words = ["ab", "aab", "b", "abab", "acb", "ab"]
    got = m.log_words(words)
    assert np.allclose(got, [[brute("▁" + w, k) for k in (0, 1)] for w in words])


def test_expected_uses_of_pieces():
    vocab = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab"])}
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.3, 0.2], [0.2, 0.3]])
    words, counts = ["▁ab", "▁a", "▁abab", "acb"], np.array([[2.0, 1.0], [1.0, 0.0], [0.0, 3.0], [1.0, 1.0]])
    want = np.zeros((5, 2))
    for w, n in zip(words, counts):
        uses, total = np.zeros((5, 2)), np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(w)]
            pieces = [w[a:z] for a, z in zip(at, at[1:])]
            if any(x not in vocab and len(x) > 1 for x in pieces):
                continue
            p = np.prod([prob[vocab[x]] if x in vocab else [langid.Model.UNKNOWN] * 2 for x in pieces], axis=0)
            total += p
            for x in pieces:
                if x in vocab:
                    uses[vocab[x]] += p
        want += n * uses / total
    assert np.allclose(langid.Lattice(words, vocab).expected(prob, counts), want)


@given(st.text(alphabet="<|\\>im_endstart \n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    segment, lo, hi, _ = chat.render(text, [{"kind": "text", "text": text}])
    assert chat.unescape(segment[lo:hi]) == text
    assert segment.count("<|") == 2
    # two turns, read back in pieces that end anywhere
    reader, got, whole = chat.Reader(), [], segment * 2
    spans = [(lo, hi), (len(segment) + lo, len(segment) + hi)]
    for k in range(0, len(whole), 7):
        got += reader.feed(whole[k : k + 7], spans if k == 0 else ())
    reader.close()
    assert got == [(text, text, [text])] * 2


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (1, 1, "assistant", "b<|im_end|>"), (None, 0, "assistant", "z"), (2, None, None, ""), (chat.PROBE and -1, 0, "user", chat.PROBE)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, None, -1} and got[1]["n_turns"] == 3
    want = "user\n\n" + "assistant\nb<|im_end|>\n" * 2
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"b<|im_end|>" * 2).hexdigest() and got[1]["loss_chars"] == 22
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("text", "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, text {chat.PARTS}")
    r = chat.format_turns(df, tokenizer=public_tokenizers.path("byte_bpe_50k.json")).orderBy("turn").collect()
    assert r[0]["segment"] == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|>end<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r[0]["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 25), ("document", "c.pdf", 1536)]
    assert r[0]["tokens"] == 4 + 25 + 1536 + sum(map(chat.counter(public_tokenizers.path("byte_bpe_50k.json")), ("see <|image|>", "end"))) and r[1]["loss_start"] == r[1]["loss_end"]
    odd = [{"kind": "video", "ref": "v"}, None, {"kind": "image", "width": -56, "height": 0}, *({"kind": "audio", "seconds": x} for x in (float("nan"), float("inf"), -1.0, None)), {"kind": "document", "pages": -3}]
    flat = chat.flatten(odd)
    assert [(a["kind"], a["tokens"]) for a in flat.attachments] == [("unknown", 0), ("image", 1), *[("audio", 1)] * 4, ("document", 512)]
    assert "".join(flat.pieces) == "<|unknown|><|image|>" + "<|audio|>" * 4 + "<|document|>"


def test_reader_refuses_what_is_not_formatted():
    for bad in ("x" + chat.START + "user\nhi" + chat.END + "\n", chat.START + "user\nhi"):
        with pytest.raises(ValueError):
            reader = chat.Reader()
            list(reader.feed(bad))
            reader.close()


def test_chat_of_whole_table(spark, sf):
    """All conversations against a formatting and reading of their own, conversation by conversation."""
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()] + [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(r[1:] for r in rows if r[0] == conv)
        said = "".join(t for _, role, t in turns if role == "assistant")
        chars = sum(len(f"<|im_start|>{role}\n{t}<|im_end|>\n") + t.count("<|") for _, role, t in turns)
        want[conv] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), chars)
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.op3_chat_format(spark, sf).collect()}
    assert got == want


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>menu words here</a></ul></nav>
<div class="ad">buy this now please do</div><article><h1>Big &amp; bold</h1><p>One  two
three.<p>Four <b>five</b> six <div class="ad-banner">an advert inside of the article that is long</div><p>x &lt; y<br>z</p>
<section class="comments"><p>first comment</p></section><form><p>your name</p></form></article><footer>&copy; foot</footer></body>"""


def test_extraction_cases(spark):
    text = html_extract.extract(PAGE)
    assert text == "Big & bold\nOne two three.\nFour five six\nx < y z"
    for odd in (None, "", "<nav>only menu</nav>", "<!-- open", "<script>x"):
        assert html_extract.extract(odd) == ""
    assert html_extract.extract("plain words") == "plain words" and html_extract.extract("a < b") == "a < b"
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (3, "v", "<p>" + "word " * 200_000, "t")], "page_id long, url string, html string, text string")
    rows = html_extract.extract_pages(df, html_extract.learn(df)).collect()
    assert len(rows) == 4 and sorted(r["n_chars"] for r in rows) == sorted([0, len(text), len(text), 999_999])
    assert html_extract.extract_pages(df.limit(0), html_extract.learn(df.limit(0))).count() == 0


ARTICLE = "<p>" + "A long story of many words is told in here. " * 6 + "</p>"
STORY = ("A long story of many words is told in here. " * 6).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="layout no-sidebar">{ARTICLE}</div>', STORY),
        (f'<div class="social-science">{ARTICLE}</div>', STORY),
        (f'<article>{ARTICLE}</article><section class="comments"><article class="comment"><p>{"I do not agree with that at all. " * 30}</p></article></section>', STORY),
        (f'<main>{ARTICLE}<section id="comment-list"><article><p>first</p></article></section></main>', STORY),
        (f'<article>{ARTICLE}</article><aside><article><p>{"Read one more thing that is not of here. " * 30}</p></article></aside>', STORY),
        (f'<article>{ARTICLE}<p>a <math><mi>x</mi></math> b <object>c</object> <canvas>d</canvas></p><xmp>e <b> f</xmp></article>', STORY + "\na x b c d\ne <b> f"),
        (f'<div class="widget">{ARTICLE}</div>', STORY),
        (f'<form action="/"><div><article>{ARTICLE}<form><p>your name</p></form></article></div></form>', STORY),
        (f'<div class="content-sidebar-wrap"><main>{ARTICLE}</main><div class="blog-sidebar">{"old posts " * 80}</div></div>', STORY),
        (f'<article>{ARTICLE}</article><div class="post-comments">{"I do not agree at all. " * 60}</div><ul class="social-share-icons"><li>share this</ul>', STORY),
        (f'<div class="sidebar left">{"menu word " * 50}</div><div class="cookie-notice">{"we use cookies " * 50}</div>{ARTICLE}<div id="footer">{"imprint " * 90}</div>', STORY),
    ],
)
def test_extraction_of_odd_pages(page, want):
    labelled = html_extract.observe(f"<nav><a>x y</a></nav><div class='w'><article>{ARTICLE * 3}</article></div><ul><li>a<li>b</ul>")
    tokens = {t for t, _ in labelled}
    learned = html_extract.weights_of({t: (labelled[t, True] + labelled[t, False], labelled[t, True]) for t in tokens})
    assert learned.word > 0 and learned.costs["li"] > learned.costs["p"]
    for weights in (html_extract.DEFAULT, learned):
        assert html_extract.extract(page, weights) == want


def test_extraction_of_whole_table(spark, sf):
    import html
    import re

    def brute(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        lines = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", p.replace("<b>", "")))).strip() for p in re.split("</?(?:p|h1)>", inner))
        return "\n".join(x for x in lines if x)

    want = {r["page_id"]: brute(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in html_extract.op4_html_extract(spark, sf).collect()} == want


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = weaklabel.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = got.count()
    assert got.where(F.col("keep").cast("int") == F.col("quality")).count() >= 0.97 * n
    assert got.where("quality = 1 and not keep").count() <= 0.01 * n


def test_label_model_is_plain_em():
    """Against EM over single documents, and against the accuracies that made the votes."""
    rng = np.random.default_rng(2)
    k, n = len(weaklabel.LABELLERS), 3000
    good = rng.random(n) < 0.8
    truth = np.array([[rng.dirichlet([6, 3, 3]), rng.dirichlet([0.3, 2, 12])] for _ in range(k)])
    votes = [tuple(int(rng.choice(3, p=truth[j, int(g)])) - 1 for j in range(k)) for g in good]
    model = weaklabel.fit_labels(Counter(votes), rounds=20)
    acc, prior = np.tile([[0.4, 0.3, 0.3], [0.02, 0.18, 0.8]], (k, 1, 1)), 0.7
    for _ in range(20):
        p = []
        for v in votes:
            a = [np.prod([acc[j, c, x + 1] for j, x in enumerate(v) if x]) for c in (0, 1)]
            p.append(prior * a[1] / (prior * a[1] + (1 - prior) * a[0]))
        new = 0.01 * n * np.tile([[0.4, 0.3, 0.3], [0.02, 0.18, 0.8]], (k, 1, 1))
        for q, v in zip(p, votes):
            for j, x in enumerate(v):
                new[j, 1, x + 1] += q
                new[j, 0, x + 1] += 1 - q
        acc, prior = new / new.sum(2, keepdims=True), float(np.clip(np.mean(p), 0.02, 0.98))
    assert np.allclose(model.accuracy, acc) and abs(model.prior - prior) < 1e-9
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.accuracy - truth)[:, :, 0].max() < 0.12


def test_quality_small_cases(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000), (None, "A fine line of words. Another fine one.")])
    rows = weaklabel.classify(d, *weaklabel.train(d)).collect()
    assert len(rows) == 5 and [r["score"] for r in rows if r["doc_id"] in (1, 2)] == [0.0, 0.0]
    empty = docs(spark, [])
    assert weaklabel.classify(empty, *weaklabel.train(empty)).count() == 0
