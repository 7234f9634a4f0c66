"""Main-text extraction as a maximum-scoring subsequence.

A page is a sequence of words, tags and class names. Words score positive, tags
and class names negative; one linear scan finds the contiguous stretch with the
largest sum, which is widened to whole blocks. The weights are log-odds from
labelled pages, those that mark their content by an ``article`` or ``main`` element:
how much more often a token stands inside of the content than elsewhere. Elements
that never hold content (menus, adverts, forms, comments and what lies in them) are
dropped wherever they stand; their words cost a little.

An element is dropped by its name, its role, or a class or id that is a word of
``NOISE_WORDS``, alone or with words of ``PLACE_WORDS`` (``sidebar-left``, not
``no-sidebar``). A ``main`` counts wherever it stands, an ``article`` inside of a form
too. If nothing at all is left of a page, it is scanned once more
without regard to classes and ids.

Defined cases: null or empty html, or html without words outside of dropped
elements, gives an empty text; broken markup (unclosed elements or comments,
stray ``<``) is read as far as it goes; a page of any length is read whole; repeated
rows and rows without an id are each extracted; an empty table gives no rows; extra
columns are ignored, whatever their names. ``br`` and table cells count as white
space inside a block.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, bounded_rows, table

# Element and class names with a meaning in HTML and in common page templates.
RAW = "script style noscript template iframe svg title textarea select".split()
LITERAL = "xmp"  # its content is text, tags included
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul xmp".split())
DROPPED = frozenset("head nav footer aside form button menu dialog".split()) | frozenset(RAW)
NOISE_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split())
PLACE_WORDS = frozenset("all alert area article articles author bar blog block body bottom box button buttons column container content count desktop email entry facebook fixed floating form gdpr global google group head header heading holder icon icons image inner item items leave left link links list load mail main mobile more new news outer page panel post posts primary reader readers replies reply right row secondary section show signup site slot sticky story text the thread this title top twitter unit user users video web wrap wrapper your".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join([*RAW, LITERAL]) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(.*?)(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Weights:
    """``word``: gain of a word; ``noise_word``: cost of one in a dropped element; ``costs`` of tags by name and of classes by ``.name``."""

    word: float = 1.0
    noise_word: float = 0.02
    costs: dict[str, float] = field(default_factory=dict)
    unseen: float = 1.0


#: What pages are scored by where no labelled page is there to learn from.
DEFAULT = Weights(costs=dict.fromkeys("p b i em strong span br h1 h2 h3 h4 h5 h6 blockquote pre code sup sub u small a ul ol li dl dt dd table thead tbody tr td th figure figcaption img picture source hr".split(), 0.1) | dict.fromkeys("nav aside form footer script style button".split(), 0.5))
#: Tags that text is made of: pages that happen not to use them inside of their content don't make them costly.
INLINE = frozenset("p b i em strong span br h1 h2 h3 h4 h5 h6 blockquote pre code sup sub u small a ul ol li dl dt dd table thead tbody tr td th figure figcaption img picture source hr".split())


@dataclass(slots=True)
class Run:
    """A text run with the block it lies in."""

    text: str
    block: int
    words: int
    noise: bool
    inside: bool


def _classes(tag: str) -> tuple[list[str], list[str]]:
    names, roles = [], []
    for key, value in _ATTRIBUTE.findall(tag):
        values = value.strip("\"'").lower().split()
        (roles if key.lower() == "role" else names).extend(values)
    return names, roles


def is_noise(name: str) -> bool:
    """Whether a class or id says that an element holds no content: a noise word, with words of places at most."""
    parts = {x for x in re.split(r"[^a-z]+", name) if x}
    if "sidebar" in parts and not parts.isdisjoint(("content", "main")):  # a frame around both
        return False
    return not parts.isdisjoint(NOISE_WORDS) and parts <= NOISE_WORDS | PLACE_WORDS


def scan(html: str, by_class: bool = True):
    """Yields ``Run``s and ``(tokens, inside, noise)`` for tags, in page order; tokens are a tag's name and its classes."""
    stack: list[tuple[str, int, bool]] = []  # name, noise (1: a form only), inside content
    block, noise, inside = 0, 0, False
    for m in _TOKEN.finditer(html):
        token = m.group()
        if token[0] != "<" or token == "<":
            text = entities.unescape(token) if "&" in token else token
            yield Run(text, block, len(text.split()), noise > 0, inside)
            continue
        if m[1]:
            if m[1].lower() == LITERAL:
                yield Run(m[2], block + 1, len(m[2].split()), noise > 0, inside)
                block += 2
            continue
        if token.startswith(("<!", "<?")):
            continue
        named = _NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        if name in BLOCK:
            block += 1
        elif name in ("br", "td", "th"):
            yield Run(" ", block, 0, noise > 0, inside)
        if token[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            was, (noise, inside) = noise > 0, (stack[-1][1], stack[-1][2]) if stack else (0, False)
            yield (name,), inside, was
            continue
        if name in VOID or token.endswith("/>") and name not in BLOCK:
            yield (name,), inside, noise > 0
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            noise, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        classes, roles = _classes(token) if "=" in token else ([], [])
        was = inside
        if name in DROPPED or name == "header" and not inside or name not in ("html", "body") and (by_class and any(map(is_noise, classes)) or not NOISE_ROLES.isdisjoint(roles)):
            noise = max(noise, 1 if name == "form" else 2)
        elif name == "main" or name == "article" and noise < 2:  # a form or a frame may hold the whole page
            noise, inside = 0, True
        stack.append((name, noise, inside))
        yield (name, *(f".{c}" for c in classes)), was, noise > 0


def observe(html: str) -> Counter:
    """How often each token and words (the token ``""``) stand inside and outside of a labelled page's content."""
    seen: Counter = Counter()
    for x in scan(html):
        if isinstance(x, Run):
            seen["", x.inside and not x.noise] += x.words
        else:
            for token in x[0]:
                seen[token, x[1] and not x[2]] += 1
    return seen


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", most_pages: int = 5000, least: int = 5, most_tokens: int = 1_000_000) -> Weights:
    """Weights from at most ``most_pages`` labelled pages, those whose ids have the smallest hashes.

    Tokens that occur fewer than ``least`` times are taken as unseen; more than
    ``most_tokens`` others are an error.
    """
    rows = pages.select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{html_col}`").cast("string").alias("t"))
    rows = rows.where(F.col("t").rlike(r"(?i)<(article|main)\b"))
    ids = rows.select("h", "i").orderBy("h", "i").limit(most_pages)
    chosen = rows.join(F.broadcast(ids.distinct()), ["h", "i"], "left_semi").select("t")

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for html in b.column(0).to_pylist():
                seen.update(observe(html))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["token", "inside", "n"])

    counted = chosen.mapInArrow(run, "token string, inside boolean, n long").groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("k"))
    rows = bounded_rows(counted.where((F.col("n") >= least) | (F.col("token") == "")), most_tokens, "tokens of labelled pages")
    return weights_of({token: (n, k) for token, n, k in rows})


def weights_of(counts: dict[str, tuple[int, int]]) -> Weights:
    """Log-odds of each token's (occurrences, those inside): a word's is a gain, any other token's a cost.

    Words gain a little and tags cost a little whatever the pages say.
    """
    inside, total = (sum(c[k] for c in counts.values()) for k in (1, 0))
    if not inside or not counts.get("", (0, 0))[1]:
        return DEFAULT
    odds = {t: math.log((k + 0.5) / (inside + 1.0)) - math.log((n - k + 0.5) / (total - inside + 1.0)) for t, (n, k) in counts.items()}
    word = max(0.1, odds.pop(""))
    costs = {t: max(0.1 * word, -w) if t not in INLINE else min(max(0.1 * word, -w), 0.5 * word) for t, w in odds.items()}
    return Weights(word=word, noise_word=0.02 * word, costs={t: c * word for t, c in DEFAULT.costs.items()} | costs, unseen=word)


def extract(html: str | None, weights: Weights = DEFAULT) -> str:
    """The text of the best stretch, its blocks joined by newlines."""
    if not html:
        return ""
    return _best(scan(html), weights) or _best(scan(html, by_class=False), weights)


def _best(tokens, weights: Weights) -> str:
    runs: list[Run] = []
    total, start, best, span = 0.0, 0, 0.0, None
    costs, unseen, gain = weights.costs, weights.unseen, weights.word
    for x in tokens:
        if isinstance(x, Run):
            if x.noise:  # dropped in any case: a long one within the content must not cut it in two
                total -= weights.noise_word * x.words
            else:
                if total <= 0 and x.words:
                    total, start = 0.0, len(runs)
                total += gain * x.words
                runs.append(x)
                if total > best and x.words:
                    best, span = total, (start, len(runs) - 1)
        elif not x[2]:
            # of classes only those count that labelled pages have; within marked content a tag costs little
            cost = sum(costs.get(t, unseen if t[0] != "." else 0.0) for t in x[0])
            total -= min(cost, 0.1 * gain) if x[1] else cost
    if span is None:
        return ""
    first, last = runs[span[0]].block, runs[span[1]].block
    blocks: dict[int, list[str]] = {}
    for r in runs:
        if first <= r.block <= last:
            blocks.setdefault(r.block, []).append(r.text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, weights: Weights, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars (code points)."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for b in batches:
            texts = [extract(h, shared.value) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages))
