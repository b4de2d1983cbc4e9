"""The divergence audit, the lexical search and the extraction against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compval.llm import divergence, extraction, lexical_search

# ---------------------------------------------------------------- divergence


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def audited(rows, least, most):
    """(lang, source, part, item, value, rank), from the definition, in Python's integers."""
    docs = [(lowered(t or ""), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), s) for t, la, s in docs if la == lang]
        df = Counter(w for words, _ in own for w in set(words))
        kept = [w for w, n in df.items() if n >= least]
        sources = sorted({s for _, s in own}, key=str.encode)
        counts = {s: Counter(w for words, x in own if x == s for w in words if df[w] >= least) for s in sources}
        every = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(every)
        for a in sources:
            pairs = sorted(((-sum(abs(p[a][w] - p[b][w]) for w in kept), b.encode()) for b in sources if b != a))
            out += [(lang, a, "pair", b.decode(), -v, i + 1) for i, (v, b) in enumerate(pairs)]
            terms = sorted((q[w] - p[a][w], w.encode()) for w in kept if counts[a][w] and p[a][w] > q[w])[:most]
            out += [(lang, a, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(terms)]
    return sorted(out)


def audit_rows(seed=5):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "ÜBER", "über", "naïve", "x1y", "ß", "中文", "don't", "zed", "Zed", "ω"]
    rows = [(" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 30]))), rnd.choice(["en", "en", None, ""]), rnd.choice(["s1", "s1", "s2", "é", None])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "xx", "only"), ("12 34", "xx", "other"), ("same same", "en", "s1"), ("same same", "en", "s1")]
    return rows + [("long " * 3000 + "tail", "en", "s2")]


def audit_table(spark, rows):
    full = [(7, t, la, s, "x", "y") for t, la, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, term string, n string").repartition(3)


def test_audit_equals_its_definition(spark, monkeypatch):
    rows = audit_rows()
    for least, most in ((1, 50), (3, 2), (200, 50)):
        got = sorted(tuple(r) for r in divergence.audit(audit_table(spark, rows), least, most).collect())
        assert got == audited(rows, least, most)


def test_audit_in_small_chunks_is_the_same(spark, monkeypatch):
    rows = audit_rows(6)
    chunks = list(divergence._chunks(iter([]), {}))
    assert chunks == []
    own = divergence._Lang({"a": 3, "b": 0}, 2)
    terms, counts = own.vectors(np.array([b"a", b"b", b"a"], object), np.array([b"t", b"t", b"s"], object), np.array([1, 2, 3]))
    assert list(terms) == [b"s", b"t"] and counts.tolist() == [[3, 1], [0, 2]]
    assert sorted(tuple(r) for r in divergence.audit(audit_table(spark, rows), 2).collect()) == audited(rows, 2, 50)


def test_audit_of_nothing(spark):
    assert divergence.audit(audit_table(spark, [("a", "en", "s")]).limit(0)).collect() == []
    assert divergence.audit(audit_table(spark, [(None, None, None)])).collect() == []


@given(st.integers(0, 10**15), st.integers(1, 9 * 10**15))
def test_shares_are_exact(count, total):
    count = min(count, total)
    got = divergence.shares(np.array([count], np.int64), np.array([total], np.int64))
    assert got[0] == 1 + 10**9 * count // total


@settings(max_examples=60)
@given(st.text(st.sampled_from("aB 1é中-\t"), max_size=60), st.integers(1, 9))
def test_pieces_part_no_term(text, most):
    got = [t for p in divergence.pieces(text.encode(), most=most) for t in p]
    assert got == [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))]


# ---------------------------------------------------------------- search


def ranked(docs, items, k=20):
    """item -> [(doc_id, score)], from the definition."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t or ""))
    counted = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = {}
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for r, (s, null, i) in enumerate(sorted(scores)[:k]):
            out.setdefault(item, []).append((r + 1, None if null else i, -s))
    return {i: sorted(rows, key=str) for i, rows in out.items()}


def search_docs(seed=9):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "über", "the", "THE", "a-b", "中文"]
    docs = [(i % 90, " ".join(rnd.choices(words, weights=[1] * 40 + [5, 5, 30, 30, 3, 1], k=rnd.choice([0, 1, 4, 40, 200])))) for i in range(150)]
    return docs + [(500, None), (501, "--- !"), (None, "w1 w2 rare"), (None, "w1 w2 rare"), (502, "the " * 5000 + "rare"), (-3, "w1 w2 rare")]


ITEMS = [(1, "w1 w2 rare the the"), (2, "über THE w3 w3 w4"), (2, "über THE w3 w3 w4"), (3, None), (4, "unseen words"), (5, ""), (-1, "the"), (None, "w5 中文 b")]


def searched(spark, docs, items, **how):
    table = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, term string, shard int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    index = lexical_search.build_index(table, **how)
    out = defaultdict(list)
    for r in lexical_search.search(index, asked).collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(rows, key=str) for i, rows in out.items()}


def test_search_equals_its_definition(spark):
    docs = search_docs()
    assert searched(spark, docs, ITEMS) == ranked(docs, ITEMS)


def test_search_does_not_depend_on_shards(spark):
    docs = search_docs(10)
    assert searched(spark, docs, ITEMS, shard_bytes=700) == searched(spark, docs, ITEMS, shard_docs=7) == ranked(docs, ITEMS)


def test_search_in_blocks(spark, monkeypatch):
    docs = search_docs(11)
    monkeypatch.setattr(lexical_search, "BLOCK", 2)
    assert searched(spark, docs, ITEMS) == ranked(docs, ITEMS)


def test_search_of_nothing(spark):
    assert searched(spark, [(1, None), (2, " ")], ITEMS) == {}
    assert searched(spark, [(1, "a b")], [(1, None)]) == {}


@given(st.lists(st.integers(0, 2**62), max_size=50))
def test_packed_numbers_come_back(values):
    data, size = lexical_search.packed(np.array(values, np.int64))
    assert lexical_search.unpacked(data.tobytes()).tolist() == values and size.sum() == len(data)


@settings(max_examples=80)
@given(st.lists(st.tuples(st.dictionaries(st.integers(0, 30), st.integers(0, 20), min_size=1), st.integers(1, 3)), max_size=6), st.integers(1, 5))
def test_pruned_merge_finds_the_best(lists, k):
    given_lists = []
    for places, times in lists:
        p = object.__new__(lexical_search.Postings)
        p.places, p.scores = sorted(places), [places[x] for x in sorted(places)]
        p.most, p.at = max(p.scores), places
        given_lists.append((p, times))
    total = Counter()
    for places, times in lists:
        for x, s in places.items():
            total[x] += s * times
    want = sorted(((-s, x) for x, s in total.items() if s > 0))[:k]
    assert sorted((-s, x) for s, x in lexical_search.best_of_shard(given_lists, k)) == want


# ---------------------------------------------------------------- extraction

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>x</article>";</script></head><body class="has-sidebar">'
    "<header><h1>Site of all</h1></header><nav><ul><li><a href=/>Home page of ours</a><li>More</ul></nav><!-- ad --><div class=ad>Buy now at our shop today</div>"
    "{}<aside>See also</aside><form>Mail <input> <button>Go</button></form><footer>&copy; ours &middot; all rights are reserved</footer></body></html>"
)


def main_text(html):
    return [t for k, t in extraction.blocks(html) if k == extraction.CONTENT]


def test_article_and_its_blocks():
    html = PAGE.format("<article><header><h1>Head &amp line</h1></header><p><b>First  one.<br>Same<p>A &lt; b &amp;amp; c &am</p>\n<ul><li>x<li>y</ul>loose <i>t</i>ext</article>")
    assert main_text(html) == ["Head & line", "First one. Same", "A < b &amp; c &am", "x", "y", "loose text"]


@pytest.mark.parametrize(
    "inside, want",
    [
        ('<p>a</p><div class="comments"><p>Nice</p></div><p>b</p>', ["a", "b"]),
        ('<p>a <span class="ad">buy</span> b</p>', ["a b"]),
        ('<p>a</p><ol><li><article class="comment-body">hi</article></ol>', ["a"]),
        ('<div class="article-header"><h2 id="comment-on">T</h2></div><p>x', ["T", "x"]),
        ("<p>a<p hidden>b</p><p style='display: none'>c</p><p title='x > class=ad'>d</p>", ["a", "d"]),
        ("<table><tr><td>1<td>2</table>1 < 2 <3<p don't>q", ["1", "2", "1 < 2 <3", "q"]),
        ("<p>x</p><script>if (a < b) '</p>'</script ><p>y<!-- <p>no -->z</p><style>q", ["x", "yz"]),
        ("<b><div>one</b> two</div>", ["one two"]),
        ("<p>&#65;&#x42;&nbsp;C&euro;</p>", ["AB C€"]),
        ("", []),
    ],
)
def test_within_an_article(inside, want):
    assert main_text(PAGE.format(f"<article>{inside}</article>")) == want
    assert main_text(f"<article>{inside}") == want


@pytest.mark.parametrize("html", ["<", "<p", "<!--", "<!-- x", "</", "<a b='", "<article><p>x</p><div class='", "<script>", "&", "<p>\0</p>", "<article></p></div>x</article>"])
def test_broken_markup_is_no_fault(html):
    assert all(t.strip() == t and t for _, t in extraction.blocks(html))


@settings(max_examples=150)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<article>", "</article>", "<nav>", "</nav>", "a", " b ", "&lt;", "<br>", "<script>", "</script>", "<!--", "-->", "\n"]), max_size=30))
def test_no_text_is_made_up(parts):
    """The blocks' characters, in order, are among those that another parser sees as text."""

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out = []

        def handle_data(self, data):
            self.out.append(data)

    html = "".join(parts)
    p = Text()
    p.feed(re.sub(r"(?s)<script>.*?(</script>|\Z)", "", re.sub(r"(?s)<!--.*?(-->|\Z)", "", html)))
    p.close()
    if "<!--" not in html and "<script>" not in html and "-->" not in html:
        seen = "".join("".join(p.out).split())
        assert "".join("".join(t.split()) for _, t in extraction.blocks(html)) == seen


def test_reading_is_linear():
    for unit in ("<a b='", "<div", "<!--", "<p><b>", "</div>", "&amp", "<div class=x>"):
        extraction.blocks(unit * 60000)


def repeats(pages, long):
    """Covered blocks of each page, by comparing all runs of blocks of a host."""
    found = [(extraction.host(u), extraction.blocks(h or "")) for _, u, h in pages]
    where = defaultdict(set)
    runs = []
    for n, (host, bl) in enumerate(found):
        own = []
        for i in range(len(bl)):
            j, words = i, 0
            while j < len(bl) and words < long and bl[j][0] != extraction.CONTENT:
                words += len(bl[j][1].split())
                j += 1
            if words >= long:
                own.append((i, j))
                where[host, tuple(t for _, t in bl[i:j])].add(tuple(bl))
        runs.append(own)
    out = []
    for (page_id, url, _), (host, bl), own in zip(pages, found, runs):
        main = [t for k, t in bl if k == extraction.CONTENT]
        covered = {x for i, j in own if len(where[host, tuple(t for _, t in bl[i:j])]) > 1 for x in range(i, j)}
        open_ = [(i, t) for i, (k, t) in enumerate(bl) if k == extraction.OPEN]
        text = main or [t for i, t in open_ if i not in covered] or [t for _, t in open_]
        out.append((page_id, url, "\n\n".join(text), len("\n\n".join(text))))
    return sorted(out, key=repr)


def test_repeated_runs_of_a_host_go(spark):
    say = lambda i: f"<p>Story {i} is about {i * 7} things, told once.</p>"
    notice = "<div><p>We use little</p><p>helpers on this site</p></div>"
    pages = [(i, f"https://a.example/{i}", f"<body>{notice}{say(i)}<p>short</p><div>Read all of our other stories</div>") for i in range(6)]
    pages += [(10, "http://b.example/x", f"<body>{notice}{say(10)}"), (11, None, notice), (None, "http://A.example:80/z", f"{notice}<p>New</p>")]
    pages += [(20, "https://a.example/art", f"<article>{say(1)}</article>{notice}"), (21, "https://a.example/art2", f"<article>{say(1)}</article>{notice}")]
    pages += [(30, "https://c.example/1", say(30)), (31, "https://c.example/2", say(30)), (32, "https://c.example/1", None), (33, "https://c.example/1", "")]
    pages += [(0, "https://a.example/0", pages[0][2])]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, head int").repartition(3)
    got = sorted((tuple(r) for r in extraction.extract(table).collect()), key=repr)
    assert got == repeats(pages, extraction.LONG)
    text = {r[0]: r[2] for r in got}
    assert text[3] == "Story 3 is about 21 things, told once." and text[20] == text[21] == "Story 1 is about 7 things, told once."
    assert text[10].startswith("We use little") and text[32] == text[33] == "" and text[30] == text[31]


def test_extraction_of_nothing(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
