import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from lakeweave.llm import page_text, queries, runs, search
from tests.llm.helpers import corpus, empty, frame

ROWS = corpus(60) + [(None, "no id " * 9, "en", "s", 0), (7, "seven again", "en", "s", 0), (61, None, "en", "s", 0), (62, "É é E e " * 700, "fr", "s", 0)]


# periodic runs


def all_runs(words, least=12):
    """Every maximal stretch that equals itself p words on, with its smallest p."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i - start + p >= max(least, 2 * p):
                found.setdefault((start, i - start + p), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return (text or "").encode().split()


def without_repeats(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            n, kinds = rng.randrange(90), rng.choice([1, 2, 3, 60])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n > 5 and rng.random() < 0.6:
                a, times = rng.randrange(n), rng.randrange(3, 11)
                p = 1 + (n - a) // times
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        for least in (12, 3):
            got = [[] for _ in docs]
            for d, *run in zip(*(x.tolist() for x in runs.find_runs(np.array(sum(docs, []), np.int32), np.array([len(w) for w in docs]), least)), strict=True):
                got[d].append(tuple(run))
            assert got == [all_runs(w, least) for w in docs]


def test_runs_in_pieces_and_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 3, 400), np.arange(300) % 41, rng.integers(0, 900, 100), np.zeros(50, int)]).astype(np.int32)
    want = all_runs(words.tolist())
    monkeypatch.setattr(runs, "_AT_ONCE", 97)
    assert list(zip(*(x.tolist() for x in runs.find_runs(words, np.array([len(words)]))[1:]), strict=True)) == want
    monkeypatch.undo()
    doc, start, length, period = runs.find_runs(np.tile(np.arange(1000, dtype=np.int32), 300), np.array([300_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1000])


def test_periodic_runs(spark):
    clash = frame(spark, ROWS).withColumn("runs", F.lit("theirs")).withColumn("window", F.lit(1))
    got = runs.periodic_runs(clash).collect()
    assert got[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "window", "n_words", "runs", "collapsed"}
    tell = lambda i, n, r, c: (-1 if i is None else i, n, r, c)
    want = []
    for i, text, *_ in ROWS:
        words, found = split(text), all_runs(split(text))
        want.append(tell(i, len(words), found, without_repeats(words, found).decode()))
    assert sorted(tell(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert runs.periodic_runs(empty(spark)).collect() == []


def test_op11_against_brute_force(spark, tmp_path):
    frame(spark, ROWS + [(i, f"a b c {i} d e f g " * 3, "en", "s", 0) for i in range(100, 160)]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = []
    for r in docs:
        words, h = split(r.text), zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"")
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = all_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        rest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(found), *rest, digest, hashlib.sha256(without_repeats(words, found)).hexdigest()))
    assert sorted(map(str, map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


# lexical search


def ranked(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(b), Counter(b)) for i, b in bags if b]
    df, n_docs, total = Counter(t for *_, b in bags for t in b), len(bags), sum(n for _, n, _ in bags)
    out = []
    for item, text in items:
        rows = []
        for i, n, bag in bags:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(x for x in rows if x[0] < 0)[:k])]
    return sorted(map(str, out))


def test_rank_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(r[0], r[1]) for r in ROWS] + [(2**62 + i, "Tie-tie, tie!") for i in range(15)] + [(-5, "w1 w2 negative"), (None, "w1 w1 w1")]
    items = [(i, " ".join(f"W{rng.randrange(400)}," for _ in range(rng.randrange(1, 30)))) for i in range(12)] + [(3, "tie"), (3, "tie"), (None, "é w1"), (90, None), (91, "unknown-term"), (92, " . ")]
    d = frame(spark, docs, "doc_id long, text string").withColumn("window", F.lit(1)).withColumn("rank", F.lit("x"))
    q = frame(spark, items, "item_id long, text string").withColumn("row", F.lit(1)).withColumn("terms", F.lit(1))
    want = ranked(docs, items)
    assert sorted(str(tuple(r)) for r in search.rank(d, q).collect()) == want
    monkeypatch.setattr(search, "SLOTS", 64)  # many windows, some of them crowded, and items in several blocks
    assert sorted(str(tuple(r)) for r in search.rank(d, q, most_terms=60).collect()) == want
    assert sorted(str(tuple(r)) for r in search.rank(d, q, k=3).collect()) == ranked(docs, items, 3)


def test_rank_of_nothing(spark):
    docs, items = frame(spark, [(1, "a b")], "doc_id long, text string"), frame(spark, [(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in search.rank(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 800)))]
    assert search.rank(docs.where("false"), items).collect() == [] == search.rank(docs, items.where("false")).collect()
    assert search.rank(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


# main text of pages


class Reader(HTMLParser):
    """Plain reading of simple pages: text of the blocks in ``article``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.off = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.off += tag in ("nav", "aside", "script", "style")
        self.blocks += [""] if tag in ("p", "h1", "li", "div", "td") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.off -= tag in ("nav", "aside", "script", "style")
        self.blocks += [""] if tag in ("p", "h1", "li", "div", "td") else []

    def handle_data(self, data):
        if self.inside > 0 and not self.off:
            self.blocks[-1] += data


def plainly(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n\n".join(" ".join(b.split()) for b in reader.blocks if b.split())


def article(i, rng):
    parts = [f"<p>{html.escape(' '.join(rng.choice(['über', 'a&b', 'x<y', 'word', 'one  two']) for _ in range(rng.randrange(3, 20))))}{i}<br>more</p>" for _ in range(rng.randrange(1, 5))]
    return f"<h1>T {i} &amp; &eacute;</h1>" + "".join(parts) + rng.choice(["", "<ul><li>eins<li><b>zw</b>ei</ul>", "<table><tr><td>1<td>2</table>", "<script>if(a<b){'</p>'}</script>", "<!-- <p>x</p> -->", "<div><p>open"])


def page(i, rng, body=None):
    menu = "".join(f'<li><a href="/{k}">m{k}</a></li>' for k in range(5))
    return f"<!DOCTYPE html><html><head><title>t{i}</title></head><body class='has-sidebar'><header>Site</header><nav><ul>{menu}</ul></nav><div class='ad box'>Buy {i}!</div><article>{body or article(i, rng)}</article><section id='comments'><p>First!</p></section><footer>&copy; {i}</footer>" + rng.choice(["</body></html>", ""])


def test_marked_pages_against_a_plain_reader(spark):
    rng = random.Random(5)
    rows = [(i, f"https://{'www.' if i % 3 else ''}host{i % 3}.example/{i % 7}/{i}.html?x={i}", page(i, rng, "<p>the same</p><p>in all</p>" if i % 5 == 0 else None)) for i in range(150)]
    rows += [(200, None, rows[1][2]), (None, None, None), (None, "", ""), (201, "http://host1.example/", None), *rows[:3]]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("theirs")).withColumn("block", F.lit(0))
    want = sorted(str((i, u, t := plainly(h or ""), len(t))) for i, u, h in rows)
    assert sorted(str(tuple(r)) for r in page_text.main_text(pages).collect()) == want
    assert page_text.main_text(pages.where("false")).collect() == []


def test_unmarked_pages_lose_what_neighbours_share(spark, monkeypatch):
    """Brute force: all pages of a host in order, each held against the one whose path is more alike."""
    monkeypatch.setattr(page_text, "BLOCK", 4)
    rng = random.Random(6)
    top, low = ["Home | News | About", "Our motto"], ["Read more", "All rights reserved"]
    rows, lines = [], {}
    for i in range(60):
        own = [f"line {i} {k} of its own" for k in range(rng.randrange(1, 4))] + rng.sample(["a common passage", "another one"], rng.randrange(3))
        host = "h0" if i % 3 else f"h{i % 9}"
        lines[i] = [*top, *own, *low]
        if i in (30, 31):
            lines[i] = lines[29]  # copies
        rows.append((i, f"http://{host}/{rng.choice('abc')}/{rng.randrange(1000):03}", "".join(f"<div>{x}</div>" for x in lines[i])))

    def common(a, b):
        best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                best[x + 1][y + 1] = (*best[x][y], x) if a[x] == b[y] else max(best[x][y + 1], best[x + 1][y], key=len)
        return set(best[-1][-1])

    want = {}
    order = sorted((*page_text.place(u), i) for i, u, _ in rows)
    for at, (host, path, i) in enumerate(order):
        near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and order[j][0] == host]
        near.sort(key=lambda x: -len([1 for k in range(min(len(path), len(x[1]))) if path[: k + 1] == x[1][: k + 1]]))
        want[i] = lines[i]
        for _, _, j in near:
            shared = common(lines[i], lines[j])
            if len(shared) < len(lines[i]):
                want[i] = [x for k, x in enumerate(lines[i]) if k not in shared]
                break
    got = page_text.main_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n\n".join(x) for i, x in want.items()}
    assert sum("Our motto" in r.text for r in got) < 10


def test_awkward_markup():
    said = lambda p: "\n".join(x.text for x in page_text.page_lines(p))
    assert said("a < b &amp; c&nbsp; d<br>e") == "a < b & c d e"
    assert said('<p>one<script>if (a<b && "x") {}</script>two<li>x<li>y') == "onetwo\nx\ny"
    assert said("<div class='postComments'>c</div><div hidden>h</div><div style='display: none'>n</div><div role=navigation>m</div>t") == "t"
    assert said("<form><header>x</header><main>q</main></form><article><div class='article-header'><h2>T</h2></div><footer>f</footer>z</article>") == "q\nT\nz"
    assert said("<p>x<span class='ad'>buy</p><p>y") == "x\ny"
    assert said("<p") == said("<!-- x") == said("<script>x") == "" and said("<") == "<"
    assert said("<p>" + "<b>x</b> " * 50_000).count("x") == 50_000
    assert page_text.main_lines(page_text.page_lines("<article><p>own</p><p>shared</p><a href=/>Next page</a></article>"), [page_text.page_lines("<p>shared</p><a>Next page</a>")]) == ["own", "shared"]
