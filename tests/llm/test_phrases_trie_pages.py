"""Phrases, the conversation trie and article texts against brute force."""

import collections
import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tidebar.llm import dom, phrases, trie, wrappers

# -- phrases ---------------------------------------------------------------------------------


def brute_phrases(docs, least=10, longest=3, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = collections.defaultdict(int)
    for p, a in found.items():
        w = p[1:]
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[p[0], *w[i : i + n]] = max(inside[p[0], *w[i : i + n]], a)
    rows = collections.defaultdict(list)
    for p, a in found.items():
        if 100 * inside[p] >= 50 * a and inside[p]:
            continue
        cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        rows[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[p[0], *p[k + 1 :]]))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
            for lang, found in rows.items() for i, x in enumerate(sorted(found)[:top])}


def phrase_docs():
    rng = random.Random(3)
    words = "the of and a in new york city ÀB éa big dog x\x00y \xa0 😀".split(" ")
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "\n", "\t ", "!?"]) for _ in range(n))
    docs = [(rng.choice(["en", "de", None, "und", ""]), prose(rng.randint(0, 60))) for _ in range(120)]
    docs += [("en", None), ("en", ""), (None, None), ("en", "..!!\n\n"), ("fr", "new york city " * 40), ("fr", "New York " * 5 + ". York City"),
             ("one", "word"), ("en", "a b " * 4000)]
    return docs + docs[:30]


@pytest.mark.parametrize("longest, shard", [(3, 400), (3, 5_000_000), (4, 2000), (2, 300)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, shard):
    docs = phrase_docs()
    df = spark.createDataFrame([(x, t, 1, "z") for x, t in docs], "lang string, text string, phrase int, n string").repartition(3)
    original = phrases.index_shards
    monkeypatch.setattr(phrases, "index_shards", lambda d, k: original(d, k, shard))
    got = [tuple(r) for r in phrases.collocations(df, longest=longest).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(docs, longest=longest)
    few = {tuple(r) for r in phrases.collocations(df, longest=longest, top=3).collect()}
    assert few == brute_phrases(docs, longest=longest, top=3)


def test_collocations_of_nothing(spark):
    schema = "lang string, text string"
    for rows in ([], [(None, None)], [("en", " ")], [("en", "once only")]):
        assert phrases.collocations(spark.createDataFrame(rows, schema)).collect() == []


def test_intervals_extend_both_ways():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") + rng.choice(["", "", "."]) for _ in range(150)) for _ in range(4)]
    want = collections.Counter()
    for t in texts:
        for p in t.split("."):
            w = p.split()
            want.update(tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    index = phrases.BidirectionalIndex.of([t.encode() for t in texts], 4)
    for sides in product([True, False], repeat=4):
        now = index.single()
        for n, left in enumerate(sides, 2):
            now = index.extend(now, left, more=True)
            got = {tuple(index.words[i - 1].decode() for i in w): s for w, s in zip(now.words, now.size)}
            assert got == {k: v for k, v in want.items() if len(k) == n}


def test_products_beyond_64_bits(spark):
    """Counts of 3e9 stand in for a corpus: 1e6 a a and l r need more than 64 bits."""
    a, l, r = 3_000_000_001, 4_000_000_007, 5_000_000_009
    counts = spark.createDataFrame([("en", 0, "", l + r), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, size int, phrase string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "index_shards", lambda d, k: d)
        m.setattr(phrases, "count_phrases", lambda i, a, b: counts)
        row = phrases.collocations(counts).first()
    assert row["score"] == 10**6 * a * a // (l * r) and row["n"] == l + r


# -- trie ------------------------------------------------------------------------------------


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, below = {}, {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        own_saved = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        leaves = sum(below[x][0] for x in kids[k]) or 1
        saved = own_saved + sum(below[x][1] for x in kids[k])
        below[k] = leaves, saved
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, depth int, size string"


def check_trie(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS).repartition(parts)
    got = trie.conversation_trie(df).collect()
    found = {(r[0], r[1]): tuple(r)[2:] for r in got}
    assert len(found) == len(got) and found == brute_trie(rows)


def test_trie_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    says = ["hi", "hello", "ok", "né 😀", "", None]
    rows = [(c, rng.choice([None, t]) if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None, "u"]), rng.choice(says))
            for c in [*range(60), *range(-12, 0), 997, 4000, 9001] if rng.random() < 0.9 for t in range(rng.randint(1, 12))]
    rows += rows[40:60] + [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(c, t, "user", "same") for c in range(5000, 5200) for t in range(7)]  # one large group of copies
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE", 16)
    check_trie(spark, rows)


def test_trie_of_a_long_conversation_and_of_ties(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    rows = [(10, t, "user", str(t % 3)) for t in range(700)] + [(c, t, "user", str(t % 3)) for c in range(11, 16) for t in range(c)]
    check_trie(spark, rows + [(11, 3, "a", "z"), (11, 3, "a", "a"), (11, 3, "a", "a")], parts=6)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.conversation_trie(empty).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "z")], TURNS)).collect() == []


def test_conversations_without_turns_are_members_of_the_root(spark):
    lonely = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    check_trie(spark, [(lonely, 0, "user", "gone"), (lonely, 1, "user", "gone")])


# -- pages -----------------------------------------------------------------------------------


def article(html):
    return "\n".join(x for _, _, x in dom.parse(html)[1])


@pytest.mark.parametrize("html, want", [
    ("<p>a<p>b", "a\nb"), ("<p>a <b>b</b>\n\t c<br>d</p>", "a b c d"), ("a &amp; b &am", "a & b &am"), ("a < b <", "a < b <"), ("x<a href='", "x"),
    ("<p title='a>b'>c</p>", "c"), ("<p title=it's>c</p>d", "c\nd"), ("<script>if (a<b) '</p>'</script>k", "k"), ("<SCRIPT>x</SCRIPT >k", "k"),
    ("<script>never ends", ""), ("a<!-- b --> c<!-- open", "a c"), ("<!-->a", "a"), ("&#65;&nbsp;&nbsp;B&#0;", "A B�"), ("a</x></p></div>b", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<head><title>t</title><body>k", "k"), ("<nav>m</nav>a", "a"), ("<div class=ad>m</div>a<div class='x sidebar-left'>n</div>", "a"),
    ("<div class='has-sidebar'>a</div>", "a"), ("<header>h</header><article><header>t</header>a</article>", "t\na"), ("<p class=advert>m</p>a", "a"),
    ("p <button>press</button> q", "p q"), ("<svg><title>t</title></svg>a", "a"), ("<form>f</form>", "f"), ("", ""), ("<div>" * 300 + "x", "x"),
    ("<div><p>a</div>b<p>c", "a\nb\nc"), ("a<hr>b", "a\nb"), ("<section id=comments><article>c</article></section>a", "a")])
def test_reading(html, want):
    assert article(html) == want


def test_very_long_pages_stay_linear():
    text = " ".join(f"w{i}" for i in range(50_000))
    assert article("<p>" + "<b>" * 20_000 + text + "</p>") == text
    assert len(dom.parse("<p>x</p>" * 30_000)[1]) == 30_000
    assert dom.parse("<a b='" * 3000)[1] == []
    assert dom.parse("<!--" * 3000)[1] == []


def test_tree_matching():
    tree = lambda *lines: dom.read("\n".join(f"{d} 1 {x}" for d, x in lines))
    a = tree((0, "page"), (1, "div.a"), (2, "t"), (1, "div.b"), (1, "div.c"))
    b = tree((0, "page"), (1, "div.a"), (2, "t"), (1, "div.x"), (1, "div.c"), (2, "t"))
    assert dom.match(a, b) == 4 and dom.match(a, tree((0, "other"))) == 0
    dom.merge(a, b)
    assert [n.label for _, n in dom.preorder(a)] == ["page", "div.a", "t", "div.b", "div.x", "div.c", "t"]
    assert [n.count for _, n in dom.preorder(a)] == [2, 2, 2, 1, 1, 2, 1]


WORDS = [f"w{i}" for i in range(400)]


def plain_site(rng, n, host):
    """Pages of nothing but divs: a constant menu, a varying teaser, the article, a constant imprint."""
    out = []
    for i in range(n):
        body = [" ".join(rng.choices(WORDS, k=rng.randint(15, 60))) for _ in range(rng.randint(2, 6))]
        inner = "".join(f"<p>{x}</p>" for x in body)
        html = (f"<body><div><a href=/>Home</a> <a href=/x>About us</a></div><div><span>{rng.choice(WORDS)} today</span></div>"
                f"<div class=k{i}><p>Terms apply to this text</p>{inner}<p>Write to the editor of {host}</p></div><div>All of it belongs to {host}</div>")
        out.append((f"http://{host}/{i}", html, "\n".join(body)))
    return out


def test_constant_nodes_are_template_and_slots_content(spark):
    rng = random.Random(2)
    pages = plain_site(rng, 30, "a.example") + plain_site(rng, 12, "B.example")
    copy = ("http://c.example/", "<body><div><p>" + " ".join(WORDS[:80]) + "</p><p>again and again</p></div>", " ".join(WORDS[:80]) + "\nagain and again")
    pages += [copy] * 20  # copies of one article are no template
    named = [(f"http://d.example/{i}", f"<nav><ul><li>{WORDS[i]}</ul></nav><main><h1>T{i}</h1><p>{' '.join(WORDS[i : i + 40])}</p>"
              f"<p>Share this article with friends</p></main><aside>{WORDS[-i]}</aside>", f"T{i}\n{' '.join(WORDS[i : i + 40])}") for i in range(12)]
    pages += named + [(None, None, ""), ("x", "", ""), (None, "<p>no host</p>", "no host"), ("http://e.example", "<nav>only a menu</nav>", "")]
    rows = [(i, u, h, "t", 5) for i, (u, h, _) in enumerate(pages)] + [(None, "http://f.example", "<p>null id</p>", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int").repartition(4)
    got = wrappers.extract_articles(df).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == {i: w for i, (_, _, w) in enumerate(pages)} | {None: "null id"}
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.url for r in got}[0] == pages[0][0]


def test_wrappers_merge_in_groups(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP", 4)
    trees = [f"0 1 page\n1 1 div.{c}\n2 1 t\n1 1 div.z" for c in "abcdefghijklmnopq"]
    got = wrappers.induce(spark.createDataFrame([("h", t, 1) for t in trees], "host string, tree string, n long")).collect()
    assert len(got) == 1
    root = dom.read(got[0].wrapper)
    assert root.count == 17 and sorted(n.label for n in root.kids) == sorted([f"div.{c}" for c in "abcdefghijklmnopqz"])
    assert next(n for n in root.kids if n.label == "div.z").count == 17


def test_wrappers_keep_all_nodes(spark):
    trees = ["\n".join(["0 1 page", *(x for b in range(10) for x in (f"1 1 div.s{t}-{b}", *(f"2 1 div.k{k}" for k in range(90))))]) for t in range(5)]
    got = wrappers.induce(spark.createDataFrame([("h", t, 1) for t in trees], "host string, tree string, n long")).collect()
    root = dom.read(got[0].wrapper)
    assert root.size() == 1 + 5 * 10 * 91
    assert sorted(n.label for n in root.kids) == sorted(f"div.s{t}-{b}" for t in range(5) for b in range(10))


def test_pages_of_nothing(spark):
    assert wrappers.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_given_pages_by_their_known_layout(spark):
    """An independent reading of the given pages: what stands in <article>."""
    import html as h

    def plain(x):
        m = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|\Z)", x)
        x = re.sub(r"<[a-zA-Z/][^>]*\Z", "", m[1]) if m else ""
        x = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n", x)))
        return "\n".join(y for y in (" ".join(h.unescape(z).split()) for z in x.split("\n")) if y)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in wrappers.extract_articles(pages).collect()} == want
