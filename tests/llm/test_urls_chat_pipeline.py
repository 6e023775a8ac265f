"""URL filter, chat format and the pipeline."""

import hashlib
import os
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from tidebar.llm import chat, queries, urls

SF = "/root/testdata/sf0.001"


# -- urls ------------------------------------------------------------------------------------


def brute_page(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def brute_verdicts(pages, ratio=3.0, damping=0.85, rounds=150):
    links, seeds = {}, {"trust": {}, "distrust": {}}
    for _, url, html in pages:
        host, _, _, verdict = brute_page(url)
        if host and verdict:
            kind = "trust" if verdict == "allow" else "distrust"
            seeds[kind][host] = seeds[kind].get(host, 0) + 1
        for m in re.finditer(r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)""", html or ""):
            if host and host != m[1].lower():
                links[host, m[1].lower()] = links.get((host, m[1].lower()), 0) + 1
    scores = {}
    for kind, start in seeds.items():
        edges = [(a, b, n) if kind == "trust" else (b, a, n) for (a, b), n in links.items()]
        out = {}
        for a, _, n in edges:
            out[a] = out.get(a, 0) + n
        now = dict(start)
        for _ in range(rounds):
            nxt = {h: x * (1 - damping) for h, x in start.items()}
            for a, b, n in edges:
                if a in now:
                    nxt[b] = nxt.get(b, 0) + damping * now[a] * n / out[a]
            now = nxt
        scores[kind] = now
    bad = {h for h, d in scores["distrust"].items() if d > 0 and d >= ratio * scores["trust"].get(h, 0)}
    out = {}
    for i, url, _ in pages:
        host, path, rule, verdict = brute_page(url)
        out[i] = (host, path, rule, verdict or ("block" if host in bad else "allow"))
    return out


def random_pages():
    rng = random.Random(4)
    hosts = [f"h{i}.{d}" for i in range(25) for d in ("net", "com", "example.org", "NET")] + ["example.org", "org", "xexample.org"]
    rows = [(0, None, None), (1, "no scheme/de/", "x"), (2, "http://", ""), (3, "x://A.Com/de/?/fr/", None), (4, "http://a.com?x://b.org/", "<a href=>"),
            (5, "http://org/", ""), (6, "http://example.org/en/12#q", ""), (7, "http://sub.example.org/es/", ""), (8, "a://b://c", ""), (9, "\n://É.com/fr/\n?", "")]
    for i in range(10, 400):
        links = "".join(f'<a HREF="{rng.choice(["https:", ""])}//{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, 3))) + '<a href="/rel">'
        rows.append((i, f"https://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'es', 'en'])}/{i}", links))
    return rows


@pytest.mark.parametrize("source", ["random", "given"])
def test_urls(spark, source):
    if source == "given":
        if not os.path.isdir(SF):
            pytest.skip("no test data")
        pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
        got = queries.QUERIES["op8_url_filter"](spark, SF).collect()
    else:
        pages = random_pages()
        df = spark.createDataFrame([(*r, "h", "v") for r in pages], "page_id long, url string, html string, host string, verdict string")
        got = urls.judge_urls(df).collect()
    want = brute_verdicts(pages)
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]
    if source == "random":
        assert any(r.rule is None and r.verdict == "block" for r in got)


def test_verdicts_reach_far_and_do_not_depend_on_the_rest(spark):
    """A chain of 14 hosts that ends at a blocked page, alone and among many blocked pages."""
    chain = [(i, f"http://h{i}.net/", f"<a href='//h{i + 1}.net'>") for i in range(13)]
    chain += [(13, "http://h13.net/", "<a href=http://bad.com/x>"), (14, "http://bad.com/de/", None)]
    rest = [(100 + i, f"http://x{i}.com/de/", "<a href='https://other.net/'>") for i in range(300)]
    schema = "page_id long, url string, html string"
    alone, among = ({r.page_id: r for r in urls.judge_urls(spark.createDataFrame(p, schema)).collect()} for p in (chain, chain + rest))
    for i in range(14):
        assert alone[i].verdict == among[i].verdict == "block" and alone[i].distrust == among[i].distrust
        assert alone[i].distrust == pytest.approx(0.15 * 0.85 ** (14 - i), rel=1e-8)


def test_no_pages(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# -- chat ------------------------------------------------------------------------------------

ALPHABET = r"<>|\[]/sINTSYend![](){}a.png" + " \nend"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_escapes_are_undone(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", out)
    parts = chat.parts_of(text)
    assert "".join(p["text"] for p in parts) == text
    piece, start, length, attachments = chat.format_turn("assistant", parts, 3)
    m = chat.PIECE.fullmatch(piece)
    assert chat.restore(m[2], attachments) == text and piece[start : start + length] == m[2]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|end|><\\|end|>", "<<SYS>>x<</SYS>>", "\\", "<", "<\\\\|", "![a](b.png)![](c.wav)<|", "![x](y)"])
def test_known_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    body, attachments = chat.Visitor().flat()
    assert body == "" and attachments == []


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[0], r[1])) + (r[2] or "", r[3] or "")):
        t = out.setdefault(conv, [0, "", ""])
        t[0] += 1
        t[1] += f"{role or ''}\n{text or ''}\n"
        t[2] += (text or "") if role == "assistant" else ""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, digest(t), len(x), digest(x)) for c, (n, t, x) in out.items()}


def test_chat_query(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    both = "</s>[INST] ok [/INST]"
    want = brute_chat(rows + [(-7, 0, "user", both), (-7, 1, "assistant", both)])
    got = {r.conv_id: r for r in queries.QUERIES["op10_chat_format"](spark, SF).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(r.formatted_chars > r.loss_chars for r in got.values())


def test_odd_conversations(spark, odd_texts):
    rng = random.Random(9)
    more = ["<|end|>", "</s>", "[INST]", "![i](http://x/y.PNG) and ![](z.mp3) <\\|", None]
    rows = [(rng.randint(0, 9), rng.randint(0, 5), rng.choice(["user", "assistant", "system", None, "<|text|>\n"]), t) for t in odd_texts + more * 5]
    rows += rows[:4] + [(None, None, None, None), (None, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, n_turns int")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == brute_chat(rows)
    assert sum(r.n_attachments for r in got.values()) == 10
    pieces = formatted.collect()
    for r in pieces:
        for a in r.attachments:
            assert r.piece[a.at :].startswith(f"<|{a.kind}|{a.number}|>")
    assert chat.read_back(chat.format_conversations(df.where("false"))).collect() == []


def test_typed_parts(spark):
    parts = [("text", "see <|end|>", None, None), ("image", None, "a.png", 10), ("audio", None, "b", None), ("document", None, "c.pdf", None), ("text", "!", None, None)]
    df = spark.createDataFrame([(1, 0, "user", "ignored", parts), (1, 1, "assistant", "plain ![q](r.gif)", None)],
                               "conv_id long, turn long, role string, text string, parts array<struct<type string, text string, ref string, tokens bigint>>")
    rows = sorted(chat.format_conversations(df, "parts").collect(), key=lambda r: r.turn_no)
    assert rows[0].piece == "<|start|>user<|text|>see <\\|end|><|image|0|><|audio|1|><|document|2|>!<|end|>"
    assert [(a.number, a.kind, a.ref, a.tokens) for r in rows for a in r.attachments] == [
        (0, "image", "a.png", 10), (1, "audio", "b", 750), (2, "document", "c.pdf", 1024), (3, "image", "r.gif", 576)]
    assert chat.read_back(chat.format_conversations(df, "parts")).first().expanded_tokens == 10 + 750 + 1024 + 576


# -- pipeline --------------------------------------------------------------------------------


def test_stages_are_what_they_should_be():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "secret scans", "packing"]


def test_pipeline_stage_by_stage(spark, odd_docs, tmp_path):
    """Each stage against its operator on what the stage before kept."""
    from tidebar.llm import decontaminate, neardup, quality, secrets

    item = "the quick answer of this old question was found by seven wise people in one long night"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    rng = random.Random(12)
    prose = lambda: " ".join(rng.choice("the of and to in is a house river green walks slowly over old stones".split()) for _ in range(90)) + "."
    base = prose()
    extra = [(9001, base), (9002, base + " more"), (9003, prose() + " " + item + " " + prose()), (9004, prose() + ' password="hunter22x" ' + prose()), (9005, prose())]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "xx", "s9", len(t), "n", 1.0) for i, t in extra], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == before.columns
        key = lambda df: sorted((repr(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
        if k == 0:
            kept = {r.doc_id for r in quality.quality_rules(before).where("kept").collect()}
            assert seen[0] == kept
        if k == 1:
            judged = {r.doc_id for r in neardup.near_duplicates(before, 5, 80).where("kept or doc_id is null").collect()}
            assert seen[1] == judged and docs.where("doc_id is not null").count() == len(judged - {None})
        if k == 2:
            bad = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()}
            assert bad == {9003} and seen[2] == seen[1] - bad
        if k == 3:
            assert seen[3] == seen[2] and key(secrets.redact_secrets(before)) == key(docs)
            assert "[SECRET]" in docs.where("doc_id = 9004").first().text
    assert {9001, 9004, 9005} <= seen[4] and 9002 not in seen[4] and seen[4] == seen[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg({"length": "sum"}).first() == docs.agg({"length": "sum"}).first()
    assert {r.doc_id for r in whole.select("doc_id").collect()} == seen[4]


def test_pipeline_of_nothing(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{odd_docs}/empty/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert docs.count() == 0
