"""Main text of web pages by wrapper induction.

Pages are read into small layout trees (see dom.py). Trees of one host are aligned by simple
tree matching and merged, group by group, until a host has one wrapper; what is merged are
distinct trees, so a host with a third of all pages costs no more than its layouts. Each page
then knows which wrapper node holds each of its blocks. A block that stays the same over a
host's pages at its node is template; a node whose blocks differ is a slot. The article is
the slots below the host's article or main part or, where nothing is named so, below the
smallest box that holds most of what varies; boxes named as menus, adverts and the like never
count. Pages with one longest block are one page for this evidence, so copies of an article
don't make it template, and a block has to stand on nearly all pages of at least five.

The wrapper of a host keeps all nodes, however rare: it grows with what differs between the
host's layouts, not with its pages. Nodes without a counterpart in it count as slots.

Defined results: a null html or one without text gives an empty text; a null url has the host
''; an unfinished tag, comment or script ends the page; repeated rows give repeated results;
an empty table gives no rows; other columns are not read. A line break inside a block is
white space. Any character that Unicode calls white space counts as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm import dom
from tidebar.llm.base import map_batches
from tidebar.session import staged

GROUP = 256
LEAST_PAGES = 5
SAME_PERCENT = 90
BROADCAST_BYTES = 32_000_000

PAGE = "page_id long, url string, host string, tree string, blocks array<struct<node int, linked long, text string>>"
_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("linked", pa.int64()), ("text", pa.string())]))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the layout tree and the blocks of text that may be the article's."""
    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, blocks = [], []
            for html in b.column(3).to_pylist():
                tree, found = dom.parse(html)
                trees.append(dom.write(tree))
                blocks.append([{"node": n, "linked": k, "text": t} for n, k, t in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(trees, pa.string()), pa.array(blocks, _BLOCKS)],
                names=["page_id", "url", "host", "tree", "blocks"])

    return map_batches(rows, run, PAGE)


def _merged(trees: list[str]) -> str:
    roots = [dom.read(t) for t in trees]
    for other in roots[1:]:
        dom.merge(roots[0], other)
    dom.fold(roots[0])
    return dom.write(roots[0])


def induce(layouts: DataFrame) -> DataFrame:
    """host, wrapper: the merged trees of a host. ``layouts``: host, tree, n (pages with it)."""
    spark = layouts.sparkSession

    def merge_group(batch):
        import pandas as pd

        ordered = batch.sort_values(["n", "tree"], ascending=[False, True])
        return pd.DataFrame({"host": [ordered["host"].iloc[0]], "tree": [_merged(ordered["tree"].tolist())], "n": [int(ordered["n"].sum())]})

    while True:
        per_host = layouts.groupBy("host").agg(F.count(F.lit(1)).alias("trees"))
        most = per_host.agg(F.max("trees")).first()[0] or 0
        parts = F.ceil(F.col("trees") / GROUP)
        layouts = layouts.join(per_host, "host").withColumn("part", F.pmod(F.xxhash64("tree"), parts))
        layouts = staged(layouts.groupBy("host", "part").applyInPandas(merge_group, "host string, tree string, n long"), "wrappers")
        if most <= GROUP:
            return layouts.select("host", F.col("tree").alias("wrapper"))


def _mapped(layouts: DataFrame) -> DataFrame:
    """host, tree, places: the wrapper's node for each of the tree's, -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tree, wrapper in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, w = dom.read(tree), dom.read(wrapper)
                known = {}
                for n, (_, node) in enumerate(dom.preorder(w)):
                    known[id(node)] = n
                own = [node for _, node in dom.preorder(a)]
                dom.merge(w, a)
                out.append([known.get(id(x.final()), -1) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))],
                                             names=["host", "tree", "places"])

    return map_batches(layouts.select("host", "tree", "wrapper"), run, "host string, tree string, places array<int>")


def article_nodes(tree: dom.Node, weight: list[int]) -> list[bool]:
    """Which nodes hold the article, by what varies in each (characters outside links)."""
    nodes = [n for _, n in dom.preorder(tree)]
    at = {id(n): i for i, n in enumerate(nodes)}
    held = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        held[i] = (0 if "!" in nodes[i].label else weight[i]) + sum(held[at[id(k)]] for k in nodes[i].kids if "!" not in k.label)

    def open_nodes(top: dom.Node, whole: int) -> list[dom.Node]:
        if "!" in top.label or top.label == "form~" and 5 * held[at[id(top)]] < 4 * whole:
            return []
        return [top, *(x for k in top.kids for x in open_nodes(k, whole))]

    reach = open_nodes(tree, held[0])
    inside = {id(n) for n in reach}
    tops: list[dom.Node] = []
    for wanted in (lambda n: n.label == "article*", lambda n: n.label == "main*", lambda n: "*" in n.label):
        named = [n for n in reach if wanted(n) and held[at[id(n)]]]
        nested = {id(x) for n in named for _, x in dom.preorder(n) if x is not n}
        named = [n for n in named if id(n) not in nested]
        if named and 10 * sum(held[at[id(n)]] for n in named) >= 3 * held[0]:
            tops = named
            break
    if not tops:
        top = tree
        while True:
            best = max((k for k in top.kids if id(k) in inside), key=lambda k: held[at[id(k)]], default=None)
            if best is None or 5 * held[at[id(best)]] < 3 * held[at[id(top)]] or not held[at[id(best)]]:
                break
            top = best
        tops = [top]
    keep = [False] * len(nodes)
    for top in tops:
        for _, n in dom.preorder(top):
            keep[at[id(n)]] = id(n) in inside
    return keep


def _judged(layouts: DataFrame) -> DataFrame:
    """host, tree, places, keep (per node) and whether the article's part has a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keeps, named = [], []
            for tree, places, weights in zip(*(b.column(c).to_pylist() for c in ("tree", "places", "weights"))):
                weights = {w["place"]: w["chars"] for w in weights or []}
                root = dom.read(tree)
                # a part of the page that no page's text varies in still has its own text
                keep = article_nodes(root, [weights.get(p, 0) + (n.label == "t") for p, (_, n) in zip(places, dom.preorder(root))])
                keeps.append(keep)
                named.append(any(k and "*" in n.label for k, (_, n) in zip(keep, dom.preorder(root))))
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), b.column("tree"), b.column("places"), pa.array(keeps, pa.list_(pa.bool_())), pa.array(named, pa.bool_())],
                names=["host", "tree", "places", "keep", "named"])

    return map_batches(layouts, run, "host string, tree string, places array<int>, keep array<boolean>, named boolean")


def _beside(rows: DataFrame, small: DataFrame, *by: str) -> DataFrame:
    """``small`` (a written table) joined by host and ``by``; broadcast only if its measured size allows it."""
    sizes = [F.size(c) * 8 for c, kind in small.dtypes if kind.startswith("array")]
    total = small.agg(F.sum(sum(sizes, F.length("host") + 64))).first()[0] or 0
    return rows.join(F.broadcast(small) if total <= BROADCAST_BYTES else small, ["host", *by])


def extract_articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: blocks of the article in page order, joined by newlines."""
    read = staged(read_pages(pages).withColumn("layout", F.xxhash64("tree")), "pages")
    layouts = staged(read.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")), "layouts")
    mapped = staged(_mapped(layouts.join(induce(layouts), "host")).withColumn("layout", F.xxhash64("tree")), "mapped")

    longest = F.expr("xxhash64(array_max(transform(blocks, b -> struct(length(b.text) as n, b.text as t))).t)")
    told = _beside(read.where("size(blocks) > 0").select("host", "layout", "blocks", longest.alias("page")),
                   mapped.select("host", "layout", "places"), "layout")
    seen = told.select("host", "page", F.explode(F.expr(
        "transform(blocks, b -> struct(places[b.node] as place, xxhash64(b.text) as block, "
        "length(b.text) - b.linked as chars, 2 * b.linked > length(b.text) as links))")).alias("b")) \
        .select("host", "page", "b.*").groupBy("host", "place", "block", "page").agg(
            F.max("chars").alias("chars"), F.min("links").alias("links"))
    seen = staged(seen, "blocks")
    each = seen.groupBy("host", "place", "block").agg(
        F.count(F.lit(1)).alias("on"), F.max("chars").alias("chars"), F.min("links").alias("links"))
    of = staged(seen.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count(F.lit(1)).alias("pages")), "places")
    constant = (F.col("on") >= LEAST_PAGES) & (100 * F.col("on") >= SAME_PERCENT * F.col("pages")) & (F.col("place") >= 0)
    each = staged(_beside(each, of, "place").withColumn("constant", constant), "evidence")
    weights = each.where("not constant and not links").groupBy("host", "place").agg(F.sum(F.col("chars") * F.col("on")).alias("chars")) \
        .groupBy("host").agg(F.collect_list(F.struct("place", "chars")).alias("weights"))
    template = each.where("constant").groupBy("host").agg(F.collect_list(F.xxhash64("place", "block")).alias("template"))
    judged = _judged(mapped.drop("layout").join(weights, "host", "left")).withColumn("layout", F.xxhash64("tree")).drop("tree")
    judged = staged(judged.join(template, "host", "left").withColumn("template", F.coalesce("template", F.array().cast("array<bigint>"))), "judged")
    # a block of links is navigation, but not where the page itself says what its article is
    text = F.expr("array_join(transform(filter(blocks, b -> keep[b.node] and (named or 2 * b.linked <= length(b.text)) "
                  "and not array_contains(template, xxhash64(places[b.node], xxhash64(b.text)))), b -> b.text), '\n')")
    return _beside(read.drop("tree"), judged, "layout").select("page_id", "url", text.alias("text")) \
        .withColumn("n_chars", F.length("text").cast("long"))
