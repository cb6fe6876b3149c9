"""Links between pages and bounded walks over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.shared import written


#: Links around links that are told apart.
NESTED = 8
#: Rows (a support's print each) of a claim that one task joins, at most.
HELD = 1 << 16


def wikilinks(body: Column) -> Column:
    """Targets of [[target|alias]] outside code spans, which end with as many backticks as they begin with.  A link with
    links inside is none, nor are those inside it."""
    plain = F.regexp_replace(body, r"(?s)(?<!`)(`++)(.*?)(?<!`)\1(?!`)", " ")
    inner = r"\[\[((?:(?!\[\[|\]\])[^\x01\x02])*+)\]\]"
    marked = F.regexp_replace(F.regexp_replace(plain, r"[\x01\x02]", " "), inner, "\x01$1\x02")
    for _ in range(NESTED):
        marked = F.regexp_replace(marked, r"(?s)\[\[(?:(?!\[\[|\]\]).)*+\]\]", " ")
    found = F.regexp_extract_all(marked, F.lit(r"\x01([^\x02|]*)[^\x02]*\x02"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))), lambda t: t != ""))


def resolved(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): the page that a link's lower-cased target names alone, else the text itself.
    ``pages``: page_id, names array."""
    names = pages.select("page_id", F.explode(F.array_distinct(F.transform("names", lambda n: F.lower(n)))).alias("name"))
    unique = names.groupBy("name").agg(F.min("page_id").alias("page"), F.countDistinct("page_id").alias("n")).where("n = 1")
    return links.join(unique, F.lower("target") == F.col("name"), "left").select("src", F.coalesce(F.col("page").cast("string"), "target").alias("dst")).distinct()


def resolved_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst, target) of links (src, target): the page whose id the target is, else the one at that path (with or
    without .md), else the one with that title; null where none or several answer.  ``pages``: id, path, title."""
    target = F.regexp_replace("target", r"^\s+|\s+$", "")
    asked = links.select("src", target.alias("target")).where("target <> ''").distinct()
    keys = lambda kind, column: pages.where(column.isNotNull() & (column != "")).select(F.col("id"), F.lit(kind).alias("kind"), column.alias("name"))
    names = keys(0, F.col("id").cast("string")).unionByName(keys(1, F.col("path"))).unionByName(keys(3, F.lower("title")))
    one = names.groupBy("kind", "name").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    forms = F.array(F.struct(F.lit(0).alias("kind"), F.col("target").alias("name")), F.struct(F.lit(1).alias("kind"), F.col("target").alias("name")), F.struct(F.lit(1).alias("kind"), F.concat("target", F.lit(".md")).alias("name")), F.struct(F.lit(3).alias("kind"), F.lower("target").alias("name")))
    tried = asked.select("src", "target", F.posexplode(forms).alias("place", "f")).select("src", "target", "place", "f.kind", "f.name")
    best = tried.join(one, ["kind", "name"]).groupBy("src", "target").agg(F.min_by("id", "place").alias("dst"))
    return asked.join(best, ["src", "target"], "left").select("src", "dst", "target")


def incident(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with an end in ``nodes`` (column node), in (src, dst) order."""
    out = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")).distinct()
    return out.orderBy("src", "dst").limit(limit) if limit else out


def projected(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, kind): wikilinks, subjects and sources of each page, each once.  ``pages``: page_id, subjects, sources.
    ``links``: src, dst as ``resolved`` gives them."""
    of = lambda column, kind: pages.select(F.col("page_id").alias("src"), F.explode(column).alias("dst"), F.lit(kind).alias("kind")).withColumn("dst", F.col("dst").cast("string"))
    return links.select("src", "dst", F.lit("wikilink").alias("kind")).unionByName(of("subjects", "subject")).unionByName(of("sources", "source")).distinct()


def visible(edges: DataFrame, nodes: DataFrame, ceiling: int) -> DataFrame:
    """Edges both of whose ends a reader may see; an end that is no node (node, sensitivity) or has no label is hidden."""
    seen = nodes.where(F.col("sensitivity") <= ceiling).select("node")
    return edges.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi")


def affected(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages with an edge to something that is newly gone (column dst)."""
    return edges.join(gone, "dst", "left_semi").select("src").distinct()


def walk(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, hops) within one or two steps, undirected; least hops."""
    if depth not in (1, 2):
        raise ValueError("a walk goes one or two steps")
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    seen = start.select("node", F.lit(0).alias("hops"))
    edge_of = seen
    for hop in range(1, depth + 1):
        edge_of = edge_of.join(both, "node").select(F.col("next").alias("node"), F.lit(hop).alias("hops")).distinct()
        seen = seen.unionByName(edge_of)
    return seen.groupBy("node").agg(F.min("hops").alias("hops"))


def walked_edges(edges: DataFrame, start: DataFrame, depth: int = 2, limit: int = 100) -> DataFrame:
    """The first ``limit`` edges (src, dst) of a walk, in order, and on each row whether there were more."""
    inner = walk(edges, start, depth - 1).select("node") if depth > 1 else start.select("node")
    found = incident(edges, inner).select("src", "dst").orderBy("src", "dst").limit(limit + 1)
    more = found.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return found.orderBy("src", "dst").limit(limit).crossJoin(F.broadcast(more))


def reach(edges: DataFrame, start: DataFrame, depth: int = 8, most: int | None = None) -> DataFrame:
    """(node, hops, parent) along directed edges from the nodes of ``start``: least hops, of equal parents the smallest.

    Breadth first: every step joins the edges with the nodes reached last alone, and drops those known before, so no path
    is walked twice and cycles end.  Edges and steps are written to the checkpoint folder, so Spark knows their sizes and
    broadcasts none but small ones.  With ``most``, the nodes nearest."""
    pairs = written(edges.select("src", "dst").distinct(), "edges")
    seen = start.select("node", F.lit(0).alias("hops"), F.lit(None).cast(dict(pairs.dtypes)["src"]).alias("parent"))
    last = seen
    for hop in range(1, depth + 1):
        step = pairs.join(last.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        last = written(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "parent"), "reached")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen.orderBy("hops", "node").limit(most) if most else seen


def impacts(reached: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes reached with what failing them costs (node, cost; the greatest said counts, unknown last), dearest first."""
    cost = known.groupBy("node").agg(F.max("cost").alias("cost"))
    return reached.join(cost, "node", "left").orderBy(F.desc_nulls_last("cost"), "hops", "node")


#: Rounds in which nodes without an edge in or out are taken away before paths are walked.
PRUNED = 2


def cycles(edges: DataFrame, depth: int = 6) -> DataFrame:
    """(node): nodes on a directed cycle of at most ``depth`` edges (src, dst, valid_from, valid_to) that all hold at one
    time.  A path carries the intersection of its intervals and ends where that is empty; one entry stays for each
    start, end and interval."""
    far = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    e = edges.select("src", "dst", F.col("valid_from").alias("f"), F.coalesce("valid_to", far).alias("t"))
    for _ in range(PRUNED):  # what nothing leads to, or from which nothing leads, is on no cycle
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "f", "t").checkpoint()
    path = e.select(F.col("src").alias("start"), F.col("dst").alias("at"), "f", "t").distinct()
    found = path.where("start = at").select("start")
    for _ in range(depth - 1):
        path = path.where("start <> at").alias("p").join(e.alias("e"), F.col("p.at") == F.col("e.src"))
        path = path.select("start", F.col("e.dst").alias("at"), F.greatest("p.f", "e.f").alias("f"), F.least("p.t", "e.t").alias("t")).where("f < t").distinct().checkpoint()
        if path.isEmpty():
            break
        found = found.unionByName(path.where("start = at").select("start"))
    return found.distinct().withColumnRenamed("start", "node")


#: A node with this share of all edges or more is joined by broadcast; there are at most HOT / 2 such nodes.
HOT = 1000


def _lowest(both: DataFrame, total: int, keep: str) -> DataFrame:
    """(u, v) of ``both`` where ``keep`` holds, as (v, least neighbour of u).  Hubs meet their least neighbour where they are."""
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("w")).checkpoint()
    hot = F.broadcast(low.where(F.col("w") * HOT >= total).drop("w"))
    rows = both.where(keep) if keep else both
    cold = low.where(F.col("w") * HOT < total).drop("w")
    met = rows.join(hot, "u").unionByName(rows.join(hot.select("u"), "u", "left_anti").join(cold, "u"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("hub"), "m")


def clusters(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, cluster): smallest node reachable.  Large-star and small-star rounds, each written to the checkpoint folder;
    a giant cluster's hub is no hot key."""
    x, y = F.greatest("a", "b"), F.least("a", "b")
    now = links.where("a <> b").select(x.alias("u"), y.alias("v")).distinct().checkpoint()
    alone = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, 2 * seen[0], "v > u").select("u", "v").distinct().checkpoint()
        small = _lowest(large, seen[0], "")
        now = small.where("u <> v").select("u", "v").unionByName(small.select(F.col("hub").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
    else:
        raise RuntimeError("clusters did not settle")
    return alone.join(now.select(F.col("u").alias("node"), F.col("v").alias("cluster")), "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def identities(claims: DataFrame, least: int = 2) -> DataFrame:
    """(node, cluster, resolution) over statements (a, b, same, owner, root) that two names are the same or not.

    A pair is qualified by its owner or by ``least`` roots, and joins unless someone denies it.  A cluster with a denied
    pair inside is split into its members, all ambiguous; one next to a pair that is denied or not qualified is whole but
    ambiguous; any other is resolved, or distinct if it has one member."""
    x, y = F.least("a", "b"), F.greatest("a", "b")
    pairs = claims.where("a <> b").groupBy(x.alias("a"), y.alias("b")).agg(
        F.bool_or(~F.col("same")).alias("denied"), F.bool_or(F.col("same") & F.col("owner")).alias("owned"), F.countDistinct(F.when(F.col("same"), F.col("root"))).alias("roots"),
    )
    pairs = pairs.withColumn("fit", F.col("owned") | (F.col("roots") >= least)).checkpoint()
    joined = clusters(pairs.where("fit AND NOT denied").select("a", "b"))
    names = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    label = names.join(joined, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")).checkpoint()
    la, lb = label.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), label.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    doubt = pairs.where("denied OR NOT fit").join(la, "a").join(lb, "b")
    split = doubt.where("denied AND ca = cb").select(F.col("ca").alias("cluster")).distinct().withColumn("split", F.lit(True))
    beside = doubt.select(F.col("ca").alias("cluster")).unionByName(doubt.select(F.col("cb").alias("cluster"))).distinct().withColumn("beside", F.lit(True))
    sizes = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    full = label.join(sizes, "cluster").join(split, "cluster", "left").join(beside, "cluster", "left")
    state = F.when(F.col("split") | F.col("beside"), "ambiguous").when(F.col("n") > 1, "resolved").otherwise("distinct")
    return full.select("node", F.when(F.col("split"), F.col("node")).otherwise(F.col("cluster")).alias("cluster"), state.alias("resolution"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """claim, n from rows (claim, support, print) that come by claim: supports less the unions that prints make of them."""
    now, above, first, n, out = None, {}, {}, 0, []

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        kind = batch.schema.field("claim").type
        for claim, support, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if claim != now:
                if now is not None:
                    out.append((now, n))
                now, above, first, n = claim, {}, {}, 0
            if support not in above:
                above[support], n = support, n + 1
            if mark is not None:
                a, b = top(support), top(first.setdefault(mark, support))
                if a != b:
                    above[a], n = b, n - 1
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([k for _, k in out], pa.int64())], names=["claim", "n"])
        out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n], pa.int64())], names=["claim", "n"])


def lineage(supports: DataFrame, prints: DataFrame, held: int = HELD) -> DataFrame:
    """(claim, n_roots, status) over supports (support, claim, derived: independent, dependent or unknown) and their prints
    (support, print: hashes of source, version, text, occurrence).  Supports that share a print are one root; copies and
    what is derived add none; an unknown one leaves the count in doubt.

    A claim none of whose supports stands under another one is joined by itself in one task; those that have supports in
    common, and those of more than ``held`` rows, are clustered across tasks."""
    own = supports.where("derived = 'independent' AND claim IS NOT NULL AND support IS NOT NULL").select("support", "claim").distinct()
    rows = written(own.join(prints.select("support", "print"), "support", "left").select("claim", "support", "print"), "lineage")
    common = rows.groupBy("support").agg(F.min("claim").alias("x"), F.max("claim").alias("y")).where("x <> y").select("support")
    wide = rows.groupBy("claim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).select("claim")
    apart = written(wide.unionByName(rows.join(common, "support", "left_semi").select("claim")).distinct(), "lineage")
    count = f"claim {dict(rows.dtypes)['claim']}, n long"
    if apart.isEmpty():
        roots = rows.repartition("claim").sortWithinPartitions("claim").mapInArrow(_joined, count)
    else:
        roots = rows.join(apart, "claim", "left_anti").repartition("claim").sortWithinPartitions("claim").mapInArrow(_joined, count)
        rest = written(rows.join(apart, "claim", "left_semi"), "lineage")
        first = rest.where("print IS NOT NULL").groupBy("claim", "print").agg(F.min("support").alias("least"))
        label = clusters(rest.join(first, ["claim", "print"]).select(F.col("support").alias("a"), F.col("least").alias("b")).distinct())
        of = rest.select("claim", "support").distinct().join(label, F.col("support") == F.col("node"), "left")
        roots = roots.unionByName(of.groupBy("claim").agg(F.countDistinct(F.coalesce("cluster", "support")).alias("n")))
    state = supports.groupBy("claim").agg(F.bool_or(F.col("derived") == "unknown").alias("vague"))
    return state.join(roots, "claim", "left").select("claim", F.coalesce("n", F.lit(0)).alias("n_roots"), F.when(F.col("vague"), "unknown").otherwise("known").alias("status"))
