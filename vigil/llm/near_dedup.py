"""Near-duplicates by SuperMinHash (operator 8).

1. Each document's distinct k-word shingles give their number, a 128-bit fingerprint of the whole set,
   and a signature cut into bands. Documents with equal sets form a class; one row stands for it.
2. Classes that share a band meet in a bucket. In each bucket all are compared with one pivot, the class
   that shares the largest buckets in sum: of an original and its edited copies, that is the original.
   So a bucket of n classes makes n - 1 pairs, not n * n / 2.
3. Pairs whose full shingle sets are similar enough are links, and union-find stars group them.
4. Where a pivot's members are still in different groups, two of them may be linked without either being
   linked to the pivot. Their sets differ from the pivot's by some shingles taken away and some added,
   and how many of these two members must share for a link follows exactly from their numbers (see
   ``_second_links``). So members are joined by rare shared differences instead of pair by pair, and the
   shared differences decide, which is the same as comparing the full sets.

A link is missed only if its documents share no band. The number of bands follows from the threshold, so
that this is below 1 in 2 million there: 26 for 0.85, 37 for 0.8.

Results for special input: a document without words is linked with nothing and is its own component; one
with fewer than k words has one shingle, all its words; rows of one id are one document; a row with a
null id has a null component and is kept. Of equal texts the smallest id stands for all. Texts of any length
are compared as a whole. No other column of the input is read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column, unused, written
from vigil.llm.components import components
from vigil.llm.minhash import band_hashes, shingles, signatures

ROWS, MOST_MISSED = 5, 4.2e-7
#: Partners that a copy of a pivot's text serves, about.
PARTNERS = 64
_SKETCH = "struct<n:bigint,print:binary,bands:array<bigint>>"


def bands(percent: int) -> int:
    """The least number of bands with which a link at the threshold is missed with a chance of ``MOST_MISSED`` at most."""
    same = (percent / 100) ** ROWS
    return 1 if same >= 1 else int(np.ceil(np.log(MOST_MISSED) / np.log1p(-same)))


def sketches(docs: DataFrame, k: int, text: str, percent: int) -> DataFrame:
    """Adds a struct: number of shingles, fingerprint of the set and band hashes."""

    n_bands = bands(percent)

    def work(texts: pa.Array) -> pa.Array:
        sets = shingles(texts, k)
        hashes = band_hashes(signatures(sets, n_bands * ROWS), n_bands).view(np.int64)
        return pa.StructArray.from_arrays(
            [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(list(hashes), pa.list_(pa.int64())),
            ],
            ["n", "print", "bands"],
        )

    return docs.withColumn("sketch", arrow_column(work, _SKETCH, plain=True)(F.col(text)))


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes from ``least`` to ``most`` can be similar enough; a node may have several texts."""
    return 100 * F.least(f"{a}most", f"{b}most") >= percent * F.greatest(f"{a}least", f"{b}least")


def _beside(pairs: DataFrame, texts: DataFrame, pivot: list[str], node: list[str]) -> DataFrame:
    """Rows of (pivot, slice): the pivot's text with null ``node`` columns, then the texts of some of its partners.

    A pivot's partners are cut into slices, each with one copy of the pivot's text, so that a pivot with very
    many partners is no trouble.
    """
    own = lambda names, other: texts.select(*(F.col(c).alias(n) for c, n in zip(("node", "version"), names)), "text", *other)
    slices = pairs.groupBy(*pivot).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("slices"))
    dealt = pairs.join(slices, pivot).withColumn("slice", F.pmod(F.xxhash64(*node), F.col("slices")).cast("int")).drop("slices")
    members = dealt.join(own(node, []), node)
    heads = slices.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).join(own(pivot, []), pivot)
    heads = heads.select(*(F.col(c) if c in heads.columns else F.lit(None).cast(t).alias(c) for c, t in members.dtypes))
    return members.unionByName(heads).repartition(*pivot, "slice").sortWithinPartitions(*pivot, "slice", F.col(node[0]).asc_nulls_first())


def _compared(batches: Iterator[pa.RecordBatch], k: int, first: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """For each batch of rows of ``_beside``: number of row, pivot's shingles and row's shingles, for rows of partners."""
    head = None
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            out = []
            for j, (own, node) in enumerate(zip(shingles(part.column("text"), k), part.column(first).is_null().to_pylist())):
                if node:
                    head = own
                else:
                    out.append((j, head, own))
            yield part, out


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which some texts' full shingle sets reach the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _compared(batches, k, "b"):
            good = []
            for j, x, y in rows:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(j)
            yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

    versions = texts.select("node", "version")
    of = lambda n: versions.select(F.col("node").alias(n), F.col("version").alias(f"{n}_version"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b")  # an id that has several texts has several versions
    dealt = _beside(rows, texts, ["a", "a_version"], ["b", "b_version"])
    return dealt.mapInArrow(work, "a long, b long").distinct()


def _differences(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """For (pivot, node): size of the pivot's set, shingles missing and added, and both in one array (added ones odd)."""
    versions = texts.select("node", "version")
    rows = pairs.join(versions.select(F.col("node").alias("pivot"), F.col("version").alias("pivot_version")), "pivot").join(versions, "node")
    dealt = _beside(rows, texts, ["pivot", "pivot_version"], ["node", "version"])
    kept = [c for c in dealt.columns if c not in ("text", "slice")]
    kinds = ", ".join(f"{c} {t}" for c, t in dealt.dtypes if c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _compared(batches, k, "node"):
            found = []
            for _, x, y in rows:
                missing, added = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                found.append((len(x), len(missing), len(added), np.r_[missing & ~np.uint64(1), added | np.uint64(1)].view(np.int64)))
            columns = [list(c) for c in zip(*found)] or [[], [], [], []]
            new = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            own = part.select(kept).take(pa.array([j for j, _, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*kept, "s", "m", "a", "delta"])

    return dealt.mapInArrow(work, f"{kinds}, s long, m long, a long, delta array<long>")


def _second_links(grouped: DataFrame, so_far: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one pivot's buckets that are in different groups so far.

    For members x and y of a pivot with s shingles, which lack m and add a shingles: x and y share
    ``s - m(x) - m(y)`` shingles and as many more as their differences have in common. So they are linked
    if the differences share ``need = w(x) + w(y) - c * s`` elements at least, where
    ``w = (1 - t) * m + t * a``, ``t = percent / (100 + percent)`` and ``c = 1 - 2 * t``. A member outside
    the pivot's group has ``w > c * s`` (else it would be linked to the pivot), so ``need`` is above w of
    the other. Two cases:

    * ``need`` is above both numbers of missing shingles: an added shingle must be shared.
    * Otherwise a difference of either kind must be.

    In both, a pair that shares ``need`` elements shares one of the rarest ``size - need + 1`` of each
    (with the same order of elements for all), so only these are joined.
    """
    t = percent / (100 + percent)
    c = 1 - 2 * t
    comp = lambda node, name: so_far.select(F.col("node").alias(node), F.col("component").alias(name))
    rows = grouped.join(comp("node", "g"), "node", "left").join(comp("pivot", "pg"), "pivot", "left")
    rows = rows.withColumn("g", F.coalesce("g", "node")).withColumn("pg", F.coalesce("pg", "pivot")).withColumn("minor", F.col("g") != F.col("pg"))
    open_ = rows.groupBy("pivot").agg(F.count_if("minor").alias("minors"), F.count(F.lit(1)).alias("size")).where("minors > 0 AND size > 1").select("pivot")
    diff = _differences(rows.join(open_, "pivot", "left_semi"), texts, k)
    diff = written(diff.withColumn("w", (1 - t) * F.col("m") + t * F.col("a")).withColumn("n", F.col("s") - F.col("m") + F.col("a")), "differences")
    of_pivot = ["pivot", "pivot_version"]
    least = diff.groupBy(of_pivot).agg(F.min("w").alias("least_w"), F.min(F.when(F.col("minor"), F.col("w"))).alias("least_minor_w"))
    # what a member needs to share with any partner: minors may pair with all, others with minors
    partner = F.when(F.col("minor"), F.col("least_w")).otherwise(F.col("least_minor_w"))
    bound = F.greatest(F.lit(1), F.ceil(F.col("w") + partner - c * F.col("s") - 1e-6)).cast("long")
    size = F.col("m") + F.col("a")
    each = diff.join(least, of_pivot).withColumn("bound", bound).where(size >= F.col("bound"))
    member = [*of_pivot, "node", "version"]
    elements = each.select(*member, "g", "minor", "n", "s", "m", "a", "bound", F.explode("delta").alias("e"))
    common = elements.groupBy(*of_pivot, "e").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    shared = elements.join(common, [*of_pivot, "e"]).withColumn("added", F.col("e").bitwiseAND(F.lit(1)) == 1)
    # elements that no other member has are the rarest, so they come before these
    own, rank = Window.partitionBy(*member), Window.partitionBy(*member).orderBy("seen", "e")
    own_a, rank_a = Window.partitionBy(*member, "added"), Window.partitionBy(*member, "added").orderBy("seen", "e")
    place = size - F.count(F.lit(1)).over(own) + F.row_number().over(rank)
    place_a = F.when(F.col("added"), F.col("a") - F.count(F.lit(1)).over(own_a) + F.row_number().over(rank_a))
    ranked = shared.withColumn("place", place).withColumn("place_a", place_a)
    any_one = F.col("place") <= size - F.col("bound") + 1
    added_one = F.coalesce(F.col("place_a") <= F.col("a") - F.greatest(F.lit(1), F.col("bound") - F.col("m")) + 1, F.lit(False))
    keys = written(ranked.withColumn("any_one", any_one).withColumn("added_one", added_one).where("any_one OR added_one").drop("place", "place_a", "seen", "added", "a", "bound"), "keys")

    x = keys.where("minor").select(*of_pivot, "e", *(F.col(q).alias(f"x_{q}") for q in ("node", "version", "g", "n", "m", "any_one", "added_one")), "s")
    y = keys.select(*of_pivot, "e", *(F.col(q).alias(f"y_{q}") for q in ("node", "version", "g", "n", "m", "minor", "any_one", "added_one")))
    need = F.ceil(F.lit(percent) * (F.col("x_n") + F.col("y_n")) / (100 + percent) - 1e-6) - F.col("s") + F.col("x_m") + F.col("y_m")
    fewest = F.least("x_m", "y_m")
    by_added = F.col("x_added_one") & F.col("y_added_one") & (need > fewest)
    by_any = F.col("x_any_one") & F.col("y_any_one") & (need <= fewest)
    sizes = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    once = ~F.col("y_minor") | (F.col("x_node") < F.col("y_node"))
    left, right = x.alias("l"), y.alias("r")
    on = [F.col(f"l.{q}") == F.col(f"r.{q}") for q in (*of_pivot, "e")]
    met = left.join(right, on[0] & on[1] & on[2] & (F.col("x_g") != F.col("y_g")) & once & sizes & (by_added | by_any))
    met = met.select(*(F.col(f"l.{q}").alias(q) for q in of_pivot), "x_node", "x_version", "y_node", "y_version", need.alias("need")).distinct()
    side = lambda q: diff.select(*of_pivot, F.col("node").alias(f"{q}_node"), F.col("version").alias(f"{q}_version"), F.col("delta").alias(f"{q}_delta"))
    both = met.join(side("x"), [*of_pivot, "x_node", "x_version"]).join(side("y"), [*of_pivot, "y_node", "y_version"])
    return both.where(F.size(F.array_intersect("x_delta", "y_delta")) >= F.col("need")).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id`` (smallest key reachable) and ``kept``."""
    source = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).withColumn("version", F.xxhash64("text"))
    sketch = written(sketches(source, k, "text", percent).select("node", "version", "sketch.*"), "sketch")
    able = sketch.where("n > 0 AND node IS NOT NULL")
    classes = written(able.groupBy("print").agg(F.min_by(F.struct("node", "version", "n", "bands"), F.struct("node", "version")).alias("c")).select("print", "c.*"), "classes")

    # rows of one id are one document: links that need no comparison
    several = able.groupBy("node").agg(F.count_distinct("print").alias("prints")).where("prints > 1").select(F.col("node").alias("b"))
    of_several = able.select("print", F.col("node").alias("b")).join(several, "b", "left_semi")
    given = classes.select("print", F.col("node").alias("a")).join(of_several, "print").where("a <> b").select("a", "b").distinct()

    banded = classes.select("node", F.explode("bands").alias("h"))
    crowded = banded.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(banded.join(crowded, "h"), "members")
    centre = members.groupBy("node").agg(F.sum("size").alias("centre"))
    each = members.select("h", "node").distinct().join(centre, "node")
    pivots = each.groupBy("h").agg(F.max(F.struct("centre", (-F.col("node")).alias("less"))).alias("p")).select("h", (-F.col("p.less")).alias("pivot"))
    grouped = written(each.join(pivots, "h").where("node <> pivot").select("pivot", "node").distinct(), "grouped")

    sized = lambda node, p: classes.groupBy(F.col("node").alias(node)).agg(F.min("n").alias(f"{p}least"), F.max("n").alias(f"{p}most"))
    first = grouped.join(sized("node", ""), "node").join(sized("pivot", "p_"), "pivot").where(_sizes_allow("", "p_", percent))
    first = first.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    asked = members.select("node").distinct().join(classes.select("node", "version"), "node")
    texts = written(source.join(asked, ["node", "version"]).groupBy("node", "version").agg(F.any_value("text").alias("text")), "texts")
    links = written(linked(first, texts, k, percent).unionByName(given), "links")
    so_far = written(components(links), "components")

    more = written(_second_links(grouped, so_far, texts, k, percent), "links")
    stars = so_far.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
    final = components(stars.unionByName(more))

    of_class = classes.join(final, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = sketch.join(of_class, "print", "left")
    component = F.when(F.col("node").isNull(), F.lit(None).cast("long")).when(F.col("n") > 0, F.col("component")).otherwise(F.col("node"))
    out = out.select(F.col("node").alias(key), "version", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which no near-duplicate has a smaller id; of repeated rows of one id, one. Other columns, whatever their names, stay."""
    found = groups(docs, key=key, text=text, k=k, percent=percent)
    own, rest = unused(docs, "own"), unused(docs, "rest")
    kept = found.where("kept").select(F.col(key).alias(own)).distinct()
    one = docs.where(F.col(key).isNotNull()).withColumn(own, F.col(key).cast("long")).withColumn(rest, F.xxhash64(text)).dropDuplicates([own, rest])
    chosen = one.groupBy(own).agg(F.min(rest).alias(rest)).join(kept, own, "left_semi")
    return one.join(chosen, [own, rest]).select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


def oracle(k: int = 3, percent: int = 85) -> str:
    """The query in DuckDB's SQL: all pairs that share a shingle, and reachability."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({low}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, least({k}, len(w)) AS size, unnest(range(1, len(w) - least({k}, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""
