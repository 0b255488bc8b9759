"""The two-tower model: vectorised forward pass, data-parallel training, retrieval metrics, calibration, gate.

An action is a weighted set of the principals that access its resource; a context is a principal's
history, its four kinds of peers and its static attributes. Each tower pools the embeddings of every
field by weight, concatenates the fields, and applies one hidden layer and a projection to unit length.
There is an action tower for each source. Distance is 1 less the cosine, within 0 and 1. Gradients are written out by hand.

Peers of a department or a team and collaborators are never paired. All pool by a symmetric weight of two principals, so the sum
over all others follows from sums over groups (``Peers``), and gradients go back by the same sums.

The embeddings and their moments are tables, as their number grows with principals and resources. A round
joins them with the members of every set and sums, sends the pooled rows through the layers, joins the
pairs with the resulting unit vectors, and takes the gradients the same way back: all sums are Spark's.
Only the layers and their gradients, which have a fixed size, pass the driver.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import huber_like, power_mean
from vigil.operators.evaluation import nearest_rank
from vigil.operators.normalize import SOURCES
from vigil.session import written

#: Fields of a context: mean over the history, then weighted sums of peers, then attributes.
CONTEXT_FIELDS = ("history", "department", "manager", "group", "collaboration", "role", "location", "employment_duration_bucket", "privilege_level")
MARGIN, OMEGA = 0.1, 2.0
SET = "array<struct<i:bigint,w:double>>"
#: Field numbers of departments', teams' and collaborators' pooled vectors; first number of the sources' own towers' fields.
DEPARTMENT, GROUP, COLLABORATION, OWN = 2, 4, 5, 100


@dataclass
class Tower:
    """Embeddings per field, a hidden layer, a projection."""

    sizes: tuple[int, ...]
    dim: int = 8
    hidden: int = 32
    out: int = 16
    seed: int = 3
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            r = np.random.default_rng(self.seed)
            wide = self.dim * len(self.sizes)
            self.p = {f"e{f}": r.normal(0, 0.3, (n, self.dim)) for f, n in enumerate(self.sizes)}
            self.p |= {"w1": r.normal(0, 1 / np.sqrt(wide), (wide, self.hidden)), "b1": np.zeros(self.hidden), "w2": r.normal(0, 1 / np.sqrt(self.hidden), (self.hidden, self.out)), "b2": np.full(self.out, 0.01)}

    def forward(self, rows: list[list[list[tuple[int, float]]]]) -> tuple[np.ndarray, tuple]:
        """Unit vectors of rows, each a list of fields of (index, weight)."""
        flat, pooled = [], []
        for f in range(len(self.sizes)):
            owner = np.array([n for n, row in enumerate(rows) for _ in row[f]], np.int64)
            index = np.array([i for row in rows for i, _ in row[f]], np.int64)
            weight = np.array([w for row in rows for _, w in row[f]], float)
            total = np.zeros((len(rows), self.dim))
            np.add.at(total, owner, self.p[f"e{f}"][index] * weight[:, None])
            flat.append((owner, index, weight))
            pooled.append(total)
        unit, kept = self.layers(np.concatenate(pooled, axis=1))
        return unit, (flat, *kept)

    def layers(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Unit vectors of pooled rows."""
        h = np.maximum(0, x @ self.p["w1"] + self.p["b1"])
        z = h @ self.p["w2"] + self.p["b2"]
        norm = np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True))
        return z / norm, (x, h, z / norm, norm)

    def layers_back(self, kept: tuple, d_unit: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the pooled rows and of the layers."""
        x, h, unit, norm = kept
        d_z = (d_unit - unit * (d_unit * unit).sum(axis=1, keepdims=True)) / norm
        d_h = (d_z @ self.p["w2"].T) * (h > 0)
        return d_h @ self.p["w1"].T, {"w2": h.T @ d_z, "b2": d_z.sum(axis=0), "w1": x.T @ d_h, "b1": d_h.sum(axis=0)}

    def backward(self, kept: tuple, d_unit: np.ndarray) -> dict[str, np.ndarray]:
        flat, *kept = kept
        d_x, out = self.layers_back(tuple(kept), d_unit)
        for f, (owner, index, weight) in enumerate(flat):
            g = np.zeros_like(self.p[f"e{f}"])
            np.add.at(g, index, d_x[owner, f * self.dim : (f + 1) * self.dim] * weight[:, None])
            out[f"e{f}"] = g
        return out


@dataclass
class TwoTower:
    """A tower for contexts, one for actions, and those of sources that have their own."""

    action: Tower
    context: Tower
    own: dict[str, Tower] = field(default_factory=dict)

    def sides(self) -> dict[str, Tower]:
        return {"a": self.action, "c": self.context, **{f"a|{s}": t for s, t in self.own.items()}}

    def packed(self) -> bytes:
        out, sides = io.BytesIO(), self.sides()
        arrays = {f"{side}_{k}": v for side, t in sides.items() for k, v in t.p.items()}
        np.savez(out, **arrays, **{f"sizes_{side}": t.sizes for side, t in sides.items()}, shape=(self.action.dim, self.action.hidden, self.action.out))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> TwoTower:
        x = np.load(io.BytesIO(data))
        dim, hidden, out = map(int, x["shape"])
        part = lambda s: {k.removeprefix(s): x[k] for k in x.files if k.startswith(s)}
        tower = lambda s: Tower(tuple(map(int, x[f"sizes_{s}"])), dim, hidden, out, p=part(f"{s}_"))
        own = [k.removeprefix("sizes_a|") for k in x.files if k.startswith("sizes_a|")]
        return cls(tower("a"), tower("c"), {s: tower(f"a|{s}") for s in own})

    def loss(self, actions: list, contexts: list[list]) -> tuple[float, np.ndarray, dict, dict]:
        """Sum of squared mean margins over rows, the margins' means, and gradients of both towers.

        ``contexts`` holds for each row its own context first and then those of its negatives.
        """
        n, k = len(actions), len(contexts[0]) - 1
        a, kept_a = self.action.forward(actions)
        c, kept_c = self.context.forward([x for row in contexts for x in row])
        mean, d_a, d_c = margins(a, c.reshape(n, k + 1, -1))
        return float((mean**OMEGA).sum()), mean, self.action.backward(kept_a, d_a), self.context.backward(kept_c, d_c.reshape(n * (k + 1), -1))


def margins(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the margins of actions (n, d) over contexts (n, k + 1, d), own ones first; gradients of both."""
    k = c.shape[1] - 1
    distance = 1 - np.einsum("nd,nkd->nk", a, c)
    margin = np.maximum(0, MARGIN + distance[:, :1] - distance[:, 1:])
    point = np.where(margin <= 1, 0.5 * margin**2, margin - 0.5)
    mean = point.mean(axis=1)
    slope = (OMEGA * mean ** (OMEGA - 1))[:, None] * np.minimum(margin, 1) / k
    d_distance = np.concatenate([slope.sum(axis=1, keepdims=True), -slope], axis=1)
    return mean, -np.einsum("nk,nkd->nd", d_distance, c), -(d_distance[:, :, None] * a[:, None, :])


def contexts(static: DataFrame, history: DataFrame, peers: DataFrame, principals: DataFrame, resources: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """(principal_key, context) with one weighted set per field, in the order of CONTEXT_FIELDS.

    A history entry weighs one by its window's resources and the number of windows, which makes the sum
    the mean over windows of the means over resources.
    """
    sets = lambda df, w: F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), w.cast("double").alias("w"))))
    h = history.join(resources.select(F.col("key").alias("resource_key"), "idx"), "resource_key")
    in_window, all_windows = Window.partitionBy("principal_key", "window_start"), Window.partitionBy("principal_key")
    h = h.withColumn("n", F.count(F.lit(1)).over(in_window)).withColumn("r", F.row_number().over(in_window.orderBy("idx"))).withColumn("windows", F.sum((F.col("r") == 1).cast("int")).over(all_windows))
    weights = h.groupBy("principal_key", "idx").agg(F.sum(F.lit(1.0) / F.col("n") / F.col("windows")).alias("w"))
    own = static.select("principal_key", *CONTEXT_FIELDS[5:])
    out = own.join(weights.groupBy("principal_key").agg(sets(weights, F.col("w")).alias("history")), "principal_key", "left")
    p = peers.join(principals.select(F.col("key").alias("peer_key"), "idx"), "peer_key")
    total = F.sum("peer_weight").over(Window.partitionBy("principal_key", "peer_type"))
    p = p.withColumn("w", F.col("peer_weight") / total)
    kinds = p.groupBy("principal_key").agg(*(F.sort_array(F.collect_list(F.when(F.col("peer_type") == k, F.struct(F.col("idx").alias("i"), F.col("w").alias("w"))))).alias(k) for k in CONTEXT_FIELDS[1:5]))
    out = out.join(kinds, "principal_key", "left")
    for name in CONTEXT_FIELDS[5:]:
        vocab = vocabularies[name].select(F.col("value").alias(name), F.col("idx").alias("_i"))
        out = out.join(F.broadcast(vocab), name, "left").withColumn(f"_{name}", F.array(F.struct(F.coalesce("_i", F.lit(0)).cast("long").alias("i"), F.lit(1.0).alias("w")))).drop("_i")  # few values
    none = F.array().cast(SET)
    fields = [F.coalesce(F.col(n).cast(SET), none) for n in CONTEXT_FIELDS[:5]] + [F.col(f"_{n}").cast(SET) for n in CONTEXT_FIELDS[5:]]
    return out.select("principal_key", F.array(*fields).alias("context"))


def members(accessors: DataFrame, principals: DataFrame, context: DataFrame) -> DataFrame:
    """(side, key, f, i, w): all members of every set.

    A resource's accessors are side ``a|source`` with a field of the source's tower, or side ``a`` and field 0 if the source has none;
    the others are the contexts'.
    """
    idx = principals.select(F.col("key").alias("principal_key"), F.col("idx").alias("i"))
    number = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    side = F.when(number > 0, F.concat(F.lit("a|"), "source")).otherwise("a").alias("side")
    f = F.when(number > 0, number - 1 + OWN).otherwise(0).cast("int").alias("f")
    a = accessors.join(idx, "principal_key").select(side, F.col("resource_key").alias("key"), f, "i", F.col("accessor_weight").cast("double").alias("w"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("w")))  # weighs nothing, but keeps contexts without members
    each = context.select("principal_key", F.posexplode("context").alias("n", "s")).select("principal_key", "n", F.explode(F.when((F.col("n") == 0) & (F.size("s") == 0), none).otherwise(F.col("s"))).alias("s"))
    return a.unionByName(each.select(F.lit("c").alias("side"), F.col("principal_key").alias("key"), (F.col("n") + 1).alias("f"), "s.i", "s.w"))


def examples(pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """The pairs with their negatives' keys in order, as ``others``."""
    keys = ["resource_key", "principal_key", "source"]
    listed = negatives.groupBy(keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "negative_key"))), lambda x: x["negative_key"]).alias("others"))
    return pairs.join(listed, keys)


@dataclass
class Peers:
    """Principals' departments (key, i, department, total), shared resources (resource_key, key, i, c, n) and collaborators' total weights (key, total);
    members of teams (team, member, key, i, k, n), k times in a team of n, and their total weights.

    Two principals of a department weigh 1. Two that access a resource weigh the smaller of their counts by the number n of
    those who access it, summed over resources. Two of a team weigh one by its size, summed over teams. A principal's weights
    are divided by their total.
    """

    departments: DataFrame | None
    shared: DataFrame | None
    totals: DataFrame | None
    teams: DataFrame | None = None
    team_totals: DataFrame | None = None

    def without(self, blank: tuple[str, ...]) -> Peers:
        """The same without some kinds."""
        gone = {"department": ("departments",), "collaboration": ("shared", "totals"), "group": ("teams", "team_totals")}
        return replace(self, **{part: None for kind in blank for part in gone.get(kind, ())})

    def tables(self) -> dict[int, DataFrame]:
        """Per field that is there, the numbers of its principals."""
        found = {DEPARTMENT: self.departments, GROUP: self.teams, COLLABORATION: self.shared}
        return {f: t.select("key", "i").distinct() for f, t in found.items() if t is not None}

    def spread(self, f: int, values: DataFrame, names: list[str]) -> DataFrame:
        """(key, names): for each principal the sum over all others of weight times values. ``values`` has the key and these columns."""
        if f == DEPARTMENT:
            rows = self.departments.select("key", "department").join(values, "key")
            sums = rows.groupBy("department").agg(*(F.sum(c).alias(f"_{c}") for c in names))
            return rows.join(sums, "department").select("key", *((F.col(f"_{c}") - F.col(c)).alias(c) for c in names))
        if f == GROUP:
            rows = self.teams.select("team", "key", "k", "n").join(values, "key")
            sums = rows.groupBy("team").agg(*(F.sum(F.col("k") * F.col(c)).alias(f"_{c}") for c in names))
            return rows.join(sums, "team").groupBy("key").agg(*(F.sum(F.col("k") * (F.col(f"_{c}") - F.col("k") * F.col(c)) / F.col("n")).alias(c) for c in names))
        # of those with a smaller count the count decides, of the others the own one: sums up to each count of a resource
        rows = self.shared.select("resource_key", "key", "c", "n").join(values, "key")
        counts = rows.groupBy("resource_key", "c").agg(*(F.sum(c).alias(f"_{c}") for c in names))
        whole = Window.partitionBy("resource_key")
        upto = whole.orderBy("c")
        low = [F.sum(F.col("c") * F.col(f"_{c}")).over(upto).alias(f"_low_{c}") for c in names]
        high = [(F.sum(f"_{c}").over(whole) - F.sum(f"_{c}").over(upto)).alias(f"_high_{c}") for c in names]
        both = rows.join(counts.select("resource_key", "c", *low, *high), ["resource_key", "c"])
        return both.groupBy("key").agg(*(F.sum((F.col(f"_low_{c}") + F.col("c") * (F.col(f"_high_{c}") - F.col(c))) / F.col("n")).alias(c) for c in names))

    def divided(self, f: int, values: DataFrame, names: list[str]) -> DataFrame:
        """Values by each principal's total weight. Principals without others go."""
        total = self.departments.select("key", "total") if f == DEPARTMENT else self.team_totals if f == GROUP else self.totals
        return values.join(total.where("total > 0"), "key").select("key", *((F.col(c) / F.col("total")).alias(c) for c in names))


def peers_of(static: DataFrame, accessors: DataFrame, principals: DataFrame, blank: tuple[str, ...] = (), members: DataFrame | None = None) -> Peers:
    """Departments of profiled principals, shared resources of all, and teams, if ``features.team_members`` are given; ``blank`` names those that are left out."""
    idx = principals.select(F.col("key"), F.col("idx").alias("i"))
    own, shared, totals, teams, team_totals = None, None, None, None, None
    if "department" not in blank:
        rows = static.select(F.col("principal_key").alias("key"), "department").join(idx, "key")
        size = rows.groupBy("department").agg((F.count(F.lit(1)) - 1).cast("double").alias("total"))
        own = written(rows.join(size, "department").select("key", "i", "department", "total"), "departments")
    if "collaboration" not in blank:
        rows = accessors.select("resource_key", F.col("principal_key").alias("key"), F.col("access_count").cast("double").alias("c")).join(idx, "key")
        size = rows.groupBy("resource_key").agg(F.count(F.lit(1)).cast("double").alias("n")).where("n > 1")
        shared = written(rows.join(size, "resource_key").select("resource_key", "key", "i", "c", "n"), "shared")
        ones = shared.select("key").distinct().withColumn("total", F.lit(1.0))
        totals = written(Peers(None, shared, None).spread(COLLABORATION, ones, ["total"]), "collaborators")
    if members is not None and "group" not in blank:
        rows = members.groupBy("team", "member", "key").agg(F.count(F.lit(1)).cast("double").alias("k"), F.max("n").cast("double").alias("n"))
        teams = written(rows.join(idx, "key").select("team", "member", "key", "i", "k", "n"), "teams")
        ones = teams.select("key").distinct().withColumn("total", F.lit(1.0))
        team_totals = written(Peers(None, None, None, teams).spread(GROUP, ones, ["total"]), "team-totals")
    return Peers(own, shared, totals, teams, team_totals)


@dataclass
class Towers:
    """Both towers. ``layers`` has no embeddings; they are rows (f, i, e0, ..., m0, ..., v0, ...) of a table. ``contexts`` has the contexts' keys, once each."""

    layers: TwoTower
    members: DataFrame
    embeddings: DataFrame
    peers: Peers = field(default_factory=lambda: Peers(None, None, None))
    contexts: DataFrame | None = None

    def names(self, letter: str) -> list[str]:
        return [f"{letter}{j}" for j in range(self.layers.action.dim)]


def _seeded(*parts) -> float:
    """A normal number by hash of the parts, the same in every engine."""
    even = lambda salt: (int(hashlib.md5("|".join(map(str, (*parts, salt))).encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
    return float(np.sqrt(-2.0 * np.log(even(0))) * np.cos(2 * np.pi * even(1)))


def seeded_tower(side: str, fields: int, seed: int) -> Tower:
    """A tower without embeddings whose layers are normal by hash."""
    t = Tower((0,) * fields, seed=seed)
    for name in ("w1", "w2"):
        n, m = t.p[name].shape
        t.p[name] = np.array([[_seeded(side, name, i, j, seed) for j in range(m)] for i in range(n)]) / np.sqrt(n)
    return t


def embedding(f: Column) -> Column:
    """The embeddings that a field's members have: all kinds of peers share theirs."""
    return F.when(f.between(DEPARTMENT, COLLABORATION), DEPARTMENT).otherwise(f).cast("int")


def towers(members: DataFrame, seed: int = 3, peers: Peers | None = None) -> Towers:
    """Untrained towers: layers and embeddings normal by hash of their names, numbers and places."""
    peers = peers or Peers(None, None, None)
    layers = TwoTower(seeded_tower("a", 1, seed), seeded_tower("c", len(CONTEXT_FIELDS), seed), {s: seeded_tower(f"a|{s}", 1, seed) for s in SOURCES})
    dim = layers.action.dim
    even = lambda j, salt: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("e"), "f", "i", F.lit(str(j)), F.lit(str(seed)), F.lit(str(salt))).cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**48)
    normal = lambda j: 0.3 * F.sqrt(-2.0 * F.log(even(j, 0))) * F.cos(2 * np.pi * even(j, 1))
    start = [normal(j).alias(f"e{j}") for j in range(dim)] + [F.lit(0.0).alias(f"{x}{j}") for x in "mv" for j in range(dim)]
    numbers = members.select(embedding(F.col("f")).alias("f"), "i")
    for f, own in peers.tables().items():
        numbers = numbers.unionByName(own.select(embedding(F.lit(f)).alias("f"), "i"))
    known = written(members.where("side = 'c'").select("key").distinct(), "context-keys")
    return Towers(layers, members, written(numbers.distinct().select("f", "i", *start), "embeddings"), peers, known)


def pooled(t: Towers) -> DataFrame:
    """(side, key, x): for each resource and principal its fields' weighted sums of embeddings, one after the other."""
    e = t.names("e")
    each = t.members.withColumn("t", embedding(F.col("f"))).join(t.embeddings.select(F.col("f").alias("t"), "i", *e), ["t", "i"])
    sums = each.groupBy("side", "key", "f").agg(*(F.sum(F.col("w") * F.col(x)).alias(x) for x in e))
    contexts_ = t.members.where("side = 'c'").select("key").distinct() if t.contexts is None else t.contexts
    for f, own in t.peers.tables().items():
        values = own.join(t.embeddings.where(F.col("f") == embedding(F.lit(f))).select("i", *e), "i").select("key", *e)
        found = t.peers.divided(f, t.peers.spread(f, values, e), e).join(contexts_, "key", "left_semi")
        sums = sums.unionByName(found.select(F.lit("c").alias("side"), "key", F.lit(f).alias("f"), *e))
    by_field = sums.groupBy("side", "key").agg(F.map_from_entries(F.collect_list(F.struct("f", F.array(*e)))).alias("x"))
    fields = F.when(F.col("side") != "c", F.map_keys("x")).otherwise(F.sequence(F.lit(1), F.lit(len(CONTEXT_FIELDS))))
    zero = F.array_repeat(F.lit(0.0), len(e))
    return by_field.select("side", "key", F.flatten(F.transform(fields, lambda f: F.coalesce(F.try_element_at("x", f), zero))).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def _sides(b: pa.RecordBatch, layers: TwoTower):
    """The batch's rows of each tower, with their pooled vectors."""
    for side, tower in layers.sides().items():
        part = b.filter(pc.equal(b.column("side"), side))
        if part.num_rows:
            yield part, tower, _matrix(part.column("x"), tower.dim * len(tower.sizes))


def units(x: DataFrame, layers: TwoTower) -> DataFrame:
    """(side, key, u): unit vectors of pooled rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, tower, own in _sides(b, layers):
                yield pa.RecordBatch.from_arrays([part.column("side"), part.column("key"), _lists(tower.layers(own)[0])], names=["side", "key", "u"])

    return x.select("side", "key", "x").mapInArrow(work, "side string, key string, u array<double>")


def layer_table(spark: SparkSession, layers: TwoTower) -> DataFrame:
    """The layers as a table, a row for each tower: (side, w1, b1, w2, b2), matrices by output. Its size doesn't depend on the input."""
    rows = [(side, t.p["w1"].T.tolist(), t.p["b1"].tolist(), t.p["w2"].T.tolist(), t.p["b2"].tolist()) for side, t in layers.sides().items()]
    return spark.createDataFrame(rows, "side string, w1 array<array<double>>, b1 array<double>, w2 array<array<double>>, b2 array<double>")


def units_by_expressions(x: DataFrame, layers: DataFrame) -> DataFrame:
    """What ``units`` gives, without Python workers: from pooled rows and a table of layers. Rows of a side without layers are left out."""
    product = lambda v, w, b: F.zip_with(w, b, lambda row, c: inner(row, v) + c)
    met = x.select("side", "key", "x").join(F.broadcast(layers), "side")  # a row per tower
    hidden = met.withColumn("h", F.transform(product(F.col("x"), F.col("w1"), F.col("b1")), lambda v: F.greatest(F.lit(0.0), v)))
    z = hidden.select("side", "key", product(F.col("h"), F.col("w2"), F.col("b2")).alias("z"))
    norm = z.withColumn("n", F.greatest(F.lit(1e-12), F.sqrt(inner("z", "z"))))
    return norm.select("side", "key", F.transform("z", lambda v: v / F.col("n")).alias("u"))


def _met(rows: DataFrame, unit: DataFrame) -> DataFrame:
    """Pairs with their resource's unit vector ``a`` and, own ones first, keys ``who`` and unit vectors ``c`` of contexts."""
    keys = [c for c in rows.columns if c != "others"]
    slots = rows.select(*keys, F.posexplode(F.concat(F.array("principal_key"), "others")).alias("slot", "who"))
    c = unit.where("side = 'c'").select(F.col("key").alias("who"), F.col("u").alias("c"))
    listed = slots.join(c, "who").groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("slot", "who", "c"))).alias("s"))
    a = unit.where("side <> 'c'").select(F.col("key").alias("resource_key"), F.col("u").alias("a"))
    return listed.join(a, "resource_key").select(*keys, "a", F.col("s.who").alias("who"), F.flatten("s.c").alias("c"))


def _unit_gradients(met: DataFrame, width: int) -> DataFrame:
    """(side, key, d): gradients of unit vectors in sum, side "a" for all resources; side "loss" has the losses' sum and their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, sizes = _matrix(b.column("a"), width), np.diff(b.column("who").offsets.to_numpy())
            c, who = _matrix(b.column("c"), width), np.array(b.column("who").flatten().to_pylist(), object)
            start = np.cumsum(sizes) - sizes
            side, key, d, total = [], [], [], 0.0
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                at = (start[rows][:, None] + np.arange(k)).reshape(-1)
                mean, d_a, d_c = margins(a[rows], c[at].reshape(len(rows), k, width))
                total += float((mean**OMEGA).sum())
                for name, keys, g in (("a", b.column("resource_key").take(pa.array(rows)).to_pylist(), d_a), ("c", who[at], d_c.reshape(-1, width))):
                    one, place = np.unique(np.array(keys, object), return_inverse=True)
                    sums = np.zeros((len(one), width))
                    np.add.at(sums, place, g)
                    side, key, d = [*side, *[name] * len(one)], [*key, *one], [*d, *sums]
            d.append(np.r_[total, b.num_rows, np.zeros(width - 2)])
            yield pa.RecordBatch.from_arrays([pa.array([*side, "loss"]), pa.array([*key, ""]), pa.array(d, pa.list_(pa.float64()))], names=["side", "key", "d"])

    found = met.mapInArrow(work, "side string, key string, d array<double>")
    return found.groupBy("side", "key").agg(F.array(*(F.sum(F.get("d", j)) for j in range(width))).alias("d"))


def _layer_gradients(x: DataFrame, d: DataFrame, layers: TwoTower) -> DataFrame:
    """Rows (side, key, d): gradients of pooled rows, and with a null key those of a batch's layers, flat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, tower, own in _sides(b, layers):
                _, kept = tower.layers(own)
                d_x, g = tower.layers_back(kept, _matrix(part.column("d"), tower.out))
                flat = np.concatenate([g[k].reshape(-1) for k in LAYERS])
                side, key = part.column("side").to_pylist(), part.column("key").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([*side, side[0]]), pa.array([*key, None], pa.string()), pa.array([*d_x, flat], pa.list_(pa.float64()))], names=["side", "key", "d"])

    of = d.select(F.col("side").alias("_of"), "key", "d")
    return x.withColumn("_of", F.when(F.col("side") == "c", "c").otherwise("a")).join(of, ["_of", "key"]).select("side", "key", "x", "d").mapInArrow(work, "side string, key string, d array<double>")


LAYERS = ("w1", "b1", "w2", "b2")


def train(rows: DataFrame, start: Towers, epochs: int = 5, rate: float = 0.02) -> tuple[Towers, list[float]]:
    """Synchronous rounds of Adam over all rows. Returns the losses before each round."""
    t = replace(start, layers=TwoTower.unpacked(start.layers.packed()))
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    losses = []
    for epoch in range(1, epochs + 1):
        x = written(pooled(t), "pooled")
        d = written(_unit_gradients(_met(rows, written(units(x, t.layers), "units")), t.layers.action.out), "unit-gradients")
        total = d.where("side = 'loss'").first()
        if total is None:
            return t, losses
        loss, n = total.d[:2]
        losses.append((loss / n) ** (1 / OMEGA))
        back = written(_layer_gradients(x, d.where("side <> 'loss'"), t.layers), "layer-gradients")
        flat = back.where("key IS NULL").select("side", F.posexplode("d").alias("j", "g")).groupBy("side", "j").agg(F.sum("g").alias("g"))
        sums: dict[str, dict[int, float]] = {side: {} for side in t.layers.sides()}
        for r in flat.collect():  # the layers' size
            sums[r.side][r.j] = r.g / n
        t = replace(t, embeddings=_embeddings_after(t, back.where("key IS NOT NULL"), n, epoch, rate))
        for side, tower in t.layers.sides().items():
            if not sums[side]:
                continue  # no resource of this source in any pair
            g, at = np.array([sums[side][j] for j in range(len(sums[side]))]), 0
            for k in LAYERS:
                own = g[at : at + tower.p[k].size].reshape(tower.p[k].shape)
                at += own.size
                m, v = moments.get(side + k, (np.zeros_like(own), np.zeros_like(own)))
                v_new = 0.999 * v + 0.001 * own * own
                m_new = 0.9 * m + 0.1 * own
                moments[side + k] = m_new, v_new
                tower.p[k] = tower.p[k] - rate * (m_new / (1 - 0.9**epoch)) / (np.sqrt(v_new / (1 - 0.999**epoch)) + 1e-8)
    return t, losses


def _embeddings_after(t: Towers, back: DataFrame, n: float, epoch: int, rate: float) -> DataFrame:
    """The embeddings after a step of Adam: gradients of pooled rows go to all members by weight."""
    e, m, v = (t.names(x) for x in "emv")
    dim = len(e)
    place = lambda f: F.when(f < OWN, F.greatest(f - 1, F.lit(0))).otherwise(0) * dim
    shares = [(F.col("w") * F.get("d", (place(F.col("f")) + j).cast("int"))).alias(f"g{j}") for j in range(dim)]
    each = t.members.join(back, ["side", "key"]).select(embedding(F.col("f")).alias("f"), "i", *shares)
    names = [f"g{j}" for j in range(dim)]
    for f, own in t.peers.tables().items():
        # by the same sums: the weight of two principals is that of the two the other way round
        mine = back.where("side = 'c'").select("key", *(F.get("d", (f - 1) * dim + j).alias(f"g{j}") for j in range(dim)))
        found = t.peers.spread(f, own.select("key").join(t.peers.divided(f, mine, names), "key", "left").fillna(0.0, names), names)
        each = each.unionByName(found.join(own, "key").select(embedding(F.lit(f)).alias("f"), "i", *names))
    g = each.groupBy("f", "i").agg(*(F.sum(c).alias(c) for c in names))
    rows = t.embeddings.join(g, ["f", "i"], "left")
    grad = [F.coalesce(F.col(f"g{j}"), F.lit(0.0)) / n for j in range(dim)]
    moved = rows.select("f", "i", *e, *((0.9 * F.col(m[j]) + 0.1 * grad[j]).alias(m[j]) for j in range(dim)), *((0.999 * F.col(v[j]) + 0.001 * grad[j] * grad[j]).alias(v[j]) for j in range(dim)))
    step = lambda j: rate * (F.col(m[j]) / (1 - 0.9**epoch)) / (F.sqrt(F.col(v[j]) / (1 - 0.999**epoch)) + 1e-8)
    return written(moved.select("f", "i", *((F.col(e[j]) - step(j)).alias(e[j]) for j in range(dim)), *m, *v), "embeddings")


def inner(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clamped(d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))


def distances(rows: DataFrame, t: Towers, unit: DataFrame | None = None) -> DataFrame:
    """Adds ``distances`` of the pair's resource to its own context and then to those of its negatives, and ``raw`` before they are kept within 0 and 1.

    ``unit`` has the towers' unit vectors, if they are written already.
    """
    unit = written(units(pooled(t), t.layers), "units") if unit is None else unit
    keys = [c for c in rows.columns if c != "others"]
    a = unit.where("side <> 'c'").select(F.col("key").alias("resource_key"), F.col("u").alias("a"))
    c = unit.where("side = 'c'").select(F.col("key").alias("who"), F.col("u").alias("c"))
    # each distance is taken where its two vectors meet, so that no vectors go on to the pairs
    slots = rows.select(*keys, F.posexplode(F.concat(F.array("principal_key"), "others")).alias("slot", "who"))
    each = slots.join(c, "who").join(a, "resource_key").select(*keys, "slot", (1 - inner("a", "c")).alias("raw"))
    listed = each.groupBy(keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "raw"))), lambda x: x["raw"]).alias("raw"))
    return listed.withColumn("distances", F.transform("raw", clamped))


#: What the gate asks for, and how many pairs a source needs to be judged and to have a policy of its own.
LEAST_TOP_1, LEAST_WIN_RATE, LEAST_MARGIN = 0.15, 0.55, 0.0
GATE_PAIRS, POLICY_PAIRS = 5, 3
#: Sources of identities and of resources, of which the gate asks for one each, and for two sources in all.
IDENTITY_SOURCES, RESOURCE_SOURCES, LEAST_SOURCES = ("okta",), ("github", "gworkspace", "snowflake"), 2
#: Thresholds without calibration, and bounds of calibrated ones.
DEFAULT_THRESHOLD, DEFAULT_HIGH, LEAST_THRESHOLD, MOST_THRESHOLD = 0.60, 0.80, 0.05, 0.99


def retrieval(scored: DataFrame) -> DataFrame:
    """Per source and in all, over pairs and their samples: share of pairs that no sample is nearer than, share nearer than the
    samples' mean, mean of that mean less the own distance, 95th percentile of own distances, and 50th and 90th of the samples' means.
    """
    own, others = F.get("raw", 0), F.slice("raw", 2, 1_000_000)
    mean = F.aggregate(others, F.lit(0.0), lambda s, x: s + x) / F.size(others)
    rows = scored.select("source", own.alias("own"), mean.alias("other"), (own <= F.array_min(others)).cast("double").alias("top"))
    both = written(rows.unionByName(rows.withColumn("source", F.lit("__all__"))), "retrieval")
    means = both.groupBy("source").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("top").alias("top_1"), F.avg((F.col("own") < F.col("other")).cast("double")).alias("win_rate"),
        F.avg(F.col("other") - F.col("own")).alias("mean_margin"), F.avg("own").alias("own_mean"), F.avg("other").alias("other_mean"),
    )
    at = lambda name, wanted: nearest_rank(both, "source", name, wanted, half_even=True).groupBy("source").agg(*(F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(f"{name}_{q}") for q in wanted))
    return means.join(at("own", {"p95": 0.95}), "source").join(at("other", {"p50": 0.5, "p90": 0.9}), "source")


def gate(metrics: DataFrame) -> DataFrame:
    """Adds whether each source with enough pairs, and all together, are good enough to be switched on, and the reason."""
    top, wins, margin = F.col("top_1") >= LEAST_TOP_1, F.col("win_rate") >= LEAST_WIN_RATE, F.col("mean_margin") > LEAST_MARGIN
    judged = (F.col("source") == "__all__") | (F.col("pairs") >= GATE_PAIRS)
    good = F.when(F.col("source") == "__all__", "sampled_retrieval_gate_pass").otherwise("source_sampled_retrieval_gate_pass")
    reason = F.when(top & wins & margin, good).when(~top, "sampled_top1_accuracy_below_threshold").when(~wins, "pairwise_win_rate_below_threshold").otherwise("mean_margin_below_threshold")
    return metrics.withColumn("passes", F.when(judged, top & wins & margin)).withColumn("reason", F.when(judged, reason))


def ranking_loss(rows: DataFrame) -> DataFrame:
    """The training loss of scored examples per source and over all: Huber's loss of each margin, the mean over a pair's samples, and the power mean over pairs."""
    margin = lambda x: F.greatest(F.lit(0.0), F.lit(MARGIN) + F.get("raw", 0) - x)
    points = F.transform(F.slice("raw", 2, F.size("raw") - 1), lambda x: huber_like(margin(x)))
    own = rows.where(F.size("raw") > 1).select("source", (F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / (F.size("raw") - 1)).alias("x"))
    every = own.select(F.explode(F.array(F.col("source"), F.lit("__all__"))).alias("source"), "x")
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), power_mean(F.col("x"), OMEGA).alias("loss"))


def activation(gated: DataFrame, training_pairs: int | None = None, final_loss: float | None = None) -> DataFrame:
    """One row: whether the model may be switched on, and why or why not; the sources that fail; and whether the sources that
    were judged cover identities and resources. ``training_pairs`` and ``final_loss`` are those of training, if it was done.

    A source that fails stops the model whatever the overall result; coverage is asked for only if all pass.
    """
    whole, judged = F.col("source") == "__all__", F.col("passes").isNotNull()
    covered = F.sort_array(F.collect_list(F.when(~whole & judged, F.col("source"))))  # a few sources
    flags = gated.agg(
        F.coalesce(F.bool_or(whole & F.col("passes")), F.lit(False)).alias("overall"), F.max(F.when(whole, F.col("reason"))).alias("overall_reason"), F.coalesce(F.max(F.when(whole, F.col("pairs"))), F.lit(0)).alias("held_out_pairs"),
        F.sort_array(F.collect_list(F.when(~whole & ~F.col("passes"), F.col("source")))).alias("failing"), covered.alias("covered"),
    )
    any_of = lambda names: F.arrays_overlap("covered", F.array(*map(F.lit, names)))
    coverage = F.when(F.size("covered") < LEAST_SOURCES, "insufficient_covered_sources").when(~any_of(IDENTITY_SOURCES), "identity_source_coverage_missing")
    coverage = coverage.when(~any_of(RESOURCE_SOURCES), "resource_source_coverage_missing").otherwise("cross_domain_coverage_gate_pass")
    # what makes a judgement impossible comes first
    blocked = None
    if training_pairs is not None and training_pairs <= 0:
        blocked = "no_training_pairs"
    elif training_pairs is not None and (final_loss is None or not np.isfinite(final_loss)):
        blocked = "final_loss_invalid"
    stop = F.when(F.lit(blocked is not None), F.lit(blocked)).when(F.col("held_out_pairs") == 0, "heldout_eval_missing")
    out = flags.withColumn("_stop", stop).withColumn("coverage_reason", F.coalesce("_stop", coverage))
    out = out.withColumns({c: F.when(F.col("_stop").isNull(), F.col(c)).otherwise(F.array().cast("array<string>")) for c in ("failing", "covered")})
    passes = F.col("coverage_reason") == "cross_domain_coverage_gate_pass"
    sources = F.size("failing") == 0
    reason = F.when(F.col("_stop").isNotNull(), F.col("_stop")).when(~sources, F.concat(F.lit("source_gate_failed:"), F.array_join("failing", ",")))
    reason = reason.when(F.col("overall") & ~passes, F.concat(F.lit("coverage_gate_failed:"), "coverage_reason")).otherwise(F.col("overall_reason"))
    eligible = F.col("_stop").isNull() & F.col("overall") & sources & passes
    return out.select(eligible.alias("eligible"), reason.alias("reason"), "failing", "covered", passes.alias("coverage_eligible"), "coverage_reason")


def policies(metrics: DataFrame, scope: str = "heldout") -> DataFrame:
    """Thresholds of each source with enough pairs, and of all together (source null, the global policy), rounded to 4 digits.

    The detection threshold is midway between the own distances' 95th and the samples' 50th percentile where these are apart; the one of
    high severity is the samples' 90th, at least 0.1 above. ``calibration_source`` and ``calibration_reason`` say where they come from.
    """
    c, bounded = F.col, lambda x: F.greatest(F.lit(LEAST_THRESHOLD), F.least(x, F.lit(MOST_THRESHOLD)))
    whole, apart = c("source") == "__all__", c("other_p50") > c("own_p95")
    rows = metrics.where(whole | (c("pairs") >= POLICY_PAIRS)).withColumn("t", bounded(F.when(apart, (c("own_p95") + c("other_p50")) / 2.0).otherwise(F.lit(DEFAULT_THRESHOLD))))
    most = F.lit(MOST_THRESHOLD)
    high = F.greatest(c("t") + 0.1, F.least(F.greatest(c("other_p90"), c("t") + 0.05), most))
    high = F.greatest(c("t"), F.least(high, most))
    reason = F.when(apart, "heldout_midpoint_between_positive_p95_and_negative_p50").otherwise("fallback_default_threshold_due_to_overlap")
    source = F.when(whole, F.lit(scope)).otherwise(F.concat(F.lit(f"{scope}:"), "source"))
    return rows.select(F.when(~whole, c("source")).alias("source"), F.round("t", 4).alias("detection_threshold"), F.round(high, 4).alias("high_severity_threshold"), source.alias("calibration_source"), reason.alias("calibration_reason"), F.when(~whole, c("pairs")).alias("pairs"))


def calibrated(scored: DataFrame) -> DataFrame:
    """The policies of pairs and their samples."""
    return policies(retrieval(scored))


def policy_of(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds the policy of each row's source, else the global one, else the defaults, and ``policy_scope`` (the source or ``global``)."""
    names = ("detection_threshold", "high_severity_threshold", "calibration_source", "calibration_reason")
    few = policy.select(F.col("source").alias("_source"), *(F.col(c).alias(f"_{c}") for c in names))  # a row per source and one more
    common = F.broadcast(few.where("_source IS NULL").drop("_source").agg(*(F.max(f"_{c}").alias(f"_global_{c}") for c in names)))
    out = rows.join(F.broadcast(few.where("_source IS NOT NULL")), F.col("source") == F.col("_source"), "left").join(common)
    own = F.col("_source").isNotNull()
    defaults = {"detection_threshold": F.lit(DEFAULT_THRESHOLD), "high_severity_threshold": F.lit(DEFAULT_HIGH), "calibration_source": F.lit(None).cast("string"), "calibration_reason": F.lit(None).cast("string")}
    out = out.withColumns({c: F.when(own, F.col(f"_{c}")).otherwise(F.coalesce(F.col(f"_global_{c}"), defaults[c])) for c in names})
    out = out.withColumn("policy_scope", F.when(own, F.col("source")).otherwise("global")).withColumn("high_severity_threshold", F.greatest("high_severity_threshold", "detection_threshold"))
    return out.drop("_source", *(f"_{c}" for c in names), *(f"_global_{c}" for c in names))


def observations(events: DataFrame, found: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per event scored by rules: the distance of its resource and principal if there is one, else the rules' score."""
    pairs = found.select("resource_key", "principal_key", F.get("distances", 0).alias("_distance"))  # a resource has one source
    rows = policy_of(events.join(pairs, ["resource_key", "principal_key"], "left"), policy)
    modelled = F.col("_distance").isNotNull()
    score, threshold = F.coalesce("_distance", "score"), F.when(modelled, F.col("detection_threshold")).otherwise(F.lit(DEFAULT_THRESHOLD))
    return rows.select("event_id", "source", "truth", F.round(score, 2).alias("score"), threshold.alias("threshold"), (score >= threshold).alias("detected"), F.when(modelled, "model").otherwise("rules").alias("scoring_mode"))


def average_linkage(vectors: np.ndarray, sizes: np.ndarray, delta: float) -> np.ndarray:
    """Cluster of each unit vector: the closest clusters by mean cosine distance merge while they are within ``delta``.

    A chain of nearest neighbours ends in two that are nearest to each other. These can merge at once, since a merger never brings
    clusters nearer to others than the nearer of both was; a cluster whose nearest is beyond ``delta`` is done for the same reason. So
    each vector costs a few rows of the matrix.
    """
    d = np.clip(1 - vectors @ vectors.T, 0, 2)
    np.fill_diagonal(d, np.inf)
    label, size, left = np.arange(len(vectors)), sizes.astype(float), np.ones(len(vectors), bool)
    for start in range(len(vectors)):
        chain = []
        while left[start]:  # smaller ones are done, so a merger with this one keeps its number
            chain = chain or [start]
            x = chain[-1]
            y = int(d[x].argmin())
            if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
                y = chain[-2]
            if not d[x, y] <= delta:
                left[x] = False
                d[x], d[:, x] = np.inf, np.inf
                chain.pop()
            elif len(chain) > 1 and y == chain[-2]:
                i, j = min(x, y), max(x, y)
                merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
                d[i], d[:, i] = merged, merged
                d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
                size[i] += size[j]
                label[label == j] = i
                left[j] = False
                del chain[-2:]
            else:
                chain.append(y)
    return label


def multi_scale(vectors: np.ndarray, scores: np.ndarray, delta: float = 0.3) -> float:
    """Sum over clusters of their highest score; equal vectors are one with their number as weight."""
    if not len(scores):
        return 0.0
    unique, place, n = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
    best = np.full(len(unique), -np.inf)
    np.maximum.at(best, place.reshape(-1), scores)
    label = average_linkage(unique, n, delta)
    return float(sum(best[label == c].max() for c in np.unique(label)))


#: Vectors of a principal that one task clusters at once, and vectors of a block when there are more.
MOST_LOCAL, BLOCK = 2048, 1024
#: A vector goes once to each block of its principal, so there are no more blocks than this while a block has up to ``LARGEST_BLOCK``; rows of a block compared at once.
MOST_BLOCKS, LARGEST_BLOCK, STRIPE = 8, 65_536, 256


def _dealt(clusters: DataFrame, block: int) -> DataFrame:
    """Each cluster once for each pair of its principal's blocks that has its own one."""
    few = F.least(F.ceil(F.count(F.lit(1)) / block), F.lit(MOST_BLOCKS))
    number = clusters.groupBy("principal").agg(F.greatest(few, F.ceil(F.count(F.lit(1)) / LARGEST_BLOCK)).cast("int").alias("blocks")).withColumnRenamed("principal", "_p")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = clusters.join(number, F.col("principal").eqNullSafe(F.col("_p"))).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("principal", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "id", "v")


def _nearest(clusters: DataFrame, block: int) -> DataFrame:
    """(id, d, other): for each cluster the one of its principal at the least mean distance, of equal ones the least id.

    A principal's clusters are cut into blocks; a task compares two blocks, for both sides at once, some rows at a time.
    """
    pairs = _dealt(clusters, block)
    stripe = STRIPE

    def work(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy())
        ids, own = t.column("id").to_numpy()[order], t.column("own").to_numpy()[order]
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        best, other = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)

        def nearer(rows: np.ndarray, d: np.ndarray, found: np.ndarray) -> None:
            less = d < best[rows]  # of equal ones the first, which has the least id
            best[rows[less]], other[rows[less]] = d[less], found[less]

        for start in range(0, len(a), stripe):
            rows = a[start : start + stripe]
            columns = b if lo < hi else b[start:]  # within a block each pair once
            if not len(columns):
                break
            d = np.clip(1 - v[rows] @ v[columns].T, 0, 2)
            if lo == hi:
                d[np.tril_indices(len(rows), 0, len(columns))] = np.inf
            nearer(columns, d.min(axis=0), ids[rows][d.argmin(axis=0)])
            nearer(rows, d.min(axis=1), ids[columns][d.argmin(axis=1)])
        met = np.isfinite(best)
        return pa.table({"id": ids[met], "d": best[met], "other": other[met]})

    found = pairs.groupBy("principal", "lo", "hi").applyInArrow(work, "id long, d double, other long").where(F.col("d") <= 2)
    return found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("x")).select("id", "x.d", "x.other")


def _merged(clusters: DataFrame, delta: float, block: int) -> tuple[DataFrame, bool]:
    """The clusters after mutual nearest ones within ``delta`` have merged, and whether any have."""
    near = written(_nearest(clusters, block).where(F.col("d") <= delta), "nearest")
    back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
    both = written(near.join(back, ["id", "other"]).where("id < other").select("id", "other"), "mutual")
    if both.isEmpty():
        return clusters, False
    gone = clusters.select(F.col("id").alias("other"), F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("score").alias("score2")).join(both, "other").drop("other")
    rows = clusters.join(both.select(F.col("other").alias("id")), "id", "left_anti").join(gone, "id", "left")
    mean = F.when(F.col("n2").isNull(), F.col("v")).otherwise(F.zip_with("v", "v2", lambda x, y: (x * F.col("n") + y * F.col("n2")) / (F.col("n") + F.col("n2"))))
    out = rows.select("principal", "id", mean.alias("v"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("score", "score2").alias("score"))
    return written(out, "clusters"), True


def cluster_scores(rows: DataFrame, delta: float = 0.3, most_local: int = MOST_LOCAL, block: int = BLOCK) -> DataFrame:
    """Multi-scale score per principal from rows (principal, vector, score), vectors of unit length.

    Actions of a principal with equal vectors are made one row by Spark first. A principal with up to
    ``most_local`` of these is clustered in one task. For others, mutual nearest clusters merge in rounds:
    the mean distance of two clusters is 1 less the product of their mean vectors, and it never falls by a
    merger below the least of both parts' distances, so the clusters are those of merging the closest first.
    """
    kind = dict(rows.dtypes)["principal"]
    each = rows.groupBy("principal", "vector").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    clusters = written(each.select("principal", F.monotonically_increasing_id().alias("id"), F.col("vector").cast("array<double>").alias("v"), "n", "score"), "clusters")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, s = np.stack(pdf["v"].to_list()).astype(float), pdf["score"].to_numpy()
        label = average_linkage(v, pdf["n"].to_numpy(), delta)
        return pd.DataFrame({"principal": [pdf["principal"].iloc[0]], "clusters": [len(np.unique(label))], "score": [float(sum(s[label == c].max() for c in np.unique(label)))]})

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy(F.col("principal").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        sized = df.join(sizes, F.col("principal").eqNullSafe(F.col("_p")))
        return (sized.where(F.col("_n") <= most_local).drop("_p", "_n"), sized.where(F.col("_n") > most_local).drop("_p", "_n"))

    small, large = split(clusters)
    out = small.groupBy("principal").applyInPandas(work, f"principal {kind}, clusters long, score double")
    more = not large.isEmpty()
    while more:
        large, more = _merged(written(large, "clusters"), delta, block)
        if more:
            small, large = split(large)
            out = out.unionByName(small.groupBy("principal").applyInPandas(work, f"principal {kind}, clusters long, score double"))
            more = not large.isEmpty()
        else:
            out = out.unionByName(large.groupBy("principal").agg(F.count(F.lit(1)).alias("clusters"), F.sum("score").alias("score")))
    return out


def blanked(context: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Contexts with some fields emptied, for ablation."""
    gone = [CONTEXT_FIELDS.index(n) for n in names]
    keep: Column = F.transform("context", lambda f, i: F.when(i.isin(gone), F.array().cast(SET)).otherwise(f))
    return context.withColumn("context", keep)
