"""Feature tables: accessor sets, history windows, collaboration, static profiles and peer groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import nonempty, privilege_level, tenure_bucket
from vigil.session import written


def access_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("resource_key", "principal_key").agg(F.count(F.lit(1)).alias("access_count"))


def accessors(events: DataFrame) -> DataFrame:
    """Share of each principal in the accesses of each resource, with the resource's first source.

    Counts per resource and principal are summed by resource and joined, so a popular resource isn't one task's.
    """
    first = F.min(F.struct("observed_at", "event_id", "source")).alias("first")
    counts = events.groupBy("resource_key", "principal_key").agg(F.count(F.lit(1)).alias("access_count"), first)
    whole = counts.groupBy("resource_key").agg(F.sum("access_count").alias("_all"), F.min("first")["source"].alias("source"))
    share = (F.col("access_count") / F.col("_all")).alias("accessor_weight")
    return counts.join(whole, "resource_key").select("resource_key", "principal_key", "access_count", share, "source")


def with_snapshot(events: DataFrame, cuts: list[str]) -> DataFrame:
    """Events before the last cut, with ``snapshot``: the number of the first cut that they are before."""
    at = [F.col("observed_at") < F.lit(c).cast("timestamp_ntz") for c in cuts]
    number = reduce(lambda rest, i: F.when(at[i], i).otherwise(rest), reversed(range(len(cuts))), F.lit(None).cast("int"))
    return events.withColumn("snapshot", number).where("snapshot IS NOT NULL")


def nested(events: DataFrame, n: int) -> dict[str, DataFrame]:
    """Accessors, history and latest attributes as they stood at each of ``n`` nested snapshots, with a column ``snapshot``.

    Events are counted once, by the first snapshot that holds them; what a snapshot adds goes to it and to all later ones.
    """
    later = F.explode(F.sequence("first_in", F.lit(n - 1))).alias("snapshot")
    rows = events.withColumnRenamed("snapshot", "first_in")
    first = F.min(F.struct("observed_at", "event_id", "source")).alias("first")
    added = rows.groupBy("first_in", "resource_key", "principal_key").agg(F.count(F.lit(1)).alias("c"), first)
    counts = added.select("*", later).groupBy("snapshot", "resource_key", "principal_key").agg(F.sum("c").alias("access_count"), F.min("first").alias("first"))
    whole = counts.groupBy("snapshot", "resource_key").agg(F.sum("access_count").alias("_all"), F.min("first")["source"].alias("source"))
    acc = counts.join(whole, ["snapshot", "resource_key"]).select("snapshot", "resource_key", "principal_key", "access_count", (F.col("access_count") / F.col("_all")).alias("accessor_weight"), "source")
    windows = rows.groupBy("principal_key", F.window("observed_at", "2 hours")["start"].alias("window_start"), "resource_key").agg(F.min("first_in").alias("first_in"))
    latest = F.max_by(F.struct("actor_email", "department", "role", "geo"), F.struct("observed_at", "event_id")).alias("l")
    at = F.max(F.struct("observed_at", "event_id")).alias("at")
    own = rows.groupBy("first_in", "principal_key").agg(latest, at).select("*", later).groupBy("snapshot", "principal_key").agg(F.max_by("l", "at").alias("l"))
    known = F.lit("unknown")
    profile = own.select("snapshot", "principal_key", nonempty(F.col("l.actor_email"), known).alias("principal_id"), nonempty(F.col("l.department"), known).alias("department"), nonempty(F.col("l.role"), known).alias("role"), nonempty(F.col("l.geo"), known).alias("location"))
    return {"accessors": acc, "history": windows.select("*", later).drop("first_in"), "latest": profile}


def history(events: DataFrame, trailing_days: int | None = None) -> DataFrame:
    """Distinct resources of each principal per two-hour window; optionally of the days before the latest event alone."""
    if trailing_days is not None:
        last = events.agg(F.max("observed_at").alias("_last"))
        events = events.join(F.broadcast(last)).where(F.col("observed_at") >= F.col("_last") - F.expr(f"INTERVAL {trailing_days} DAYS"))  # one row
    return events.select("principal_key", F.window("observed_at", "2 hours")["start"].alias("window_start"), "resource_key").distinct()


#: Principals of a block, and rows of a block that are weighed at once.
BLOCK, STRIPE = 4096, 256


#: Columns of counts that are multiplied at once, and how much more an addition by places costs than a multiplication.
COLUMNS, DEARER = 2048, 40


def _met(t: pa.Table) -> list[tuple]:
    """(places, places, resources) of one block's and the other's principals that are connected by resources that both blocks know.

    A resource has (places, counts, places of the other side, counts, size).
    """

    def entries(own: pa.Table) -> tuple:
        """Places, resources, counts and sizes, by resource."""
        place = np.repeat(np.arange(own.num_rows), own.column("r").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        r, c, n = (own.column(x).combine_chunks().flatten().to_numpy() for x in ("r", "c", "n"))
        order = np.lexsort((place, r))
        return place[order], r[order], c[order].astype(float), n[order].astype(float)

    lo, hi, own = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("own").to_numpy()
    mine = entries(t.filter(pa.array(own == lo)))
    theirs = mine if lo == hi else entries(t.filter(pa.array(own == hi)))
    known = np.intersect1d(mine[1], theirs[1])
    sides = []
    for place, r, c, n in (mine, theirs):
        kept = np.isin(r, known)
        sides.append((place[kept], np.searchsorted(known, r[kept]), c[kept], n[kept]))
    label, before = np.arange(len(known)), None
    while before is None or (label != before).any():
        before = label.copy()
        for place, r, _, _ in sides:
            least = np.full(place.max(initial=-1) + 1, len(known))
            np.minimum.at(least, place, label[r])
            np.minimum.at(label, r, least[place])
        label = label[label]
    (a, ra, ca, n), (b, rb, cb, _) = sides
    cuts = [(np.searchsorted(r, np.arange(len(known))), np.searchsorted(r, np.arange(len(known)), "right")) for r in (ra, rb)]
    out = []
    for one in np.unique(label):
        parts = [(slice(cuts[0][0][r], cuts[0][1][r]), slice(cuts[1][0][r], cuts[1][1][r])) for r in np.flatnonzero(label == one)]
        rows, columns = np.unique(np.concatenate([a[x] for x, _ in parts])), np.unique(np.concatenate([b[y] for _, y in parts]))
        out.append((rows, columns, [(np.searchsorted(rows, a[x]), ca[x], np.searchsorted(columns, b[y]), cb[y], n[x.start]) for x, y in parts]))
    return out


def _stripes(t: pa.Table, stripe: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, bool]]:
    """(keys, keys, weights, whether both are of one block) of some of one block's principals with those of the other's that they are connected with.

    The smaller of two counts is a sum over levels that both reach, so resources that many share are weighed by products of matrices;
    others are added up place by place.
    """
    lo, hi, own = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("own").to_numpy()
    keys = [t.filter(pa.array(own == x)).column("principal_key").combine_chunks() for x in (lo, hi)]
    for rows, columns, resources in _met(t):
        dense, places = [], []
        for a, c, b, k, n in resources:
            levels = np.unique(np.concatenate([c, k]))
            levels = levels[levels <= min(c.max(), k.max())]
            steps = np.diff(levels, prepend=0.0) / n
            if len(levels) * len(rows) * len(columns) < DEARER * len(a) * len(b):
                dense += [(a, c, b, k, level, step) for level, step in zip(levels, steps)]
            else:
                places.append((a, c, b, k, n))
        for first in range(0, len(rows), stripe):
            w = np.zeros((min(stripe, len(rows) - first), len(columns)))
            for at in range(0, len(dense), COLUMNS):
                some = dense[at : at + COLUMNS]
                x, y = np.zeros((len(w), len(some))), np.zeros((len(columns), len(some)))
                for j, (a, c, b, k, level, step) in enumerate(some):
                    i, e = np.searchsorted(a, (first, first + len(w)))
                    x[a[i:e][c[i:e] >= level] - first, j] = step
                    y[b[k >= level], j] = 1.0
                w += x @ y.T
            for a, c, b, k, n in places:
                i, e = np.searchsorted(a, (first, first + len(w)))
                if i < e:
                    w[np.ix_(a[i:e] - first, b)] += np.minimum(c[i:e, None], k) * (1.0 / n)
            if lo == hi:
                w[np.arange(len(w)), first + np.arange(len(w))] = 0.0  # rows and columns are the same
            yield keys[0].take(pa.array(rows[first : first + len(w)])), keys[1].take(pa.array(columns)), w, lo == hi


def _blocks(counts: DataFrame, max_accessors: int | None):
    """Principals with their shared resources (numbers, counts, sizes), grouped by pairs of blocks."""
    counts = written(counts.select("resource_key", "principal_key", "access_count"), "counts")
    size = counts.groupBy("resource_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if max_accessors is not None:
        size = size.where(F.col("n") <= max_accessors)
    size = written(size.withColumn("r", F.monotonically_increasing_id()), "sizes")
    listed = F.collect_list(F.struct("r", F.col("access_count").alias("c"), "n")).alias("x")
    own = counts.where("principal_key IS NOT NULL").join(size, "resource_key").groupBy("principal_key").agg(listed)
    own = written(own.select("principal_key", "x.r", "x.c", "x.n"), "accessed")
    blocks = own.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    dealt = own.join(F.broadcast(blocks)).withColumn("own", F.pmod(F.xxhash64("principal_key"), F.col("blocks")).cast("int"))  # one row
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "principal_key", "r", "c", "n").groupBy("lo", "hi")


def collaboration(events: DataFrame, max_accessors: int | None = None) -> DataFrame:
    """Co-access weight of principals: over shared resources, the smaller count by the number of accessors."""
    return weighed(access_counts(events), max_accessors)


def weighed(counts: DataFrame, max_accessors: int | None = None) -> DataFrame:
    """The same from (resource_key, principal_key, access_count).

    Principals are dealt to blocks, and a task weighs one block against another over the resources that both know, some
    rows at a time. So what is shuffled is each principal's counts once for each block; pairs come out with their weight summed
    and are never shuffled. A task hands over matrices with the keys of their rows and columns, from which Spark makes the pairs.
    ``max_accessors`` leaves out resources that more principals share; without it all are kept.
    """

    stripe = STRIPE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for a, b, w, same in _stripes(pa.Table.from_batches(batches), stripe):
            for x, y, v in ((a, b, w),) if same else ((a, b, w), (b, a, w.T)):
                yield pa.RecordBatch.from_arrays([listed(x), listed(y), listed(pa.array(np.ascontiguousarray(v).reshape(-1)))], ["a", "b", "w"])

    met = _blocks(counts, max_accessors).applyInArrow(work, "a array<string>, b array<string>, w array<double>")
    each = met.select("b", "w", F.size("b").alias("width"), F.posexplode("a").alias("i", "principal_key"))
    each = each.select("w", "width", "i", "principal_key", F.posexplode("b").alias("j", "collaborator_key"))
    weight = F.get("w", F.col("i") * F.col("width") + F.col("j")).alias("co_access_weight")
    return each.select("principal_key", "collaborator_key", weight).where("co_access_weight > 0")


def collaboration_size(events: DataFrame) -> DataFrame:
    """One row: the number of rows of ``collaboration``, which aren't made."""

    stripe = STRIPE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(np.count_nonzero(w)) * (1 if same else 2) for _, _, w, same in _stripes(pa.Table.from_batches(batches), stripe))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return _blocks(access_counts(events), None).applyInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"))


def latest_static(events: DataFrame) -> DataFrame:
    """Attributes of each principal from its latest event; of equal times the later event id."""
    known = F.lit("unknown")
    latest = F.max_by(F.struct("actor_email", "department", "role", "geo"), F.struct("observed_at", "event_id")).alias("l")
    return events.groupBy("principal_key").agg(latest).select(
        "principal_key", nonempty(F.col("l.actor_email"), known).alias("principal_id"), nonempty(F.col("l.department"), known).alias("department"), nonempty(F.col("l.role"), known).alias("role"), nonempty(F.col("l.geo"), known).alias("location")
    )


def static_profiles(events: DataFrame, principals: DataFrame) -> DataFrame:
    """Latest attributes, overridden by what the organisation says, with tenure and privilege."""
    return profiles(latest_static(events), principals)


def profiles(latest: DataFrame, principals: DataFrame) -> DataFrame:
    """The same from the latest attributes."""
    org = principals.select(F.col("email"), "idx", *(F.col(c).alias(f"org_{c}") for c in ("department", "role", "location")))
    rows = latest.join(org, F.col("principal_id") == F.col("email"), "left")
    pick = lambda c: F.coalesce(nonempty(F.col(f"org_{c}")), F.col(c)).alias(c)
    out = rows.select("principal_key", "principal_id", pick("department"), pick("role"), pick("location"), F.when(F.col("idx").isNull(), "1-3yr").otherwise(tenure_bucket(F.col("idx"))).alias("employment_duration_bucket"))
    return out.withColumn("privilege_level", privilege_level(F.col("role")))


def _peers(a: DataFrame, kind: str, weight) -> DataFrame:
    return a.select("principal_key", "peer_key", F.lit(kind).alias("peer_type"), weight.alias("peer_weight"))


#: Keys of a block of peers that share all their groups, and of a run of them that is repeated for each other key: as many as Parquet packs
#: into one stretch, so that repeated runs are equal bytes.
PEERS, RUN = 4096, 504


def _group_pairs(rows: DataFrame) -> DataFrame:
    """(principal_key, peer_key, peer_weight): pairs of different keys whose groups meet, each once, of (key, groups, apart).

    ``groups`` has a principal's groups (g, n, k), sorted; two weigh the product of their k by the first one's n, summed over their groups.
    Those with a common number in ``apart`` aren't paired.
    Keys with the same groups are put into blocks, and a group's blocks are dealt out for each block of the other side. Two blocks are paired
    in the least group that they share, with their whole weight. So pairs come out summed and are never shuffled, and what is shuffled is a few
    thousandths of them. Peers come in runs that repeat for each principal, so columns are written small.
    """
    session = rows.sparkSession
    own = written(rows, "peers")
    same = ["groups", "apart"]
    count = own.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / PEERS).alias("blocks"))
    dealt = own.join(count, same).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    keys = F.sort_array(F.collect_list(F.struct("key")))["key"]  # collect_list itself drops nulls
    blocks = written(dealt.groupBy(*same, "block").agg(keys.alias("keys")), "blocks")
    in_group = blocks.withColumn("g", F.explode(F.array_distinct("groups.g")))
    sides = written(in_group.groupBy("g").agg(F.ceil(F.sum(F.size("keys")) / PEERS).cast("int").alias("sides")), "sides")
    more = sides.agg(F.sum(F.col("sides") * F.col("sides") - 1)).first()[0] or 0
    parts = int(session.conf.get("spark.sql.shuffle.partitions")) + 2 * more
    side = in_group.join(sides, "g").withColumn("side", F.pmod(F.col("block") + F.pmod(F.xxhash64(*same), "sides"), "sides").cast("int"))
    side = side.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))

    def dealt_as(lo: str, hi: str, name: str) -> DataFrame:
        named = [F.col(c).alias(f"{name}_{c}") for c in (*same, "keys")]
        return side.select("g", F.col(lo).alias("lo"), F.col(hi).alias("hi"), *named).repartition(parts, "g", "lo", "hi")

    met = dealt_as("side", "with", "a").join(dealt_as("with", "side", "b").hint("merge"), ["g", "lo", "hi"])
    met = met.where("g = array_min(array_intersect(a_groups.g, b_groups.g)) AND NOT arrays_overlap(a_apart, b_apart)")
    weight = F.expr("aggregate(a_groups, 0D, (w, x) -> w + aggregate(filter(b_groups, y -> y.g = x.g), 0L, (c, y) -> c + y.k) * x.k / x.n)")
    runs = F.expr(f"transform(sequence(0, (size(b_keys) - 1) div {RUN}), i -> slice(b_keys, i * {RUN} + 1, {RUN}))")
    met = met.select("a_keys", F.explode(runs).alias("run"), weight.alias("peer_weight"))
    met = met.select(F.explode("a_keys").alias("principal_key"), "run", "peer_weight").select("principal_key", F.explode("run").alias("peer_key"), "peer_weight")
    return met.where("NOT principal_key <=> peer_key")


def department_peers(static: DataFrame) -> DataFrame:
    """Pairs of one department. Quadratic in a department by definition; consumers that only count use the grouped table."""
    known = static.where("principal_key IS NOT NULL AND department IS NOT NULL")
    group = F.array(F.struct(F.col("department").alias("g"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("k")))
    pairs = _group_pairs(known.select(F.col("principal_key").alias("key"), group.alias("groups"), F.array().cast("array<long>").alias("apart")))
    return _peers(pairs, "department", F.lit(1.0))


def _people(static: DataFrame, principals: DataFrame) -> DataFrame:
    """Principals with a profile: idx, manager and the key of the profile (the greatest of an e-mail's keys)."""
    own = static.groupBy(F.col("principal_id").alias("email")).agg(F.max("principal_key").alias("key"))
    return principals.select("idx", "email", "manager_idx").join(own, "email")


def manager_peers(static: DataFrame, principals: DataFrame) -> DataFrame:
    """Siblings under one manager with weight 1; cousins, whose managers are siblings, with 0.5."""
    people = _people(static, principals)
    me = people.select(F.col("key").alias("principal_key"), F.col("manager_idx").alias("m"), F.col("email").alias("me"))
    other = people.select(F.col("key").alias("peer_key"), F.col("manager_idx").alias("om"), F.col("email").alias("them"))
    siblings = me.join(other, F.col("m") == F.col("om")).where("me <> them").select("principal_key", "peer_key")
    boss = principals.select(F.col("idx").alias("m"), F.col("manager_idx").alias("g"))
    uncle = principals.select(F.col("idx").alias("om"), F.col("manager_idx").alias("g"))
    cousins = me.join(boss, "m").join(uncle, "g").where("m <> om").join(other, "om").where("me <> them").select("principal_key", "peer_key").distinct()
    cousins = cousins.join(siblings, ["principal_key", "peer_key"], "left_anti")
    return _peers(siblings, "manager", F.lit(1.0)).unionByName(_peers(cousins, "manager", F.lit(0.5)))


def team_members(static: DataFrame, principals: DataFrame, teams: DataFrame) -> DataFrame:
    """(team, n, member, key): members of teams of more than one that have a profile, with the team's size."""
    people = _people(static, principals).select("idx", "key")
    return teams.withColumn("n", F.size("member_indices")).where("n > 1").select("team", "n", F.explode("member_indices").alias("idx")).join(people, "idx").withColumnRenamed("idx", "member")


def team_peers(static: DataFrame, principals: DataFrame, teams: DataFrame) -> DataFrame:
    """Members of one team, weight one by its size, summed over the teams that two share. Quadratic in a team by definition.

    A member isn't its own peer. That matters where one member has several keys or one key several members: such pairs are made from
    members, the others from sets of teams.
    """
    member = written(team_members(static, principals, teams).where("team IS NOT NULL"), "members")
    shared = member.groupBy("member").agg(F.count_distinct(F.struct("key")).alias("keys")).where("keys > 1").select("member")
    links = written(member.select("member", "key").distinct().join(shared, "member"), "links")
    apart = links.groupBy("key").agg(F.sort_array(F.collect_set("member")).alias("apart"))
    sets = member.groupBy("key", F.col("team").alias("g"), F.col("n").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    sets = sets.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("g", "n", "k"))).alias("groups"))
    rows = sets.join(apart.withColumnRenamed("key", "own"), F.col("key").eqNullSafe(F.col("own")), "left")
    rows = rows.select("key", "groups", F.coalesce("apart", F.array().cast("array<long>")).alias("apart"))

    several = member.groupBy("key").agg(F.count_distinct("member").alias("members")).where("members > 1").select(F.col("key").alias("p"), F.col("key").alias("q"))
    odd = links.select("member", F.col("key").alias("p")).join(links.select("member", F.col("key").alias("q")), "member").select("p", "q").where("NOT p <=> q")
    odd = several.unionByName(odd).distinct()
    a = member.select(F.col("team").alias("t"), "n", F.col("member").alias("i"), F.col("key").alias("principal_key"))
    b = member.select(F.col("team").alias("u"), F.col("member").alias("j"), F.col("key").alias("peer_key"))
    odd = odd.join(a, F.col("p").eqNullSafe(F.col("principal_key"))).join(b, F.col("q").eqNullSafe(F.col("peer_key")) & (F.col("t") == F.col("u"))).where("i <> j")
    odd = odd.groupBy("principal_key", "peer_key").agg(F.sum(F.lit(1.0) / F.col("n")).alias("peer_weight"))
    return _peers(_group_pairs(rows).unionByName(odd), "group", F.col("peer_weight"))


def peer_groups(static: DataFrame, principals: DataFrame, teams: DataFrame) -> DataFrame:
    """All three kinds."""
    return reduce(DataFrame.unionByName, [department_peers(static), manager_peers(static, principals), team_peers(static, principals, teams)])


def peer_counts(static: DataFrame, principals: DataFrame, teams: DataFrame) -> DataFrame:
    """(principal_key, peer_type, n, peers): how many rows of ``peer_groups`` of each kind a principal has, and how many different peers, for
    those who have any, without pairs of departments and teams.

    Who is in the same teams has the same peers, so sets of teams that meet are paired, and their members are counted.
    """
    kind = lambda rows, name, peers="n": rows.where("n > 0").select("principal_key", F.lit(name).alias("peer_type"), "n", F.col(peers).alias("peers"))
    size = static.groupBy("department").agg((F.count(F.lit(1)) - 1).alias("n"))
    department = static.select("principal_key", "department").join(size, "department")
    manager = manager_peers(static, principals).groupBy("principal_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("peer_key").alias("different"))
    member = team_members(static, principals, teams).groupBy("team", "key").agg(F.count_distinct("member").alias("k"))
    # a profile that two entries of a team share is its own peer
    sets = written(member.groupBy("key").agg(F.sort_array(F.collect_list("team")).alias("s"), (F.max("k") > 1).cast("long").alias("own")), "team-sets")
    number = sets.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    each = number.select("s", "c", F.explode("s").alias("team"))
    meet = each.select("s", "team").join(each.select(F.col("s").alias("other"), "c", "team"), "team").select("s", "other", "c").distinct()
    reach = meet.groupBy("s").agg(F.sum("c").alias("c"))
    group = sets.join(reach, "s").select(F.col("key").alias("principal_key"), (F.col("c") - 1 + F.col("own")).alias("n"))
    return reduce(DataFrame.unionByName, [kind(department, "department"), kind(manager, "manager", "different"), kind(group, "group")])


def first_team_peers(members: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """(principal_key, idx, weight): at least each principal's first ``n`` team peers by their ``idx`` in ``numbers`` (key, idx), with their whole weights.

    A team's first n + 1 members hold all of a member's first peers there, so the others aren't paired.
    """
    k = members.groupBy("team", "member", "key").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    own = k.groupBy("team", "key").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("team").orderBy("idx"))
    first = own.join(numbers, "key").withColumn("place", place).where(F.col("place") <= n + 1).select("team", "idx", F.col("key").alias("peer_key"), F.col("k").alias("peer_k"))
    both = own.join(first, "team").withColumn("w", F.when(F.col("key") == F.col("peer_key"), F.col("k") * F.col("k") - F.col("same")).otherwise(F.col("k") * F.col("peer_k")) / F.col("n"))
    return both.where("w > 0").groupBy(F.col("key").alias("principal_key"), "idx").agg(F.sum("w").alias("weight"))


def first_department_peers(static: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """(principal_key, idx, weight): each principal's first ``n`` or more department peers by their ``idx`` in ``numbers`` (key, idx).

    A department's first n + 1 members hold all of a member's first peers, so the others aren't paired.
    """
    own = static.select("principal_key", "department").join(numbers.select(F.col("key").alias("principal_key"), "idx"), "principal_key")
    place = F.row_number().over(Window.partitionBy("department").orderBy("idx"))
    first = own.withColumn("place", place).where(F.col("place") <= n + 1).select("department", "idx", F.col("principal_key").alias("peer_key"))
    both = static.select("principal_key", "department").join(first, "department").where("principal_key <> peer_key")
    return both.select("principal_key", "idx", F.lit(1.0).alias("weight"))


def first_collaborators(accessors: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """(principal_key, idx, weight): each principal's first ``n`` collaborators by their ``idx`` in ``numbers`` (key, idx), with their whole co-access weights.

    A resource's first n + 1 accessors hold all of an accessor's first collaborators there, so the others aren't paired.
    """
    counts = accessors.select("resource_key", "principal_key", F.col("access_count").alias("c"))
    size = counts.groupBy("resource_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = written(counts.join(size, "resource_key").join(numbers.select(F.col("key").alias("principal_key"), "idx"), "principal_key"), "accessed")
    place = F.row_number().over(Window.partitionBy("resource_key").orderBy("idx"))
    first = own.withColumn("place", place).where(F.col("place") <= n + 1).select("resource_key", F.col("idx").alias("peer"))
    met = own.select("resource_key", "principal_key", "idx").join(first, "resource_key").where("idx <> peer").select("principal_key", "peer").distinct()
    few = met.withColumn("place", F.row_number().over(Window.partitionBy("principal_key").orderBy("peer"))).where(F.col("place") <= n).select("principal_key", "peer")
    theirs = own.select("resource_key", F.col("idx").alias("peer"), F.col("c").alias("k"))
    both = few.join(own.select("principal_key", "resource_key", "c", "n"), "principal_key").join(theirs, ["resource_key", "peer"])
    return both.groupBy("principal_key", F.col("peer").alias("idx")).agg(F.sum(F.least("c", "k") * (F.lit(1.0) / F.col("n"))).alias("weight"))


def readiness(tables: dict[str, DataFrame], required: tuple[str, ...] = ("accessors", "history", "static", "peers"), counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """Row counts of the tables, and whether all required ones have rows. ``counted`` has those whose number of ``rows`` is known otherwise."""
    known = {n: t.agg(F.count(F.lit(1)).alias("rows")) for n, t in tables.items()} | (counted or {})
    counts = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("table"), "rows") for n, t in known.items()])
    needed = F.col("table").isin(*required)
    flags = counts.agg(F.bool_and(~needed | (F.col("rows") > 0)).alias("ready"))
    return counts.withColumn("required", needed).join(F.broadcast(flags))  # one row


def signature(df: DataFrame, key: str) -> DataFrame:
    """Number of rows and an order-free hash of their keys, to tell whether inputs changed."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(number), F.lit(0)).alias("hash"))


SQL = {
    "accessors": """
  SELECT resource_key, principal_key, n AS access_count, n / sum(n) OVER (PARTITION BY resource_key) AS accessor_weight,
    first_value(source) OVER (PARTITION BY resource_key ORDER BY o, e) AS source
  FROM (SELECT resource_key, principal_key, count(*) AS n, min(observed_at) AS o, arg_min(event_id, (observed_at, event_id)) AS e, arg_min(source, (observed_at, event_id)) AS source FROM accepted GROUP BY ALL)""",
    "history": "SELECT DISTINCT principal_key, time_bucket(INTERVAL 2 HOUR, observed_at, TIMESTAMP '1970-01-01') AS window_start, resource_key FROM accepted",
    "collaboration": """
  WITH c AS (SELECT resource_key, principal_key, count(*) AS n FROM accepted GROUP BY ALL), s AS (SELECT resource_key, count(*) AS k FROM c GROUP BY ALL),
  p AS (SELECT a.principal_key AS x, b.principal_key AS y, sum(least(a.n, b.n) * (1::DOUBLE / k)) AS w FROM c a JOIN c b ON a.resource_key = b.resource_key AND a.principal_key < b.principal_key JOIN s ON s.resource_key = a.resource_key GROUP BY ALL)
  SELECT x AS principal_key, y AS collaborator_key, w AS co_access_weight FROM p UNION ALL SELECT y, x, w FROM p""",
    "static": """
  WITH l AS (SELECT principal_key, arg_max(actor_email, (observed_at, event_id)) AS principal_id, arg_max(department, (observed_at, event_id)) AS department, arg_max(role, (observed_at, event_id)) AS role, arg_max(geo, (observed_at, event_id)) AS geo FROM accepted GROUP BY principal_key)
  SELECT principal_key, principal_id, coalesce(nullif(p.department, ''), nullif(l.department, ''), 'unknown') AS department, coalesce(nullif(p.role, ''), nullif(l.role, ''), 'unknown') AS role,
    coalesce(nullif(p.location, ''), nullif(geo, ''), 'unknown') AS location,
    CASE WHEN idx IS NULL THEN '1-3yr' WHEN (idx * 7.3::DOUBLE) % 6 < 0.25 THEN '<3mo' WHEN (idx * 7.3::DOUBLE) % 6 < 1 THEN '3-12mo' WHEN (idx * 7.3::DOUBLE) % 6 < 3 THEN '1-3yr' WHEN (idx * 7.3::DOUBLE) % 6 < 5 THEN '3-5yr' ELSE '5yr+' END AS employment_duration_bucket,
    CASE coalesce(nullif(p.role, ''), nullif(l.role, ''), 'unknown') WHEN 'security-admin' THEN 'admin' WHEN 'executive' THEN 'elevated' WHEN 'manager' THEN 'elevated' WHEN 'staff-engineer' THEN 'elevated' ELSE 'regular' END AS privilege_level
  FROM l LEFT JOIN principals p ON p.email = l.principal_id""",
    "people": "SELECT idx, email, manager_idx, k AS key FROM principals JOIN (SELECT principal_id, max(principal_key) AS k FROM static GROUP BY ALL) ON principal_id = email",
    "department_peers": "SELECT a.principal_key, b.principal_key AS peer_key, 'department' AS peer_type, 1::DOUBLE AS peer_weight FROM static a JOIN static b ON a.department = b.department AND a.principal_key <> b.principal_key",
    "manager_peers": """
  WITH s AS (SELECT a.key AS p, b.key AS q FROM people a JOIN people b ON a.manager_idx = b.manager_idx AND a.email <> b.email),
  c AS (SELECT DISTINCT a.key AS p, b.key AS q FROM people a JOIN principals m ON m.idx = a.manager_idx JOIN principals u ON u.manager_idx = m.manager_idx AND u.idx <> m.idx JOIN people b ON b.manager_idx = u.idx WHERE a.email <> b.email)
  SELECT p AS principal_key, q AS peer_key, 'manager' AS peer_type, 1::DOUBLE AS peer_weight FROM s UNION ALL SELECT p, q, 'manager', 0.5::DOUBLE FROM (SELECT * FROM c EXCEPT SELECT * FROM s)""",
    "team_peers": """
  WITH m AS (SELECT team, len(member_indices) AS n, unnest(member_indices) AS idx FROM teams), k AS (SELECT team, n, m.idx, key FROM m JOIN people ON people.idx = m.idx WHERE n > 1)
  SELECT a.key AS principal_key, b.key AS peer_key, 'group' AS peer_type, sum(1::DOUBLE / a.n) AS peer_weight FROM k a JOIN k b ON a.team = b.team AND a.idx <> b.idx GROUP BY ALL""",
    "peers": "SELECT * FROM department_peers UNION ALL SELECT * FROM manager_peers UNION ALL SELECT * FROM team_peers",
}
NEEDS = {"accessors": ["accepted"], "history": ["accepted"], "collaboration": ["accepted"], "static": ["accepted", "principals"], "people": ["static", "principals"], "department_peers": ["static"], "manager_peers": ["people", "principals"], "team_peers": ["people", "teams"], "peers": ["department_peers", "manager_peers", "team_peers"]}
