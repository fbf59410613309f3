"""Synthetic compositions: pools, connected plans, audits."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.operators import dedup
from quarry.operators.lineage import cut, numbered

#: Members of a structural class, in the order in which classes take turns.
ARITY = {"direct": 2, "branching": 3, "deep": 4}
#: Proof templates by class, of ordinary plans and of final-only ones; %n$s is the n-th member.
TEMPLATES = {
    "direct": ("and(leaf:%1$s,leaf:%2$s);path=2", "iff(forward:leaf:%2$s,backward:leaf:%1$s);path=2"),
    "branching": ("and(leaf:%1$s,iff(forward:leaf:%3$s,backward:leaf:%2$s));path=3", "iff(forward:and(leaf:%2$s,leaf:%3$s),backward:leaf:%1$s);path=3"),
    "deep": ("and(iff(forward:leaf:%2$s,backward:leaf:%1$s),iff(forward:leaf:%4$s,backward:leaf:%3$s));path>=3", "iff(forward:and(and(leaf:%2$s,leaf:%3$s),leaf:%4$s),backward:leaf:%1$s);path>=3"),
}
#: The tag that names a family, the family without a tag, and the one that it leaves out.
FAMILY_TAG, GENERIC, APART = "prime-family:", "generic", "prime-family:pnt-plus"
#: Every tenth plan, from the first on, is for the final evaluation only; attempts per plan asked for, and at least.
FINAL_EVERY, ATTEMPTS, LEAST_ATTEMPTS, RETRIEVED = 10, 200, 2000, 4


def pools(records: DataFrame) -> DataFrame:
    """Records by family, the first in order of ``pos`` for each (family, declaration name).

    A record is in the family of each of its family tags, and in the generic one unless it has the tag that is kept apart.
    """
    tags = F.coalesce("topic_tags", F.array().cast("array<string>"))
    named = F.transform(F.filter(tags, lambda t: t.startswith(FAMILY_TAG)), lambda t: F.substring(t, F.lit(len(FAMILY_TAG) + 1), F.length(t)))
    families = F.array_distinct(F.concat(F.when(F.array_contains(tags, APART), F.array().cast("array<string>")).otherwise(F.array(F.lit(GENERIC))), named))
    return dedup.keep_first(records.select("*", F.explode(families).alias("family")), ["family", "declaration_name"], ["pos"])


def template(structure: Column, members: Column, final_only: Column) -> Column:
    """The normalised proof template of a plan, over its members' ids."""
    out = F.lit(None).cast("string")
    for name, (plain, final) in TEMPLATES.items():
        slots = [F.get(members, F.lit(i)) for i in range(max(ARITY.values()))]
        out = F.when(structure == name, F.when(final_only, F.format_string(final, *slots)).otherwise(F.format_string(plain, *slots))).otherwise(out)
    return out


def generator(structure: Column, final_only: Column) -> Column:
    return F.when(final_only, F.concat(F.lit("final-only:"), structure, F.lit("-graph-iff-v2"))).otherwise(F.concat(structure, F.lit("-graph-logic-v2")))


def described(plans: DataFrame) -> DataFrame:
    """plans (with members, structural_class, final_only) and their template, generator and derivation fingerprint."""
    dag, made = template(F.col("structural_class"), F.col("members"), F.col("final_only")), generator(F.col("structural_class"), F.col("final_only"))
    return plans.withColumns({"normalized_proof_dag": dag, "generator_family": made}).withColumn(
        "derivation_family_fingerprint", dedup.family_fingerprint(F.col("members"), F.col("normalized_proof_dag"), F.col("generator_family"))
    )


def connected_plans(pool: DataFrame, relations: DataFrame, seed: str, quota: int) -> DataFrame:
    """Connected plans of every class, found by joins and picked by hash order: the distributed planner.

    pool: (family, statement_id); relations: (a, b) undirected.  Not the random walk's output, but its
    contract: members are connected, sets are distinct, at most ``quota`` plans a family and class.
    """
    edges = relations.select("a", "b").union(relations.select("b", "a")).where("a <> b").distinct()
    fam = pool.select("family", "statement_id").distinct()
    own = fam.join(edges, F.col("statement_id") == F.col("a")).select("family", "a", "b").join(fam.withColumnRenamed("statement_id", "b"), ["family", "b"]).select("family", "a", "b")
    h = F.sha2(F.concat_ws(x.NUL, F.lit(seed), "family", F.array_join("members", x.NUL)), 256)
    best = Window.partitionBy("family").orderBy("_h", "members")
    sets = own.where("a < b").select("family", F.array("a", "b").alias("members"))
    out = None
    for structure in ARITY:
        # a class has the first sets of its size by hash; only those grow on, so no level exceeds the quota
        sets = sets.withColumn("_h", h).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= quota).drop("_h")
        part = sets.withColumn("structural_class", F.lit(structure))
        out = part if out is None else out.unionByName(part)
        grown = sets.select("family", "members", F.explode("members").alias("a")).join(own, ["family", "a"]).where(~F.array_contains("members", F.col("b")))
        sets = grown.select("family", F.array_sort(F.array_append("members", F.col("b"))).alias("members")).distinct()
    return out


def _drawn(key: str, sizes: Sequence[int]) -> int:
    """The last of a row of draws below the sizes, from the generator that the key seeds."""
    draw = random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest(), "big")).randrange
    return [draw(n) for n in sizes][-1]


def _step(key: str, sizes: Sequence[int], ways: Sequence) -> dict | None:
    """The drawn way of a frontier: its source and the place in the source's list; ways: (place, source, degree, places of members) by place."""
    ways = sorted((w["place"], w["source"], w["degree"], sorted(w["held"])) for w in ways)
    total = sum(degree - len(held) for _, _, degree, held in ways)
    if not total:
        return None
    at = _drawn(key, [*sizes, total])
    for _, source, degree, held in ways:
        if at < degree - len(held):
            for k in held:  # members are passed over
                at += k <= at
            return {"source": source, "k": at, "total": total}
        at -= degree - len(held)
    return None


def _looked_up(look: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A function that numbers the neighbours of the declarations (family, a) asked for: (family, a, b, relation, k), with those of earlier calls; each is looked up once."""
    order = Window.partitionBy("family", "a").orderBy("b", "relation")  # over the neighbours of one declaration
    known: list[tuple[DataFrame, DataFrame]] = []

    def near(sources: DataFrame) -> DataFrame:
        fresh = sources.select("family", "a").distinct()
        if known:
            fresh = fresh.join(F.broadcast(known[0][0]), ["family", "a"], "left_anti")
        fresh = cut(fresh)
        if known and fresh.isEmpty():
            return known[0][1]
        found = cut(look(fresh).select("family", "a", "b", "relation", (F.row_number().over(order) - 1).cast("bigint").alias("k")))
        if known:
            fresh, found = cut(known[0][0].union(fresh)), known[0][1].union(found)
        known[:] = [(fresh, found)]
        return found

    return near


def _walked(asked: DataFrame, places: DataFrame, look: Callable[[DataFrame], DataFrame], seed: str) -> DataFrame:
    """Attempts (family, attempt, at, n, arity) with the names, members and steps of their walks; short where a walk could not grow.

    Every step looks up the neighbours of the names it starts from, and is one join for the drawn way, after two that count the frontier, so a
    task holds no family's neighbours.
    """
    first = F.udf(lambda key, n: _drawn(key, [n]), "bigint", useArrow=True)
    step = F.udf(_step, "struct<source:string,k:bigint,total:bigint>", useArrow=True)
    key = F.concat_ws(x.NUL, F.lit(seed), "family", F.col("attempt").cast("string"), F.col("at").cast("string"))
    own = asked.withColumn("_key", key).withColumn("_pos", first("_key", "n")).join(places, ["family", "_pos"])
    none = F.array().cast("array<struct<src:string,dst:string,relation:string>>")
    rows = own.select("family", "attempt", "at", "arity", "_key", F.array(F.col("n")).alias("_sizes"), F.array("name").alias("names"), none.alias("steps"))
    walk = ["family", "attempt", "at"]
    for size in range(1, max(ARITY.values())):
        rows = cut(rows)
        growing = rows.where((F.size("names") == size) & (F.col("arity") > size))
        sources = growing.select(*walk, "names", F.posexplode("names").alias("place", "a"))
        near = look(sources)
        degrees = near.groupBy("family", "a").agg(F.count(F.lit(1)).alias("degree"))
        held = sources.select(*walk, "place", "a", F.explode("names").alias("b")).join(near.select("family", "a", "b", "k"), ["family", "a", "b"]).groupBy(*walk, "place").agg(F.collect_list("k").alias("held"))
        ways = sources.join(degrees, ["family", "a"], "left").join(held, [*walk, "place"], "left")
        ways = ways.groupBy(*walk).agg(F.collect_list(F.struct("place", F.col("a").alias("source"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("held", F.array().cast("array<bigint>")).alias("held"))).alias("ways"))
        drawn = growing.join(ways, walk).withColumn("_d", step("_key", "_sizes", "ways")).where("_d is not null").select(*rows.columns, F.col("_d.source").alias("a"), F.col("_d.k").alias("k"), F.col("_d.total").alias("_total"))
        grown = drawn.join(near, ["family", "a", "k"]).select(
            "family", "attempt", "at", "arity", "_key", F.array_append("_sizes", F.col("_total")).alias("_sizes"), F.array_append("names", F.col("b")).alias("names"),
            F.array_append("steps", F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "relation")).alias("steps"),
        )
        rows = rows.where(~((F.size("names") == size) & (F.col("arity") > size))).unionByName(grown)
    return rows.where(F.size("names") == F.col("arity")).select(*walk, "arity", "names", "steps")


def walk_plans(pool: DataFrame, near: DataFrame | Callable[[DataFrame], DataFrame], counts: dict[str, int], seed: str, ahead: int = 256, lags: int = 4) -> DataFrame:
    """Seeded walks over each family's neighbours, classes in turn, sets of members distinct over all families.

    pool: (family, declaration_name, statement_id), names once a family; near: (family, a, b, relation) of declaration names, pairs once, as
    ``graph.neighbours`` gives, or a function as ``graph.neighbour_lookup`` gives, which is asked for the neighbours of names that walks reach; only
    the names of a round's walks are told to every task, at most four a walk.  Attempt i of a family has a generator seeded by (seed, family, i, plans so far), and fails if its walk
    cannot grow or its set was taken; a family that cannot give its count raises.

    Attempts run ahead in parallel: for the next ``ahead`` attempts, the walks for the numbers of plans so far that the share of failures up to now lets
    expect, give or take ``lags``.  The driver then follows the attempts in order with a digest of each walk's set, and asks for the next ones
    where it runs out.  It holds a digest for each plan asked for, and one row for each attempt of a round.
    """
    spark = pool.sparkSession
    own = pool.where(F.col("family").isin(*counts)).select("family", F.col("declaration_name").alias("name"), F.col("statement_id").cast("string").alias("id"))
    placed = numbered(own, ["family", "name"], "_at")
    sizes = placed.groupBy("family").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    n_of = {r["family"]: r["n"] for r in sizes.collect()}  # a row a family asked for
    places = cut(placed.join(F.broadcast(sizes), "family").select("family", (F.col("_at") - F.col("_first")).alias("_pos"), "name", "id"))
    if isinstance(near, DataFrame):
        rows = cut(near.where(F.col("family").isin(*counts)).select("family", "a", "b", "relation"))
        near = lambda wanted: rows.join(F.broadcast(wanted), ["family", "a"], "left_semi")
    look = _looked_up(near)
    classes, families = list(ARITY), sorted(counts)
    goals = dict(zip(families, itertools.accumulate(counts[f] for f in families), strict=True))
    for f in families:
        if n_of.get(f, 0) < max(ARITY.values()):
            raise ValueError(f"family {f} has {n_of.get(f, 0)} sources; four at least are needed")

    def walks(keys: list[tuple[str, int, int]]) -> DataFrame:
        asked = spark.createDataFrame([(f, i, at, n_of[f], ARITY[classes[at % len(classes)]]) for f, i, at in keys], "family string, attempt bigint, at bigint, n bigint, arity int")
        return _walked(asked, places.drop("id"), look, seed)

    known: dict[tuple[str, int, int], bytes | None] = {}
    taken: set[bytes] = set()
    accepted: list[tuple[str, int, int]] = []
    at_of = {f: goals[f] - counts[f] for f in families}
    tried = dict.fromkeys(families, 0)
    while True:
        waiting = []
        for f in families:
            while not waiting and at_of[f] < goals[f]:
                now = (f, tried[f] + 1, at_of[f])
                if now[1] > max(LEAST_ATTEMPTS, ATTEMPTS * counts[f]):
                    raise ValueError(f"family {f} gives fewer than {counts[f]} distinct plans")
                if now not in known:
                    break
                tried[f] += 1
                mark = known.pop(now)
                if mark is not None and mark not in taken:
                    taken.add(mark)
                    accepted.append(now)
                    at_of[f] += 1
            if at_of[f] < goals[f]:
                waiting.append(f)
        if not waiting:
            break
        # later families wait for the sets of earlier ones, but their walks need not
        keys = set()
        for f in (f for f in waiting if (f, tried[f] + 1, at_of[f]) not in known):
            rate = (at_of[f] - goals[f] + counts[f] + 1) / (tried[f] + 1)  # of attempts that gave a plan so far
            for i in range(ahead):
                least, most = max(0, math.floor(rate * i) - lags), min(i, math.floor(rate * i) + lags)
                keys |= {(f, tried[f] + 1 + i, at) for at in range(at_of[f] + least, min(at_of[f] + most + 1, goals[f]))}
        known = {k: v for k, v in known.items() if k[0] in waiting and k[1] > tried[k[0]]}
        known |= dict.fromkeys(keys)
        ids = places.select("family", "name", "id")
        members = walks(sorted(keys)).select("family", "attempt", "at", F.explode("names").alias("name")).join(ids, ["family", "name"])
        digest = F.sha2(F.array_join(F.array_sort(F.collect_set("id")), x.NUL), 256)
        for r in members.groupBy("family", "attempt", "at").agg(digest.alias("mark")).collect():
            known[r["family"], r["attempt"], r["at"]] = bytes.fromhex(r["mark"])
    plans = cut(walks(accepted)) if accepted else walks([])
    ids = plans.select("at", F.posexplode("names").alias("place", "name"), "family").join(places, ["family", "name"]).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("m"))
    structure = F.element_at(F.array(*map(F.lit, classes)), (F.col("at") % len(classes) + 1).cast("int"))
    return plans.join(ids, "at").select(
        F.col("at").cast("int").alias("pos"), "family", "names", F.col("m.id").alias("members"), structure.alias("structural_class"), (F.col("at") % FINAL_EVERY == 0).alias("final_only"), "steps"
    )


def retrieval(plans: DataFrame, pool: DataFrame, near: DataFrame, seed: str) -> DataFrame:
    """(pos, rank, declaration_name, origins): four declarations of the family beside each plan, by hash order.

    They are neighbours of members, or have the type head of the plan's own kind (iff for final-only plans, else and).
    """
    head = F.when(F.col("final_only"), "iff").otherwise("and")
    around = plans.select("pos", "family", "names", F.explode("names").alias("a")).join(near, ["family", "a"]).select(
        "pos", "names", F.col("b").alias("declaration_name"), F.concat(F.lit("dependency-relevance-neighborhood:"), "relation").alias("origin")
    )
    alike = plans.select("pos", "family", "names", head.alias("type_head")).join(pool.select("family", "type_head", "declaration_name"), ["family", "type_head"]).select(
        "pos", "names", "declaration_name", F.concat(F.lit("type-head:"), "type_head").alias("origin")
    )
    every = around.union(alike).where(~F.array_contains("names", F.col("declaration_name"))).groupBy("pos", "declaration_name").agg(F.array_sort(F.collect_set("origin")).alias("o"))
    h = F.sha2(F.concat_ws(x.NUL, F.lit(seed), F.col("pos").cast("string"), F.lit("retrieval"), "declaration_name"), 256)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(h, "declaration_name"))).where(F.col("rank") <= RETRIEVED)
    return ranked.select("pos", "rank", "declaration_name", F.array_join("o", ",").alias("origins"))


def audit(plans: DataFrame) -> DataFrame:
    """Plans with what fails: dependencies that were planned and not used, a wrong arity, unconnected members.

    plans: (plan_id, structural_class, planned, actual, members, edges array<struct<src,dst>>).
    """
    arity = F.element_at(F.create_map(*[v for k, n in ARITY.items() for v in (F.lit(k), F.lit(n))]), F.col("structural_class"))

    def reach(seen, e):
        one = F.array_contains(seen, e["src"]) | F.array_contains(seen, e["dst"])
        return F.when(one, F.array_distinct(F.concat(seen, F.array(e["src"], e["dst"])))).otherwise(seen)

    # at most four members, so as many sweeps over the edges reach all of them
    grown = F.slice("members", 1, 1)
    for _ in range(max(ARITY.values())):
        grown = F.aggregate("edges", grown, reach)
    return plans.withColumns({
        "unused": F.array_except("planned", "actual"), "arity_ok": F.size(F.array_distinct("members")) == arity, "connected": F.size(F.array_except("members", grown)) == 0,
    }).withColumn("ok", (F.size("unused") == 0) & F.coalesce("arity_ok", F.lit(False)) & F.col("connected"))


def failing_members(df: DataFrame, group: str, item: str, judge: Callable[[Column], Column], verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((group, item) that fail, verdicts), by halving: a failing batch of a group is judged again by halves, down to single items.

    ``judge`` makes a boolean column, whether a batch fails, of a column of sorted item arrays (``F.udf`` for one in Python).  All batches of a level are
    rows of their own and are judged together, in separate tasks, so there are as many rounds as halvings.  verdicts: (key, fails) by the
    batch's content; batches that it knows are not judged again, nor are equal batches of several groups.  A batch that fails while both its halves pass
    gives no member.  Null items are left out, repeated ones count once.
    """
    digest = lambda items: F.unhex(F.sha2(F.array_join(items, x.NUL), 256))
    batches = df.where(F.col(item).isNotNull()).groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))
    batches = cut(batches.withColumn("key", digest("items")))
    # groups move by their batches' keys alone; items travel once a level, with each content
    groups, contents = batches.select("_group", "key"), batches.select("key", "items")
    known = None if verdicts is None else verdicts.select(F.unhex("key").alias("key"), "fails", F.lit(None).cast("int").alias("size"))
    most, failed = batches.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0], None
    while True:
        contents = contents.groupBy("key").agg(F.any_value("items").alias("items"))
        if known is None:
            judged = cut(contents.select("key", "items", judge(F.col("items")).alias("fails"), F.lit(True).alias("fresh")))
            known = judged.select("key", "fails", F.size("items").alias("size"))
        else:
            alike = known.where(F.coalesce(F.col("size") <= most, F.lit(True)))  # larger batches are none of this level's
            fresh = contents.join(alike, "key", "left_anti").select("key", "items", judge(F.col("items")).alias("fails"), F.lit(True).alias("fresh"))
            judged = cut(fresh.union(contents.join(alike.where("fails").select("key"), "key", "left_semi").select("key", "items", F.lit(True), F.lit(False))))
            known = known.union(judged.where("fresh").select("key", "fails", F.size("items")))
        most = (most + 1) // 2
        half = F.floor(F.size("items") / 2).cast("int")
        halves = F.array(F.slice("items", F.lit(1), half), F.slice("items", half + 1, F.size("items")))
        bad = judged.where("fails").select(
            "key", F.when(F.size("items") == 1, F.col("items")[0]).alias("one"), F.when(F.size("items") > 1, F.transform(halves, lambda h: F.struct(digest(h).alias("key"), h.alias("items")))).alias("halves")
        )
        moved = cut(groups.join(bad.select("key", "one", F.col("halves.key").alias("keys")), "key").select("_group", "one", "keys"))
        single = moved.where("keys is null").select(F.col("_group").alias(group), F.col("one").alias(item))
        failed = single if failed is None else failed.unionByName(single)
        groups = moved.select("_group", F.explode("keys").alias("key"))
        contents = bad.select(F.explode("halves").alias("h")).select("h.key", "h.items")
        if groups.isEmpty():
            return failed, known.select(F.lower(F.hex("key")).alias("key"), "fails")
