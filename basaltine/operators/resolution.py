"""Entity resolution: identities, pair decisions, ordered cluster assignment, merges.

Assignment depends on the order of arrival, so it is not a component labelling;
but only entities that share a strong key can influence each other.  Keys link
entities in stars, star components are dealt to tasks, and each component is
folded in order through indexes by key: no pairs are compared, however many
entities share a key.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gtin, normal_code, normal_text
from ..session import checkpointed

KINDS = ("gtin_exact", "maker_model_exact", "maker_mpn_exact", "source_sku_exact")
#: Names of clusters that the lists of a chunk have at most, about, and those of a task; bytes of lists in an Arrow batch.
CELL, TASK, BATCH = 1 << 22, 1 << 24, 4 << 20
#: Between the names of a part of a list; stands for more than one trade item number.
MARK, MANY = "\0", "many"


def identities(entities: DataFrame) -> DataFrame:
    """Comparable identity of each entity: entity_key, entity_type, domain, title, gtin, makers, model, mpn, sku, ord.

    Missing identity columns count as empty.
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in entities.columns else F.lit("")
    makers = F.array_distinct(F.filter(F.array(normal_text(has("brand")), normal_text(has("manufacturer"))), lambda m: m != ""))
    return entities.select(
        "entity_key", "entity_type", F.lower(F.trim(has("source_domain"))).alias("domain"), normal_text(has("title")).alias("title"), gtin(has("gtin")).alias("gtin"), makers.alias("makers"),
        normal_code(has("model")).alias("model"), normal_code(has("mpn")).alias("mpn"), normal_code(has("sku")).alias("sku"), F.col("ord") if "ord" in entities.columns else F.col("entity_key").alias("ord"))


def decision(a: str, b: str) -> Column:
    """Decision on a joined pair of identity structs: outcome, reason, supporting signals."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    same = lambda f: (x(f) != "") & (x(f) == y(f))
    maker = F.arrays_overlap(x("makers"), y("makers"))
    both = (x("gtin") != "") & (y("gtin") != "")
    local = (x("domain") != "") & (x("domain") == y("domain"))
    reason = (
        F.when(both, F.when(same("gtin"), "gtin_exact").otherwise("gtin_conflict")).when(maker & same("model"), "maker_model_exact").when(maker & same("mpn"), "maker_mpn_exact")
        .when(same("sku") & local, "source_sku_exact"))
    strong = reason.isNotNull()
    support = F.array_compact(F.array(
        F.when(~strong & same("sku"), "sku_cross_source_only"), F.when(same("title") & (~strong | reason.isin("maker_model_exact", "maker_mpn_exact")), "title_exact"), F.when(~strong & maker, "maker_overlap")))
    outcome = F.when(reason == "gtin_conflict", "conflict").when(strong, "match").otherwise("insufficient")
    return F.struct(outcome.alias("outcome"), F.coalesce(reason, F.when(F.size(support) > 0, "supporting_signals_only").otherwise("no_identity_match")).alias("reason"), support.alias("supporting"))


def strong_keys(ids: DataFrame) -> DataFrame:
    """(entity_key, kind, key) of each strong key."""
    of = lambda kind, parts, ok: F.when(ok, F.struct(F.lit(kind).alias("kind"), F.concat_ws("|", "entity_type", *parts).alias("key")))
    m = F.explode_outer(F.when(F.size("makers") > 0, F.col("makers")).otherwise(F.array(F.lit(""))))
    rows = ids.withColumn("maker", m)
    keys = F.array_compact(F.array(
        of("gtin_exact", ["gtin"], F.col("gtin") != ""), of("maker_model_exact", ["maker", "model"], (F.col("maker") != "") & (F.col("model") != "")),
        of("maker_mpn_exact", ["maker", "mpn"], (F.col("maker") != "") & (F.col("mpn") != "")), of("source_sku_exact", ["domain", "sku"], (F.col("domain") != "") & (F.col("sku") != ""))))
    return rows.select("entity_key", F.explode(keys).alias("k")).select("entity_key", "k.kind", "k.key").distinct()


def star_components(keys: DataFrame) -> DataFrame:
    """(entity_key, component): the least entity that each one reaches over shared keys.

    Labels travel over keys and back, and jump to their own label, until nothing changes.
    """
    labels = checkpointed(keys.groupBy("entity_key").agg(F.min("entity_key").alias("component")))
    while True:
        by_key = keys.join(labels, "entity_key").groupBy("kind", "key").agg(F.min("component").alias("low"))
        lower = keys.join(by_key, ["kind", "key"]).groupBy("entity_key").agg(F.min("low").alias("low"))
        jump = labels.select(F.col("entity_key").alias("low"), F.col("component").alias("jumped"))
        fresh = labels.join(lower, "entity_key").join(jump, "low", "left").select("entity_key", F.least("component", "low", "jumped").alias("component"), F.col("component").alias("old"))
        fresh = checkpointed(fresh)
        labels = fresh.select("entity_key", "component")
        if fresh.where("component <> old").isEmpty():
            return labels


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cluster and decision of each entity; rows come component by component, in order of arrival.

    A decision asks whether a key leads to no open cluster, to one or to several,
    and whether it leads to one of another trade item number.  So clusters are
    indexed by key and number, and two of them are looked at for each.  An entity
    without a number meets all clusters of its keys, and they only become more:
    two for each key are kept for it.
    """
    component = None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("component", "numbered", "entity_key", "gtin", "keys"))
        for part, numbered, key, own, keys in zip(*columns):
            if part != component:
                component, place = part, -1
                every: dict[str, dict] = {}  # key: cluster: place of the first member
                bare: dict[str, dict] = {}  # key: number: cluster: place of the first member that a number holder is matched with
                number: dict[str, str] = {}
                met: dict[str, set] = {}  # cluster: its keys in bare
            place += 1
            found: dict[str, tuple] = {}
            clash = False
            for k in keys:
                if own:
                    slots = bare.get(k, {})
                    ways = [islice(slots.get(n, {}).items(), 2) for n in ("", own)]
                    clash = clash or len(slots) > ("" in slots) + (own in slots)
                else:
                    ways = [every.get(k, {}).items()]
                for cluster, first in chain(*ways):
                    found[cluster] = min(found.get(cluster, (first, 9)), (first, int(k[0])))
            if len(found) == 1:
                cluster, (_, kind) = next(iter(found.items()))
                verdict, reason = "linked", KINDS[kind]
            elif found:
                cluster, verdict, reason = key, "deferred_ambiguous", "ambiguous_multiple_clusters"
            elif clash:
                cluster, verdict, reason = key, "created_separate", "target_cluster_identity_conflict"
            else:
                cluster, verdict, reason = key, "new_cluster", "no_strong_match"
            old = number.get(cluster, "")
            if own and old != own:
                fresh = number[cluster] = MANY if old else own
                for k in met.get(cluster, ()):
                    slots = bare[k]
                    slots.setdefault(fresh, {})[cluster] = slots[old].pop(cluster)
                    if not slots[old]:
                        del slots[old]
            for k in keys:
                slots = every.setdefault(k, {})
                if len(slots) < 2:
                    slots.setdefault(cluster, place)
                # A pair that has two trade item numbers is decided by them alone.
                if numbered and (not own or k[0] == "0"):
                    bare.setdefault(k, {}).setdefault(number.get(cluster, ""), {}).setdefault(cluster, place)
                    met.setdefault(cluster, set()).add(k)
            out.append((place, cluster, verdict, reason, len(found) > 1 or clash))
        if out:
            given = [batch.column(c) for c in ("component", "entity_key", "entity_type", "gtin", "keys")]
            made = [pa.array(values, kind) for values, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(given + made, names=["component", "entity_key", "entity_type", "gtin", "keys", "place", "cluster_key", "decision", "reason", "listed"])


def _list(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    """Names of the clusters that each listed entity met at one key; rows come chunk by chunk, entities and what clusters gain at the key in order of arrival."""
    names = ["component", "place", "entity_key", "cluster_key", "decision", "reason", "candidates", "conflicts"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    chunk, rows, held = None, [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("k", "chunk", "step", "place", "cluster_key", "number", "since", "many", "component", "gtin", "entity_key", "decision", "reason"))
        for k, part, step, place, cluster, number, since, many, component, own, key, verdict, reason in zip(*columns):
            if (k, part) != chunk:
                chunk, every, bare, numbers = (k, part), [], [], {}
            if step:
                if step & 1:
                    insort(every, cluster)
                if step & 2:
                    insort(bare, cluster)
                    if number is not None:
                        numbers[cluster] = number, since, many
                continue
            clash = {c for c, (n, t, m) in numbers.items() if (t < place and n != own) or (m is not None and m < place)} if own else ()
            open_ = () if verdict != "deferred_ambiguous" else every if not own else [c for c in bare if c not in clash] if clash else bare
            lists = [mark.join(x) if x else None for x in (open_, sorted(clash))]
            rows.append((component, place, key, cluster, verdict, reason, *lists))
            held += sum(len(x) for x in lists if x)
            if held > BATCH or len(rows) >= 10_000:
                yield made(rows)
                rows, held = [], 0
    if rows:
        yield made(rows)


def _listed(placed: DataFrame) -> DataFrame:
    """Rows of entities that met several clusters or conflicts, with their names.

    What a cluster gains at a key and who asks there meet in chunks of a key;
    each chunk has all gains and a share of those who ask, so that no task
    writes all lists of a key.  Lists of entities of one key are done then; parts
    of others are put together.
    """
    columns = ["entity_key", "cluster_key", "decision", "reason"]
    by_cluster = placed.where("gtin <> ''").groupBy("cluster_key", "gtin").agg(F.min("place").alias("at")).groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("at", "gtin"))).alias("g"))
    numbers = by_cluster.select("cluster_key", F.get("g", F.lit(0))["gtin"].alias("number"), F.get("g", F.lit(0))["at"].alias("since"), F.get("g", F.lit(1))["at"].alias("many"))
    steps = placed.select("component", "place", "gtin", "listed", *columns, F.size("keys").alias("parts"), F.explode("keys").alias("k"))
    asked = steps.where("listed")
    gains = steps.groupBy("k", "cluster_key").agg(F.min("place").alias("first"), F.min(F.when((F.col("gtin") == "") | F.col("k").startswith("0"), F.col("place"))).alias("bare"))
    sizes = gains.groupBy("k").agg(F.count("*").alias("n")).join(asked.groupBy("k").agg(F.count("*").alias("w"), F.count_if(F.col("parts") > 1).alias("shared")), "k")
    sizes = checkpointed(sizes.withColumn("chunks", F.ceil(F.col("n") * F.col("w") / CELL)))
    total, shared = (x or 0 for x in sizes.agg(F.sum(F.col("n") * (F.col("w") - F.col("shared")) + F.col("chunks") * F.col("n")), F.sum(F.col("n") * F.col("shared") + F.col("chunks") * F.col("n"))).first())
    tasks = lambda names, each: min(int(names // each) + 1, 20_000)
    at = lambda c, step: F.struct(F.col(c).alias("place"), F.lit(step).alias("step"))
    moments = F.when(F.col("first") == F.col("bare"), F.array(at("first", 3))).when(F.col("bare").isNull(), F.array(at("first", 1))).otherwise(F.array(at("first", 1), at("bare", 2)))
    gains = gains.join(sizes.select("k", "chunks"), "k").join(numbers, "cluster_key", "left").withColumn("at", F.explode(moments)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    gains = checkpointed(gains.select("k", "chunk", "at.step", "at.place", "cluster_key", "number", "since", "many"))
    asked = asked.join(sizes.select("k", "chunks"), "k").withColumns({"chunk": F.pmod("place", "chunks"), "step": F.lit(0)}).drop("chunks", "listed")
    shape = "component string, place long, entity_key string, cluster_key string, decision string, reason string, candidates string, conflicts string"

    def lists(rows: DataFrame, names: int, mark: str) -> DataFrame:
        both = rows.drop("parts").unionByName(gains, allowMissingColumns=True)
        return both.repartition(tasks(names, TASK), "k", "chunk").sortWithinPartitions("k", "chunk", "place", "step").mapInArrow(lambda batches: _list(batches, mark), shape)

    alone = lists(asked.where("parts = 1"), total, ",").select(*columns, *[F.coalesce(c, F.lit("")).alias(c) for c in ("candidates", "conflicts")])
    together = lambda c: F.array_join(F.sort_array(F.array_distinct(F.split(F.concat_ws(MARK, F.collect_list(c)), MARK))), ",").alias(c)
    parts = lists(asked.where("parts > 1"), shared, MARK).repartition(tasks(shared, CELL), "component", "place")
    return alone.unionByName(parts.groupBy("component", "place").agg(*[F.first(c).alias(c) for c in columns], together("candidates"), together("conflicts")).drop("component", "place"))


def assign_clusters(entities: DataFrame) -> DataFrame:
    """Cluster of each entity and the decision that put it there.

    The decisions of a component are made in order, in time and memory that grow
    with its entities; the names of the clusters that an entity met are listed
    apart, in many tasks.  The lists have as many names as there are pairs of an
    ambiguous entity and an earlier cluster of its keys.
    """
    ids = checkpointed(identities(entities).drop("title"))
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    lists = strong_keys(ids).groupBy("entity_key").agg(F.sort_array(F.collect_list(F.concat_ws("|", kind.cast("string"), "key"))).alias("keys"))
    keyed = checkpointed(ids.select("entity_key", "entity_type", "ord", "gtin").join(lists, "entity_key", "left"))
    # One entity stands for all that have the same keys.
    sets = checkpointed(keyed.where("keys IS NOT NULL").groupBy("keys").agg(F.min("entity_key").alias("entity_key"), F.max(F.col("gtin") != "").alias("numbered")))
    parts = sets.join(star_components(sets.select("entity_key", F.lit("").alias("kind"), F.explode("keys").alias("key"))), "entity_key").drop("entity_key")
    parts = parts.drop("numbered").join(parts.groupBy("component").agg(F.max("numbered").alias("numbered")), "component")
    ordered = keyed.where("keys IS NOT NULL").join(parts, "keys").repartition("component").sortWithinPartitions("component", "ord", "entity_key", "gtin")
    placed = checkpointed(ordered.select("component", "numbered", "entity_key", "entity_type", "gtin", "keys").mapInArrow(
        _fold, "component string, entity_key string, entity_type string, gtin string, keys array<string>, place long, cluster_key string, decision string, reason string, listed boolean"))
    lone = keyed.where("keys IS NULL").select("entity_key", F.col("entity_key").alias("cluster_key"), F.lit("new_cluster").alias("decision"), F.lit("no_strong_match").alias("reason"))
    # The first entity of each type had nothing to be compared with.
    firsts = ids.groupBy("entity_type").agg(F.min_by("entity_key", F.struct("ord", "entity_key")).alias("entity_key")).select("entity_key", F.lit(True).alias("is_first"))
    plain = placed.where("NOT listed").select(lone.columns).unionByName(lone).join(firsts, "entity_key", "left")
    plain = plain.withColumn("reason", F.when(F.col("is_first") & (F.col("decision") == "new_cluster"), "no_candidates").otherwise(F.col("reason"))).drop("is_first")
    plain = plain.withColumns({"candidates": F.lit(""), "conflicts": F.lit("")})
    return plain if placed.where("listed").isEmpty() else plain.unionByName(_listed(placed))


def compared_entities(ids: DataFrame) -> DataFrame:
    """How many earlier entities of its type each one was held against."""
    before = Window.partitionBy("entity_type").orderBy("ord", "entity_key").rowsBetween(Window.unboundedPreceding, -1)
    return ids.select("entity_key", F.count("*").over(before).alias("compared"))


def cluster_summary(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Members and distinct sources of each cluster."""
    rows = members.join(entities.select("entity_key", "source_domain"), "entity_key", "left")
    return rows.groupBy("cluster_key").agg(F.count("*").alias("members"), F.countDistinct("source_domain").alias("sources"))


def review_queue(assigned: DataFrame, kind: str = "all") -> DataFrame:
    """Decisions that a person should look at: ambiguous ones, conflicts, or both."""
    wanted = {"ambiguous": ["deferred_ambiguous"], "conflict": ["created_separate"], "all": ["deferred_ambiguous", "created_separate"]}
    if kind not in wanted:
        raise ValueError(f"kind must be one of {sorted(wanted)}")
    return assigned.where(F.col("decision").isin(wanted[kind]))


def merge_verdict(clusters: DataFrame, members: DataFrame, ids: DataFrame, source: str, target: str) -> tuple[str, str]:
    """Whether two clusters may be merged by request, and why: decision and reason.

    Conflicts and matches are looked for through shared keys and counts of
    trade item numbers, not through pairs.
    """
    if source == target:
        return "rejected", "same_cluster"
    rows = {r.cluster_key: r for r in clusters.where(F.col("cluster_key").isin(source, target)).select("cluster_key", "entity_type", "merged_into_cluster_key").collect()}
    if len(rows) < 2:
        return "rejected", "cluster_not_found"
    for key, name in ((source, "source"), (target, "target")):
        if rows[key].merged_into_cluster_key:
            return "rejected", f"{name}_cluster_already_merged"
    if rows[source].entity_type != rows[target].entity_type:
        return "rejected", "entity_type_mismatch"
    both = ids.join(members.where(F.col("cluster_key").isin(source, target)).select("entity_key", "cluster_key"), "entity_key")
    numbers = both.where("gtin <> ''").groupBy("cluster_key").agg(F.min("gtin").alias("lo"), F.max("gtin").alias("hi")).collect()
    if len(numbers) == 2 and len({n for r in numbers for n in (r.lo, r.hi)}) > 1:
        return "rejected", "identity_conflict"
    keyed = strong_keys(both).join(both.select("entity_key", "cluster_key", (F.col("gtin") != "").alias("numbered")), "entity_key")
    sides = keyed.groupBy("kind", "key").agg(F.countDistinct("cluster_key").alias("clusters"))
    if sides.where("clusters = 2").isEmpty():
        return "rejected", "no_strong_identity_match"
    return "merged", "explicit_strong_identity_match"


def target_gate(rows: DataFrame, title: Column, required: list[str], anchors: list[str]) -> DataFrame:
    """Whether each item is the product looked for: confirmed, uncertain, rejected or not evaluated."""
    split = lambda words: sorted({t for w in words for t in "".join(c if c.isalnum() else " " for c in w.casefold()).split()})
    need, fixed = split(required), split(anchors)
    if not need or not fixed:
        return rows.withColumns({"target_status": F.lit("not_evaluated"), "target_reason": F.lit("")})
    have = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    missing = lambda words: F.size(F.array_except(F.array(*[F.lit(w) for w in words]), have))
    model = F.exists(have, lambda t: t.rlike(r"\p{Nd}")) & F.lit(any(any(c.isdigit() for c in t) for t in fixed))
    status = F.when(missing(need) == 0, "confirmed").when(missing(fixed) == 0, "uncertain").otherwise("rejected")
    reason = F.when(missing(need) == 0, "target_identity_confirmed").when(missing(fixed) == 0, "target_identity_incomplete").when(model, "target_model_conflict").otherwise("target_model_missing")
    return rows.withColumns({"target_status": status, "target_reason": reason})
