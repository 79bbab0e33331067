"""Snapshots, deltas, retention and lifecycle folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.store import staged


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, hash): added, deleted or modified."""
    both = before.select("path", F.col("hash").alias("_old")).join(after.select("path", F.col("hash").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def merged(base: DataFrame, fresh: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A snapshot with a delta: fresh rows replace those of their key, deleted keys go."""
    kept = base.join(fresh.select(key).distinct(), key, "left_anti").join(deleted.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh)


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes (column node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids, edges.source_id == ids.node, "left_semi").join(ids, edges.target_id == ids.node, "left_semi")


def precedence(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The row of each key that comes first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def retained(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first `most` rows: a top-k, combined before it is merged."""
    return rows.orderBy(*order).limit(most)


def hotset(events: DataFrame, key: str) -> DataFrame:
    """Upserts folded to a row a key: first and last seen, accesses, whether ever pinned."""
    return events.groupBy(key).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").cast("long").alias("accesses"), F.max(F.col("event_type") == "purchase").alias("pinned"))


#: What an event does to an anchor.
ACTIONS = {"signup": "create", "view": "observe", "click": "useful", "error": "ignored", "purchase": "promote"}


def fold_anchor(state: dict, action: str) -> dict:
    """One step of an anchor's life. Two ignored injections without a useful one make it dormant; a useful one revives."""
    out = dict(state)
    if action in ("create", "promote"):
        out["state"] = "active"
        out["pinned"] = out["pinned"] or action == "promote"
    elif action == "useful":
        out |= {"useful": out["useful"] + 1, "ignored": 0, "state": "active" if out["state"] == "dormant" else out["state"]}
    elif action == "ignored":
        out["ignored"] += 1
        if out["ignored"] >= 2 and out["useful"] == 0:
            out["state"] = "dormant"
    out["seen"] += 1
    return out


NEW_ANCHOR = {"state": "active", "pinned": False, "useful": 0, "ignored": 0, "seen": 0}


def anchor_lifecycle(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The state of each anchor after its events in order (ts, event_id), as fold_anchor has it. Before the first useful
    event nothing resets the ignored ones, and after it none makes dormant, so a few grouped aggregates (combined before
    the shuffle) tell the state: no task holds the events of a key."""
    kinds = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ACTIONS.items()], F.lit("observe"))
    at = F.struct(F.col("ts").isNull().alias("none"), "ts", "event_id")
    rows = events.select(F.col(key).cast("long").alias(key), kinds.alias("_action"), at.alias("_at"))
    is_a = lambda *names: F.col("_action").isin(*names)
    each = rows.groupBy(key).agg(
        F.count("*").alias("seen"), F.count_if(is_a("useful")).alias("useful"), F.count_if(is_a("ignored")).alias("_all"), F.max(is_a("promote")).alias("pinned"),
        F.max(F.when(is_a("useful"), F.col("_at"))).alias("_useful"), F.max(F.when(is_a("ignored"), F.col("_at"))).alias("_ignored"), F.max(F.when(is_a("create", "promote"), F.col("_at"))).alias("_active"))
    last = each.where("useful > 0").select(F.col(key).alias("_key"), "_useful")
    later = rows.where(is_a("ignored")).join(last, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("_at") > F.col("_useful")).groupBy("_key").agg(F.count("*").alias("_later"))
    dormant = (F.col("useful") == 0) & (F.col("_all") >= 2) & (F.col("_active").isNull() | (F.col("_ignored") > F.col("_active")))
    ignored = F.when(F.col("useful") == 0, F.col("_all")).otherwise(F.coalesce("_later", F.lit(0)))
    return each.join(later, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, F.when(dormant, "dormant").otherwise("active").alias("state"), "pinned", "useful", ignored.alias("ignored"), "seen")


def anchor_rank(anchors: DataFrame, score, last_seen) -> DataFrame:
    """Adds `rank_score`: 1000 active, 100 dormant, 10 archived, else -1000; 500 pinned; score; 10 a useful, -5 an
    ignored; last_seen / 1000."""
    base = F.when(F.col("state") == "active", 1000).when(F.col("state") == "dormant", 100).when(F.col("state") == "archived", 10).otherwise(-1000)
    return anchors.withColumn("rank_score", base + F.when(F.col("pinned"), 500).otherwise(0) + score + 10 * F.col("useful") - 5 * F.col("ignored") + last_seen / 1000)


#: What a state and what is known of an anchor add to its rank.
STATE_WEIGHTS, PINNED_WEIGHT, USEFUL_WEIGHT, IGNORED_WEIGHT = {"active": 1000, "dormant": 100, "archived": 10}, 500, 10, 5


@dataclass(frozen=True)
class Budgets:
    """The most anchors of a path, active ones of a path and in all, pinned ones, and ones that are not active."""

    per_path: int = 12
    active_per_path: int = 4
    active: int = 64
    pinned: int = 16
    cold: int = 200


def aged(anchors: DataFrame, last, now, dormant_after: int, archive_after: int, retire_ignored: int) -> DataFrame:
    """Anchors in one of five states by what was known of them: `tombstoned` (column forgotten) and `retired` (ignored at least
    retire_ignored times in a row without being useful since) are for good; the others are dormant or archived when they have
    not been seen (last) for so long (now); pinned ones do not age."""
    unseen = now - last
    state = (
        F.when(F.col("forgotten"), "tombstoned").when(~F.col("pinned") & (F.col("ignored") >= retire_ignored), "retired").when(~F.col("pinned") & (unseen > archive_after), "archived")
        .when(~F.col("pinned") & (unseen > dormant_after) & (F.col("state") == "active"), "dormant").otherwise(F.col("state")))
    return anchors.withColumn("state", state)


def capped_anchors(anchors: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """Anchors (id, path, state, pinned, rank_score) within budgets: those of a path beyond its most go, active ones beyond
    theirs become dormant, pinned ones beyond theirs are unpinned, and of the rest that is not active and not pinned what
    is beyond goes. Tombstoned ones go first. Order: rank_score, path, id.

    Each limit depends on those before, but only by counts of what came earlier in one order, so each is a rank: within a
    path by a window, over all by a top-k, which is combined before it is merged. No task holds all anchors."""
    order = [F.desc("rank_score"), "path", "id"]
    rank = lambda rows, name, *by: rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    best = lambda rows, most, flag: rows.orderBy(*order).limit(most).select("id", F.lit(True).alias(flag))
    kept = staged(rank(anchors.where("state <> 'tombstoned'"), "_n", "path").where(F.col("_n") <= budgets.per_path).drop("_n"))
    able = rank(kept.where("state = 'active'"), "_n", "path").where(F.col("_n") <= budgets.active_per_path)
    pins = kept.where("pinned")
    kept = kept.join(best(able, budgets.active, "_active"), "id", "left").join(best(pins, budgets.pinned, "_pinned"), "id", "left")
    state = F.when((F.col("state") == "active") & F.col("_active").isNull(), "dormant").otherwise(F.col("state"))
    kept = staged(kept.withColumns({"state": state, "pinned": F.col("_pinned").isNotNull()}).drop("_active", "_pinned"))
    cold = kept.where("state <> 'active'")
    stays = kept.join(best(cold, budgets.cold, "_cold"), "id", "left").where("state = 'active' or pinned or _cold")
    return stays.drop("_cold")


def cap_warnings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(warning, n) of what the budgets did: anchors dropped, made dormant, unpinned; none, no row."""
    both = before.where("state <> 'tombstoned'").select("id", F.col("state").alias("_state"), F.col("pinned").alias("_pinned")).join(after.select("id", "state", "pinned"), "id", "left")
    tests = {"dropped": F.col("state").isNull(), "made_dormant": (F.col("_state") == "active") & (F.col("state") == "dormant"), "unpinned": F.col("_pinned") & ~F.coalesce("pinned", F.lit(True))}
    each = both.select(F.explode(F.array_compact(F.array(*[F.when(holds, name) for name, holds in tests.items()]))).alias("warning"))
    return each.groupBy("warning").agg(F.count("*").alias("n"))
