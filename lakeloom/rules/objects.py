"""Lifecycle, replication, locks and notification of object versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.rules.conditions import key_glob

# ---------------------------------------------------------------- filters


def tags(text: Column) -> Column:
    """`k=v&k2=v2`, URL-decoded; empty keys are skipped and the last of equal keys wins."""
    pairs = F.transform(F.split(F.coalesce(text, F.lit("")), "&"), lambda p: F.struct(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.coalesce(p["k"] != "", F.lit(False)) & ~F.coalesce(later(p, i), F.lit(False))))


def tag_filter(have: Column, wanted: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.element_at(have, F.lit(k)) == v, F.lit(False)) for k, v in wanted.items()], F.lit(True))


def size_filter(size: Column, more_than: int | None = None, less_than: int | None = None) -> Column:
    """Both bounds are strict; negative sizes count as 0."""
    s = F.greatest(size, F.lit(0))
    return (F.lit(True) if more_than is None else s > more_than) & (F.lit(True) if less_than is None else s < less_than)


def rule_filter(key: Column, size: Column, have: Column, r: dict) -> Column:
    return key.startswith(r.get("prefix", "")) & tag_filter(have, r.get("tags", {})) & size_filter(size, r.get("more_than"), r.get("less_than"))


# ---------------------------------------------------------------- locks and lifecycle


def locked(meta: Column, now: Column, delete_marker: Column, default_days: Column | None = None, created: Column | None = None) -> Column:
    """Legal hold, or retention until a later time (unreadable: locked), or the bucket's default; markers are never locked."""
    hold = F.coalesce(F.upper(F.element_at(meta, "legal-hold")) == "ON", F.lit(False))
    mode, until = F.element_at(meta, "mode"), F.element_at(meta, "retain-until")
    own = mode.isNotNull() & F.coalesce(F.try_to_timestamp(until) > now, F.lit(True))
    default = F.lit(False) if default_days is None else F.coalesce(mode.isNull() & (created + F.make_interval(days=default_days) > now), F.lit(False))
    return ~delete_marker & (hold | own | default)


def guarded(action: Column, replication: Column, is_locked: Column, version: Column) -> Column:
    """What is left of a lifecycle action: pending replication stops all, a lock stops deletes, a missing version id too."""
    deletes = action.startswith("Delete")
    return F.when(F.coalesce(replication.isin("PENDING", "FAILED"), F.lit(False)) | (deletes & (is_locked | version.isNull())), "None").otherwise(action)


def check_transition(t: dict) -> str | None:
    """What is wrong with a transition, or None: exactly one of days and date, days from 0, dates at midnight."""
    if ("days" in t) == ("date" in t):
        return "exactly one of days and date"
    if "days" in t and t["days"] < 0:
        return "negative days"
    if "date" in t and (t["date"].hour, t["date"].minute, t["date"].second) != (0, 0, 0):
        return "date is not midnight"
    return None


def expire_noncurrent(versions: DataFrame, key: str, order: list[Column], keep: int, old_enough: Column, can_delete: Column) -> DataFrame:
    """Noncurrent versions from the newest: one goes if it is old enough, can be deleted, and `keep` newer ones were spared.

    Every version that stays counts as spared, be it young, blocked or within `keep`. So none goes before `keep` are
    spared, which are the first `keep`, and from there on that bound is met: a row number says the same as the count.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return versions.withColumn("action", F.when(old_enough & (rank > keep) & can_delete, "DeleteVersion").otherwise("None"))


def stop_after(versions: DataFrame, key: str, order: list[Column], stops: Column) -> DataFrame:
    """Versions behind one that ends the evaluation of its object are not evaluated."""
    before = F.max(stops.cast("int")).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return versions.withColumn("evaluated", F.coalesce(before, F.lit(0)) == 0)


# ---------------------------------------------------------------- replication


def replication_target(key: Column, have: Column, rules: list[dict]) -> Column:
    """Per destination the rule of highest priority (of equal ones the first listed); of destinations the one listed first."""
    def entry(i: int, r: dict) -> Column:
        ok = F.lit(bool(r.get("enabled", True))) & key.startswith(r.get("prefix", "")) & tag_filter(have, r.get("tags", {}))
        return F.when(ok, F.struct(F.lit(-r["priority"]).alias("p"), F.lit(i).alias("i"), F.lit(r["id"]).alias("id"), F.lit(r["to"]).alias("to")))

    dests = list(dict.fromkeys(r["to"] for r in rules))
    best = [F.array_min(F.array(*[entry(i, r) for i, r in enumerate(rules) if r["to"] == t])) for t in dests]
    return F.coalesce(*[b["id"] for b in best])


def role_target(key: Column, rules: list[dict]) -> Column:
    """With a role the highest priority decides, of equal ones the first."""
    return F.array_min(F.array(*[F.when(key.startswith(r.get("prefix", "")), F.struct(F.lit(-r["priority"]).alias("p"), F.lit(i).alias("i"), F.lit(r["id"]).alias("id"))) for i, r in enumerate(rules)]))["id"]


def replicate_delete(delete_marker: Column, version: Column, marker_enabled: bool, delete_enabled: bool) -> Column:
    """What a delete does at the target: a version purge, a marker, or nothing."""
    return F.when(version.isNotNull() & ~delete_marker, F.lit("PurgeVersion") if delete_enabled else F.lit("None")).when(delete_marker, F.lit("Marker") if marker_enabled else F.lit("None")).otherwise("None")


def active_prefix(prefix: Column, rule_prefix: str, recursive: bool) -> Column:
    """Whether a rule could hold below a prefix."""
    down = F.lit(rule_prefix).startswith(prefix) if recursive else F.lit(False)
    return prefix.startswith(rule_prefix) | down


# ---------------------------------------------------------------- notification

#: Single event names in the order of their bits, the first is bit 0. Fixed values.
EVENT_BITS = [
    "s3:ObjectAccessed:Get", "s3:ObjectAccessed:GetRetention", "s3:ObjectAccessed:GetLegalHold", "s3:ObjectAccessed:Head", "s3:ObjectAccessed:Attributes",
    "s3:ObjectCreated:CompleteMultipartUpload", "s3:ObjectCreated:Copy", "s3:ObjectCreated:Post", "s3:ObjectCreated:Put", "s3:ObjectCreated:PutRetention", "s3:ObjectCreated:PutLegalHold",
    "s3:ObjectTagging:Put", "s3:ObjectTagging:Delete",
    "s3:ObjectRemoved:Delete", "s3:ObjectRemoved:DeleteMarkerCreated", "s3:ObjectRemoved:DeleteAllVersions", "s3:ObjectRemoved:NoOP",
    "s3:BucketCreated:*", "s3:BucketRemoved:*",
    "s3:Replication:OperationFailedReplication", "s3:Replication:OperationCompletedReplication", "s3:Replication:OperationMissedThreshold", "s3:Replication:OperationReplicatedAfterThreshold", "s3:Replication:OperationNotTracked",
    "s3:ObjectRestore:Post", "s3:ObjectRestore:Completed", "s3:ObjectTransition:Failed", "s3:ObjectTransition:Complete",
    "s3:Scanner:ManyVersions", "s3:Scanner:LargeVersions", "s3:Scanner:BigPrefix", "s3:LifecycleDelMarkerExpiration:Delete",
    "s3:ObjectAcl:Put", "s3:LifecycleExpiration:Delete", "s3:LifecycleExpiration:DeleteMarkerCreated", "s3:LifecycleTransition", "s3:IntelligentTiering",
]
#: Names that stand for others: all single names of their kind but those that are only asked for by name. Fixed values.
EVENTS = {
    "s3:ObjectAccessed:*": ["s3:ObjectAccessed:Get", "s3:ObjectAccessed:Head", "s3:ObjectAccessed:GetRetention", "s3:ObjectAccessed:GetLegalHold", "s3:ObjectAccessed:Attributes"],
    "s3:ObjectCreated:*": ["s3:ObjectCreated:CompleteMultipartUpload", "s3:ObjectCreated:Copy", "s3:ObjectCreated:Post", "s3:ObjectCreated:Put"],
    "s3:ObjectTagging:*": ["s3:ObjectTagging:Put", "s3:ObjectTagging:Delete"],
    "s3:ObjectRemoved:*": ["s3:ObjectRemoved:Delete", "s3:ObjectRemoved:DeleteMarkerCreated", "s3:ObjectRemoved:NoOP"],
    "s3:Replication:*": ["s3:Replication:OperationFailedReplication", "s3:Replication:OperationCompletedReplication", "s3:Replication:OperationNotTracked", "s3:Replication:OperationMissedThreshold", "s3:Replication:OperationReplicatedAfterThreshold"],
    "s3:ObjectRestore:*": ["s3:ObjectRestore:Post", "s3:ObjectRestore:Completed"],
    "s3:LifecycleExpiration:*": ["s3:LifecycleExpiration:Delete", "s3:LifecycleExpiration:DeleteMarkerCreated"],
    "s3:ObjectTransition:*": ["s3:ObjectTransition:Failed", "s3:ObjectTransition:Complete", "s3:LifecycleTransition"],
    "s3:Scanner:*": ["s3:Scanner:ManyVersions", "s3:Scanner:LargeVersions", "s3:Scanner:BigPrefix"],
    "s3:ObjectCreated:PutTagging": ["s3:ObjectTagging:Put"],
    "s3:ObjectCreated:DeleteTagging": ["s3:ObjectTagging:Delete"],
}


def expand(names: list[str]) -> list[str]:
    return [e for n in names for e in EVENTS.get(n, [n])]


def event_bit(name: Column) -> Column:
    """The bit of a single event name, or null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for k, e in enumerate(EVENT_BITS) for x in (e, 1 << k)]).cast("map<string,bigint>"), name)


def event_mask(names: list[str]) -> int:
    """The bits of the names together, each for itself or for those it stands for. Raises ValueError for unknown names."""
    return sum(1 << k for k in {EVENT_BITS.index(e) for e in expand(names)})


def route(events: DataFrame, event: str, key: str, subscriptions: list[dict]) -> DataFrame:
    """One row for each event and distinct target among the subscriptions that hold; works on streams too."""
    ok = [F.when(F.col(event).isin(*expand(s["events"])) & key_glob(F.col(key), s["pattern"]), F.lit(s["target"])) for s in subscriptions]
    return events.withColumn("target", F.explode(F.array_distinct(F.filter(F.array(*ok), lambda t: t.isNotNull()))))


def event_record(bucket: Column, key: Column, name: Column, at: Column, size: Column, user: Column) -> Column:
    """The nested record of a notification, as JSON."""
    return F.to_json(F.struct(name.alias("eventName"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.struct(user.alias("principalId")).alias("userIdentity"), F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key"), size.alias("size")).alias("object")).alias("s3")))
