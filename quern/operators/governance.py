"""Access, compliance and metadata predicates; columns as in the governed document table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EngineConfig
from .lineage import cut, few, spread


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class ComplianceFilter:
    exclude_pii: bool = False
    gdpr_only: bool = False
    hipaa_only: bool = False
    exclude_financial: bool = False
    min_retention: int | None = None

    def predicate(self) -> Column:
        parts = []
        if self.exclude_pii:
            parts.append(~F.col("pii_present"))
        if self.gdpr_only:
            parts.append(F.col("gdpr_relevant"))
        if self.hipaa_only:
            parts.append(F.col("hipaa_relevant"))
        if self.exclude_financial:
            parts.append(~F.col("financial_data"))
        if self.min_retention is not None:  # a missing retention fails
            parts.append(F.coalesce(F.col("retention_days") >= self.min_retention, F.lit(False)))
        return _all(parts)


@dataclass(frozen=True)
class GovernanceFilter:
    departments: tuple[str, ...] = ()
    max_access: int | None = None
    languages: tuple[str, ...] = ()
    start: int | None = None
    end: int | None = None
    required_tags: tuple[str, ...] = ()
    any_tags: tuple[str, ...] = ()
    excluded_tags: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    compliance: ComplianceFilter = ComplianceFilter()

    def predicate(self) -> Column:
        tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        text = lambda *v: F.array(*map(F.lit, v))
        parts = [self.compliance.predicate()]
        for column, values in (("department", self.departments), ("language", self.languages), ("author", self.authors)):
            if values:  # a missing value fails
                parts.append(F.coalesce(F.col(column).isin(*values), F.lit(False)))
        if self.max_access is not None:
            parts.append(F.col("access_level") <= self.max_access)
        if self.start is not None:
            parts.append(F.col("timestamp") >= self.start)
        if self.end is not None:
            parts.append(F.col("timestamp") <= self.end)
        if self.required_tags:
            parts.append(F.size(F.array_except(text(*self.required_tags), tags)) == 0)
        if self.any_tags:
            parts.append(F.arrays_overlap(tags, text(*self.any_tags)))
        if self.excluded_tags:
            parts.append(~F.arrays_overlap(tags, text(*self.excluded_tags)))
        return _all(parts)


def can_access(pairs: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """``pairs`` (user_id, doc_id) with column allowed; unknown users and documents are not allowed.

    A user (user_id, departments, level, is_admin) reads levels up to their own, of
    their departments and of documents without one; administrators of all.  Keys of both
    joins are unique on one side, so the result has the rows of ``pairs``.
    """
    asked = pairs.join(docs.select("doc_id", "department", "access_level", F.lit(True).alias("known")), "doc_id", "left").join(users.select("user_id", "departments", "level", "is_admin"), "user_id", "left")
    own = F.col("is_admin") | F.col("department").isNull() | F.array_contains("departments", F.col("department"))
    return asked.select(*pairs.columns, F.coalesce(F.col("known") & (F.col("access_level") <= F.col("level")) & own, F.lit(False)).alias("allowed"))


def access_classes(docs: DataFrame, users: DataFrame) -> DataFrame:
    """(kind, id, class, other, allowed): what every user may read of all documents, without a row for every two of them.

    Users with equal departments, level and role are a class, documents with equal department and
    level another.  Rows of kind ``user`` and ``document`` name each one's class; rows of kind
    ``pair`` say of each two classes (class, other) what holds for all their members, asked of the
    member of smallest id.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    u = users.withColumn("class", F.concat_ws("|", F.coalesce(F.array_join("departments", ",", ""), F.lit("")), text("level"), text("is_admin")))
    d = docs.withColumn("class", F.concat_ws("|", text("department"), text("access_level")))
    one_u = u.groupBy("class").agg(F.min_by(F.struct("user_id", "departments", "level", "is_admin"), "user_id").alias("x")).select("class", "x.*")
    one_d = d.groupBy("class").agg(F.min_by(F.struct("doc_id", "department", "access_level"), "doc_id").alias("x")).select(F.col("class").alias("other"), "x.*")
    pairs = one_u.select("class", "user_id").crossJoin(one_d.select("other", "doc_id"))  # a row a class on both sides
    asked = can_access(pairs, one_d, one_u).select(F.lit("pair").alias("kind"), F.lit(None).cast("long").alias("id"), "class", "other", "allowed")
    member = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), "class", F.lit(None).cast("string").alias("other"), F.lit(None).cast("boolean").alias("allowed"))
    return member(u, "user", "user_id").unionByName(member(d, "document", "doc_id")).unionByName(asked)


def readable(docs: DataFrame, users: DataFrame, most: int = EngineConfig.broadcast_rows) -> DataFrame:
    """(user_id, doc_id): every user with every document they may read, by the rule of ``can_access``.

    The rule is asked once of each two classes (equal departments, level and role; equal department and
    level).  A document then stands once for each class of users that may read it and meets the members of
    that class, where it is read if users are at most ``most``.  Else every partition of the shuffle takes all
    users and a share of the documents, so one large class is spread over tasks.
    """
    whom, what = ["departments", "level", "is_admin"], ["department", "access_level"]
    same = lambda names: _all([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    u, d = users.select("user_id", *whom), spread(docs.select("doc_id", *what))
    own = F.col("is_admin") | F.col("department").isNull() | F.array_contains("departments", F.col("department"))
    classes = u.select(*whom).distinct().crossJoin(d.select(*what).distinct())  # a row a class on both sides
    classes = cut(classes.where((F.col("access_level") <= F.col("level")) & own).select(*(F.col(c).alias(f"_{c}") for c in whom + what)))
    reach = d.join(few(classes, classes.count(), most), same(what)).select("doc_id", *(f"_{c}" for c in whom))
    if users.count() <= most:
        members = u.groupBy(*whom).agg(F.collect_list("user_id").alias("_users"))  # at most that many in all
        return reach.join(F.broadcast(members), same(whom)).select(F.explode("_users").alias("user_id"), "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = reach.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    u = u.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return reach.join(u, same([*whom, "part"])).select("user_id", "doc_id")
