"""Versions, advisory ranges and vulnerability scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.color import let

_VERSION = r"^\s*[vV=^~<>]*\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-.]?((?:[A-Za-z][0-9A-Za-z-]*|[0-9]+[A-Za-z-][0-9A-Za-z-]*|(?<=-)[0-9]+)(?:\.[0-9A-Za-z-]+)*))?"


def parse_version(version: Column) -> Column:
    """struct(major, minor, patch, pre), comparable as it is; null if it begins with no number.

    A release sorts after all its pre-releases: a missing ``pre`` is ``~``, above any ASCII letter.
    """
    part = lambda i: F.coalesce(F.regexp_extract(version, _VERSION, i).try_cast("long"), F.lit(0).cast("long"))
    pre = F.regexp_extract(version, _VERSION, 4)
    parsed = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.when(pre == "", "~").otherwise(pre).alias("pre"))
    return F.when(version.rlike(r"^\s*[vV=^~<>]*\s*\d"), parsed)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is no version."""
    order = lambda p: F.when(p["x"].isNull() | p["y"].isNull(), F.lit(None)).when(p["x"] < p["y"], -1).when(p["x"] == p["y"], 0).otherwise(1).cast("int")
    return let(F.struct(parse_version(a).alias("x"), parse_version(b).alias("y")), order)


def minimum_satisfying(range_: Column) -> Column:
    """The lowest version that a range like ^1.2 or >=1.2 <2 allows; null for * and the like."""
    number = F.regexp_extract(range_, r"(\d+(?:\.\d+){0,2}(?:-[0-9A-Za-z.-]+)?)", 1)
    dots = F.length(number) - F.length(F.replace(F.regexp_replace(number, "-.*$", ""), F.lit("."), F.lit(""))) - F.coalesce(F.length(F.regexp_extract(number, "(-.*)$", 1)), F.lit(0))
    return F.when(number == "", F.lit(None)).when(dots == 0, F.concat(number, F.lit(".0.0"))).when(dots == 1, F.concat(number, F.lit(".0"))).otherwise(number)


def affected_by(version: Column, events: Column) -> Column:
    """Is a version inside an advisory range: events (introduced, fixed, last_affected) in version order, the last one at or below it decides."""
    point = lambda text, kind: F.struct(parse_version(text).alias("at"), F.lit(kind).alias("kind"))
    points = F.flatten(
        F.transform(
            events,
            lambda e: F.filter(
                F.array(point(F.when(e["introduced"] == "0", F.lit("0.0.0-0")).otherwise(e["introduced"]), "introduced"), point(e["fixed"], "fixed"), point(e["last_affected"], "last")),
                lambda p: p["at"].isNotNull(),
            ),
        )
    )

    def inside(v: Column) -> Column:
        # of equal versions, 'fixed' sorts before 'introduced' and 'introduced' before 'last'
        below = F.filter(F.array_sort(points), lambda p: p["at"] <= v)
        last = F.element_at(below, F.lit(-1))
        open_ = F.when(F.size(below) == 0, F.lit(False)).otherwise(let(last, lambda p: F.when(p["kind"] == "introduced", True).when(p["kind"] == "fixed", False).otherwise(p["at"] == v)))
        return F.when(v.isNull(), F.lit(False)).otherwise(open_)

    return let(parse_version(version), inside)


def first_fix(version: Column, fixes: Column) -> Column:
    """The lowest fix above the version on its own major branch, else the highest fix; null without one."""
    known = F.filter(F.transform(fixes, lambda f: F.struct(parse_version(f).alias("at"), f.alias("text"))), lambda f: f["at"].isNotNull())

    def chosen(x: Column) -> Column:
        branch = F.filter(x["known"], lambda f: (f["at"] > x["v"]) & (f["at"]["major"] == x["v"]["major"]))
        return F.coalesce(F.array_min(branch)["text"], F.array_max(x["known"])["text"])

    return let(F.struct(parse_version(version).alias("v"), known.alias("known")), chosen)


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("info")


def _up(x: Column) -> Column:
    """Rounding up to a decimal as the specification of the score does it, in whole numbers."""
    n = F.floor(x * 100000 + 0.5).cast("long")
    return F.when(n % 10000 == 0, n / 100000.0).otherwise((F.floor(n / 10000) + 1) / 10.0)


def cvss_base(vector: Column) -> Column:
    """Base score of a CVSS 3.x vector; null if a metric is missing."""
    return let(F.str_to_map(F.upper(vector), F.lit("/"), F.lit(":")), _score)


def _score(m: Column) -> Column:

    def metric(name: str, **values: float) -> Column:
        got = F.element_at(m, F.lit(name))
        out = None
        for k, x in values.items():
            out = F.when(got == k, F.lit(x)) if out is None else out.when(got == k, F.lit(x))
        return out

    changed = F.element_at(m, F.lit("S")) == "C"
    pr = F.when(changed, metric("PR", N=0.85, L=0.68, H=0.5)).otherwise(metric("PR", N=0.85, L=0.62, H=0.27))
    impact_of = lambda n: metric(n, N=0.0, L=0.22, H=0.56)
    impact = let(
        1 - (1 - impact_of("C")) * (1 - impact_of("I")) * (1 - impact_of("A")),
        lambda iss: F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss),
    )
    exploit = 8.22 * metric("AV", N=0.85, A=0.62, L=0.55, P=0.2) * metric("AC", L=0.77, H=0.44) * pr * metric("UI", N=0.85, R=0.62)

    def base(x: Column) -> Column:
        total = F.least(F.when(changed, 1.08 * (x["i"] + x["e"])).otherwise(x["i"] + x["e"]), F.lit(10.0))
        return F.when(x["i"].isNull() | x["e"].isNull(), F.lit(None)).when(x["i"] <= 0, F.lit(0.0)).otherwise(let(total, _up))

    return let(F.struct(impact.alias("i"), exploit.alias("e")), base)
