"""Rules over hosts and paths for URLs, by a sorted sweep with column functions only.

A host is turned round, label by label, with a point after each: ``a.example.net`` becomes ``net.example.a.``. So all
hosts that a rule's host fits follow each other in the order of these keys, and the rule is an interval of them.
Intervals of different rules are nested or apart. The sweep sorts the begin and end of every interval together with
the URLs' keys: the running sum of begins minus ends is the height of the stack of active rules, and the rule at
height j is the last one that began at height j.

Hosts are swept first, each once however many URLs it has; that gives the active hosts of rules. Then, for every
different (host, path), the paths are swept inside each active host, and the longest rule wins. Sums and last begins
are running totals over ranges of keys (``ordered.running``), so a host with a third of all URLs is dealt over many
tasks, as is one with a third of all rules.

Rows of any kind: the host is what lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path goes on to ``?``, ``#`` or the end. Null URLs and those without ``://`` have an empty host and
path. Very long URLs are read whole. Repeated rows and null ids each get their own row. Rules: an empty host fits every
host; a null host or path is empty; hosts with ``/``, ``?`` or ``#`` and paths with ``?`` or ``#`` fit nothing, as no
URL has them; of equal rules a blocking one wins; of two rules of the same length the one with the longer host wins.
No rules, or no rows: every URL gets the default. Other columns are ignored but for those of ``carry``, which keep
their names; the names of the result cannot be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.components import stored
from facetry.llm.ordered import running

ALLOW, BLOCK = "allow", "block"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BEGIN, POINT, END = 0, 1, 2


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host in reverse order, each with a point, as bytes."""
    return _bytes(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bytes(text: Column) -> Column:
    # The byte 0xFF, which closes an interval, is in no valid UTF-8.
    return F.make_valid_utf8(text).cast("binary")


def active_rules(rules: DataFrame, points: DataFrame, innermost: bool) -> DataFrame:
    """The rules whose key begins the key of a point: ``key`` of the point and ``rule``, a struct.

    ``rules`` has binary ``key`` and struct ``rule`` that begins with it, ``points`` has binary ``key``; both without
    repeated keys. A point gets a row for each active rule, or with ``innermost`` for the longest only.
    """
    none = F.lit(None).cast(rules.schema["rule"].dataType)

    def events(frame: DataFrame, key: Column, kind: int, step: int, rule: Column) -> DataFrame:
        return frame.select(key.alias("key"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), rule.alias("rule"))

    key = F.col("key")
    moves = (
        events(rules, key, BEGIN, 1, F.col("rule"))
        .unionByName(events(rules, F.concat(key, F.lit(b"\xff")), END, -1, none))
        .unionByName(events(points, key, POINT, 0, none))
        .withColumn("all", F.lit(0))
    )
    heights = running(moves, ["all"], ["key", "kind"], {"height": ("sum", "step")}).where(F.col("kind") != END)
    # A begin lies at its own height; a point asks for the last begin at each height of the stack, or at its top.
    own = F.array("height")
    stack = F.when(F.col("kind") == BEGIN, own).otherwise(F.sequence(F.lit(1).cast("long"), F.col("height")))
    levels = own if innermost else stack
    asked = heights.where("height > 0").select("key", "kind", "rule", F.explode(levels).alias("level"))
    found = running(asked, ["level"], ["key", "kind"], {"top": ("max", "rule")})
    return found.where(F.col("kind") == POINT).select("key", F.col("top").alias("rule"))


def read_rules(rules: DataFrame) -> DataFrame:
    """Rules by key: host_key, host, path, verdict, each (host, path) once; those that can fit no URL left out."""
    host = F.coalesce(F.translate(F.col("host").cast("string"), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    rows = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").cast("string").alias("verdict"))
    rows = rows.where(~F.rlike("host", F.lit("[/?#]")) & ~F.rlike("path", F.lit("[?#]")))
    rows = rows.groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == BLOCK).alias("verdict"))
    every = F.lit(b"")
    return rows.withColumn("host_key", F.when(F.col("host") == "", every).otherwise(host_key(F.col("host"))))


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = ALLOW, url: str = "url", carry: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """``carry``, host, path, rule, verdict, rule_host and rule_path of every row of ``pages``.

    ``rules`` has the columns host, path and verdict. ``rule`` is host and path of the rule that decided, null where
    none fits and the verdict is ``default``.
    """
    address = F.col(url).cast("string")
    rows = pages.select(*carry, host_of(address).alias("host"), path_of(address).alias("path"))
    known = stored(read_rules(rules), "rules")

    hosts = rows.select("host").distinct().withColumn("key", host_key(F.col("host")))
    names = known.select(F.col("host_key").alias("key")).distinct().withColumn("rule", F.struct("key"))
    active = active_rules(names, hosts.select("key").distinct(), innermost=False)
    active = active.select("key", F.col("rule.key").alias("rule_key"))
    active = stored(hosts.join(active, "key").select("host", "rule_key"), "active_hosts")

    addresses = rows.select("host", "path").distinct()
    asked = addresses.join(active, "host").withColumn("key", _inside(F.col("rule_key"), F.col("path")))
    asked = stored(asked, "asked_paths")
    paths = known.withColumn("key", _inside(F.col("host_key"), F.col("path")))
    paths = paths.select("key", F.struct("key", "host", "path", "verdict").alias("rule"))
    won = active_rules(paths, asked.select("key").distinct(), innermost=True)
    # The longest rule inside each active host; the longest of these, then the one with the longer host.
    size = F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))
    best = asked.join(won, "key").groupBy("host", "path").agg(F.max_by("rule", size).alias("rule"))
    best = best.select(
        "host",
        "path",
        F.col("rule.host").alias("rule_host"),
        F.col("rule.path").alias("rule_path"),
        F.col("rule.verdict").alias("verdict"),
    )
    return rows.join(best, ["host", "path"], "left").select(
        *carry,
        "host",
        "path",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
        "rule_host",
        "rule_path",
    )


def _inside(rule_key: Column, path: Column) -> Column:
    """The paths of one host of rules follow each other: no host has a slash, so the first one ends its key."""
    return F.concat(rule_key, F.lit(b"/"), _bytes(path))
