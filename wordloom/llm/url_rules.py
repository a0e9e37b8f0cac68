"""URL filters by a sort-merge range join.

A host's key is its labels from the last to the first, each with a full stop
behind it, so that a host and all its subdomains are one interval of keys.
URLs are dealt out by ranges of (key, path), a rule goes to every range that
its interval meets, and each range is sorted and swept once: a stack holds the
hosts with rules that enclose the present key, and the rules of one host are
nested by path in the same way.

A busy host's URLs are split by path and by id.  A range that lies inside one
host takes only those rules whose paths meet its own, so the copies of a rule
are as many as the ranges that it may decide in.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.ranges import bounds, dealt, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://`` and the path up to a
    query or fragment; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    found = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k)
    return F.translate(found(1), UPPER, LOWER), found(2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def host_of(key: Column) -> Column:
    return F.array_join(F.reverse(F.split(F.substring(key, F.lit(1), F.length(key) - 1), r"\.", -1)), ".")


def _spread(cuts: list[tuple]):
    """Copies each rule to the ranges that its interval meets."""

    def parts_of(key: str, path: str) -> list[int]:
        low, high = bisect_right(cuts, (key,)), bisect_left(cuts, (key[:-1] + "/",))  # "/" follows "." directly
        out = []
        for p in range(low, high + 1):
            first, last = (cuts[p - 1] if p else None), (cuts[p] if p < len(cuts) else None)
            if first and last and first[0] == last[0] and (path > last[1] or path < first[1] and not first[1].startswith(path)):
                continue
            out.append(p)
        return out

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = frame.to_pylist()
            parts = [parts_of(r["key"], r["path"]) for r in rows]
            take = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            copies = frame.take(take)
            yield pa.RecordBatch.from_arrays([*copies.columns, pa.array([p for own in parts for p in own], pa.int32())], [*frame.schema.names, "part"])

    return run


class _Host:
    """One host's rules by path; ``up`` is the next rule that encloses one."""

    def __init__(self, key: str):
        self.key, self.size = key, len(key) - 1
        self.paths: list[str] = []
        self.up: list[int] = []
        self.verdicts: list[str] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.verdicts[-1] = verdict
            return
        above = len(self.paths) - 1
        while above >= 0 and not path.startswith(self.paths[above]):
            above = self.up[above]
        self.paths.append(path)
        self.up.append(above)
        self.verdicts.append(verdict)

    def longest(self, path: str) -> int:
        """The longest rule that the path starts with, -1 if there is none."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.up[at]
        return at


def _sweep(default: str, id_type: pa.DataType):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Host] = []
        present = None
        for frame in frames:
            names = ("part", "key", "kind", "path", "verdict")
            rules, verdicts, urls = [], [], []
            for i, (part, key, kind, path, verdict) in enumerate(zip(*(frame.column(frame.schema.get_field_index(n)).to_pylist() for n in names), strict=True)):
                if part != present:
                    present, stack = part, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(_Host(key))
                    stack[-1].add(path, verdict)
                    continue
                best, rule, said = -1, None, default
                for host in stack:  # from the shortest host to the longest: of equal lengths the longer host's rule wins
                    at = host.longest(path)
                    if at >= 0 and host.size + len(host.paths[at]) >= best:
                        best, said = host.size + len(host.paths[at]), host.verdicts[at]
                        rule = ".".join(reversed(host.key[:-1].split("."))) + host.paths[at]
                urls.append(i)
                rules.append(rule)
                verdicts.append(said)
            kept = frame.take(pa.array(urls, pa.int64()))
            column = lambda n: kept.column(kept.schema.get_field_index(n))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([column("id").cast(id_type), column("key"), column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "key", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(``key``, ``host``, ``path``, ``rule``, ``verdict``) of every URL.

    ``rules``: (``host``, ``path``, ``verdict`` allow or block); it may be as
    large as Spark can shuffle.  A rule fits its host and all subdomains if
    the URL's path starts with the rule's.  The rule with most characters
    wins, of equals the one of the longer host, and block where one rule is
    both; where none fits, ``rule`` is null and the verdict ``default``.

    Null URLs and those without ``://`` have an empty host and path.  Repeated
    rows and null ids are judged like others and all returned; URLs may have
    any length; rules with a null are left out; an empty table gives an empty
    one; other columns are ignored.
    """
    parts = partitions(pages)
    host, path = host_and_path(F.col(url))
    own = pages.select(F.col(key).alias("id"), host_key(host).alias("key"), path.alias("path"))
    own = own.withColumn("salt", F.xxhash64("id"))
    cuts = bounds(own, ["key", "path", "salt"], parts)
    none = F.lit(None).cast("string")
    placed = dealt(own, ["key", "path", "salt"], cuts).select("part", "id", "key", F.lit(1).alias("kind"), "path", none.alias("verdict"))
    lowered = F.translate("host", UPPER, LOWER)
    wanted = rules.where("host is not null and path is not null and verdict is not null").select(host_key(lowered).alias("key"), "path", "verdict")
    spread = wanted.mapInArrow(_spread(cuts), "key string, path string, verdict string, part int")
    spread = spread.select("part", F.lit(None).cast(own.schema["id"].dataType).alias("id"), "key", F.lit(0).alias("kind"), "path", "verdict")
    ordered = placed.unionByName(spread).repartitionById(parts, "part").sortWithinPartitions("part", "key", "kind", "path")
    id_type = own.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    judged = ordered.mapInArrow(_sweep(default, to_arrow_type(id_type)), f"id {id_type.simpleString()}, key string, path string, rule string, verdict string")
    return judged.select(F.col("id").alias(key), host_of(F.col("key")).alias("host"), "path", "rule", "verdict")
