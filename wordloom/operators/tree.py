"""A tree of directories and files kept in two tables.

``dirs(dir_id, name, parent_id)`` (the root is 0, its own parent null) and
``files(file_id, name, parent_id, title, content)``.  A path costs one join
with the directories for each of its levels; absolute paths of all
directories take about as many rounds as the tree's depth has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import content_url
from wordloom.sources.kept import kept

ROOT = 0


def _ident(path: Column) -> Column:
    return F.xxhash64(path).bitwiseAND(F.lit((1 << 62) - 1))


def dir_row(spark: SparkSession, name: str) -> DataFrame:
    """The row that ``from_paths`` gives a directory right below the root."""
    return spark.range(1).select(_ident(F.lit(name)).alias("dir_id"), F.lit(name).alias("name"), F.lit(ROOT).cast("long").alias("parent_id"))


def from_paths(paths: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Builds both tables from slash-separated paths: the last segment is a
    file.  Ids are hashes of paths, so they are stable and need no order."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    cut = paths.select(parts.alias("parts")).where(F.size("parts") > 0).distinct()
    name_of = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    levels = cut.where(F.size("parts") > 1).select("parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"))
    parent = lambda n: F.when(n == 1, F.lit(ROOT).cast("long")).otherwise(_ident(name_of(n - 1)))
    n = F.col("n")
    dirs = levels.select(_ident(name_of(n)).alias("dir_id"), F.element_at("parts", n).alias("name"), parent(n).alias("parent_id")).distinct()
    root = paths.sparkSession.range(1).select(F.lit(ROOT).cast("long").alias("dir_id"), F.lit("").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    last = F.size("parts")
    files = cut.select(_ident(F.concat(F.lit("f:"), F.array_join("parts", "/"))).alias("file_id"), F.element_at("parts", last).alias("name"), parent(last).alias("parent_id"))
    return root.unionByName(dirs), files


def normal_path(path: str) -> list[str] | None:
    """Segments without ``.``, ``..`` and empty ones; None above the root."""
    out: list[str] = []
    for s in path.split("/"):
        if s == "..":
            if not out:
                return None
            out.pop()
        elif s not in ("", "."):
            out.append(s)
    return out


def resolve_dir(dirs: DataFrame, path: str) -> DataFrame:
    """The directory row at a path, or no row.  Of equal names the smallest
    id is found.  Filters reach the scan of each level."""
    segments = normal_path(path)
    if segments is None:
        return dirs.limit(0)
    at = dirs.where(F.col("dir_id") == ROOT)
    for s in segments:
        below = dirs.where(F.col("name") == s).join(at.select(F.col("dir_id").alias("_up")), F.col("parent_id") == F.col("_up"), "left_semi")
        at = below.groupBy().agg(F.min(F.struct(*dirs.columns)).alias("_row")).where("_row is not null").select("_row.*")
    return at


def resolve_file(dirs: DataFrame, files: DataFrame, path: str) -> DataFrame:
    head, _, name = path.rstrip("/").rpartition("/")
    at = resolve_dir(dirs, head).select(F.col("dir_id").alias("_up"))
    return files.where(F.col("name") == name).join(at, F.col("parent_id") == F.col("_up"), "left_semi")


def resolve(dirs: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(``kind``, ``id``): the directory at a path or, without one, the file."""
    d = resolve_dir(dirs, path).select(F.lit(0).alias("_k"), F.lit("dir").alias("kind"), F.col("dir_id").alias("id"))
    f = resolve_file(dirs, files, path).select(F.lit(1).alias("_k"), F.lit("file").alias("kind"), F.col("file_id").alias("id"))
    return d.unionByName(f).groupBy().agg(F.min(F.struct("_k", "kind", "id")).alias("_row")).where("_row is not null").select("_row.kind", "_row.id")


def list_dir(dirs: DataFrame, files: DataFrame, dir_id: int) -> DataFrame:
    """(``kind``, ``id``, ``name``) of a directory's children."""
    d = dirs.where(F.col("parent_id") == dir_id).select(F.lit("dir").alias("kind"), F.col("dir_id").alias("id"), "name")
    return d.unionByName(files.where(F.col("parent_id") == dir_id).select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "name"))


def absolute_paths(dirs: DataFrame) -> DataFrame:
    """(``dir_id``, ``path``); the root's path is empty.

    Each round joins every open row with the row that it has come up to and so
    doubles its climb: a tree of any depth d takes about log2(d) joins.  What
    doesn't lead to a root (no parent row, or a ring) has no path.
    """
    root = F.col("parent_id").isNull()
    left = kept(dirs.select("dir_id", F.when(root, F.lit("")).otherwise(F.concat(F.lit("/"), "name")).alias("path"), F.col("parent_id").alias("up")))
    done = left.where("up is null")
    left = left.where("up is not null")
    while left.head(1):
        above = done.unionByName(left).select(F.col("dir_id").alias("_id"), F.col("path").alias("_head"), F.col("up").alias("_up"))
        climbed = kept(left.join(above, F.col("up") == F.col("_id")).select("dir_id", F.concat("_head", "path").alias("path"), F.col("_up").alias("up")))
        reached, left = climbed.where("up is null"), climbed.where("up is not null")
        if not reached.head(1):  # every level that leads to a root is reached before a deeper one
            break
        done = done.unionByName(reached)
    return done.select("dir_id", "path")


def settled(path: Column) -> Column:
    """A path's segments without ``.``, ``..`` and empty ones; null above the
    root, as ``normal_path`` has it."""
    parts = F.split(path, "/")
    plain = F.filter(parts, lambda s: ~s.isin("", "."))

    def step(held: Column, s: Column) -> Column:
        return F.when(s != "..", F.concat(held, F.array(s))).when(F.size(held) > 0, F.slice(held, F.lit(1), F.size(held) - 1))

    climbing = F.aggregate(plain, F.array().cast("array<string>"), step)
    return F.when(F.array_contains(plain, ".."), climbing).otherwise(plain)


def resolve_many(dirs: DataFrame, files: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """``paths`` with the ``kind`` (dir or file) and ``id`` of what each one
    names, a directory before a file; both null where there is nothing.

    Every directory's absolute path is climbed up to once (by doubling, in
    about log2(depth) joins), so all paths of a table meet theirs in one join,
    however deep; of equal names in a directory the smallest id counts, and
    what is below the others can't be reached."""
    names = ("_dir", "_dirs_path", "_file", "_path", "_norm", "_head", "_name")
    if set(names) & set(paths.columns):
        raise ValueError(f"columns {names} are taken")
    first = dirs.groupBy("parent_id", "name").agg(F.min("dir_id").alias("dir_id"))
    at = absolute_paths(first).select(F.col("dir_id").alias("_dir"), F.col("path").alias("_dirs_path"))
    at = kept(at)
    own = files.groupBy("parent_id", "name").agg(F.min("file_id").alias("_file")).join(at, F.col("parent_id") == F.col("_dir"))
    own = own.select("_file", F.concat("_dirs_path", F.lit("/"), "name").alias("_path"))
    # Equal paths are looked up once, so a path that many rows share is one row here.
    wanted = paths.select(F.col(path).alias("_norm")).distinct().withColumn("_name", settled(F.col("_norm")))
    joined = F.when(F.col("_name").isNotNull(), F.concat(F.when(F.size("_name") > 0, "/").otherwise(""), F.array_join("_name", "/")))
    wanted = wanted.withColumn("_head", joined).drop("_name")
    found = wanted.join(at, F.col("_head") == F.col("_dirs_path"), "left").join(own, F.col("_head") == F.col("_path"), "left")
    kind = F.when(F.col("_dir").isNotNull(), "dir").when(F.col("_file").isNotNull(), "file")
    found = found.select("_norm", kind.alias("kind"), F.coalesce("_dir", "_file").alias("id"))
    return paths.join(found, F.col(path) == F.col("_norm"), "left").drop("_norm")


def by_ids(dirs: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``kind``, ``id``, ``name``, ``parent_id``) of directories and files by
    id (``wanted``: ``kind`` and ``id``)."""
    rows = dirs.select(F.lit("dir").alias("kind"), F.col("dir_id").alias("id"), "name", "parent_id")
    rows = rows.unionByName(files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "name", "parent_id"))
    return rows.join(wanted.select("kind", "id").distinct(), ["kind", "id"], "left_semi")


def content(files: DataFrame, urls: DataFrame, url: str) -> DataFrame:
    """``urls`` with the ``title`` and ``content`` of the file that a content
    URL names by its id (``.../@<file id>``); null where there is none."""
    wanted = urls.withColumn("_file", content_url(F.col(url))["path"])
    wanted = wanted.withColumn("_file", F.when(F.col("_file").startswith("@"), F.expr("try_cast(substring(_file, 2) AS BIGINT)")))
    return wanted.join(files.select(F.col("file_id").cast("long").alias("_file"), "title", "content"), "_file", "left").drop("_file")
