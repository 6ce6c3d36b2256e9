"""Listing, looking up, walking and summarising a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import columns as c

ROOT, TRASH = 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def no_case(name: Column) -> Column:
    """Order of names as the catalog sorts them: only A-Z are folded."""
    return F.translate(name, UPPER, LOWER)


def folders_first(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.col("kind") != "d", no_case(F.col("name")), "name")


def entries(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """Nodes with `is_project` (the top folder of a project) and `in_project`; a negative stored size reads as 0."""
    tops = projects.select(F.col("root").alias("id"), F.lit(True).alias("_top"))
    out = nodes.join(tops, "id", "left").withColumn("is_project", F.coalesce("_top", F.lit(False))).drop("_top")
    out = out.withColumn("in_project", F.col("project").isNotNull())
    return out.withColumn("stored", F.greatest("stored", F.lit(0))) if "stored" in nodes.columns else out


def by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def child(nodes: DataFrame, parent: int, name: str) -> DataFrame:
    """A name is looked up as it is written, with its case."""
    return nodes.where((F.col("parent") == parent) & (F.col("name") == name))


def children(nodes: DataFrame, parent: int) -> DataFrame:
    return folders_first(nodes.where(F.col("parent") == parent))


def canonical(path: str) -> str:
    return "/" + "/".join(p for p in path.split("/") if p)


def resolve(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path, or no row; what is in the trash has none."""
    return nodes.where(F.col("path") == canonical(path))


def list_folder(nodes: DataFrame, path: str) -> DataFrame:
    """The children of the folder at a path, folders first."""
    here = resolve(nodes, path).where("kind = 'd'").select(F.col("id").alias("parent"))
    return folders_first(nodes.join(F.broadcast(here), "parent", "left_semi"))  # one id


def project_of(paths: DataFrame, nodes: DataFrame, column: str = "path") -> DataFrame:
    """paths with `project` and `found`, those of the deepest existing folder at or above each path."""
    p = paths.select(column).distinct()
    up = p.withColumn("_parts", c.parts(F.col(column)))
    up = up.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("_parts"))))
    up = up.withColumn("at", F.concat(F.lit("/"), F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), "/")))
    there = nodes.where("path IS NOT NULL").select(F.col("path").alias("at"), F.col("project"), F.col("path").alias("found"))
    best = up.join(there, "at").groupBy(column).agg(F.max_by(F.struct("project", "found"), "depth").alias("_b"))
    return paths.join(best.select(column, "_b.project", "_b.found"), column, "left")


def stat(nodes: DataFrame, projects: DataFrame, path: str) -> DataFrame:
    """The entry at a path, with the path of its project's top folder."""
    tops = nodes.join(projects.select(F.col("root").alias("id"), F.col("project").alias("_p")), "id").select("_p", F.col("path").alias("project_path"))
    e = entries(resolve(nodes, path), projects)
    return e.join(tops, e["project"] == tops["_p"], "left").drop("_p")


def walk(nodes: DataFrame, path: str) -> DataFrame:
    """Every node below a path, with its path relative to it."""
    top = canonical(path).rstrip("/")
    below = nodes.where(c.below(F.col("path"), F.lit(top or "/")))
    return below.withColumn("rel", F.substring("path", F.lit(len(top) + 2), F.length("path")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every node and each node above it, by the parent links alone.

    Frontiers go up one level at a time: one join a level of the tree, each on what has not reached the top.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default would stop at a million rows
    return spark.sql(
        """WITH RECURSIVE up(id, ancestor, distance) MAX RECURSION LEVEL 4096 AS (
             SELECT id, parent, 1 FROM {n} WHERE parent IS NOT NULL
             UNION ALL SELECT u.id, n.parent, u.distance + 1 FROM up u JOIN {n} n ON u.ancestor = n.id WHERE n.parent IS NOT NULL)
           SELECT id, ancestor, distance FROM up""",
        n=nodes.select("id", "parent"),
    )


def paths_of(nodes: DataFrame) -> DataFrame:
    """(id, path, in_trash, detached) from parent links: names from the top down; in the trash, below it."""
    up = ancestors(nodes)
    names = nodes.select(F.col("id").alias("ancestor"), "name")
    above = up.join(names, "ancestor").where(f"ancestor NOT IN ({ROOT}, {TRASH})")
    parts = above.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))).alias("a"))
    ends = up.groupBy("id").agg(F.bool_or(F.col("ancestor") == TRASH).alias("in_trash"), F.bool_or(F.col("ancestor").isin(ROOT, TRASH)).alias("tied"))
    d = nodes.select("id", "name").where(f"id NOT IN ({ROOT}, {TRASH})").join(parts, "id", "left").join(ends, "id", "left")
    names = F.concat(F.coalesce(F.transform("a", lambda x: x["name"]), F.array().cast("array<string>")), F.array("name"))
    return d.select("id", F.concat(F.lit("/"), F.array_join(names, "/")).alias("path"), F.coalesce("in_trash", F.lit(False)).alias("in_trash"), (~F.coalesce("tied", F.lit(False))).alias("detached"))


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path and all below it."""
    top = canonical(path)
    return nodes.where((F.col("path") == top) | c.below(F.col("path"), F.lit(top)))


def info(nodes: DataFrame, content_blobs: DataFrame, blobs: DataFrame, packs: DataFrame, path: str) -> DataFrame:
    """One row: files, folders (without itself), original, stored and duplicate bytes, archived_at, protection, last_checked.

    A content counts once; a solid block's stored bytes are shared by size; protection and checks are those of all packs
    that hold any of it.
    """
    s = subtree(nodes, path)
    loc = content_blobs.join(blobs.select("blob_id", "project", F.col("kind").alias("blob_kind"), "raw_len", "data_len", "pack_id"), ["blob_id", "project"])
    loc = loc.join(packs.select("pack_id", "project", "state", "checked_at"), ["pack_id", "project"])
    loc = loc.select("project", "sha256", "blob_kind", "raw_len", "data_len", "pack_id", "state", "checked_at")
    one = s.where("kind = 'f'").groupBy("project", "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"), F.max("size").alias("size")).join(loc, ["project", "sha256"], "left")
    share = F.when((F.col("blob_kind") == "s") & (F.col("raw_len") > 0), F.col("data_len").cast("double") * F.col("size") / F.col("raw_len")).otherwise(F.col("data_len").cast("double"))
    by_pack = one.groupBy("project", "pack_id").agg(
        F.sum("n").alias("files"), F.sum("all").alias("original"), F.sum(F.when(F.col("pack_id").isNotNull(), F.col("size")).otherwise(0)).alias("unique"),
        F.sum(share).alias("stored"), F.first("state").alias("state"), F.first("checked_at").alias("checked_at"),
    )
    held = F.col("pack_id").isNotNull()
    data = by_pack.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("original"), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.round(F.sum("stored")), F.lit(0.0)).cast("long").alias("stored_bytes"), F.coalesce(F.sum(F.col("original") - F.col("unique")), F.lit(0)).alias("duplicate_bytes"),
        F.when(F.count_if(held) == 0, F.lit("none")).when(F.count_if(held & (F.col("state") == "damaged")) > 0, F.lit("damaged"))
        .when(F.count_if(held & (F.col("state") != "protected")) == 0, F.lit("protected")).otherwise(F.lit("pending")).alias("protection"),
        F.when(F.count_if(held & F.col("checked_at").isNull()) == 0, F.min("checked_at")).alias("last_checked"),
    )
    tree = s.agg(
        F.greatest(F.count_if(F.col("kind") == "d") - F.max(F.when((F.col("path") == canonical(path)) & (F.col("kind") == "d"), 1).otherwise(0)), F.lit(0)).alias("folders"),
        F.max("created").alias("archived_at"), F.first(F.when(F.col("path") == canonical(path), F.col("kind")), ignorenulls=True).alias("kind"),
    )
    return tree.crossJoin(data).where("kind IS NOT NULL").select(F.lit(canonical(path)).alias("path"), "*")  # one row each


def index_lines(nodes: DataFrame, content_blobs: DataFrame, blobs: DataFrame, packs: DataFrame, first_paths: DataFrame) -> DataFrame:
    """(path, line) of the plain-text index, by path: path, size, sha256, pack, start, length, offset in a block, member, stored as."""

    def clean(x: Column) -> Column:
        for raw, told in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            x = F.replace(x, F.lit(raw), F.lit(told))
        return x

    b = blobs.select("blob_id", "project", F.col("kind").alias("blob_kind"), "pack_id", "data_off", "data_len")
    loc = content_blobs.select("project", "sha256", "blob_id", "blob_off").join(b, ["blob_id", "project"]).join(packs.select("pack_id", "project"), ["pack_id", "project"])
    files = nodes.where("kind = 'f' AND path IS NOT NULL").join(loc, ["project", "sha256"]).join(first_paths, ["project", "sha256"], "left")
    solid = F.col("blob_kind") == "s"
    fields = [
        clean(F.substring("path", 2, 1_000_000)), F.col("size").cast("string"), F.col("sha256"), F.format_string("pack-%08d", "pack_id"), F.col("data_off").cast("string"), F.col("data_len").cast("string"),
        F.when(solid, F.col("blob_off").cast("string")).otherwise(F.lit("")), F.when(solid, F.lit("solid")).otherwise(F.lit("file")),
        F.when(F.col("stored_path") == F.col("path"), F.lit("")).otherwise(F.coalesce(clean(F.substring("stored_path", 2, 1_000_000)), F.lit(""))),
    ]
    return files.select("path", F.concat_ws("\t", *fields).alias("line")).orderBy("path")
