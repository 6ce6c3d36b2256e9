"""Mutations as functions from tables to their next version. Nothing is changed in place; a version is published by writing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.api.browse import TRASH, ancestors, canonical, no_case, project_of
from cairnspark.functions import columns as c


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and those new rows whose key it does not have; of new rows with one key, one."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """table with new rows in place of those with the same key; of new rows with one key, the last by `order`."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    last = new.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))


def delete_in(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows whose key stands in `gone`."""
    return table.join(gone.select(*keys), keys, "left_anti")


def union_created(mine: Column, more: Column) -> Column:
    """Paths created so far and new ones, each once, in order."""
    return F.array_union(mine, more)


def made_id(path: Column) -> Column:
    """The id of a new node: 62 bits of its path's hash, above all ids dealt out in order; a task that is run again makes the same one."""
    return F.xxhash64(path).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))


def mkdirs(nodes: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """nodes and the missing folders of the paths wanted, with their parents; each inherits the project of the deepest folder there."""
    p = wanted.select(c.parts(F.col("path")).alias("p"))
    every = p.select(F.explode(F.expr("transform(sequence(1, size(p)), i -> concat('/', array_join(slice(p, 1, i), '/')))")).alias("path")).where("path <> '/'").distinct()
    there = nodes.where("path IS NOT NULL")
    missing = every.join(there.select("path"), "path", "left_anti")
    placed = project_of(missing, there).drop("found")
    made = placed.withColumn("id", made_id(F.col("path")))
    ids = there.select(F.col("path").alias("up"), F.col("id").alias("parent")).union(made.select("path", "id"))
    made = made.withColumn("up", c.parent(F.col("path"))).join(ids, "up", "left").drop("up")
    made = made.select("id", "parent", "path", c.base_name(F.col("path")).alias("name"), F.lit("d").alias("kind"), "project", F.lit(now * 1_000_000_000).alias("mtime_ns"), F.lit(now).alias("created"))
    return nodes.unionByName(made, allowMissingColumns=True)


def inherit_project(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New rows (with a parent) with the project of the parent."""
    above = nodes.select(F.col("id").alias("parent"), "project")
    return new.drop("project").join(above, "parent", "left")


def create_projects(nodes: DataFrame, projects: DataFrame, wanted: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, projects, outcome): the folders wanted (id) become projects, unless inside one. An existing project stays as it is.

    A project's id follows from its folder's path, so that a task that is run again makes the same one.
    """
    w = nodes.join(wanted.select("id"), "id").join(projects.select(F.col("root").alias("id"), F.lit(True).alias("_top")), "id", "left")
    status = F.when(F.col("_top"), "exists").when(F.col("project").isNotNull(), "inside a project").otherwise("created")
    outcome = w.select("id", "path", status.alias("status"))
    made = outcome.where("status = 'created'").select(F.col("id").alias("root"), "path", c.stable_id(F.col("path")).alias("project"))
    under = made.select(F.col("path").alias("_top"), F.col("project").alias("_new"))
    p = nodes.withColumn("_parts", c.parts(F.col("path"))).withColumn("_up", F.explode_outer(F.expr("transform(sequence(1, greatest(size(_parts), 1)), i -> concat('/', array_join(slice(_parts, 1, i), '/')))")))
    owner = p.join(under, F.col("_up") == F.col("_top")).groupBy("id").agg(F.max("_new").alias("_new"))
    moved = nodes.join(owner, "id", "left").withColumn("project", F.coalesce("_new", "project")).drop("_new").select(*nodes.columns)
    return moved, projects.unionByName(made.select("project", "root")), outcome


def insert_symlinks(nodes: DataFrame, links: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, outcome): links (path, target, mtime_ns) whose folder is there and whose name is valid and free."""
    up = links.withColumn("up", c.parent(F.col("path"))).withColumn("name", c.base_name(F.col("path")))
    folders = nodes.where("kind = 'd' AND path IS NOT NULL").select(F.col("path").alias("up"), F.col("id").alias("parent"), "project")
    taken = nodes.where("path IS NOT NULL").select("path", F.lit(True).alias("_taken"))
    x = up.join(folders, "up", "left").join(taken, "path", "left")
    status = F.when(~c.valid_name(F.col("name"), F.col("up") == "/"), "invalid name").when(F.col("parent").isNull(), "no folder").when(F.col("_taken"), "already exists").otherwise("created")
    x = x.withColumn("status", status)
    made = x.where("status = 'created'").select(
        made_id(F.col("path")).alias("id"), "parent", "path", "name", F.lit("l").alias("kind"), "project", "target", "mtime_ns", F.lit(now).alias("created")
    )
    return nodes.unionByName(made, allowMissingColumns=True), x.select("path", "status")


def set_totals(nodes: DataFrame) -> DataFrame:
    """Folders' sizes made anew from the files below them; what is in the trash counts in the trash only."""
    up = nodes.where("kind = 'f' AND path IS NOT NULL").select("size", F.explode(F.expr("transform(sequence(0, size(filter(split(path, '/'), p -> p <> '')) - 1), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")).alias("path"))
    total = up.groupBy("path").agg(F.sum("size").alias("_total"))
    out = nodes.join(total, "path", "left")
    size = F.when((F.col("kind") == "d") & F.col("path").isNotNull(), F.coalesce("_total", F.lit(0))).otherwise(F.col("size"))
    return out.withColumn("size", size).drop("_total").select(*nodes.columns)


def carried(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """nodes with `stored`, recounted: a content's bytes count at the file of least id that has it; folders have the sum below.

    stored: project, sha256 and stored bytes of each content. Idempotent, whatever was there before.
    """
    least = nodes.where("kind = 'f'").groupBy("project", "sha256").agg(F.min("id").alias("id"))
    own = least.join(stored, ["project", "sha256"]).select("id", F.col("stored").alias("_own"))
    base = nodes.drop("stored").join(own, "id", "left")
    sums = ancestors(nodes).join(own, "id").groupBy("ancestor").agg(F.sum("_own").alias("_below")).withColumnRenamed("ancestor", "id")
    return base.join(sums, "id", "left").withColumn("stored", F.coalesce("_own", F.lit(0)) + F.coalesce("_below", F.lit(0))).drop("_own", "_below")


def move(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """nodes with the node at `source`, and all below it, at `target`; unchanged where that is not allowed (see move_refusal)."""
    s, t = canonical(source), canonical(target)
    up, name = t.rsplit("/", 1)
    parent = nodes.where((F.col("path") == (up or "/")) & (F.col("kind") == "d")).select(F.col("id").alias("_parent"))
    ok = move_refusal(nodes, source, target).where("why IS NULL").select(F.lit(True).alias("_ok"))
    gate = parent.crossJoin(ok)  # one row or none
    x = nodes.join(F.broadcast(gate), F.lit(True), "left")
    top, below = F.col("path") == s, c.below(F.col("path"), F.lit(s))
    moved = F.col("_ok").isNotNull() & (top | below)
    return x.select(*(
        F.when(moved & top, F.col("_parent")).otherwise(F.col("parent")).alias("parent") if col == "parent"
        else F.when(moved & top, F.lit(name)).otherwise(F.col("name")).alias("name") if col == "name"
        else F.when(moved, F.concat(F.lit(t), F.substring("path", F.lit(len(s) + 1), F.length("path")))).otherwise(F.col("path")).alias("path") if col == "path"
        else F.col(col)
        for col in nodes.columns
    ))


def move_refusal(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """One row with `why` a node may not move, null where it may."""
    s, t = canonical(source), canonical(target)
    there = nodes.where(F.col("path").isin(s, t, t.rsplit("/", 1)[0] or "/")).agg(
        F.count_if(F.col("path") == s).alias("s"), F.count_if(F.col("path") == t).alias("t"), F.count_if((F.col("path") == (t.rsplit("/", 1)[0] or "/")) & (F.col("kind") == "d")).alias("up")
    )
    name = F.lit(t.rsplit("/", 1)[1])
    why = F.when(F.lit(s == "/"), "cannot move the archive root").when(~c.valid_name(name, F.lit(t.count("/") == 1)), "invalid name").when(F.col("s") == 0, "not found")
    why = why.when(F.lit(t == s), F.lit(None)).when(F.lit(t.startswith(s + "/")), "cannot move a folder into itself").when(F.col("t") > 0, "already exists").when(F.col("up") == 0, "no folder")
    return there.select(why.alias("why"))


def trash(nodes: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """nodes with those of `ids` in the trash, under their id as name, with where they came from; what is below them loses its path too.

    Nodes already in the trash stay as they are.
    """
    tops = nodes.where("path IS NOT NULL AND path <> '/'").join(ids.select("id"), "id", "left_semi").select("id", F.col("path").alias("_top"))
    p = nodes.where("path IS NOT NULL").select("id", F.explode(F.expr("transform(sequence(1, greatest(size(filter(split(path, '/'), p -> p <> '')), 1)), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")).alias("_top"))
    gone = p.join(tops.select("_top"), "_top", "left_semi").select("id").distinct().withColumn("_gone", F.lit(True))
    x = nodes.join(tops.withColumnRenamed("_top", "_origin"), "id", "left").join(gone, "id", "left")
    own = F.col("_origin").isNotNull()
    return x.select(*(
        F.when(own, F.lit(TRASH)).otherwise(F.col("parent")).alias("parent") if col == "parent"
        else F.when(own, F.col("id").cast("string")).otherwise(F.col("name")).alias("name") if col == "name"
        else F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("path")).alias("path") if col == "path"
        else F.when(own, F.lit(now)).otherwise(F.col("trashed_at")).alias("trashed_at") if col == "trashed_at"
        else F.when(own, F.col("_origin")).otherwise(F.col("trash_origin")).alias("trash_origin") if col == "trash_origin"
        else F.col(col)
        for col in nodes.columns
    ))


def trash_list(nodes: DataFrame) -> DataFrame:
    """What is in the trash itself, newest first."""
    return nodes.where(F.col("parent") == TRASH).select("id", c.base_name(F.col("trash_origin")).alias("name"), "trash_origin", "kind", "size", "trashed_at").orderBy(F.desc("trashed_at"), F.desc("id"))


def restore(nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, outcome): trashed nodes put back where they came from; a taken place or a missing folder is an outcome of its own."""
    t = nodes.where(F.col("parent") == TRASH).join(ids.select("id"), "id", "left_semi").select("id", F.col("trash_origin").alias("back"))
    twice = Window.partitionBy("back").orderBy("id")
    folders = nodes.where("kind = 'd' AND path IS NOT NULL").select(F.col("path").alias("up"), F.col("id").alias("_parent"))
    taken = nodes.where("path IS NOT NULL").select(F.col("path").alias("back"), F.lit(True).alias("_taken"))
    x = t.withColumn("_nth", F.row_number().over(twice)).withColumn("up", c.parent(F.col("back"))).join(folders, "up", "left").join(taken, "back", "left")
    x = x.withColumn("status", F.when(F.coalesce("_taken", F.lit(False)) | (F.col("_nth") > 1), "already exists").when(F.col("_parent").isNull(), "no folder").otherwise("restored"))
    ok = x.where("status = 'restored'").select("id", F.col("back").alias("_back"), "_parent")
    y = nodes.join(ok, "id", "left")
    own = F.col("_back").isNotNull()
    back = y.select(*(
        F.when(own, F.col("_parent")).otherwise(F.col("parent")).alias("parent") if col == "parent"
        else F.when(own, c.base_name(F.col("_back"))).otherwise(F.col("name")).alias("name") if col == "name"
        else F.when(own, F.col("_back")).otherwise(F.col("path")).alias("path") if col == "path"
        else F.when(own, F.lit(None)).otherwise(F.col(col)).alias(col) if col in ("trashed_at", "trash_origin")
        else F.col(col)
        for col in nodes.columns
    ))
    return back, x.select("id", F.col("back").alias("path"), "status")


def purge(nodes: DataFrame, contents: DataFrame, blobs: DataFrame, packs: DataFrame, cutoff: int) -> dict[str, DataFrame]:
    """Everything after trash older than `cutoff` is gone for good: nodes, contents (with `refs`), blobs, packs, and `report`.

    A trashed node goes with all below it. Contents lose its references. A pack that is not open, holds some blob and none
    with a content still in use goes with its blobs and their contents.
    """
    tops = nodes.where((F.col("parent") == TRASH) & (F.col("trashed_at") < cutoff)).select("id")
    below = ancestors(nodes).join(tops.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    kept = delete_in(nodes, tops.union(below), ["id"])
    refs = kept.where("kind = 'f'").groupBy("project", "sha256").agg(F.count(F.lit(1)).alias("refs"))
    c2 = contents.drop("refs").join(refs, ["project", "sha256"], "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    used = c2.where("refs > 0").join(blobs.select("blob_id", "project", "pack_id"), ["blob_id", "project"]).select("pack_id", "project").distinct()
    held = blobs.select("pack_id", "project").distinct()
    dead = packs.where("state <> 'open'").join(held, ["pack_id", "project"], "left_semi").join(used, ["pack_id", "project"], "left_anti")
    gone_blobs = blobs.join(dead.select("pack_id", "project"), ["pack_id", "project"], "left_semi")
    items, freed = tops.agg(F.count(F.lit(1)).alias("items")), dead.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_freed"))
    return {
        "nodes": kept, "contents": delete_in(c2, gone_blobs, ["blob_id", "project"]), "blobs": delete_in(blobs, dead, ["pack_id", "project"]),
        "packs": delete_in(packs, dead, ["pack_id", "project"]), "dead": dead, "report": items.crossJoin(freed),
    }


def heirs(nodes: DataFrame, gone: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, heir, stored): for each file of `gone` that carried its content's bytes, the next file that has the content and stays."""
    files = nodes.where("kind = 'f'").select("id", "project", "sha256")
    least = files.groupBy("project", "sha256").agg(F.min("id").alias("id"))
    lost = least.join(gone.select("id"), "id", "left_semi").join(stored, ["project", "sha256"])
    stay = files.join(gone.select("id"), "id", "left_anti").groupBy("project", "sha256").agg(F.min("id").alias("heir"))
    return lost.join(stay, ["project", "sha256"], "left").select("id", "heir", "stored")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, path, n, free): for each path wanted the least n >= 2 such that "name (n)" beside it is not taken.

    However many numbers are taken: the free one is at most one more than as many as there are, so it is sought among the
    gaps of the taken ones, by join and sort. Wants of one path each get the same answer; they do not block each other.
    """
    numbered = r"^(.*) \(([0-9]{1,9})\)(\.[^./]*)?$"
    dot = r"^(.+)(\.[^.]*)$"
    name = c.base_name(F.col("path"))
    stem = F.when(name.rlike(dot), F.regexp_extract(name, dot, 1)).otherwise(name)
    suffix = F.when(name.rlike(dot), F.regexp_extract(name, dot, 2)).otherwise(F.lit(""))
    w = wanted.select("id", "path", c.parent(F.col("path")).alias("up"), stem.alias("stem"), suffix.alias("suffix"))
    t = taken.select(c.parent(F.col("path")).alias("up"), c.base_name(F.col("path")).alias("name")).where(F.col("name").rlike(numbered))
    t = t.select("up", F.regexp_extract("name", numbered, 1).alias("stem"), F.regexp_extract("name", numbered, 2).alias("digits"), F.coalesce(F.regexp_extract("name", numbered, 3), F.lit("")).alias("suffix"))
    t = t.where(~F.col("digits").startswith("0")).select("up", "stem", "suffix", F.col("digits").cast("long").alias("n")).where("n >= 2").distinct()
    # the taken numbers 2, 3, ... without a gap are those whose rank is n - 1; the free one follows them
    run = t.withColumn("rank", F.row_number().over(Window.partitionBy("up", "stem", "suffix").orderBy("n"))).where("n = rank + 1")
    last = run.groupBy("up", "stem", "suffix").agg(F.max("n").alias("last"))
    out = w.join(last, ["up", "stem", "suffix"], "left").withColumn("n", F.coalesce(F.col("last") + 1, F.lit(2)))
    free = F.concat(F.rtrim(F.col("up"), F.lit("/")), F.lit("/"), F.col("stem"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"), F.col("suffix"))
    return out.select("id", "path", "n", free.alias("free"))


def sorted_view(nodes: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """A folder's rows as a window sorts them: folders first, then by name, size (unknown: -1) or date (unknown: 0)."""
    key = {"name": no_case(F.col("name")), "size": F.coalesce("size", F.lit(-1)), "date": F.coalesce("mtime_ns", F.lit(0))}[by]
    return nodes.orderBy(F.col("kind") != "d", key.desc() if descending else key.asc(), no_case(F.col("name")), "name")


def between(rows: DataFrame, order: list[Column], anchor: Column, target: Column) -> DataFrame:
    """The rows from the anchor's to the target's place in an order, both included, whichever comes first; none if one is absent."""
    x = rows.withColumn("_at", F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order))))
    ends = x.where(anchor | target).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.count_if(anchor).alias("_a"), F.count_if(target).alias("_t"))
    return x.crossJoin(F.broadcast(ends)).where("_at BETWEEN _low AND _high AND _a > 0 AND _t > 0").drop("_at", "_low", "_high", "_a", "_t")  # one row of ends


def snapshots_to_drop(days: DataFrame, keep: int) -> DataFrame:
    """Days beyond the newest `keep`: one row a day, so few."""
    newest = days.select("day").distinct().orderBy(F.desc("day")).limit(keep)
    return days.select("day").distinct().join(newest, "day", "left_anti")


def due(last_run: Column, now: Column, hours: int = 20) -> Column:
    """A daily task is due when it never ran or ran so many hours ago."""
    return last_run.isNull() | (now - last_run >= hours * 3600)




def trash_plan(wanted: DataFrame, present: DataFrame, home: str, trash_folder: str) -> DataFrame:
    """(path, outcome) for items of a plain tree to be sent to the trash: if any is refused or missing, none is moved.

    Refused are the tops of disks, the home folder and what holds it, and what is in the trash.
    """
    there = present.select("path", F.lit(True).alias("_there"))
    inside = (F.col("path") == trash_folder) | c.below(F.col("path"), F.lit(trash_folder))
    why = F.coalesce(c.protected_path(F.col("path"), home), F.when(inside, F.lit("it is in the trash already"))).alias("_why")
    x = wanted.select("path").distinct().join(there, "path", "left").select("path", why, F.coalesce("_there", F.lit(False)).alias("_there"))
    gate = x.agg(F.coalesce(F.bool_or(F.col("_why").isNotNull() | ~F.col("_there")), F.lit(False)).alias("_stop"))
    outcome = F.when(F.col("_why").isNotNull(), F.concat(F.lit("refused: "), F.col("_why"))).when(~F.col("_there"), "missing").when(F.col("_stop"), "not moved").otherwise("moved")
    return x.crossJoin(F.broadcast(gate)).select("path", outcome.alias("outcome"))  # one row of gate


def untrash_plan(notes: DataFrame, present: DataFrame) -> DataFrame:
    """(id, target, outcome) for trashed items to be put back: nothing is overwritten, and the folder must still be there."""
    taken = present.select(F.col("path").alias("original"), F.lit(True).alias("_taken"))
    folders = present.where("kind = 'd'").select(F.col("path").alias("_up"), F.lit(True).alias("_home"))
    x = notes.withColumn("_up", c.parent(F.col("original"))).join(taken, "original", "left").join(folders, "_up", "left")
    outcome = F.when(F.col("_taken"), "already exists").when(F.col("_home").isNull() & (F.col("_up") != "/"), "the folder it came from is gone").otherwise("restored")
    return x.select("id", F.col("original").alias("target"), outcome.alias("outcome"))
