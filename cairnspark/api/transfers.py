"""Transfers and jobs: states and controls, plans, commits, imports, rebuilding and recovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.api.changes import free_names
from cairnspark.functions import columns as c

STALE_SECONDS, KEPT_SECONDS, RECENT_SECONDS, LEAST_SPAN, MOST_DROPS = 15, 30 * 86_400, 86_400, 0.5, 3
#: What a stale, cancelled, paused or resumed job says.
INTERRUPTED = "Stopped before it finished (the server may have restarted). Start it again to continue; finished files are kept."
SAID = {
    "cancel": "Stopped. Files archived before it stopped are kept.",
    "pause": "Paused. Press play to continue where it stopped; files already archived are kept.",
    "resume": "Continuing where it stopped", "discard": "Abandoned: what it had retrieved was removed.",
}


def active(state: Column) -> Column:
    return state.isin(*c.ACTIVE)


def unfinished(state: Column) -> Column:
    return active(state) | (state == "paused")


def finished(state: Column) -> Column:
    return state.isin(*c.FINISHED)


def job_list(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs newest first by id. Finished ones older than 30 days are gone; one that should run but is silent and unlocked reads as interrupted.

    jobs: id (string), state, updated (seconds), locked, message.
    """
    age = now - F.col("updated")
    kept = jobs.where(~(finished(F.col("state")) & (age > KEPT_SECONDS)))
    stale = active(F.col("state")) & ~F.col("locked") & (age > STALE_SECONDS)
    out = kept.withColumn("message", F.when(stale, F.lit(INTERRUPTED)).otherwise(F.col("message"))).withColumn("state", F.when(stale, F.lit("interrupted")).otherwise(F.col("state")))
    return out.orderBy(F.desc("id"))


def restartable(jobs: DataFrame) -> DataFrame:
    """Interrupted jobs that this server can start again by itself: not those relayed through another computer."""
    return jobs.where((F.col("state") == "interrupted") & F.col("relay").isNull())


def control(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, op, state, message, outcome) for each request (id, op) to cancel, pause, resume or discard a job.

    A job that runs (locked) sees a request to stop by itself: its state stays and the outcome is `asked`. Resuming is for
    paused and interrupted jobs that do not run, discarding for those that neither run nor are about to.
    """
    s, op, free = F.col("state"), F.col("op"), ~F.col("locked")
    takes = (
        ((op == "cancel") & s.isin("paused", "interrupted", "queued") & free) | ((op == "pause") & s.isin("interrupted", "queued") & free)
        | ((op == "resume") & s.isin("paused", "interrupted") & free) | ((op == "discard") & free & ~active(s))
    )
    after = F.when(op.isin("cancel", "discard"), "cancelled").when(op == "pause", "paused").when(op == "resume", "queued")
    said = F.when((op == "discard") & (F.col("direction") == "send"), F.col("message"))
    for k, text in SAID.items():
        said = said.when(op == k, F.lit(text))
    outcome = F.when(s.isNull(), F.lit("not found")).when(takes, F.lit("done")).when(op.isin("cancel", "pause"), F.lit("asked")).when(op == "resume", F.lit("ignored")).otherwise(F.lit("stop the transfer first"))
    j = requests.join(jobs.select("id", "state", "locked", "direction", "message"), "id", "left")
    return j.select("id", "op", F.when(takes, after).otherwise(s).alias("state"), F.when(takes, said).otherwise(F.col("message")).alias("message"), outcome.alias("outcome"))


def run_outcome(runs: DataFrame) -> DataFrame:
    """(id, state, done_is_total) of jobs whose run has ended.

    runs: id, cancel_asked, pause_asked, stopped (by the user while it ran), bad (some file failed), error (null: none), kind
    of it, relay, link, drops, link_up, gave_up. A pause asked counts unless a stop is asked too. Over a signed-in link a lost
    connection is tried again, thrice at most while the link is up, and waits for a sign-in while it is down.
    """
    lost = c.is_lost(F.col("kind"), F.col("error")) | (F.col("kind") == "signed_out")
    stop = F.col("cancel_asked") | F.col("stopped")
    by_link = lost & F.col("link") & F.col("error").isNotNull()
    state = F.when(F.col("pause_asked") & ~F.col("cancel_asked"), "paused").when(F.col("cancel_asked"), "cancelled")
    state = state.when(by_link & stop, "cancelled").when(by_link & ~F.col("link_up") & ~F.col("gave_up"), "waiting").when(by_link & F.col("link_up") & (F.col("drops") < MOST_DROPS), "running")
    state = state.when(F.col("error").isNotNull() & c.is_lost(F.col("kind"), F.col("error")) & F.col("relay"), "interrupted").when(F.col("error").isNotNull(), "failed")
    state = state.when(F.col("stopped"), "cancelled").when(F.col("bad"), "failed").otherwise("done")
    return runs.select("id", state.alias("state")).withColumn("done_is_total", F.col("state").isin("done", "cancelled") | ((F.col("state") == "failed") & F.lit(True)))


def speed(samples: DataFrame, window: float, key: str = "job_id", at: str = "secs", total: str = "total", order: str = "event_id") -> DataFrame:
    """samples with `rate`, whole bytes a second over about the last `window` seconds of a running total.

    The samples start anew where the total falls (a file is sent again). The base is the newest sample at least `window` old,
    or the first where none is; a span of less than half a second gives 0.
    """
    by = Window.partitionBy(key).orderBy(at, order)
    x = samples.withColumn("_fell", (F.col(total) < F.lag(total).over(by)).cast("int"))
    x = x.withColumn("_run", F.sum(F.coalesce("_fell", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_run").orderBy(at, order)
    # among samples at least `window` old the last in order, by a range of times; several at one time: the last of them
    x = x.withColumn("_place", F.row_number().over(run))
    old = Window.partitionBy(key, "_run").orderBy((F.col(at) * 1000).cast("long")).rangeBetween(Window.unboundedPreceding, -round(window * 1000))
    base = F.max_by(F.struct(F.col(at).alias("t"), F.col(total).alias("d")), F.col("_place")).over(old)
    first = F.first(F.struct(F.col(at).alias("t"), F.col(total).alias("d"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_base", F.coalesce(base, first))
    span = F.col(at) - F.col("_base.t")
    rate = F.when(span < LEAST_SPAN, F.lit(0)).otherwise(F.floor((F.col(total) - F.col("_base.d")) / span)).cast("long")
    return x.withColumn("rate", rate).drop("_fell", "_run", "_place", "_base")


def busy_with(views: DataFrame, request: DataFrame) -> DataFrame:
    """Sources of a request (place, source) that an unfinished transfer of the same place works on, around or inside: (source, id, name)."""
    v = views.where(unfinished(F.col("state"))).select("id", "place", F.explode("sources").alias("busy"))
    r = request.select("place", "source")
    # paths that overlap have one as a prefix of the other: meet on every prefix of the longer
    trimmed = lambda col: F.regexp_replace(col, r"[/\\]+$", "")
    tops = lambda col: F.transform(F.sequence(F.lit(1), F.size(F.split(trimmed(col), r"[/\\]"))), lambda i: F.array_join(F.slice(F.split(trimmed(col), r"[/\\]"), F.lit(1), i), "/"))
    own = lambda col: F.regexp_replace(trimmed(col), r"\\", "/")
    a = v.select("id", "place", "busy", F.explode(tops(F.col("busy"))).alias("at")).join(r.select("place", "source", own(F.col("source")).alias("at")), ["place", "at"])
    b = r.select("place", "source", F.explode(tops(F.col("source"))).alias("at")).join(v.select("id", "place", "busy", own(F.col("busy")).alias("at")), ["place", "at"])
    return a.select("source", "id").union(b.select("source", "id")).distinct().withColumn("name", c.last_name(F.col("source")))


def adopt(views: DataFrame, jobs: DataFrame, dismissed: DataFrame, server: str, now: Column) -> DataFrame:
    """views with a server's jobs: the unfinished, the interrupted and those of the last day, but not the dismissed; known ones are replaced."""
    take = jobs.where(unfinished(F.col("state")) | (F.col("state") == "interrupted") | (F.col("updated") > now - RECENT_SECONDS))
    new = take.withColumn("id", F.concat(F.lit(f"R:{server}:"), F.col("id"))).join(dismissed.select("id"), "id", "left_anti")
    return views.join(new.select("id"), "id", "left_anti").unionByName(new.select(*views.columns))


def changed_views(views: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of a listing that are shown and look different now."""
    shown = views.select("id", F.struct(*[x for x in views.columns if x != "id"]).alias("_old"))
    new = jobs.select("id", F.struct(*[x for x in views.columns if x != "id"]).alias("_new"))
    return new.join(shown, "id").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("id", "_new.*")


def kept_routes(routes: DataFrame, servers: DataFrame) -> DataFrame:
    """Routes both of whose ends are servers that are kept, not temporary ones."""
    kept = servers.where(~F.col("temporary")).select("id")
    return routes.join(kept.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(kept.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def server_names(ids: DataFrame, servers: DataFrame) -> DataFrame:
    """For each list (list_id, ids) the names of the servers it has, sorted; unknown ids are dropped, repeated ones stay."""
    x = ids.select("list_id", F.explode_outer("ids").alias("id")).join(servers.select("id", "name"), "id", "left")
    return x.groupBy("list_id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def abandon_plan(jobs: DataFrame) -> DataFrame:
    """(id, path, action) for each path that abandoned jobs created: sends put them in the trash, copies and retrieves delete only
    what lies directly in their destination; all else is kept.

    jobs: id, direction, dest, created.
    """
    x = jobs.select("id", "direction", "dest", F.explode("created").alias("path"))
    action = F.when(F.col("direction") == "send", "trash").when(c.directly_in(F.col("path"), F.col("dest")), "remove").otherwise("keep")
    return x.select("id", "path", action.alias("action"))


def dock(jobs: DataFrame) -> DataFrame:
    """One row for the status line: counts, bytes done and in all, rate, percent (floor) and seconds left of the jobs that move."""
    a = jobs.agg(
        F.count_if(active(F.col("state"))).alias("moving"), F.count_if(F.col("state") == "paused").alias("paused"), F.count_if(F.col("state") == "failed").alias("failed"),
        *(F.coalesce(F.sum(F.when(active(F.col("state")), F.col(x))), F.lit(0)).alias(x) for x in ("done", "total", "rate")),
    )
    percent = F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total"))).otherwise(F.lit(0)).cast("long")
    return a.withColumn("percent", percent).withColumn("seconds_left", F.when((F.col("rate") > 0) & (F.col("total") >= F.col("done")), (F.col("total") - F.col("done")) / F.col("rate")))


def scrub(packs: DataFrame, checks: DataFrame, due_before: int) -> DataFrame:
    """(pack_id, project, state, outcome, place) for the packs whose turn it is, least recently checked first.

    checks: pack_id, project, sound (a deep check of a sealed pack), verify ('ok', 'repairable', 'unrepairable' or an error),
    repaired (a repair that then passed a deep check). Open packs are passed over; a failed check changes no state.
    """
    turn = packs.where((F.col("state") != "open") & (F.col("checked_at").isNull() | (F.col("checked_at") < due_before)))
    x = turn.join(checks, ["pack_id", "project"], "left")
    sealed, v = F.col("state") == "sealed", F.col("verify")
    state = F.when(sealed, F.when(F.col("sound"), "sealed").otherwise("damaged")).when(v == "ok", "protected").when(v == "repairable", F.when(F.col("repaired"), "protected").otherwise("damaged"))
    state = state.when(v == "unrepairable", "damaged").otherwise(F.col("state"))
    said = F.when(sealed, F.when(F.col("sound"), "ok (no recovery data yet)").otherwise("DAMAGED, no recovery data")).when(v == "ok", "ok")
    said = said.when(v == "repairable", F.when(F.col("repaired"), "damage found and repaired").otherwise("DAMAGED: repair failed")).when(v == "unrepairable", "DAMAGED beyond what recovery data can fix")
    said = said.otherwise(F.concat(F.lit("check failed: "), F.coalesce(v, F.lit("no answer"))))
    return x.select("pack_id", "project", state.alias("state"), said.alias("outcome"), F.coalesce("checked_at", F.lit(0)).alias("last")).orderBy("last", "pack_id", "project")


def protect(packs: DataFrame, made: DataFrame) -> DataFrame:
    """(pack_id, project, state, outcome) for sealed packs whose recovery data was made: only what verifies is protected, all else stays sealed.

    made: pack_id, project, verify ('ok', another verdict, or null), error.
    """
    x = packs.where("state = 'sealed'").join(made, ["pack_id", "project"])
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), F.col("error"))).when(F.col("verify") == "ok", "protected")
    said = said.otherwise(F.concat(F.lit("recovery data did not verify ("), F.col("verify"), F.lit("); will retry")))
    return x.select("pack_id", "project", F.when(said == "protected", "protected").otherwise("sealed").alias("state"), said.alias("outcome"))


def conflicts(source: DataFrame, there: DataFrame, policy: str, this_job: DataFrame) -> DataFrame:
    """(id, path, decision) for files (id, path, sha256) to be placed over nodes (path, kind, sha256) that may be there.

    `identical` where a file with the same content is; else by policy: skip, fail, keep-both, or replace, which only what this
    very transfer stored (this_job: path) allows: folders and frozen files refuse. A parent that is a file refuses all.
    """
    up = source.withColumn("up", c.parent(F.col("path")))
    tops = source.select("path", F.explode(F.expr("transform(sequence(1, greatest(size(filter(split(path, '/'), p -> p <> '')) - 1, 1)), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")).alias("up")).where("up <> path")
    blocked = tops.join(there.where("kind <> 'd'").select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct().withColumn("_blocked", F.lit(True))
    old = there.select("path", F.col("kind").alias("_kind"), F.col("sha256").alias("_sha"))
    x = up.join(old, "path", "left").join(this_job.select("path").distinct().withColumn("_own", F.lit(True)), "path", "left").join(blocked, "path", "left")
    clash = {"skip": F.lit("skip"), "fail": F.lit("already exists"), "keep-both": F.lit("keep both"),
             "replace": F.when(F.col("_kind") == "d", F.lit("is a folder")).when(F.col("_own"), F.lit("replace")).otherwise(F.lit("frozen"))}[policy]
    decision = F.when(F.col("_blocked"), "not a folder").when(F.col("_kind").isNull(), "new").when((F.col("_kind") == "f") & (F.col("_sha") == F.col("sha256")), "identical").otherwise(clash)
    return x.select("id", "path", decision.alias("decision"))


def stored_by_job(files: DataFrame, content_blobs: DataFrame, packs: DataFrame, job: Column) -> DataFrame:
    """Files whose content lies in a pack of this job that is still open: only these may be replaced."""
    mine = packs.where((F.col("state") == "open") & job).select("pack_id", "project")
    held = content_blobs.join(mine, ["pack_id", "project"], "left_semi").select("project", "sha256").distinct()
    return files.join(held, ["project", "sha256"], "left_semi")


def commit(writes: DataFrame, checks: DataFrame) -> DataFrame:
    """(seq, state, why) for what a transfer wrote in order (scope, seq, digest, size), given its read-back checks (scope, seq, digest, size, error).

    The first write of a scope that fails its check is rolled back with all after it, which are sent again.
    """
    x = writes.join(checks.select("scope", "seq", F.col("digest").alias("_digest"), F.col("size").alias("_size"), "error"), ["scope", "seq"], "left")
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_digest").isNull(), F.lit("the read-back check stopped unexpectedly"))
    bad = bad.when(F.col("_digest") != F.col("digest"), F.lit("checksum mismatch after writing")).when(F.col("_size") != F.col("size"), F.lit("size changed while sending"))
    x = x.withColumn("_bad", bad)
    first = x.where("_bad IS NOT NULL").groupBy("scope").agg(F.min("seq").alias("_first"))
    x = x.join(first, "scope", "left")
    state = F.when(F.col("_first").isNull() | (F.col("seq") < F.col("_first")), "committed").otherwise("sent again")
    why = F.when(F.col("seq") == F.col("_first"), F.col("_bad")).when(F.col("seq") > F.col("_first"), F.lit("written after a file whose check failed"))
    return x.select("scope", "seq", state.alias("state"), why.alias("why"))


def check_block(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(block, ok): a solid block's members as sent against the entries read back, place by place; path, size and digest must agree."""
    m = members.select("block", F.posexplode("members").alias("pos", "m"))
    e = entries.select("block", F.posexplode("members").alias("pos", "e"))
    x = m.join(e, ["block", "pos"], "full_outer")
    return x.groupBy("block").agg(F.bool_and(F.coalesce(F.col("m") == F.col("e"), F.lit(False))).alias("ok"))


def manifest_members(entries: DataFrame, members: DataFrame) -> DataFrame:
    """entries (pack_id, project, path, member) with `found`: whether the pack's tar has the member it names; entries without one are found."""
    there = members.select("pack_id", "project", "member").distinct().withColumn("_there", F.lit(True))
    x = entries.join(there, ["pack_id", "project", "member"], "left")
    return x.withColumn("found", F.col("member").isNull() | F.coalesce("_there", F.lit(False))).drop("_there")


def reconcile(expected: DataFrame, members: DataFrame) -> DataFrame:
    """(part, path, problem) for every file of a part's manifest that is missing or listed twice, and every member that is not in it or doubled."""
    e = expected.groupBy("part", "path").agg(F.count(F.lit(1)).alias("listed"))
    m = members.groupBy("part", "path").agg(F.count(F.lit(1)).alias("held"))
    x = e.join(m, ["part", "path"], "full_outer")
    problem = F.when(F.col("listed") > 1, "listed twice").when(F.col("listed").isNull(), "unexpected member").when(F.col("held").isNull(), "missing").when(F.col("held") > 1, "unexpected member")
    return x.select("part", "path", problem.alias("problem")).where("problem IS NOT NULL")


def import_plan(parts: DataFrame, receipts: DataFrame, expected: DataFrame, members: DataFrame, sums: DataFrame) -> DataFrame:
    """(part, state, why) in order of part: imported before (a receipt), refused (a problem), or to be imported.

    sums: part, want (recorded checksum), got. Running it again after the receipts are written imports nothing twice.
    """
    bad = reconcile(expected, members).groupBy("part").agg(F.min(F.struct("path", "problem")).alias("_p"))
    unsafe = expected.where(~c.safe_relative(F.col("path"))).groupBy("part").agg(F.min("path").alias("_unsafe"))
    x = parts.select("part").distinct().join(receipts.select("part").distinct().withColumn("_done", F.lit(True)), "part", "left").join(sums, "part", "left").join(bad, "part", "left").join(unsafe, "part", "left")
    why = F.when(F.col("want").isNull() | F.col("got").isNull(), "no checksum").when(F.col("want") != F.col("got"), "doesn't match its checksum")
    why = why.when(F.col("_unsafe").isNotNull(), F.concat(F.lit("unsafe path: "), F.col("_unsafe"))).when(F.col("_p").isNotNull(), F.concat(F.col("_p.path"), F.lit(": "), F.col("_p.problem")))
    state = F.when(F.col("_done"), "imported before").when(why.isNotNull(), "refused").otherwise("import")
    return x.select("part", state.alias("state"), F.when(state == "refused", why).alias("why")).orderBy("part")


def import_receipts(plan: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """One receipt for each part that was imported: files, bytes, and what became of them (outcome of each file: stored, deduplicated or identical)."""
    f = files.groupBy("part").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), *(F.count_if(F.col("outcome") == k).alias(k) for k in ("stored", "deduplicated", "identical"))
    )
    ok = plan.where("state = 'import'").select("part").join(f, "part").where("stored + deduplicated + identical = files")
    return ok.withColumn("imported_at", F.lit(now).cast("long"))


def rebuild(entries: DataFrame, members: DataFrame, packs: DataFrame) -> dict[str, DataFrame]:
    """A catalog made anew from the packs' manifests: `files`, `folders`, `contents`, `projects`, `missing` and `skipped`.

    packs: pack_id, project, project_path, readable, has_manifest. entries: pack_id, entry, project, path, kind, sha256, size,
    mtime_ns, member. Packs are replayed in order of their id: the last entry of a path stays, a project lies where its newest
    pack says. A content is its first entry with a member; a file without one whose content no earlier entry stored is missing.
    """
    good = packs.where("readable AND has_manifest")
    skipped = packs.where("NOT (readable AND has_manifest)").select("pack_id", "project", F.when(~F.col("readable"), "unreadable").otherwise("no manifest (the pack was never sealed)").alias("why"))
    e = entries.join(good.select("pack_id", "project"), ["pack_id", "project"], "left_semi")
    e = manifest_members(e, members)
    at = F.struct("pack_id", "entry")
    firsts = e.where("kind = 'f' AND member IS NOT NULL AND found").groupBy("project", "sha256").agg(F.min(at).alias("_first"), F.min_by("member", at).alias("member"), F.min_by("size", at).alias("size"))
    f = e.where("kind = 'f' AND sha256 IS NOT NULL").join(firsts.select("project", "sha256", "_first"), ["project", "sha256"], "left")
    kept = f.where(F.col("_first").isNotNull() & (F.col("_first") <= at))
    missing = f.where(~(F.col("_first").isNotNull() & (F.col("_first") <= at))).select("path", "pack_id", "project")
    last = kept.groupBy("path").agg(F.max_by(F.struct("project", "sha256", "size", "mtime_ns", "pack_id"), at).alias("l")).select("path", "l.*")
    folders = e.where("kind = 'd'").select(F.explode(F.expr("transform(sequence(1, size(filter(split(path, '/'), p -> p <> ''))), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")).alias("path"))
    above = last.select(c.parent(F.col("path")).alias("path")).distinct().select(F.explode(F.expr("transform(sequence(1, greatest(size(filter(split(path, '/'), p -> p <> '')), 1)), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")).alias("path"))
    placed = good.groupBy("project").agg(F.max_by("project_path", "pack_id").alias("path"))
    return {
        "files": last, "folders": folders.union(above).where("path <> '/'").distinct(), "contents": firsts.select("project", "sha256", "member", "size", F.col("_first.pack_id").alias("pack_id")),
        "projects": placed, "missing": missing, "skipped": skipped,
    }


def recovery(entries: DataFrame) -> DataFrame:
    """(path, pack_id, how) as the packs' own notes give files back without a catalog: packs in order, later ones over earlier.

    Within a pack members come out first (`unpacked`), then copies of files that are there by then (`copied`); a copy of a file
    that is in no pack up to then is `not there`. entries: pack_id, entry, path, member, same_as.
    """
    own = entries.where("member IS NOT NULL").select("path", "pack_id", F.lit(0).alias("step"))
    need = entries.where("member IS NULL AND same_as IS NOT NULL").select("path", "pack_id", F.col("same_as").alias("_from"), "entry")
    first = own.groupBy(F.col("path").alias("_from")).agg(F.min("pack_id").alias("_since"))
    copies = need.join(first, "_from", "left").withColumn("ok", F.coalesce(F.col("_since") <= F.col("pack_id"), F.lit(False)))
    every = own.withColumn("ok", F.lit(True)).union(copies.select("path", "pack_id", F.lit(1).alias("step"), "ok"))
    done = every.where("ok").groupBy("path").agg(F.max(F.struct("pack_id", "step")).alias("l")).select("path", "l.pack_id", F.when(F.col("l.step") == 0, "unpacked").otherwise("copied").alias("how"))
    lost = every.where("NOT ok").join(done.select("path"), "path", "left_anti").groupBy("path").agg(F.max("pack_id").alias("pack_id")).withColumn("how", F.lit("not there"))
    return done.unionByName(lost)


def resend(failed: DataFrame, plan: DataFrame) -> DataFrame:
    """Plan items whose destination failed its check, with the reason, to be sent again; the first reason of a path counts."""
    why = failed.groupBy("path").agg(F.min_by("reason", "seq").alias("reason"))
    return plan.join(why, "path")


def links_by_project(links: DataFrame) -> DataFrame:
    """Links of a batch by project, since each project has its own catalog rows: how many, and the first in order."""
    return links.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def timing(puts: DataFrame) -> DataFrame:
    """One row: files, bytes and seconds of each step of a transfer's puts (files, bytes, receive, check, wait, commit)."""
    return puts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("files", "bytes", "receive", "check", "wait", "commit")))


def timing_line(t: DataFrame) -> DataFrame:
    """The log line of a roll-up."""
    parts = [F.format_string("%s %.1f s", F.lit(x), F.col(x).cast("double")) for x in ("receive", "check", "wait", "commit")]
    return t.select(F.concat_ws(", ", F.concat(F.col("files").cast("string"), F.lit(" files")), c.human_bytes(F.col("bytes")), *parts).alias("line"))


def partial_files(files: DataFrame, suffix: str = ".partial") -> DataFrame:
    """Per top folder, how many files an interrupted run left half written."""
    return files.where(F.col("path").endswith(suffix)).groupBy(F.try_element_at(c.parts(F.col("path")), F.lit(1)).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def frame_plan(files: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, first_frame, last_frame, skip, sent, shortcut): the frames of a stream that hold a file's bytes.

    files: id, blob, off, size. frames: blob, frame, c_off, c_len, d_off, d_len. `shortcut`: the frames hold more than twice the
    file's bytes and 64 KiB, so the file is cheaper to compress anew than to send as it lies. An empty file needs no frame.
    """
    end = F.col("off") + F.col("size")
    x = files.where("size > 0").join(frames, "blob").where((F.col("d_off") < end) & (F.col("d_off") + F.col("d_len") > F.col("off")))
    p = x.groupBy("id", "off", "size").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), (F.col("off") - F.min("d_off")).alias("skip"), F.sum("c_len").alias("sent"))
    return p.select("id", "first_frame", "last_frame", "skip", "sent", (F.col("sent") > 2 * F.col("size") + 65_536).alias("shortcut"))


def same_file(a: str, b: str) -> Column:
    """Whether two structs tell of one unchanged file: size, times, device and inode, an unknown value equal to an unknown one."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ("size", "mtime_ns", "ctime_ns", "dev", "ino")))


def copy_plan(items: DataFrame, there: DataFrame, policy: str, move: bool = False) -> DataFrame:
    """(rel, target, action) for a plain copy of items (rel, kind, size, mtime_ns, sha256) into a folder that holds `there` (same columns).

    Junk is left out, links are passed over, folders are merged. A file of the same size and time is there already; a move
    also compares contents. Another file of the name is skipped or replaced; with keep-both a chosen item whose name is taken
    goes beside it under the next free name, so nothing in it meets anything.
    """
    kept = items.where(~F.exists(F.split("rel", "/"), lambda p: c.excluded(p))).withColumn("_top", F.substring_index("rel", "/", 1))
    if policy == "keep-both":
        tops = kept.select("_top").distinct().join(there.select(F.col("rel").alias("_top")), "_top", "left_semi")
        new = free_names(tops.select(F.col("_top").alias("id"), F.concat(F.lit("/"), "_top").alias("path")), there.where("NOT contains(rel, '/')").select(F.concat(F.lit("/"), "rel").alias("path")))
        kept = kept.join(new.select(F.col("id").alias("_top"), F.substring("free", 2, 100_000).alias("_new")), "_top", "left")
    else:
        kept = kept.withColumn("_new", F.lit(None).cast("string"))
    moved = F.concat(F.coalesce("_new", "_top"), F.substring("rel", F.length("_top") + 1, F.length("rel")))
    x = kept.withColumn("target", moved)
    old = there.select(F.col("rel").alias("target"), F.struct("kind", "size", "mtime_ns", "sha256").alias("_old"))
    x = x.join(old, "target", "left")
    same = (F.col("_old.kind") == "f") & (F.col("_old.size") == F.col("size")) & (F.col("_old.mtime_ns") == F.col("mtime_ns"))
    if move:
        same = same & (F.col("_old.sha256") == F.col("sha256"))
    clash = {"skip": "a different file is already there", "replace": "replace", "keep-both": "keep both"}[policy]
    action = F.when(F.col("kind") == "l", "shortcut (symbolic link)").when(F.col("kind") == "d", F.when(F.col("_old").isNull(), "new folder").otherwise("merge"))
    action = action.when(F.col("_old").isNull(), "copy").when(same, "already there").otherwise(F.lit(clash))
    return x.select("rel", "target", action.alias("action"))


def emptied_folders(left: DataFrame) -> DataFrame:
    """Folders of what is left (path, kind) after a move that hold nothing but junk files and folders of that kind, deepest first."""
    keeps = left.where((F.col("kind") != "d") & ~((F.col("kind") == "f") & c.excluded(c.base_name(F.col("path")))))
    held = keeps.select(F.explode(F.expr("transform(sequence(1, greatest(size(filter(split(path, '/'), p -> p <> '')) - 1, 1)), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")).alias("path")).distinct()
    return left.where("kind = 'd'").select("path").join(held, "path", "left_anti").orderBy(F.desc(F.size(c.parts(F.col("path")))), "path")


def idle_packs(packs: DataFrame, now: int, older_than: int) -> DataFrame:
    """Open packs that nobody writes to (locked) and that were not touched for so many seconds; one whose time is unknown counts as idle."""
    idle = F.col("touched").isNull() | (F.lit(now) - F.col("touched") >= older_than)
    return packs.where((F.col("state") == "open") & ~F.col("locked") & idle)


def leaving(views: DataFrame) -> DataFrame:
    """(kind, name, n): what closing the window would stop: own transfers that move, how many are paused, and each server's."""
    own = F.col("id").startswith("L")
    moving = views.where(own & active(F.col("state"))).select(F.lit("transfer").alias("kind"), F.col("title").alias("name"), F.lit(1).cast("bigint").alias("n"))
    paused = views.where(own & (F.col("state") == "paused")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("paused").alias("kind"), F.lit("").alias("name"), "n")
    servers = views.where(~own & active(F.col("state")) & F.col("server").isNotNull()).groupBy("server").agg(F.count(F.lit(1)).alias("n")).select(F.lit("server").alias("kind"), F.col("server").alias("name"), "n")
    return moving.union(paused).union(servers)


def worker_report(packs: DataFrame, protected: DataFrame, scrubbed: DataFrame) -> DataFrame:
    """One row after a maintenance cycle: packs by state as protecting and checking left them, and the names of the damaged."""
    keys = ["pack_id", "project"]
    new = protected.select(*keys, F.col("state").alias("_p")).join(scrubbed.select(*keys, F.col("state").alias("_s")), keys, "full_outer")
    x = packs.join(new, keys, "left").withColumn("state", F.coalesce("_s", "_p", "state"))
    name = F.format_string("%s/pack-%08d", "project", "pack_id")
    return x.agg(
        F.count(F.lit(1)).alias("packs_total"), F.count_if(F.col("state") == "protected").alias("packs_protected"), F.count_if(F.col("state").isin("open", "sealed")).alias("packs_pending"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("state") == "damaged", name))), ",").alias("packs_damaged"),
    )
