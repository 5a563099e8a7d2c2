"""Folder trees, placement and ordering of documents, scopes and transfers.

folders: id, parent_id, name, depth, sort_order. placed: document_id, folder_id, sort_order. Trees are at most
MAX_DEPTH + 1 levels deep, so that ancestors come from as many joins, whatever the number of folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MAX_DEPTH = 4
#: Distance between neighbours' places.
STEP = 1000


class InvalidName(ValueError):
    """A name is blank or too long."""


def checked_name(name: str, limit: int = 80) -> str:
    name = name.strip()
    if not name or len(name) > limit:
        raise InvalidName(name)
    return name


def lineage(folders: DataFrame) -> DataFrame:
    """id, ancestor, level, path: every folder with itself and the folders above it (level: how far below)."""
    f = folders.select("id", "parent_id", "name")
    now = f.select("id", F.col("id").alias("ancestor"), F.col("parent_id").alias("up"), F.lit(0).cast("long").alias("level"), F.col("name").alias("path"))
    out = now
    up = f.select(F.col("id").alias("a"), F.col("parent_id").alias("next"), F.col("name").alias("label"))
    for _ in range(MAX_DEPTH):
        now = now.join(up, now["up"] == up["a"]).select("id", F.col("a").alias("ancestor"), F.col("next").alias("up"), (F.col("level") + 1).alias("level"), F.concat("label", F.lit(" / "), "path").alias("path"))
        out = out.unionByName(now)
    return out


def subtree(folders: DataFrame, root: int) -> DataFrame:
    return lineage(folders).where(F.col("ancestor") == root).select("id", "level")


def paths(folders: DataFrame) -> DataFrame:
    """id, path: names from the top."""
    return lineage(folders).where("up IS NULL").select("id", "path")


def heights(folders: DataFrame) -> DataFrame:
    """id, height (levels below), deepest (depth of the deepest folder below)."""
    own = folders.select(F.col("id").alias("f"), "depth")
    rows = lineage(folders).join(own, F.col("id") == F.col("f"))
    return rows.groupBy(F.col("ancestor").alias("id")).agg(F.max("level").alias("height"), F.max("depth").alias("deepest"))


def counts(folders: DataFrame, placed: DataFrame) -> DataFrame:
    """id, documents and folders below, at any depth."""
    per = placed.groupBy("folder_id").agg(F.count("*").alias("n"))
    rows = lineage(folders).join(per, F.col("id") == F.col("folder_id"), "left")
    return rows.groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("documents"), (F.count("*") - 1).alias("folders"))


def documents_below(folders: DataFrame, placed: DataFrame, root: int) -> DataFrame:
    below = subtree(folders, root).select(F.col("id").alias("folder_id"))
    return placed.join(below, "folder_id", "left_semi").select("document_id", "folder_id", "sort_order")


def checked_moves(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: id, target (null: the top). verdict: ok, missing, no-target, into-itself, too-deep."""
    own = folders.select(F.col("id").alias("f"))
    to = folders.select(F.col("id").alias("t"), F.col("depth").alias("t_depth"))
    tall = heights(folders).select(F.col("id").alias("h"), "height")
    inside = lineage(folders).select(F.col("ancestor").alias("x"), F.col("id").alias("y"))
    rows = moves.join(own, moves["id"] == F.col("f"), "left").join(to, F.col("target") == F.col("t"), "left").join(tall, moves["id"] == F.col("h"), "left")
    rows = rows.join(inside, (moves["id"] == F.col("x")) & (F.col("target") == F.col("y")), "left")
    verdict = (
        F.when(F.col("f").isNull(), "missing").when(F.col("target").isNotNull() & F.col("t").isNull(), "no-target").when(F.col("y").isNotNull(), "into-itself")
        .when(F.coalesce(F.col("t_depth") + 1, F.lit(0)) + F.col("height") > MAX_DEPTH, "too-deep").otherwise("ok")
    )
    return rows.select(moves["id"], "target", verdict.alias("verdict"))


def moved(folders: DataFrame, id_: int, target: int | None) -> DataFrame:
    """folders after a checked move: the subtree's depths follow, and the folder goes behind its new siblings."""
    below = subtree(folders, id_).select(F.col("id").alias("b"))
    at = folders.where(F.col("id") == target).select("depth").first() if target is not None else None
    own = folders.where(F.col("id") == id_).select("depth").first()
    shift = (at[0] + 1 if at else 0) - own[0]
    same = F.col("parent_id") == target if target is not None else F.col("parent_id").isNull()
    last = folders.where(same).agg(F.max("sort_order")).first()[0]
    me = F.col("id") == id_
    return folders.join(below, F.col("id") == F.col("b"), "left").select(
        "id", F.when(me, F.lit(target).cast("long")).otherwise(F.col("parent_id")).alias("parent_id"), "name",
        (F.col("depth") + F.when(F.col("b").isNotNull(), shift).otherwise(0)).cast("long").alias("depth"),
        F.when(me, F.lit((last if last is not None else -STEP) + STEP)).otherwise(F.col("sort_order")).cast("long").alias("sort_order"),
    )


def with_folder(folders: DataFrame, id_: int, parent: int | None, name: str) -> DataFrame:
    """folders with a new one: its name differs from its siblings', and it's not too deep."""
    name = checked_name(name)
    same = F.col("parent_id") == parent if parent is not None else F.col("parent_id").isNull()
    if folders.where(same & (F.lower("name") == name.lower())).limit(1).count():
        raise InvalidName(name)
    above = folders.where(F.col("id") == parent).select("depth").first() if parent is not None else None
    depth = above[0] + 1 if above else 0
    if (parent is not None and above is None) or depth > MAX_DEPTH:
        raise ValueError("no such folder, or too deep")
    last = folders.where(same).agg(F.max("sort_order")).first()[0]
    row = folders.sparkSession.createDataFrame([(id_, parent, name, depth, (last if last is not None else -STEP) + STEP)], "id long, parent_id long, name string, depth long, sort_order long")
    return folders.unionByName(row)


def renamed(folders: DataFrame, id_: int, name: str) -> DataFrame:
    return folders.withColumn("name", F.when(F.col("id") == id_, F.lit(checked_name(name))).otherwise(F.col("name")))


def without_empty(folders: DataFrame, placed: DataFrame, root: int) -> DataFrame:
    """folders without a subtree, which must hold no documents."""
    below = subtree(folders, root).select(F.col("id").alias("b"))
    if placed.join(below, F.col("folder_id") == F.col("b"), "left_semi").limit(1).count():
        raise ValueError("the folder isn't empty")
    return folders.join(below, F.col("id") == F.col("b"), "left_anti")


def moved_documents(placed: DataFrame, ids: DataFrame, folder: int | None) -> DataFrame:
    """placed after documents (document_id, place) went behind what's in a folder, in the order of place."""
    there = F.col("folder_id") == folder if folder is not None else F.col("folder_id").isNull()
    last = placed.where(there).agg(F.max("sort_order")).first()[0]
    w = W.partitionBy(F.lit(1)).orderBy("place")  # the user's selection, bounded
    new = ids.select("document_id", (F.row_number().over(w) * STEP + F.lit(last if last is not None else -STEP)).cast("long").alias("to"))
    rows = placed.join(new, "document_id", "left")
    return rows.select("document_id", F.when(F.col("to").isNotNull(), F.lit(folder).cast("long")).otherwise(F.col("folder_id")).alias("folder_id"), F.coalesce("to", "sort_order").alias("sort_order"))


def complete_orders(siblings: DataFrame, wanted: DataFrame) -> DataFrame:
    """parent_id, complete: whether the wanted ids are exactly those that are there."""
    a = siblings.select(F.col("id").alias("a"), F.col("parent_id").alias("pa"))
    b = wanted.select(F.col("id").alias("b"), F.col("parent_id").alias("pb"))
    rows = a.join(b, (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb")), "full")
    return rows.groupBy(F.coalesce("pa", "pb").alias("parent_id")).agg((~F.bool_or(F.col("a").isNull() | F.col("b").isNull())).alias("complete"))


def renumbered(siblings: DataFrame, parent: str, *order: str) -> DataFrame:
    """id, parent, sort_order in steps, in a new order."""
    w = W.partitionBy(parent).orderBy(*order)
    return siblings.select("id", parent, ((F.row_number().over(w) - 1) * STEP).cast("long").alias("sort_order"))


def next_orders(folders: DataFrame, placed: DataFrame) -> DataFrame:
    """parent_id, next_order: behind folders and documents."""
    rows = folders.select("parent_id", "sort_order").unionByName(placed.select(F.col("folder_id").alias("parent_id"), "sort_order"))
    return rows.groupBy("parent_id").agg((F.max("sort_order") + STEP).cast("long").alias("next_order"))


def grouped(rows: DataFrame) -> DataFrame:
    """rows: page_id, url, author. Groups by author, Uncategorized last, pages by url."""
    per = rows.groupBy("author").agg(F.count("*").alias("documents"), F.array_sort(F.collect_list(F.struct("url", "page_id"))).alias("own"))
    out = per.select("author", "documents", F.array_join(F.transform("own", lambda x: x["page_id"].cast("string")), ",").alias("pages"))
    return out.orderBy(F.col("author") == "Uncategorized", "author")


def transfer_closure(folders: DataFrame, placed: DataFrame, selected: DataFrame, needed: DataFrame) -> DataFrame:
    """kind, id: selected and needed documents, and all folders above where they are."""
    docs = selected.unionByName(needed).distinct().join(placed, "document_id")
    above = lineage(folders).join(docs.select(F.col("folder_id").alias("f")).distinct(), F.col("id") == F.col("f"), "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return docs.select(F.lit("document").alias("kind"), F.col("document_id").alias("id")).unionByName(above.select(F.lit("folder").alias("kind"), "id"))


def merged_folders(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """their_id, our_id (null: to be made): folders of a package matched with ours by parent and name, level by level."""
    low = F.lower("name")
    mine = ours.select(F.col("id").alias("our_id"), F.col("parent_id").alias("our_parent"), low.alias("our_name"))
    done = None
    for depth in range(MAX_DEPTH + 1):
        level = theirs.where(F.col("depth") == depth).select(F.col("id").alias("their_id"), "parent_id", low.alias("name"))
        if done is None:
            level = level.withColumn("at", F.lit(None).cast("long")).withColumn("known", F.lit(True))
        else:
            up = done.select(F.col("their_id").alias("p"), F.col("our_id").alias("at"))
            level = level.join(up, F.col("parent_id") == F.col("p")).withColumn("known", F.col("at").isNotNull())
        found = level.join(mine, F.col("known") & F.col("at").eqNullSafe(F.col("our_parent")) & (F.col("name") == F.col("our_name")), "left").select("their_id", "our_id")
        done = found if done is None else done.unionByName(found)
    return done


def matching(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """The catalogue's text filter: any of the columns contains the needle, in any case."""
    hit: Column | None = None
    for c in columns:
        own = F.lower(c).contains(needle.lower())
        hit = own if hit is None else hit | own
    return rows.where(hit) if needle.strip() else rows


def scoped(rows: DataFrame, include: DataFrame | None, exclude: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """include None: no limit; an empty one: nothing."""
    if include is not None:
        rows = rows.join(include.select(key), key, "left_semi")
    return rows if exclude is None else rows.join(exclude.select(key), key, "left_anti")


def imported_folders(paths: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """path, name, parent, depth of the folders that an import of files (folder: a relative path) makes below a fresh root.

    The root's name gets ` (n)` if the top level has it already; folders deeper than MAX_DEPTH are refused, all together.
    """
    taken = {r.name.lower() for r in folders.where("parent_id IS NULL").select("name").collect()}  # the user's top level
    name, n = checked_name(root), 1
    while name.lower() in taken:
        n += 1
        name = f"{checked_name(root)} ({n})"
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    deep = paths.where(F.size(parts) > MAX_DEPTH).limit(1).count()
    if deep:
        raise ValueError("folders too deep")
    each = paths.select(F.explode_outer(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.slice(parts, 1, i))).alias("p")).distinct()
    top = F.concat(F.array(F.lit(name)), F.col("p"))
    return each.select(
        F.array_join(top, "/").alias("path"), F.element_at(top, -1).alias("name"),
        F.when(F.size("p") > 0, F.array_join(F.slice(top, 1, F.size("p")), "/")).alias("parent"), F.size("p").cast("long").alias("depth"),
    )


def folder_names(url: Column) -> Column:
    """The decoded folders of a url's path."""
    parts = F.filter(F.split(F.regexp_replace(url, r"^[a-z]+://[^/]*|[?#].*$", ""), "/"), lambda p: p != "")
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.coalesce(F.try_url_decode(p), p))


def selection(current: Column, shown: Column, chosen: bool) -> Column:
    """A bulk selection: all that's shown is added or taken away; what's hidden stays as it was."""
    return F.array_union(current, shown) if chosen else F.array_except(current, shown)
