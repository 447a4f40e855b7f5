"""Queries on the tree of files: listing, sizes, totals, tags, filters, and changes of subtrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.paths import base_name, depth, has_prefix, within
from terrane.tables import latest

FILE_COLUMNS = ("size", "mtime_ns", "parent_id", "scan_root", "name", "path", "kind", "link_target", "content_head", "content_hash", "mime", "symbols_text", "tags_text", "search_text")


def current_files(files: DataFrame, columns: Sequence[str] = FILE_COLUMNS) -> DataFrame:
    """The latest state of each file: of the rows with one id the one with the greatest ``indexed_at_ns``.

    Name only the columns that are needed: the others are neither read nor shuffled. Rows without an id are left out.
    """
    return latest(files.filter("id IS NOT NULL"), ["id"], "indexed_at_ns", columns)


def ls(files: DataFrame, path: str) -> DataFrame:
    """Children of a folder, by kind and name; none for a path that isn't known."""
    folder = files.filter(F.col("path") == path).select(F.col("id").alias("parent_id")).distinct()
    return files.join(folder, "parent_id", "left_semi").select("name", "path", "kind", "size", "mtime_ns").orderBy("kind", "name", "path")


def big(files: DataFrame, more_than: int) -> DataFrame:
    """Files of more than so many bytes, the largest first."""
    if more_than < 0:
        raise ValueError("a size can't be negative")
    return files.filter((F.col("kind") == "file") & (F.col("size") > more_than)).select("path", "size", "mime").orderBy(F.desc("size"), "path")


def _total(files: DataFrame, *keys: str) -> DataFrame:
    size = F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)), F.lit(0))
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), size.cast("long").alias("bytes"))


def du(files: DataFrame, path: str) -> DataFrame:
    """Number of entries of a subtree, its root among them, and the bytes of its files, by the beginning of the path."""
    return _total(files.filter(within(F.col("path"), path)))


def du_recursive(files: DataFrame, path: str, levels: int = 100) -> DataFrame:
    """The same by following ``parent_id`` down, for trees whose paths can't be trusted."""
    spark = files.sparkSession
    files.select("id", "parent_id", "path", "kind", "size").createOrReplaceTempView("_du_files")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(levels, int(spark.conf.get("spark.sql.cteRecursionLevelLimit", "100")))))
    return spark.sql(
        """
        WITH RECURSIVE subtree(id, kind, size) AS (
          SELECT id, kind, size FROM _du_files WHERE path = :path
          UNION ALL
          SELECT f.id, f.kind, f.size FROM _du_files f JOIN subtree s ON f.parent_id = s.id)
        SELECT count(*) AS entries, CAST(coalesce(sum(CASE WHEN kind = 'file' THEN size ELSE 0 END), 0) AS BIGINT) AS bytes FROM subtree
        """,
        args={"path": path},
    )


def du_all(files: DataFrame) -> DataFrame:
    """``path, entries, bytes`` of every folder at once.

    Each entry counts for its own path and for every folder above; the counts are added up before the shuffle.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.select("kind", "size", F.explode(F.filter(above, lambda p: p != "")).alias("path"))
    totals = _total(rows, "path")
    return totals.join(files.filter("kind = 'dir'").select("path").distinct(), "path", "left_semi")


def containing(files: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """The largest files whose name or content holds a text, letter case aside."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return files.filter(F.col("name").ilike(pattern) | F.col("content_head").ilike(pattern)).select("path", "kind", "size").orderBy(F.desc("size"), "path").limit(limit)


def by_extension(files: DataFrame, ending: str, limit: int = 50) -> DataFrame:
    """Files whose name ends in a dot and ``ending``."""
    return files.filter((F.col("kind") == "file") & F.col("name").endswith(f".{ending}")).select("path", "size").orderBy("path").limit(limit)


def tags(files: DataFrame) -> DataFrame:
    """``file_id, tag``, each pair once, from the words of ``tags_text``."""
    words = F.filter(F.split(F.coalesce("tags_text", F.lit("")), r"\s+"), lambda t: t != "")
    return files.select(F.col("id").alias("file_id"), F.explode(F.array_distinct(words)).alias("tag"))


def tags_text(file_tags: DataFrame) -> DataFrame:
    """``file_id, tags_text``: the tags of each file in ascending order, separated by spaces."""
    return file_tags.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), " ").alias("tags_text"))


def by_tag(files: DataFrame, file_tags: DataFrame, tag: str) -> DataFrame:
    """Files with a tag, the largest first."""
    chosen = file_tags.filter(F.col("tag") == tag).select(F.col("file_id").alias("id")).distinct()
    return files.join(chosen, "id", "left_semi").select("path", "kind", "size").orderBy(F.desc("size"), "path")


def with_all_tags(files: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Files whose ``tags_text`` holds every tag as a word."""
    return files.filter(metadata_filter(wanted_tags=wanted))


def metadata_filter(kinds: Sequence[str] = (), wanted_tags: Sequence[str] = (), prefix: str = "", min_size: int = 0, max_size: int = 0) -> Column:
    """Condition of a search request; 0 leaves a size unbounded on that side. Bounds are inclusive."""
    condition = F.lit(True)
    if prefix:
        condition = condition & has_prefix(F.col("path"), prefix)
    if min_size > 0:
        condition = condition & (F.col("size") >= min_size)
    if max_size > 0:
        condition = condition & (F.col("size") <= max_size)
    if kinds:
        condition = condition & F.col("kind").isin(*kinds)
    words = F.split(F.trim(F.coalesce("tags_text", F.lit(""))), r"\s+")
    for tag in wanted_tags:
        condition = condition & F.array_contains(words, tag)
    return condition


def scan_order(entries: DataFrame) -> DataFrame:
    """Parents before children: by depth, then path."""
    return entries.orderBy(depth(F.col("path")), "path")


def stale(files: DataFrame, root: str, seen: DataFrame) -> DataFrame:
    """Known entries of a subtree that a scan didn't see."""
    return files.filter(within(F.col("path"), root)).join(seen.select("path").distinct(), "path", "left_anti")


def reusable(found: DataFrame, known: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Entries of a scan whose stored text and vectors still hold: ``path`` and the id they have.

    The kind and modification time are the same, for files the size too, and the vectors are of the current model.
    Links are always read again.
    """
    models = embeddings.groupBy(F.col("file_id").alias("id")).agg(F.max("model").alias("model"))
    old = known.join(models, "id", "left").select("path", F.col("id").alias("known_id"), F.col("kind").alias("old_kind"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.coalesce("model", F.lit("")).alias("old_model"))
    same = (
        (F.col("kind") == F.col("old_kind"))
        & (F.col("kind") != "symlink")
        & ((F.col("kind") == "dir") | (F.col("size") == F.col("old_size")))
        & (F.col("mtime_ns") == F.col("old_mtime"))
        & (F.col("old_model") == model)
    )
    return found.join(old, "path").filter(same).select("path", "known_id")


def with_ids(known: DataFrame, changed: DataFrame, key: str = "path", id: str = "id") -> DataFrame:
    """``changed`` with ids: an existing key keeps its id, a new one gets the next; new ids follow the order of the keys."""
    from terrane.operators.numbering import numbered

    joined = changed.join(known.select(key, id), key, "left")
    last = known.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    fresh = numbered(joined.filter(F.col(id).isNull()).drop(id), [key], id, last + 1)
    return joined.filter(F.col(id).isNotNull()).unionByName(fresh)


def upsert(known: DataFrame, changed: DataFrame, deleted: DataFrame | None = None, key: str = "path", id: str = "id") -> DataFrame:
    """``known`` with the rows of ``changed`` put in by key: an existing key keeps its id, a new one gets the next.

    ``changed`` has the columns of ``known`` but the id. ``deleted`` (its key column) takes rows out; a key that is both
    changed and deleted stays. New ids follow the order of the keys.
    """
    rest = known.join(changed.select(key), key, "left_anti")
    if deleted is not None:
        rest = rest.join(deleted.select(key), key, "left_anti")
    return rest.unionByName(with_ids(known, changed, key, id).select(*known.columns))


def rename_subtree(files: DataFrame, old: str, new: str) -> DataFrame:
    """``files`` with a subtree moved: paths, scan roots and the name of its root follow."""
    inside = within(F.col("path"), old)
    moved = F.concat(F.lit(new), F.substring("path", F.lit(len(old) + 1), F.char_length("path")))
    out = files.withColumn("_in", inside).withColumn("_path", F.when(inside, moved).otherwise(F.col("path")))
    if "scan_root" in files.columns:
        root = F.concat(F.lit(new), F.substring("scan_root", F.lit(len(old) + 1), F.char_length("scan_root")))
        out = out.withColumn("scan_root", F.when(within(F.col("scan_root"), old), root).otherwise(F.col("scan_root")))
    if "name" in files.columns:
        out = out.withColumn("name", F.when(F.col("path") == old, base_name(F.lit(new))).otherwise(F.col("name")))
    return out.withColumn("path", F.col("_path")).select(*files.columns)


def remove_subtree(files: DataFrame, path: str, children: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """What is left of ``files`` and of tables that point to it, given as name -> (table, its column of file ids)."""
    left = files.filter(~within(F.col("path"), path))
    out = {"files": left}
    for name, (table, column) in (children or {}).items():
        gone = files.filter(within(F.col("path"), path)).select(F.col("id").alias(column))
        out[name] = table.join(gone, column, "left_anti")
    return out


def check(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, occurrences: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row of integrity counts: rows, and rows that point to what isn't there."""
    ids = files.select(F.col("id").alias("_id")).distinct()

    def orphans(table: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
        return table.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_id"), "left_anti").agg(F.count(F.lit(1)).alias(name))

    chunk_ids = chunks.select(F.col("id").alias("_id")).distinct()
    concept_ids = concepts.select(F.col("id").alias("_id")).distinct()
    counts = [
        files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("file_rows").alias("item"), "n"),
        files.groupBy("path").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_paths").alias("item"), "n"),
    ]
    for table, column, keys, name in (
        (files.select("parent_id"), "parent_id", ids, "missing_parents"),
        (chunks.select("file_id"), "file_id", ids, "chunks_without_file"),
        (embeddings.select("file_id"), "file_id", ids, "vectors_without_file"),
        (occurrences.select("chunk_id"), "chunk_id", chunk_ids, "occurrences_without_chunk"),
        (occurrences.select("concept_id"), "concept_id", concept_ids, "occurrences_without_concept"),
    ):
        counts.append(orphans(table, column, keys, "n").select(F.lit(name).alias("item"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
