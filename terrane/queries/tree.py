"""Queries on the tree of files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.paths import base_name, depth, directory, extension, has_prefix, within
from terrane.operators import relational as R
from terrane.queries.common import FILES
from terrane.sources.policy import EXCLUDE_PATTERNS, INCLUDE_EXTENSIONS, LANGUAGES, Policy, language
from terrane.tables import table

_ROOT = "/srv/trees/emberlog"


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.current_files(table(spark, d, "files"), columns)


def _base(spark, d):
    return _files(spark, d, "size", "mtime_ns", "parent_id", "name", "path", "kind", "tags_text", "scan_root", "mime")


def ls_children(spark, d):
    return R.ls(_base(spark, d), _ROOT)


def big_files(spark, d):
    return R.big(_base(spark, d), 4096)


def du_subtree(spark, d):
    return R.du(_base(spark, d), _ROOT)


def du_subtree_recursive(spark, d):
    return R.du_recursive(_base(spark, d), _ROOT)


def du_all_folders(spark, d):
    return R.du_all(_base(spark, d))


def by_tag(spark, d):
    files = _base(spark, d)
    return R.by_tag(files, R.tags(files), "reviewed")


def tags_listed(spark, d):
    return R.tags_text(R.tags(_base(spark, d)))


def tags_all(spark, d):
    return R.with_all_tags(_base(spark, d), ["owner", "draft"]).select("id", "path")


def kind_counts(spark, d):
    return _base(spark, d).groupBy("scan_root", "kind").agg(F.count(F.lit(1)).alias("n"))


def path_prefix(spark, d):
    return _base(spark, d).filter(has_prefix(F.col("path"), "/srv/trees/emb")).select("id", "path")


def subtree_filter(spark, d):
    return _base(spark, d).filter(within(F.col("path"), _ROOT)).select("id", "path")


def size_range(spark, d):
    return _base(spark, d).filter(R.metadata_filter(kinds=["file"], min_size=500, max_size=1500)).select("id", "path", "size")


def path_parts(spark, d):
    p = F.col("path")
    return _base(spark, d).select("id", base_name(p).alias("base"), directory(p).alias("folder"), depth(p).alias("depth"), extension(p).alias("ext"), language(p).alias("language"))


def include_policy(spark, d):
    files = _base(spark, d)
    return files.filter(Policy().includes(F.col("name"), F.col("kind"))).select("id", "path")


def exclude_policy(spark, d):
    files = _base(spark, d)
    return files.filter(Policy().excludes(F.col("path"), F.col("scan_root"))).select("id", "path")


def scan_order(spark, d):
    return R.scan_order(_base(spark, d).select("id", "path"))


def stale_anti_join(spark, d):
    files = _base(spark, d)
    seen = files.filter(F.col("id") % 3 != 0)  # stands for what a scan found
    return R.stale(files, _ROOT, seen).select("id", "path")


def skip_unchanged_reuse(spark, d):
    files = table(spark, d, "files")
    known = R.current_files(files, ["size", "mtime_ns", "path", "kind"])
    found = files.groupBy("path").agg(F.max("kind").alias("kind"), F.min("size").alias("size"), F.min("mtime_ns").alias("mtime_ns"))
    vectors = table(spark, d, "file_embeddings")
    model = vectors.groupBy("model").count().orderBy(F.desc("count"), "model").first()
    return R.reusable(found, known, vectors, model["model"] if model else "")


def upsert_merge(spark, d):
    known = _base(spark, d).select("id", "path", "size").filter(F.col("id") % 2 == 0)
    changed = _base(spark, d).filter(F.col("id") % 5 < 2).select("path", (F.col("size") + 1).alias("size"))
    deleted = _base(spark, d).filter(F.col("id") % 4 == 0).select("path")
    return R.upsert(known, changed, deleted)


def rename_subtree(spark, d):
    return R.rename_subtree(_base(spark, d).select("id", "name", "path", "scan_root"), _ROOT, "/srv/moved/elsewhere")


def remove_subtree(spark, d):
    files = _base(spark, d)
    left = R.remove_subtree(files, _ROOT, {"chunks": (table(spark, d, "chunks"), "file_id")})
    return left["chunks"].groupBy("file_id").agg(F.count_distinct("id").alias("chunks"))


def containing(spark, d):
    return R.containing(_files(spark, d, "size", "name", "path", "kind", "content_head"), "journal_")


def by_extension(spark, d):
    return R.by_extension(_base(spark, d), "rs")


def check_report(spark, d):
    return R.check(_base(spark, d), table(spark, d, "chunks"), table(spark, d, "file_embeddings"), table(spark, d, "concept_occurrences"), table(spark, d, "concepts"))


_IN = f"(path = '{_ROOT}' OR starts_with(path, '{_ROOT}/'))"
_COMPONENTS = "|".join(p.replace(".", "\\.").replace("*", "[^/]*") for p in EXCLUDE_PATTERNS)
_WITH = f"WITH {FILES}"
_TAGS = f"{_WITH}, tag AS (SELECT DISTINCT id AS file_id, unnest(string_split_regex(coalesce(tags_text, ''), '\\s+')) AS tag FROM cur), tags AS (SELECT * FROM tag WHERE tag <> '')"
_BYTES = "CAST(coalesce(sum(CASE WHEN kind = 'file' THEN size ELSE 0 END), 0) AS BIGINT)"

QUERIES = {f.__name__: f for f in (
    ls_children, big_files, du_subtree, du_subtree_recursive, du_all_folders, by_tag, tags_listed, tags_all, kind_counts, path_prefix, subtree_filter,
    size_range, path_parts, include_policy, exclude_policy, scan_order, stale_anti_join, skip_unchanged_reuse, upsert_merge, rename_subtree, remove_subtree, containing, by_extension, check_report,
)}
SQL = {
    "ls_children": f"{_WITH} SELECT name, path, kind, size, mtime_ns FROM cur WHERE parent_id = (SELECT max(id) FROM cur WHERE path = '{_ROOT}')",
    "big_files": f"{_WITH} SELECT path, size, mime FROM cur WHERE kind = 'file' AND size > 4096",
    "du_subtree": f"{_WITH} SELECT count(*) AS entries, {_BYTES} AS bytes FROM cur WHERE {_IN}",
    "du_subtree_recursive": f"""WITH RECURSIVE {FILES}, sub AS (
        SELECT id, kind, size FROM cur WHERE path = '{_ROOT}' UNION ALL SELECT f.id, f.kind, f.size FROM cur f JOIN sub s ON f.parent_id = s.id)
        SELECT count(*) AS entries, {_BYTES} AS bytes FROM sub""",
    "du_all_folders": f"""{_WITH} SELECT d.path, count(*) AS entries, CAST(sum(CASE WHEN f.kind = 'file' THEN f.size ELSE 0 END) AS BIGINT) AS bytes
        FROM (SELECT DISTINCT path FROM cur WHERE kind = 'dir') d JOIN cur f ON f.path = d.path OR starts_with(f.path, d.path || '/') GROUP BY d.path""",
    "by_tag": f"{_TAGS} SELECT path, kind, size FROM cur WHERE id IN (SELECT file_id FROM tags WHERE tag = 'reviewed')",
    "tags_listed": f"{_TAGS} SELECT file_id, string_agg(tag, ' ' ORDER BY tag) AS tags_text FROM tags GROUP BY file_id",
    "tags_all": f"{_TAGS} SELECT id, path FROM cur WHERE id IN (SELECT file_id FROM tags WHERE tag = 'owner') AND id IN (SELECT file_id FROM tags WHERE tag = 'draft')",
    "kind_counts": f"{_WITH} SELECT scan_root, kind, count(*) AS n FROM cur GROUP BY ALL",
    "path_prefix": f"{_WITH} SELECT id, path FROM cur WHERE substr(path, 1, 14) = '/srv/trees/emb'",
    "subtree_filter": f"{_WITH} SELECT id, path FROM cur WHERE {_IN}",
    "size_range": f"{_WITH} SELECT id, path, size FROM cur WHERE kind = 'file' AND size BETWEEN 500 AND 1500",
    "path_parts": f"""{_WITH}, p AS (SELECT id, string_split(path, '/') AS s, path, lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^.]*)$', 1)) AS ext FROM cur)
        SELECT id, s[-1] AS base, CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder, len(s) AS depth, ext,
        CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())} ELSE '' END AS language FROM p""",
    "include_policy": f"{_WITH} SELECT id, path FROM cur WHERE kind <> 'file' OR lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ({', '.join(repr(x) for x in INCLUDE_EXTENSIONS)}) OR regexp_full_match(name, '{'|'.join(p.replace('.', chr(92) + '.').replace('*', '[^/]*') for p in Policy().include_patterns)}')",
    "exclude_policy": f"{_WITH} SELECT id, path FROM cur WHERE len(list_filter(string_split(substr(path, length(scan_root) + 2), '/'), lambda x: regexp_full_match(x, '{_COMPONENTS}'))) > 0",
    "scan_order": f"{_WITH} SELECT id, path FROM cur ORDER BY len(string_split(path, '/')), path",
    "stale_anti_join": f"{_WITH} SELECT id, path FROM cur WHERE {_IN} AND path NOT IN (SELECT path FROM cur WHERE id % 3 <> 0)",
    "skip_unchanged_reuse": f"""{_WITH}, m AS (SELECT model FROM file_embeddings GROUP BY model ORDER BY count(*) DESC, model LIMIT 1),
        emb AS (SELECT file_id, max(model) AS model FROM file_embeddings GROUP BY file_id),
        found AS (SELECT path, max(kind) AS kind, min(size) AS size, min(mtime_ns) AS mtime_ns FROM files GROUP BY path)
        SELECT found.path, cur.id AS known_id FROM found JOIN cur ON cur.path = found.path JOIN emb ON emb.file_id = cur.id
        WHERE found.kind = cur.kind AND found.kind <> 'symlink' AND (found.kind = 'dir' OR found.size = cur.size) AND found.mtime_ns = cur.mtime_ns AND emb.model = (SELECT model FROM m)""",
    "upsert_merge": f"""{_WITH}, known AS (SELECT id, path, size FROM cur WHERE id % 2 = 0), changed AS (SELECT path, size + 1 AS size FROM cur WHERE id % 5 < 2),
        deleted AS (SELECT path FROM cur WHERE id % 4 = 0),
        fresh AS (SELECT path, size FROM changed WHERE path NOT IN (SELECT path FROM known))
        SELECT id, path, size FROM known WHERE path NOT IN (SELECT path FROM changed) AND path NOT IN (SELECT path FROM deleted)
        UNION ALL SELECT k.id, c.path, c.size FROM changed c JOIN known k USING (path)
        UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY path), path, size FROM fresh""",
    "rename_subtree": f"""{_WITH} SELECT id, CASE WHEN path = '{_ROOT}' THEN 'elsewhere' ELSE name END AS name,
        CASE WHEN {_IN} THEN '/srv/moved/elsewhere' || substr(path, {len(_ROOT) + 1}) ELSE path END AS path,
        CASE WHEN scan_root = '{_ROOT}' OR starts_with(scan_root, '{_ROOT}/') THEN '/srv/moved/elsewhere' || substr(scan_root, {len(_ROOT) + 1}) ELSE scan_root END AS scan_root FROM cur""",
    "remove_subtree": f"{_WITH} SELECT file_id, count(DISTINCT id) AS chunks FROM chunks WHERE file_id NOT IN (SELECT id FROM cur WHERE {_IN}) GROUP BY file_id",
    "containing": f"{_WITH} SELECT path, kind, size FROM cur WHERE contains(lower(name), 'journal_') OR contains(lower(content_head), 'journal_') ORDER BY size DESC, path LIMIT 50",
    "by_extension": f"{_WITH} SELECT path, size FROM cur WHERE kind = 'file' AND ends_with(name, '.rs') ORDER BY path LIMIT 50",
    "check_report": f"""{_WITH}
        SELECT 'file_rows' AS item, count(*) AS n FROM cur
        UNION ALL SELECT 'repeated_paths', count(*) FROM (SELECT path FROM cur GROUP BY path HAVING count(*) > 1)
        UNION ALL SELECT 'missing_parents', count(*) FROM cur WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM cur)
        UNION ALL SELECT 'chunks_without_file', count(*) FROM chunks WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT id FROM cur)
        UNION ALL SELECT 'vectors_without_file', count(*) FROM file_embeddings WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT id FROM cur)
        UNION ALL SELECT 'occurrences_without_chunk', count(*) FROM concept_occurrences WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks)
        UNION ALL SELECT 'occurrences_without_concept', count(*) FROM concept_occurrences WHERE concept_id IS NOT NULL AND concept_id NOT IN (SELECT id FROM concepts)""",
}
