"""Lines that recur across documents, found by a log-template tree, with DataFrame functions alone.

The tree has fixed depth: a line goes by its number of tokens, then by its leading tokens, where a token that holds a digit counts as a
field ``<*>``; so it comes to a leaf. In a leaf, lines that are the same but for their fields share a template, if MASK_SHARE of its tokens
are no fields; lines of hardly more than fields (rows of numbers, dates, unspaced sentences) share one only if they are the same
altogether. Lines that no such template claims are generalised once more: a position holds a constant if one token fills it in most of the leaf's lines, else a field,
and lines that have all the constants share the leaf's template if enough positions are constant. A template that occurs in MIN_DOCS
documents is dropped everywhere but in the document with the smallest id, which keeps what the others lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import Scratch

#: Documents that make a template recur; leading tokens that choose a leaf.
MIN_DOCS, DEPTH = 3, 4
#: A token is constant at a position from this share of the leaf's lines on; a template needs this share of constant positions.
CONSTANT_SHARE, TEMPLATE_SHARE = 0.5, 0.75
#: A masked line is a template if this share of its tokens are no fields.
MASK_SHARE = 0.5

#: Rows of two numbers that may be broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000

_FIELD = "[^ ]*[0-9][^ ]*"


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, pos, template (the masked line, or the line if that is mostly fields), leaf and masked line of the lines that hold more than blanks."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("pos", "_raw"))
    lines = lines.select("doc_id", "text_id", "pos", F.trim("_raw").alias("_line")).where("_line <> ''").select("doc_id", "text_id", "pos", "_line", _masked(F.col("_line")).alias("_mask"))
    lead = F.substring_index("_mask", " ", DEPTH)
    n = F.length("_mask") - F.length(F.replace("_mask", F.lit(" "), F.lit("")))
    fields = (F.length("_mask") - F.length(F.replace("_mask", F.lit("<*>"), F.lit("")))) / 3
    template = F.when(fields > (1 - MASK_SHARE) * (n + 1), F.col("_line")).otherwise(F.col("_mask"))
    return lines.select("doc_id", "text_id", "pos", F.xxhash64(template).alias("template"), F.xxhash64(n, lead).alias("leaf"), "_mask")


def _recurring(lines: DataFrame, key: str, min_docs: int) -> DataFrame:
    """The keys of min_docs documents or more, with the smallest id; documents are counted once, before and after the shuffle."""
    per_doc = lines.groupBy(key, "doc_id").agg(F.lit(1).alias("_one"))
    return per_doc.groupBy(key).agg(F.count("_one").alias("_docs"), F.min("doc_id").alias("_first")).where(F.col("_docs") >= min_docs).select(key, "_first")


def bounded(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: to be broadcast if it has BROADCAST_ROWS rows at most, else joined by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def dropped_lines(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id and pos of the lines to drop."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    lines = lines_of(known)
    narrow = scratch.save(lines.drop("_mask"), "lines")
    same = bounded(scratch.save(_recurring(narrow, "template", min_docs), "templates"))
    exact = narrow.join(same, "template").where("doc_id <> _first").select("doc_id", "text_id", "pos")
    leaves = bounded(scratch.save(_recurring(narrow.join(same, "template", "left_anti"), "leaf", min_docs).select("leaf"), "leaves"))
    # Lines of recurring leaves; the leading tokens are alike by definition.
    loose = scratch.save(lines.join(leaves, "leaf", "left_semi").join(same.select("template"), "template", "left_anti").select("leaf", "doc_id", "text_id", "pos", "_mask"), "loose")
    tokens = loose.select("leaf", "doc_id", "text_id", "pos", F.posexplode(F.split("_mask", " ")).alias("at", "token"))
    size = loose.groupBy("leaf").agg(F.count(F.lit(1)).alias("_lines"))
    filled = tokens.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("_n"))
    top = filled.groupBy("leaf", "at").agg(F.max("_n").alias("_n"), F.min_by("token", F.struct(-F.col("_n"), "token")).alias("constant"))
    fixed = top.join(size, "leaf").where((F.col("_n") >= CONSTANT_SHARE * F.col("_lines")) & (F.col("constant") != "<*>")).select("leaf", "at", "constant")
    share = fixed.groupBy("leaf").agg(F.count(F.lit(1)).alias("_fixed"))
    wide = tokens.groupBy("leaf").agg(F.max("at").alias("_last"))
    good = share.join(wide, "leaf").where(F.col("_fixed") >= TEMPLATE_SHARE * (F.col("_last") + 1)).select("leaf", "_fixed")
    hits = tokens.join(fixed, ["leaf", "at"]).where("token = constant").groupBy("leaf", "doc_id", "text_id", "pos").agg(F.count(F.lit(1)).alias("_hits"))
    member = scratch.save(hits.join(good, "leaf").where("_hits = _fixed").select("leaf", "doc_id", "text_id", "pos"), "members")
    general = member.join(_recurring(member, "leaf", min_docs), "leaf").where("doc_id <> _first").select("doc_id", "text_id", "pos")
    return exact.unionByName(general)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with recurring lines taken out of their text, and n_lines and n_dropped added.

    n_lines counts all lines, blank ones too. Rows with a null id or text stay as they are. Blank lines stay. Rows that repeat an id
    are the same document; of the smallest document, all lines stay. Other columns pass through, columns named n_lines or n_dropped
    are replaced.
    """
    # Columns with the names used here are called otherwise meanwhile.
    held = {c: f"held {c}" for c in docs.columns if c in ("_gone", "_doc", "_tid", "_text_id")}
    docs = docs.withColumnsRenamed(held)
    scratch = Scratch(docs.sparkSession, "lines")
    gone = dropped_lines(docs, scratch, min_docs).groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("_gone"))
    rows = docs.drop("n_lines", "n_dropped").withColumn("_text_id", F.xxhash64("text"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_tid"), "_gone")
    out = rows.join(gone, (rows["doc_id"] == gone["_doc"]) & (rows["_text_id"] == gone["_tid"]), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    columns = [F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in rows.columns if c != "_text_id"]
    n = F.coalesce(F.size(lines), F.lit(0))
    done = out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("n_dropped"))
    return done.withColumnsRenamed({v: k for k, v in held.items()})


#: The same in DuckDB, for doc_id, n_lines, n_dropped and kept_sha256.
ORACLE = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT doc_id, pos, raw, CASE WHEN trim(raw) = '' THEN NULL ELSE regexp_replace(trim(raw), '{_FIELD}', '<*>', 'g') END AS mask FROM raw),
keyed AS (SELECT doc_id, pos, mask, string_split(mask, ' ') AS tokens, len(string_split(mask, ' ')) AS n, list_slice(string_split(mask, ' '), 1, {DEPTH}) AS head FROM lines WHERE mask IS NOT NULL),
same AS (SELECT mask, min(doc_id) AS first FROM keyed GROUP BY mask HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
exact AS (SELECT k.doc_id, k.pos FROM keyed k JOIN same s USING (mask) WHERE k.doc_id <> s.first),
rest AS (SELECT * FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.mask = k.mask)),
leaves AS (SELECT n, head FROM rest GROUP BY n, head HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
loose AS (SELECT r.* FROM rest r JOIN leaves l ON r.n = l.n AND r.head = l.head),
tokens AS (SELECT n, head, doc_id, pos, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM loose),
size AS (SELECT n, head, count(*) AS lines FROM loose GROUP BY n, head),
filled AS (SELECT n, head, p, token, count(*) AS c FROM tokens GROUP BY n, head, p, token),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, head, p ORDER BY c DESC, token) AS r FROM filled),
fixed AS (SELECT f.n, f.head, f.p, f.token FROM ranked f JOIN size s ON f.n = s.n AND f.head = s.head WHERE r = 1 AND c >= {CONSTANT_SHARE} * s.lines AND token <> '<*>'),
good AS (SELECT n, head, count(*) AS fixed FROM fixed GROUP BY n, head HAVING count(*) >= {TEMPLATE_SHARE} * n),
member AS (SELECT t.n, t.head, t.doc_id, t.pos FROM tokens t JOIN fixed f ON t.n = f.n AND t.head = f.head AND t.p = f.p AND t.token = f.token JOIN good g ON g.n = t.n AND g.head = t.head GROUP BY t.n, t.head, t.doc_id, t.pos, g.fixed HAVING count(*) = g.fixed),
general AS (SELECT m.doc_id, m.pos FROM member m JOIN (SELECT n, head, min(doc_id) AS first FROM member GROUP BY n, head HAVING count(DISTINCT doc_id) >= {MIN_DOCS}) s ON m.n = s.n AND m.head = s.head WHERE m.doc_id <> s.first),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT * FROM exact UNION ALL SELECT * FROM general)),
kept AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_dropped FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
