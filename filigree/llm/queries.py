"""Queries of the package's operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import cover, groups, leak, nearest, pack, pii, quota
from filigree.llm.items import category, clean_rows, standing, usable_items
from filigree.session import materialize, read, release


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return usable_items(read(spark, d, "items"), read(spark, d, "datasets"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Clean rows, older ones as well: enough to choose a grid's features by, and without the shuffle of _usable."""
    return clean_rows(read(spark, d, "items"), read(spark, d, "datasets")).select("dataset_id", "features")


def _alike(spark, d):
    return groups.Alike(_usable(spark, d), sample=_rows(spark, d))


def p1_found(spark, d):
    return groups.groups(_alike(spark, d)).select("group_id", "id")


def p1_groups(spark, d):
    last = standing(read(spark, d, "item_attributes").select("id", "attr_name", "attr_value", "loaded_at"), ["id", "attr_name"])
    kinds = last.select("id", "attr_name", F.coalesce(category(F.col("attr_value")), F.lit("")).alias("category"))
    return groups.describe(materialize(groups.groups(_alike(spark, d))), kinds)


def _quotas(spark, d):
    held = materialize(quota.holdings(read(spark, d, "items"), read(spark, d, "item_attributes")))
    want = quota.wanted(read(spark, d, "sample_targets"))
    return materialize(quota.quotas(want, held)), want, held


def p2_found(spark, d):
    return quota.short_of(_quotas(spark, d)[0])


def p2_sample(spark, d):
    return quota.draw(*_quotas(spark, d))


def p2_report(spark, d):
    return _quotas(spark, d)[0].where("other IS NULL").select("request_id", "category", "want", "goal", "available", "quota", "shortfall", "deviation")


def p2_sample_sizes(spark, d):
    """The sample of p2_sample by category: rows, and those that do not hold the category they were drawn for."""
    report, want, held = _quotas(spark, d)
    drawn = quota.draw(report, want, held).join(want.select("request_id", "category", "dataset_id", "attr_name", "kind"), ["request_id", "category"])
    true = held.select("id", "dataset_id", "attr_name", "kind", F.lit(True).alias("true"))
    each = drawn.join(true, ["id", "dataset_id", "attr_name", "kind"], "left").groupBy("request_id", "category")
    return each.agg(F.countDistinct("id").alias("n"), F.count_if(F.col("true").isNull()).alias("strangers"))


def p3_found(spark, d):
    usable = materialize(_usable(spark, d))
    probes = read(spark, d, "probe_items").where("id IS NOT NULL").select("id").distinct()
    near = nearest.nearest(usable, usable.join(probes, "id", "left_semi"))
    release(usable)  # its rows are in blocks now
    return near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def p3_neighbours(spark, d):
    usable = materialize(_usable(spark, d))
    near = nearest.nearest(usable)
    release(usable)
    return near.select("src", "dst", F.round("distance", 6).alias("distance"), "rank")


def p5_found(spark, d):
    return cover.only_by_themselves(_usable(spark, d), read(spark, d, "subset_requests"), sample=_rows(spark, d)).select("id")


def p5_subset(spark, d):
    return cover.round_robin(_usable(spark, d), read(spark, d, "subset_requests"), sample=_rows(spark, d))


def _packed(spark, d):
    return pack.pack(materialize(pack.token_lengths(read(spark, d, "documents"), pack.tokenizer_path())))


def p6_found(spark, d):
    return pack.split_documents(_packed(spark, d))


def p6_containers(spark, d):
    return _packed(spark, d).select("doc_id", "part", "n", "container")


def p6_quarters(spark, d):
    """Texts packed by quarters of their bytes, so that SQL can count what must hold of any packing."""
    quarters = F.ceil(F.octet_length("text") / 4).cast("bigint")
    lengths = read(spark, d, "documents").select("doc_id", F.coalesce(quarters, F.lit(0)).alias("n_tokens"))
    packed = pack.pack(materialize(lengths))
    used = packed.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("n").alias("n"))
    docs = packed.groupBy("doc_id").agg(F.countDistinct("part").alias("p"), F.max("parts").alias("parts"), F.sum("n").alias("n"))
    docs = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("p") != F.col("parts")).alias("broken"), F.sum("parts").alias("pieces"), F.sum("n").alias("total"))
    full = used.agg(F.count_if(F.col("n") > pack.CAPACITY).alias("over"), (F.sum("n") >= 0.97 * F.count("*") * pack.CAPACITY).alias("well_filled"))
    return docs.crossJoin(F.broadcast(full))


def _leaks(spark, d):
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_found(spark, d):
    return _leaks(spark, d).select("doc_id", "eval_id")


def p7_matches(spark, d):
    return _leaks(spark, d)


def p7_clean(spark, d):
    return leak.clean(read(spark, d, "documents").select("doc_id", "repo", "file_path", "text"), _leaks(spark, d))


def p8_found(spark, d):
    return pii.details(read(spark, d, "documents")).select("doc_id", "kind", "pii_text")


def p8_redacted(spark, d):
    return pii.redacted(read(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_report, p2_sample, p2_sample_sizes, p3_found, p3_neighbours, p5_found, p5_subset, p6_found, p6_containers, p6_quarters, p7_found, p7_matches, p7_clean, p8_found, p8_redacted)
}

_USABLE = """
WITH last AS (SELECT id, dataset_id, features FROM (
    SELECT id, dataset_id, features, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM items WHERE id IS NOT NULL) WHERE rn = 1),
usable AS (SELECT i.id, i.dataset_id, i.features FROM last i
    JOIN (SELECT dataset_id, max(n_features) AS k FROM datasets GROUP BY dataset_id) s ON i.dataset_id = s.dataset_id
    WHERE len(i.features) = s.k AND s.k > 0
      AND len(list_filter(i.features, lambda v: v IS NULL OR isnan(v) OR isinf(v) OR v = -999)) = 0
      AND len(list_filter(i.features, lambda v: v <> 0)) > 0)
"""
_DIST = "sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_CATEGORY = "lower(regexp_replace(trim({}, ' \t\n\r'), '[ \t_-]+', ' ', 'g'))"
_WORDS = """
WITH doc AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
test AS (SELECT eval_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT id, k, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM doc WHERE len(w) >= 12)),
e AS (SELECT id, k, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM test WHERE len(w) >= 12))
"""
_HELD = f"""
WITH item AS (SELECT id, dataset_id FROM (SELECT id, dataset_id, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM items) WHERE rn = 1),
attr AS (SELECT id, attr_name, {_CATEGORY.format("attr_value")} AS kind FROM (
    SELECT *, row_number() OVER (PARTITION BY id, attr_name ORDER BY loaded_at DESC NULLS LAST) AS rn FROM item_attributes) WHERE rn = 1),
held AS (SELECT dataset_id, attr_name, kind, count(*) AS n FROM item JOIN attr USING (id) GROUP BY ALL),
ask AS (SELECT t.request_id, t.category, coalesce(t.min_rows, 0) AS floor, CAST(round(t.target_share * t.sample_size) AS BIGINT) AS target,
    CAST(greatest(coalesce(t.min_rows, 0), round(t.target_share * t.sample_size)) AS BIGINT) AS want, coalesce(h.n, 0) AS have, {_CATEGORY.format("t.category")} AS kind
  FROM sample_targets t LEFT JOIN held h ON t.dataset_id = h.dataset_id AND t.attr_name = h.attr_name AND h.kind = {_CATEGORY.format("t.category")}),
room AS (SELECT *, greatest(target - floor, 0) AS room, sum(greatest(target - floor, 0)) OVER r AS rooms, sum(greatest(floor - target, 0)) OVER r AS over FROM ask WINDOW r AS (PARTITION BY request_id)),
part AS (SELECT *, CASE WHEN over > rooms THEN room WHEN rooms = 0 THEN 0 ELSE over * room // rooms END AS base, CASE WHEN over > rooms OR rooms = 0 THEN 0 ELSE over * room % rooms END AS rest FROM room),
goals AS (SELECT *, CAST(want - base - CASE WHEN over <= rooms AND row_number() OVER (PARTITION BY request_id ORDER BY rest DESC, kind) <= over - sum(base) OVER (PARTITION BY request_id) THEN 1 ELSE 0 END AS BIGINT) AS goal FROM part)
"""

SQL = {
    # Forty rounds of labels: more than any chain of the small tables needs.
    "p1_found": _USABLE.replace("WITH", "WITH RECURSIVE", 1)
    + f""", alike AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.dataset_id = b.dataset_id WHERE a.id = b.id OR {_DIST} <= 1.0),
label AS (SELECT 0 AS k, id, id AS l FROM usable UNION ALL SELECT k + 1, e.a, min(l) FROM label JOIN alike e ON label.id = e.b WHERE k < 40 GROUP BY k, e.a),
done AS (SELECT id, l FROM label WHERE k = 40)
SELECT l AS group_id, id FROM done WHERE l IN (SELECT l FROM done GROUP BY l HAVING count(*) >= 5)""",
    "p2_found": _HELD + "SELECT request_id, category FROM ask WHERE have < want",
    "p2_report": _HELD
    + """SELECT request_id, category, want, goal, have AS available, least(goal, have) AS quota, greatest(want - have, 0) AS shortfall, least(goal, have) - target AS deviation FROM goals""",
    # how many are drawn of each category, and that they all are of it
    "p2_sample_sizes": _HELD + "SELECT request_id, category, least(goal, have) AS n, CAST(0 AS BIGINT) AS strangers FROM goals WHERE least(goal, have) > 0",
    "p3_found": _USABLE
    + f""", near AS (SELECT a.id AS p, b.id AS q, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS r
  FROM usable a JOIN usable b ON a.dataset_id = b.dataset_id AND a.id <> b.id WHERE a.id IN (SELECT id FROM probe_items))
SELECT DISTINCT least(p, q) AS src, greatest(p, q) AS dst FROM near WHERE r <= 10""",
    "p3_neighbours": _USABLE
    + f""", pairs AS (SELECT a.id AS src, b.id AS dst, {_DIST} AS d FROM usable a JOIN usable b ON a.dataset_id = b.dataset_id AND a.id <> b.id)
SELECT src, dst, round(d, 6) AS distance, rank FROM (
  SELECT src, dst, d, CAST(row_number() OVER (PARTITION BY src ORDER BY d, dst) AS INTEGER) AS rank FROM pairs) WHERE rank <= 10""",
    "p5_found": _USABLE
    + f"""SELECT a.id FROM usable a WHERE a.dataset_id IN (SELECT dataset_id FROM subset_requests WHERE subset_size > 0)
  AND NOT EXISTS (SELECT 1 FROM usable b WHERE b.dataset_id = a.dataset_id AND b.id <> a.id AND {_DIST} <= 1.0)""",
    "p5_subset": _USABLE.replace("WITH", "WITH RECURSIVE", 1)
    + f""", wanted AS (SELECT dataset_id, max(subset_size) AS k FROM subset_requests WHERE subset_size > 0 GROUP BY dataset_id),
bin AS (SELECT u.*, list_transform(features, lambda v: floor(v / 4)) AS bin FROM usable u JOIN wanted USING (dataset_id)),
rep AS (SELECT dataset_id, bin, min(id) AS rep FROM bin GROUP BY ALL),
each AS (SELECT b.dataset_id, b.id, b.features, CASE WHEN b.id <> rep AND {_DIST.replace("a.", "b.").replace("b.features, b.features", "b.features, r.features")} <= 1 THEN rep ELSE b.id END AS part
  FROM bin b JOIN rep USING (dataset_id, bin) JOIN usable r ON r.id = rep.rep),
stand AS (SELECT * FROM each WHERE id = part),
met AS MATERIALIZED (SELECT a.id AS a, b.part AS b FROM stand a JOIN each b ON a.dataset_id = b.dataset_id WHERE a.id = b.id OR {_DIST} <= 1.0),
alike AS MATERIALIZED (SELECT a, b FROM met UNION SELECT b, a FROM met),
spread AS (SELECT 0 AS r, id, id AS l FROM stand UNION ALL SELECT r + 1, e.a, min(l) FROM spread JOIN alike e ON spread.id = e.b WHERE r < 40 GROUP BY r, e.a),
one AS (SELECT e.dataset_id, e.id, e.part, s.l AS label FROM each e JOIN spread s ON e.part = s.id WHERE s.r = 40),
turn AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, part ORDER BY md5(concat_ws('-', dataset_id, id)), id) AS turn FROM one),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label ORDER BY turn, md5(concat_ws('-', 'part', part)), id) AS rank FROM turn),
placed AS (SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id ORDER BY rank, md5(concat_ws('-', 'label', dataset_id, label)), id) AS place FROM ranked)
SELECT dataset_id, id, CAST(place AS INTEGER) AS place FROM placed JOIN wanted USING (dataset_id) WHERE place <= k""",
    "p6_quarters": """
WITH q AS (SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS n FROM documents)
SELECT count(*) AS documents, CAST(0 AS BIGINT) AS broken, CAST(sum(ceil(n / 4096)) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS total, CAST(0 AS BIGINT) AS over, true AS well_filled FROM q WHERE n > 0""",
    "p7_found": _WORDS + "SELECT DISTINCT d.id AS doc_id, e.id AS eval_id FROM d JOIN e USING (s)",
    "p7_matches": _WORDS
    + """, hit AS (SELECT d.id AS doc_id, e.id AS eval_id, d.k AS p, e.k AS q FROM d JOIN e USING (s)),
run AS (SELECT doc_id, eval_id, p, q, p - row_number() OVER (PARTITION BY doc_id, eval_id, p - q ORDER BY p) AS g FROM hit),
match AS (SELECT doc_id, eval_id, count(*) + 11 AS n, min(p) - 1 AS dw, min(q) - 1 AS ew FROM run GROUP BY doc_id, eval_id, p - q, g)
SELECT doc_id, eval_id, CAST(n AS INTEGER) AS n_words, CAST(dw AS INTEGER) AS doc_word, CAST(ew AS INTEGER) AS eval_word FROM match
QUALIFY row_number() OVER (PARTITION BY doc_id, eval_id ORDER BY n DESC, dw, ew) = 1""",
    "p7_clean": _WORDS + "SELECT doc_id, repo, file_path, text FROM documents WHERE doc_id NOT IN (SELECT d.id FROM d JOIN e USING (s))",
}
