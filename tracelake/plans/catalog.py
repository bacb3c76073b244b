"""The registered queries of the evidence engine and their DuckDB equivalents.

The document table stands in for a source tree, benchmark texts for questions,
labels for judgements, and a projection on ``doc_id % 10`` for a later revision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.tables import kept
from tracelake.operators import corpus, diff, evaluate, grouped, metrics, pack, postings, rank, verify

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_FILES = "files AS (SELECT doc_id, concat_ws('/', lang, source, doc_id || '.txt') AS path, text FROM documents WHERE text IS NOT NULL)"
_LS = "list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i < len(p) THEN p[i] || chr(10) ELSE p[i] END), lambda x: x <> '')"
_LN = f"{_FILES}, ln AS (SELECT doc_id, path, text, {_LS} AS ls FROM (SELECT *, string_split(text, chr(10)) AS p FROM files))"
_CH = rf"""{_LN}, ch AS (
  SELECT *, sha256('["' || path || '",' || start_line || ',' || end_line || ',["<text>","text"],"' || file_sha256 || '"]') AS id FROM (
    SELECT path, CAST(s AS BIGINT) AS start_line, CAST(least(s + 79, len(ls)) AS BIGINT) AS end_line, array_to_string(ls[s : least(s + 79, len(ls))], '') AS text, sha256(text) AS file_sha256
    FROM (SELECT *, unnest(range(1, len(ls) + 1, 80)) AS s FROM ln)) WHERE NOT regexp_full_match(text, '\s*'))"""


def _terms_sql(x: str) -> str:
    camel = r"regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')"
    parts = f"list_filter(string_split(lower({camel}), '_'), lambda y: y <> '')"
    return rf"flatten(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+(?:_[\p{{L}}\p{{N}}]+)*'), lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([lower(w)], {parts}) ELSE [lower(w)] END))"


_TF = f"""{_CH}, ts AS (SELECT id, path, start_line, list_concat(list_concat({_terms_sql('text')}, ['text', 'text']), {_terms_sql('path')}) AS t FROM ch),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM ts) GROUP BY ALL)"""
_BM = f"""{_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM ts),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_terms_sql('text')}) AS term FROM benchmark),
sc AS (SELECT query_id, ts.id, path, start_line, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / al))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ts ON ts.id = tf.id CROSS JOIN st GROUP BY ALL)"""
_AFTER = rf"""{_LN}, af AS (
  SELECT doc_id, path, text, {_LS} AS ls FROM (SELECT *, string_split(text, chr(10)) AS p FROM (
    SELECT doc_id, unnest(CASE WHEN doc_id % 10 = 7 THEN [path, 'copy/' || path] WHEN doc_id % 10 = 4 THEN ['moved/' || path] ELSE [path] END) AS path,
      CASE doc_id % 10 WHEN 3 THEN 'inserted header' || chr(10) || text WHEN 5 THEN 'edited ' || text WHEN 7 THEN 'displaced' || chr(10) || text
        WHEN 8 THEN text || chr(10) || 'appended line' WHEN 9 THEN text || chr(10) || 'appended line' ELSE text END AS text
    FROM files WHERE doc_id % 10 <> 6))),
en AS (SELECT *, path || ':' || start_line AS entry_id, end_line - start_line + 1 AS n FROM (
  SELECT path, s AS start_line, least(s + 79, len(ls)) AS end_line, ls[s] AS head, array_to_string(ls[s : least(s + 79, len(ls))], '') AS text, sha256(text) AS file_sha256
  FROM (SELECT *, unnest(range(1, len(ls) + 1, 80)) AS s FROM ln)) WHERE NOT regexp_full_match(text, '\s*'))"""


def _places_sql(files: str) -> str:
    """Every place of every span: lines equal to its first, where as many lines as it has are its text."""
    return f"""SELECT entry_id, f.path, f.s AS line FROM en JOIN (SELECT path, s, ls[s] AS head FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS s FROM {files})) f USING (head)
  JOIN {files} x ON x.path = f.path WHERE len(x.ls) >= f.s + n - 1 AND array_to_string(x.ls[f.s : f.s + n - 1], '') = en.text"""


_OCC = f"{_AFTER}, oc AS ({_places_sql('af')})"
_VER = f"""{_OCC}, ver AS (
  SELECT e.entry_id, CASE WHEN array_to_string(a.ls[e.start_line : e.end_line], '') = e.text AND len(a.ls) >= e.end_line THEN 'valid'
      WHEN o.n = 1 THEN 'relocated' WHEN o.n > 1 THEN 'ambiguous' WHEN a.path IS NOT NULL THEN 'modified' ELSE 'deleted' END AS status, o.n, m
  FROM en e LEFT JOIN af a ON a.path = e.path
  LEFT JOIN (SELECT entry_id, count(*) AS n, min({{'path': path, 'line': line}}) AS m FROM oc GROUP BY entry_id) o USING (entry_id))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _files(spark, d) -> DataFrame:
    return corpus.documents_as_files(spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").isNotNull()))


def _once(spark, d) -> DataFrame:
    """Chunks of different ids."""
    return corpus.chunks(corpus.once(_files(spark, d)))


def _index(spark, d) -> postings.Index:
    return postings.Index(_once(spark, d).withColumn("cost", F.octet_length("text")), _queries(spark, d))


def _queries(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("corpus_manifest", f"WITH {_LN} SELECT path, sha256(text) AS file_sha256, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(ls) AS BIGINT) AS n_lines FROM ln")
def corpus_manifest(spark, d):
    return corpus.manifest(_files(spark, d))


@query(
    "policy_exclusions",
    rf"""WITH {_LN} SELECT path, CASE WHEN strlen(text) > 2097152 THEN 'too_large' WHEN contains(text, 'PRIVATE KEY-----') THEN 'private_key'
      WHEN regexp_matches(array_to_string(ls[1:5], ''), '(?i)(@generated|do not edit|automatically generated|autogenerated|code generated by)') THEN 'generated_marker' END AS reason FROM ln""",
)
def policy_exclusions(spark, d):
    return _files(spark, d).select("path", corpus.exclusion(F.col("path"), F.col("text"), F.octet_length("text")).alias("reason"))


@query("line_table", f"WITH {_LN} SELECT path, CAST(i AS BIGINT) AS line_no, ls[i] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM ln)")
def line_table(spark, d):
    return corpus.lines(_files(spark, d))


@query("chunk_windows", f"WITH {_CH} SELECT id, path, start_line, end_line, sha256(text) AS text_sha256, '<text>' AS symbol, 'text' AS kind FROM ch")
def chunk_windows(spark, d):
    return corpus.chunks(_files(spark, d)).select("id", "path", "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"), "symbol", "kind")


@query("owner_islands", f"""WITH {_LN}, o AS (SELECT path, i, ls[i] AS line, strlen(ls[i]) % 3 AS owner FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM ln)),
r AS (SELECT *, sum(c) OVER (PARTITION BY path ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(owner) OVER (PARTITION BY path ORDER BY i) = owner THEN 0 ELSE 1 END AS c FROM o)),
k AS (SELECT *, (row_number() OVER (PARTITION BY path, run ORDER BY i) - 1) // 2 AS piece FROM r)
SELECT path, CAST(min(owner) AS BIGINT) AS owner, CAST(min(i) AS BIGINT) AS start_line, CAST(max(i) AS BIGINT) AS end_line, sha256(string_agg(line, '' ORDER BY i)) AS text_sha256 FROM k GROUP BY path, run, piece""")
def owner_islands(spark, d):
    owned = corpus.lines(_files(spark, d)).withColumn("owner", (F.octet_length("line") % 3).cast("long"))
    return corpus.islands(owned, 2).select("path", "owner", "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"))


@query("term_frequencies", f"WITH {_TF} SELECT id, term, tf FROM tf")
def term_frequencies(spark, d):
    return rank.term_frequencies(_once(spark, d))


@query("document_frequencies", f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequencies(spark, d):
    return rank.document_frequencies(_once(spark, d))


def _top_sql(scores: str) -> str:
    return f"SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, path, start_line, id) AS rank FROM {scores} WHERE score > 0) WHERE rank <= 10"


@query("bm25_topk", f"WITH {_BM} {_top_sql('sc')}")
def bm25_topk(spark, d):
    return rank.top(_index(spark, d).first(10), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_EDGES = f"""ed AS (SELECT DISTINCT src, dst FROM (SELECT term, min(path) AS src, max(path) AS dst FROM (SELECT DISTINCT term, path FROM tf JOIN ch USING (id)) GROUP BY term HAVING count(*) = 2)),
both_ways AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)"""


@query("rare_term_edges", f"WITH {_TF}, {_EDGES} SELECT src, dst FROM ed")
def rare_term_edges(spark, d):
    return rank.rare_term_edges(_files(spark, d))


@query(
    "graph_topk",
    f"""WITH {_BM}, {_EDGES}, fs AS (SELECT query_id, path, max(score) AS s FROM sc WHERE score > 0 GROUP BY ALL),
bo AS (SELECT query_id, dst AS path, max(s) AS b FROM both_ways JOIN fs ON fs.path = src GROUP BY ALL),
bc AS (SELECT query_id, ch.id, ch.path, ch.start_line, b FROM bo JOIN ch USING (path)),
al AS (SELECT coalesce(sc.query_id, bc.query_id) AS query_id, coalesce(sc.id, bc.id) AS id, coalesce(sc.path, bc.path) AS path, coalesce(sc.start_line, bc.start_line) AS start_line, coalesce(score, 0) + 0.15 * coalesce(b, 0) AS score
  FROM sc FULL JOIN bc ON sc.query_id = bc.query_id AND sc.id = bc.id) {_top_sql('al')}""",
)
def graph_topk(spark, d):
    return rank.top(_index(spark, d).linked(rank.rare_term_edges(_files(spark, d)), 10), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def _entries(spark, d):
    return verify.entries(_files(spark, d))


def _after(spark, d):
    return verify.drifted(_files(spark, d))


@query("occurrence_index", f"WITH {_OCC} SELECT entry_id, path, CAST(line AS BIGINT) AS line FROM oc")
def occurrence_index(spark, d):
    return verify.occurrences(_entries(spark, d), _after(spark, d))


@query("verify_status", f"WITH {_VER} SELECT entry_id, status, CASE WHEN status = 'relocated' THEN m.path END AS new_path, CAST(CASE WHEN status = 'relocated' THEN m.line END AS BIGINT) AS new_line FROM ver")
def verify_status(spark, d):
    return verify.verify(_entries(spark, d), _after(spark, d)).select("entry_id", "status", "new_path", "new_line")


@query("verify_summary", f"WITH {_VER} SELECT status, count(*) AS n FROM ver GROUP BY status")
def verify_summary(spark, d):
    return verify.summary(verify.verify(_entries(spark, d), _after(spark, d)))


@query("all_valid", f"WITH {_VER} SELECT count(*) > 0 AND bool_and(status = 'valid') AS valid FROM ver")
def all_valid(spark, d):
    return verify.all_valid(verify.verify(_entries(spark, d), _after(spark, d)))


_ACC = f"""{_VER}, acc AS (SELECT e.entry_id, a.path IS NOT NULL AND len(a.ls) >= e.end_line AS by_range,
  coalesce(len(a.ls) >= e.end_line AND array_to_string(a.ls[e.start_line : e.end_line], '') = e.text, false) AS by_line, coalesce(sha256(a.text) = e.file_sha256, false) AS by_hash FROM en e LEFT JOIN af a ON a.path = e.path)"""


@query("baseline_acceptors", f"WITH {_ACC} SELECT entry_id, coalesce(by_range, false) AS by_range, by_line, by_hash FROM acc")
def baseline_acceptors(spark, d):
    return verify.acceptors(_entries(spark, d), _after(spark, d))


def _judged(spark, d):
    results, accepted, _ = verify.judged(_entries(spark, d), _after(spark, d))
    return results.join(accepted, "entry_id").withColumn("truth", F.col("status").isin("valid", "relocated"))


_CONF = "count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (NOT truth AND NOT pred) AS tn, count(*) FILTER (truth AND NOT pred) AS fn"


@query(
    "confusion_metrics",
    f"""WITH {_ACC}, j AS (SELECT status IN ('valid', 'relocated') AS truth, unnest(['by_range', 'by_line', 'by_hash']) AS method, unnest([coalesce(by_range, false), by_line, by_hash]) AS pred FROM ver JOIN acc USING (entry_id)),
c AS (SELECT method, {_CONF} FROM j GROUP BY method)
SELECT *, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 8) AS accuracy, round(fp / nullif(fp + tn, 0), 8) AS false_acceptance FROM c""",
)
def confusion_metrics(spark, d):
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in ("by_range", "by_line", "by_hash")]))
    rows = _judged(spark, d).select("truth", methods.alias("x")).select("truth", "x.method", "x.pred")
    out = metrics.confusion(rows, "method")
    return out.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "accuracy", "false_acceptance")})


@query(
    "status_confusion_matrix",
    f"""WITH {_ACC}, s AS (SELECT unnest(['valid', 'relocated', 'ambiguous', 'modified', 'deleted', 'invalid']) AS x), j AS (SELECT status AS truth, CASE WHEN by_line THEN 'valid' WHEN by_range THEN 'modified' ELSE 'deleted' END AS pred FROM ver JOIN acc USING (entry_id))
SELECT a.x AS truth, b.x AS pred, count(j.truth) AS n FROM s a CROSS JOIN s b LEFT JOIN j ON j.truth = a.x AND j.pred = b.x GROUP BY ALL""",
)
def status_confusion_matrix(spark, d):
    rows = _judged(spark, d).select(F.col("status").alias("truth"), F.when(F.col("by_line"), "valid").when(F.col("by_range"), "modified").otherwise("deleted").alias("pred"))
    return metrics.status_matrix(rows, verify.STATUSES)


@query("status_agreement", f"WITH {_ACC} SELECT round(avg(CASE WHEN by_line = (status = 'valid') THEN 1 ELSE 0 END), 8) AS agreement FROM ver JOIN acc USING (entry_id)")
def status_agreement(spark, d):
    rows = _judged(spark, d).select((F.col("status") == "valid").alias("truth"), F.col("by_line").alias("pred"))
    return metrics.agreement(rows).select(F.round("agreement", 8).alias("agreement"))


_REL = f"""{_BM}, tk AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, path, start_line, id) AS rank FROM sc WHERE score > 0),
kw AS (SELECT query_id, min({{'n': -length(term), 'term': term}}).term AS term FROM q GROUP BY query_id),
rel AS (SELECT DISTINCT query_id, path FROM kw JOIN tf USING (term) JOIN ch USING (id)),
per AS (SELECT query_id, count(*) AS labels, count(rank) AS found, min(rank) AS first_rank FROM rel LEFT JOIN (SELECT query_id, path, min(rank) AS rank FROM tk WHERE rank <= 10 GROUP BY ALL) USING (query_id, path) GROUP BY query_id)"""


def _retrieved(spark, d):
    index = _index(spark, d)
    # A file is judged relevant if it has the question's longest term; of equals the first.
    return metrics.retrieval(rank.top(index.first(10), 10), index.relevant())


@query("retrieval_metrics", f"WITH {_REL} SELECT query_id, round(found / labels, 8) AS recall, found > 0 AS hit, CAST(first_rank AS INTEGER) AS first_rank, round(coalesce(1 / first_rank, 0), 8) AS reciprocal_rank FROM per")
def retrieval_metrics(spark, d):
    return _retrieved(spark, d).withColumns({c: F.round(c, 8) for c in ("recall", "reciprocal_rank")})


@query("retrieval_summary", f"WITH {_REL} SELECT 'bm25' AS method, count(*) AS queries, round(avg(CASE WHEN found > 0 THEN 1 ELSE 0 END), 8) AS hit_rate, round(avg(found / labels), 8) AS mean_recall, round(avg(coalesce(1 / first_rank, 0)), 8) AS mrr FROM per GROUP BY 1")
def retrieval_summary(spark, d):
    out = metrics.retrieval_summary(_retrieved(spark, d).withColumn("method", F.lit("bm25")), "method")
    return out.withColumns({c: F.round(c, 8) for c in ("hit_rate", "mean_recall", "mrr")})


@query("hash_rank_sample", "SELECT source, doc_id, CAST(r AS INTEGER) AS sample_rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('2026' || chr(0) || source || chr(0) || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def hash_rank_sample(spark, d):
    return metrics.hash_rank_sample(spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id"), "source", "doc_id", 3, "2026")


@query("uniqueness_eligibility", f"WITH {_AFTER}, oc AS ({_places_sql('ln')}) SELECT e.entry_id, end_line - start_line >= 2 AND strlen(e.text) <= 6000 AND o.n = 1 AS eligible FROM en e JOIN (SELECT entry_id, count(*) AS n FROM oc GROUP BY entry_id) o USING (entry_id)")
def uniqueness_eligibility(spark, d):
    saved = _entries(spark, d)
    n = verify.occurrences(saved, _files(spark, d)).groupBy("entry_id").agg(F.count("*").alias("n"))
    ok = (F.col("end_line") - F.col("start_line") >= 2) & (F.octet_length("text") <= 6000) & (F.col("n") == 1)
    return saved.join(n, "entry_id").select("entry_id", ok.alias("eligible"))


@query(
    "greedy_pack",
    f"""WITH RECURSIVE {_BM}, tk AS (SELECT query_id, id, strlen(text) AS cost, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, sc.path, sc.start_line, id) AS rank FROM sc JOIN ch USING (id) WHERE score > 0),
g AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT query_id FROM tk)
  UNION ALL SELECT g.query_id, tk.rank, CASE WHEN used + cost <= 8000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 8000 THEN list_append(kept, id) ELSE kept END FROM g JOIN tk ON tk.query_id = g.query_id AND tk.rank = g.rank + 1)
SELECT query_id, array_to_string(kept, ',') AS kept, used FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS r FROM g) WHERE r = 1""",
)
def greedy_pack(spark, d):
    ranked = rank.top(_index(spark, d).packable(8000), None).withColumn("cost", F.explode(F.expr("array_repeat(cost, cast(copies as int))")))
    return pack.greedy(ranked, "query_id", "rank", "id", "cost", 8000).select("query_id", F.array_join("kept", ",").alias("kept"), "used")


@query("snapshot_diff", f"WITH {_AFTER} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'edited' END AS change FROM ln b FULL JOIN af a ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text")
def snapshot_diff(spark, d):
    return diff.changed_files(_files(spark, d), _after(spark, d))


def _nodes(files):
    return files.select("path", F.sha2("text", 256).alias("sha"), T.line_count(F.col("text")).alias("n_lines"))


_DELTA = f"""{_AFTER}, o AS (SELECT path, sha256(text) AS sha, CAST(len(ls) AS VARCHAR) AS n FROM ln), w2 AS (SELECT path, sha256(text) AS sha, CAST(len(ls) AS VARCHAR) AS n FROM af),
ops AS (SELECT o.path, 'remove' AS op, NULL AS field, NULL AS value FROM o ANTI JOIN w2 USING (path)
  UNION ALL SELECT path, 'add', unnest(['sha', 'n_lines']), unnest([sha, n]) FROM w2 ANTI JOIN o USING (path)
  UNION ALL SELECT path, 'set', 'sha', w2.sha FROM o JOIN w2 USING (path) WHERE o.sha <> w2.sha
  UNION ALL SELECT path, 'set', 'n_lines', w2.n FROM o JOIN w2 USING (path) WHERE o.n <> w2.n)"""


@query("delta_ops", f"WITH {_DELTA} SELECT path, op, field, value FROM ops")
def delta_ops(spark, d):
    return diff.delta(_nodes(_files(spark, d)), _nodes(_after(spark, d)), "path")


@query(
    "delta_apply_check",
    f"""WITH {_DELTA}, rb AS (SELECT path, max(coalesce(s.value, o.sha)) AS sha, max(coalesce(n.value, o.n)) AS n FROM o LEFT JOIN (SELECT path, value FROM ops WHERE op = 'set' AND field = 'sha') s USING (path)
    LEFT JOIN (SELECT path, value FROM ops WHERE op = 'set' AND field = 'n_lines') n USING (path) WHERE path NOT IN (SELECT path FROM ops WHERE op = 'remove') GROUP BY path
  UNION ALL SELECT path, max(value) FILTER (field = 'sha'), max(value) FILTER (field = 'n_lines') FROM ops WHERE op = 'add' GROUP BY path),
bad AS (SELECT ops.path FROM ops LEFT JOIN o USING (path) WHERE (op = 'add') = (o.path IS NOT NULL))
SELECT (SELECT count(*) FROM w2) AS target, (SELECT count(*) FROM rb) AS rebuilt, (SELECT count(*) FROM w2 FULL JOIN rb USING (path) WHERE w2.sha IS DISTINCT FROM rb.sha OR w2.n IS DISTINCT FROM rb.n) AS differing, (SELECT count(*) FROM bad) AS violations""",
)
def delta_apply_check(spark, d):
    old, new = _nodes(_files(spark, d)), _nodes(_after(spark, d))
    ops = diff.delta(old, new, "path")
    rebuilt = diff.apply(old, ops, "path")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    both = new.select("path", F.struct("sha", "n_lines").alias("a")).join(rebuilt.select("path", F.struct("sha", "n_lines").alias("b")), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return count(new, "target").join(count(rebuilt, "rebuilt")).join(count(both, "differing")).join(count(diff.violations(old, ops, "path"), "violations"))


_NEXT = f"""{_FILES}, nx AS (SELECT path AS src, lead(path) OVER (PARTITION BY split_part(path, '/', 2) ORDER BY doc_id) AS dst FROM files
  UNION ALL SELECT path, min(path) OVER (PARTITION BY text) FROM files), ne AS (SELECT DISTINCT src, dst FROM nx WHERE dst IS NOT NULL AND src <> dst)"""


@query(
    "closure_reachability",
    f"""WITH RECURSIVE {_NEXT}, c AS (SELECT path AS root, path AS node, 0 AS depth FROM files UNION SELECT c.root, e.dst, c.depth + 1 FROM c JOIN ne e ON e.src = c.node WHERE c.depth < 4)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY ALL""",
)
def closure_reachability(spark, d):
    """From every file: to the next of its source, and to the first file of the same text."""
    files = _files(spark, d)
    follows = files.select(F.col("path").alias("src"), F.lead("path").over(Window.partitionBy(F.element_at(F.split("path", "/"), 2)).orderBy("doc_id")).alias("dst"))
    hashed = files.select("path", F.sha2("text", 256).alias("sha"))
    same = hashed.join(hashed.groupBy("sha").agg(F.min("path").alias("dst")), "sha").select(F.col("path").alias("src"), "dst")
    edges = follows.union(same).where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()
    return diff.closure(edges, files.select(F.col("path").alias("root")), 4)


@query(
    "worst_status_rollup",
    f"WITH {_VER} SELECT split_part(path, '/', 2) AS source, min(CASE status WHEN 'deleted' THEN 'b missing' WHEN 'modified' THEN 'c changed' WHEN 'ambiguous' THEN 'd unresolved' ELSE 'e unchanged' END)[3:] AS status FROM ver JOIN en USING (entry_id) GROUP BY 1",
)
def worst_status_rollup(spark, d):
    s = F.col("status")
    dep = F.when(s == "deleted", "missing").when(s == "modified", "changed").when(s == "ambiguous", "unresolved").otherwise("unchanged")
    results, _, spans = verify.judged(_entries(spark, d), _after(spark, d))
    return results.join(spans, "entry_id").select(F.element_at(F.split("path", "/"), 2).alias("source"), dep.alias("dep")).groupBy("source").agg(verify.worst(F.col("dep")).alias("status"))


@query("macro_means", "WITH p AS (SELECT source, avg(quality) AS m, sum(quality) AS s, count(quality) AS c FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT round(avg(m), 8) AS macro_mean, round(sum(s) / sum(c), 8) AS mean, count(*) AS groups FROM p")
def macro_means(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id")
    return metrics.macro_means(rows, "source", "quality").withColumns({c: F.round(c, 8) for c in ("macro_mean", "mean")})


@query("paired_outcomes", f"WITH {_ACC} SELECT count(*) FILTER (by_line AND by_hash) AS both, count(*) FILTER (by_line AND NOT by_hash) AS first_only, count(*) FILTER (NOT by_line AND by_hash) AS second_only, count(*) FILTER (NOT by_line AND NOT by_hash) AS neither FROM acc")
def paired_outcomes(spark, d):
    acc = verify.acceptors(_entries(spark, d), _after(spark, d))
    return metrics.paired_outcomes(acc.select("entry_id", F.col("by_line").alias("correct")), acc.select("entry_id", F.col("by_hash").alias("correct")), "entry_id")


@query("adjacent_versions", "SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL")
def adjacent_versions(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn")).where(F.col("next_turn").isNotNull())


@query("split_rollup", "SELECT coalesce(lang, 'all') AS lang, count(*) AS n, sum(quality) AS good, median(n_chars) AS median_chars FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def split_rollup(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return metrics.with_total(rows, "lang", n=F.count("*"), good=F.sum("quality"), median_chars=F.median("n_chars"))


@query("index_percentiles", "SELECT lang, n_chars AS value FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE pos = floor(0.975 * (n - 1))")
def index_percentiles(spark, d):
    return metrics.index_percentile(spark.read.parquet(f"{d}/documents.parquet").select("lang", "n_chars"), "n_chars", 0.975, "lang")


@query("repeated_bytes", "WITH u AS (SELECT text, min(strlen(text)) AS b FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT CAST((SELECT sum(strlen(text)) FROM documents) AS BIGINT) AS bytes, (SELECT count(*) FROM documents) AS n, CAST((SELECT sum(b) FROM u) AS BIGINT) AS unique_bytes, CAST((SELECT sum(strlen(text)) FROM documents) - (SELECT sum(b) FROM u) AS BIGINT) AS repeated_bytes")
def repeated_bytes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").isNotNull()).withColumn("sha", F.sha2("text", 256))
    return metrics.repeated_bytes(docs, ["sha"], "text")


_ODD = ("", "../", "/", "a//", "./", "b\\")


@query(
    "path_checks",
    rf"""WITH {_FILES}, od AS (SELECT ['', '../', '/', 'a//', './', 'b\'][1 + doc_id % 6] || path || CASE WHEN doc_id % 7 = 6 THEN '/' ELSE '' END AS path, text FROM files)
SELECT path, path = '' OR contains(path, '\') OR contains(path, chr(0)) OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0 AS unsafe,
  CAST(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0)) AS INTEGER) AS fence FROM od""",
)
def path_checks(spark, d):
    """Paths of which most are not safe, by ``doc_id``."""
    before = F.element_at(F.array(*map(F.lit, _ODD)), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    odd = F.concat(before, "path", F.when(F.pmod("doc_id", F.lit(7)) == 6, "/").otherwise(""))
    return _files(spark, d).select(odd.alias("path"), "text").select("path", T.unsafe_path(F.col("path")).alias("unsafe"), T.fence_width(F.col("text")).alias("fence"))


@query("publication_findings", rf"""WITH {_LN} SELECT path, CAST(i AS BIGINT) AS line_no, kind FROM (SELECT path, i, unnest(['email', 'key']) AS kind, unnest([regexp_matches(l, '[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+'), contains(l, 'AKIA')]) AS hit FROM (SELECT path, i, ls[i] AS l FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM ln))) WHERE hit""")
def publication_findings(spark, d):
    return evaluate.findings(_files(spark, d), {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+", "key": "AKIA"})


def _trees(spark, d):
    """A small Python tree for each document, and a later one made by ``doc_id % 10``."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    k = F.pmod("doc_id", F.lit(10))
    n = F.col("doc_id").cast("string")
    entry = F.concat(F.lit("from mid import step\n\ndef entry(x):\n    return step(x) + "), n, F.lit("\n"))
    mid = F.lit("from leaf import rate\n\ndef step(x):\n    return x * rate()\n")
    leaf = F.concat(F.lit("def rate():\n    return "), n, F.lit("\n"))
    tree = lambda *files: F.explode(F.array(*[F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in files]))
    before = docs.select("doc_id", tree(("entry.py", entry), ("mid.py", mid), ("leaf.py", leaf)).alias("f"))
    leaf2 = F.when(k == 3, F.concat(F.lit("# header\n\n"), leaf)).when(k == 5, F.replace(leaf, F.lit("return "), F.lit("return 1 + "))).when(k == 7, F.concat(leaf, leaf)).when(k == 8, F.concat(leaf, F.lit("\nOTHER = 1\n"))).otherwise(leaf)
    mid2 = F.when(k == 9, F.replace(mid, F.lit("x * rate()"), F.lit("rate() * x"))).otherwise(mid)
    after = docs.select("doc_id", k.alias("k"), tree(("entry.py", entry), ("mid.py", mid2), ("leaf.py", leaf2)).alias("f"))
    after = after.where(~((F.col("k") == 6) & (F.col("f.path") == "leaf.py")))
    path = F.when((F.col("k") == 4) & (F.col("f.path") == "leaf.py"), "other/leaf.py").otherwise(F.col("f.path"))
    cols = lambda df, p: df.select(F.col("doc_id").alias("rev"), p.alias("path"), F.col("f.text").alias("text"))
    anchors = docs.select(F.col("doc_id").alias("rev"), F.lit("a").alias("id"), F.lit("entry.py").alias("path"), F.lit("entry").alias("symbol"), F.lit("function").alias("kind"))
    return cols(before, F.col("f.path")), cols(after, path), anchors


@query(
    "dependency_revisions",
    """SELECT doc_id AS rev, 'a' AS id, CASE doc_id % 10 WHEN 9 THEN 'changed' ELSE 'unchanged' END AS one_hop,
  CASE doc_id % 10 WHEN 4 THEN 'unresolved' WHEN 5 THEN 'changed' WHEN 6 THEN 'unresolved' WHEN 7 THEN 'unresolved' WHEN 9 THEN 'changed' ELSE 'unchanged' END AS transitive,
  CAST(5 AS BIGINT) AS nodes, true AS delta_ok FROM documents""",
)
def dependency_revisions(spark, d):
    """One-hop witnesses and transitive graphs of a tree per document, before and after its edit."""
    return grouped.compare_revisions(*_trees(spark, d)).drop("complete")


@query("snapshot_identity", f"WITH {_FILES}, h AS (SELECT sha256(path || chr(0) || sha256(text)) AS h FROM files), r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sha256('v1' || string_agg(h, ',' ORDER BY r)) AS snapshot_id FROM r")
def snapshot_identity(spark, d):
    return corpus.snapshot_id(_files(spark, d))


@query(
    "bootstrap_ci",
    """WITH c AS (SELECT source, sum(quality) AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i FROM labels JOIN documents USING (doc_id) GROUP BY source), k AS (SELECT count(*) AS size FROM c),
p AS (SELECT draw, CAST('0x' || substr(sha256('20260921:' || draw || ':' || turn), 1, 8) AS BIGINT) % size AS i FROM (SELECT unnest(range(5000)) AS draw), (SELECT size, unnest(range(1, size + 1)) AS turn FROM k)),
m AS (SELECT sum(s) / sum(n) AS mean FROM p JOIN c USING (i) GROUP BY draw), o AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS pos FROM m)
SELECT round(min(mean) FILTER (WHERE pos = floor(0.025 * 4999)), 8) AS low, round(min(mean) FILTER (WHERE pos = floor(0.975 * 4999)), 8) AS high FROM o""",
)
def bootstrap_ci(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id")
    return metrics.hashed_bootstrap(rows, "source", "quality", 5000, 20260921).select(F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


_BUDGETS = (2000, 4000, 8000)


@query(
    "budget_summary",
    f"""WITH {_REL}, b AS (SELECT *, unnest([2000, 4000, 8000]) AS budget, coalesce(first_rank, 1) * 900 AS rendered FROM per)
SELECT budget, count(*) AS queries, round(avg(CASE WHEN found > 0 THEN 1 ELSE 0 END), 8) AS hit_rate, round(avg(found / labels), 8) AS mean_recall, round(avg(coalesce(1 / first_rank, 0)), 8) AS mrr,
  count(*) FILTER (rendered > budget) AS violations, count(*) FILTER (rendered <> CASE WHEN query_id % 5 = 0 THEN 0 ELSE rendered END) AS mismatches FROM b GROUP BY budget""",
)
def budget_summary(spark, d):
    """Sizes stand in for rendered answers: 900 bytes for each rank down to the first relevant one."""
    rendered = F.coalesce("first_rank", F.lit(1)) * 900
    per = _retrieved(spark, d).withColumn("budget", F.explode(F.array(*map(F.lit, _BUDGETS)))).withColumns({"rendered": rendered, "consumed": F.when(F.col("query_id") % 5 == 0, 0).otherwise(rendered)})
    return evaluate.budget_summary(per, "budget").withColumns({c: F.round(c, 8) for c in ("hit_rate", "mean_recall", "mrr")})


@query("frontier_summary", "SELECT lang, CAST(place AS INTEGER) AS place, kind, reason, n FROM (SELECT lang, kind, substr(reason, 1, 160) AS reason, n, row_number() OVER (PARTITION BY lang ORDER BY kind, reason) AS place FROM (SELECT lang, coalesce(source, 'unresolved') AS kind, coalesce(CASE WHEN doc_id % 3 > 0 THEN repeat('r', CAST(150 + doc_id % 20 AS INT)) END, 'unknown') AS reason, count(*) AS n FROM documents GROUP BY ALL)) WHERE place <= 4")
def frontier_summary(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    reason = F.when(F.col("doc_id") % 3 > 0, F.repeat(F.lit("r"), (150 + F.col("doc_id") % 20).cast("int")))
    return evaluate.frontier_summary(docs.select("lang", F.col("source").alias("kind"), reason.alias("reason")), "lang")


_DEP = ("unchanged", "changed", "missing", "unresolved")


@query(
    "drift_flags",
    f"""WITH {_VER}, j AS (SELECT status, strlen(en.path) AS k, start_line AS s, ['unchanged', 'changed', 'missing', 'unresolved'] AS d FROM ver JOIN en USING (entry_id)),
f AS (SELECT status IN ('valid', 'relocated') AS ok, d[1 + k % 4] AS dep, d[1 + (k + s) % 3] AS anchor, d[1 + (k + s) % 4] IN ('changed', 'missing') OR d[1 + k // 2 % 4] IN ('changed', 'missing') AS ref FROM j)
SELECT count(*) AS samples, count(*) FILTER (ok) AS text_recoverable, count(*) FILTER (ok AND dep IN ('changed', 'missing')) AS additionally_flagged, count(*) FILTER (ok AND anchor = 'unchanged' AND ref) AS direct_reference_flag,
  count(*) FILTER (ok AND anchor IN ('changed', 'missing')) AS anchor_flag, count(*) FILTER (ok AND dep = 'unresolved') AS needs_review FROM f""",
)
def drift_flags(spark, d):
    """Text statuses are real; those of witnesses are drawn from the lengths of paths."""
    results, _, spans = verify.judged(_entries(spark, d), _after(spark, d))
    rows = results.join(spans.select("entry_id", F.octet_length("path").alias("k"), F.col("start_line").alias("s")), "entry_id")
    pick = lambda n: F.element_at(F.array(*map(F.lit, _DEP)), n + 1)
    k, s = F.col("k"), F.col("s")
    shown = rows.select(F.col("status").alias("source_status"), pick(k % 4).alias("dependency_status"), pick((k + s) % 3).alias("anchor_status"), F.array(pick((k + s) % 4), pick((F.floor(k / 2) % 4).cast("int"))).alias("references"))
    return evaluate.drift_summary(evaluate.drift_flags(shown))


def _attempts(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return rows.select(F.col("lang").alias("condition"), F.col("source").alias("drift"), (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 500, "short").alias("error_type"))


@query("failure_types", "SELECT lang AS condition, CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 500 THEN 'short' ELSE 'unknown' END AS error_type, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality <> 1 GROUP BY ALL")
def failure_types(spark, d):
    return evaluate.failure_types(_attempts(spark, d))


@query("passes_by_drift", "SELECT lang AS condition, source AS drift, count(*) FILTER (quality = 1) AS passed, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def passes_by_drift(spark, d):
    return evaluate.passes_by_drift(_attempts(spark, d))


@query(
    "suite_summary",
    """WITH c AS (SELECT ['unchanged', 'changed', 'missing', 'unresolved', 'invalid'][1 + doc_id % 5] AS expected, ['unchanged', 'changed', 'missing', 'unresolved', 'invalid'][1 + doc_id // 2 % 5] AS observed,
  doc_id % 4 = 0 AS fresh, doc_id % 3 = 0 AS usable, CAST(n_chars AS DOUBLE) AS capture, CAST(n_chars % 97 AS DOUBLE) AS verify, strlen(source) AS sidecar, n_chars AS bundle FROM documents)
SELECT count(*) AS cases, count(*) FILTER (expected = observed) AS correct, count(*) FILTER (expected IN ('changed', 'missing', 'invalid')) AS stale, count(*) FILTER (expected IN ('changed', 'missing', 'invalid') AND fresh) AS unsafe_by_witness,
  count(*) FILTER (expected IN ('changed', 'missing', 'invalid') AND usable) AS unsafe_by_text, count(*) FILTER (observed = 'unresolved') AS unresolved, count(*) FILTER (expected = 'unresolved' AND fresh) AS unresolved_as_fresh,
  median(capture) AS median_capture_ms, median(verify) AS median_verify_ms, CAST(median(sidecar) AS DOUBLE) AS median_sidecar_bytes, round(median(sidecar / nullif(bundle, 0)), 8) AS median_ratio FROM c""",
)
def suite_summary(spark, d):
    """Cases drawn from document numbers and sizes."""
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), F.array(*map(F.lit, (*_DEP, "invalid")))
    pick = lambda n: F.element_at(names, (n % 5 + 1).cast("int"))
    i, n = F.col("doc_id"), F.col("n_chars")
    cases = docs.select(pick(i).alias("expected"), pick(F.floor(i / 2)).alias("observed"), (i % 4 == 0).alias("fresh"), (i % 3 == 0).alias("text_usable"), n.cast("double").alias("capture_ms"), (n % 97).cast("double").alias("verify_ms"), F.octet_length("source").alias("sidecar_bytes"), n.alias("bundle_bytes"))
    return evaluate.suite_summary(cases).withColumn("median_ratio", F.round("median_ratio", 8))


@query("publication_export", rf"""WITH {_FILES}, p AS (SELECT path, text, regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+', '<redacted>', 'g'), 'AKIA[A-Z0-9]+', '<redacted>', 'g') AS safe FROM files)
SELECT path, sha256(safe) AS sha256, CAST(strlen(safe) AS BIGINT) AS n_bytes, safe <> text AS redacted FROM p""")
def publication_export(spark, d):
    return evaluate.publication(_files(spark, d), {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+", "key": "AKIA[A-Z0-9]+"}).drop("text")


@query("production_paths", f"WITH {_FILES} SELECT path, (starts_with(path, 'en/') OR starts_with(path, 'de/')) AND NOT contains('/' || lower(path), '/src3/') AS production FROM files")
def production_paths(spark, d):
    return _files(spark, d).select("path", evaluate.production(F.col("path"), ("en", "de/"), ("src3", "tests")).alias("production"))


@query("seeded_order", "SELECT doc_id, sha256('230921:' || doc_id) AS order_key FROM documents")
def seeded_order(spark, d):
    return evaluate.seeded_order(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id")


@query("bundle_render")
def bundle_render(spark, d):
    index = postings.Index(_once(spark, d).withColumn("cost", grouped.entry_bytes()), _queries(spark, d))
    best = kept(rank.top(postings.narrowed(index.packable(4000, written=True), 4000), None), "bundles")
    files = _files(spark, d).join(F.broadcast(best.select("path").distinct()), "path", "left_semi")
    found = corpus.chunks(files).join(F.broadcast(best.select("query_id", "id", "rank", "score", "total")), "id")
    return grouped.bundles(found.join(F.broadcast(_queries(spark, d)), "query_id"))
