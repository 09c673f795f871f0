"""The operators as registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, chat_repair, embedding_dedup, exact_topk, language_id, mixing, near_dedup, packing, pii, secrets, spelling, url_filters
from ._spans import digests
from ._shared import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts: n_shingles 0, own component, kept. Null ids: no component. Rows of one id are one document; an empty table gives no rows."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and ones without a letter are ``und`` with score 0; a null id is never held out; repeated rows get equal results; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "text")
    return language_id.identify(rows, language_id.train(docs), keep=["doc_id", "held_out"])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no spans and the digest of an empty string; repeated rows get equal results; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return digests(secrets.scan(docs, secrets.train(docs)), secrets.KINDS, 3)


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts, parent domains and first path parts of ``pages``, as the tables have none.

    Digits of a pattern's MD5 choose whether and when it is added, removed 150 days later and added again 300 days later.
    """
    url = pages.select(url_filters.host_of(F.col("url")).alias("host"), url_filters.path_of(F.col("url")).alias("path")).where("host IS NOT NULL")
    first = F.regexp_extract("path", "^/*([^/]+)", 1)
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    names = url.select(F.explode(F.array("host", parent, F.concat("host", F.lit("/"), first))).alias("pattern")).distinct()
    digit = lambda i, n: F.conv(F.substring(F.md5("pattern"), i, n), 16, 10).cast("int")
    start = F.date_add(F.lit("2023-01-01").cast("date"), digit(2, 3) % 700)
    entries = names.select("pattern", digit(1, 1).alias("d"), start.alias("start")).where("d < 6")
    steps = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(days).alias("days"), F.lit(below).alias("below")) for a, days, below in (("add", 0, 6), ("remove", 150, 4), ("add", 300, 2))])
    entries = entries.select("pattern", "d", "start", F.inline(steps)).where("d < below")
    return entries.select("pattern", "action", F.date_add("start", F.col("days")).alias("at"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are ``pages``; the tables have no fetch times, so page_id gives one within two years."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(730)).cast("int"))
    found = url_filters.evaluate(pages.withColumn("fetched", fetched), dated_list(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null role or text is empty; a turn with a null id is a conversation of its own; repeated rows are turns of their own; an empty table gives no rows."""
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vectors, ones with null or non-finite components and null ids take no part; equal rows each count; ties go to the smaller id; an empty table gives no rows."""
    return exact_topk.search(table(spark, sf_dir, "embeddings"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty, zero and non-finite vectors and null labels link with nothing; repeated rows are vectors of their own; an empty table gives no rows."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no spans and the digest of an empty string; repeated rows get equal results; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return digests(pii.scan(docs, pii.train(docs)), pii.KINDS, 4)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has size 0 and takes 0; a null source is one of its own; rows of one id are ordered by size; an empty table gives no rows."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is one piece of one id; null ids stay; repeated rows get places of their own; an empty table gives no rows."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no words, a null id counts as an empty one in the checksum, repeated rows count each; ties go to the smaller word; an empty table gives no rows."""
    return spelling.variants(spelling.words_of(table(spark, sf_dir, "documents")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no ids and the digests of nothing; null ids stay; repeated rows get equal results; an empty table gives no rows."""
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return found.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults where the checksum of ``conv_id:turn`` says so; a null is one space throughout, but keeps its place in order."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("h")).where("h <> 0")
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts are one space, null turns come first, a null id is a conversation; rows of one turn go by a hash of role and text; an empty table gives no rows."""
    turns = table(spark, sf_dir, "conversations")
    audits, repaired = chat_repair.repair(damaged(turns))
    digest = chat_repair.digests(repaired).select(F.col("conv_id").alias("_digest_of"), "sha256")
    audits = audits.withColumnRenamed("conv_id", "_audit_of")
    rows = turns.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("_audit_of")), "left")
    rows = rows.join(digest, F.col("conv_id").eqNullSafe(F.col("_digest_of")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The water level that fills the targets is found from the order of size / weight, as shares grow by weight alone.
OP4_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM rows GROUP BY source
), weighted AS (
  SELECT source, s, (i - 1) % 3 + 1 AS w, sum(s) OVER () AS total FROM sources
), ordered AS (
  SELECT *, coalesce(sum(3 * s) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w,
         row_number() OVER (ORDER BY s / w, source NULLS LAST) AS n
  FROM weighted WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT *, (total - capped) / open_w AS share FROM ordered
), cutoff AS (
  SELECT min(n) AS n FROM level WHERE share * w <= 3 * s
), targets AS (
  SELECT l.source, l.s, CASE WHEN l.n < c.n THEN 3 * l.s ELSE (SELECT (total - capped) * l.w / open_w FROM level WHERE n = c.n) END::DOUBLE AS target
  FROM level l, cutoff c
), ranked AS (
  SELECT r.*, t.s AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM ranked
"""

OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
), lowest AS (
  SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), found AS (
  SELECT x AS vec_id, min(y) AS y FROM reach GROUP BY x
), counts AS (
  SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(y, e.vec_id)) AS component_id, e.vec_id <= coalesce(y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN found USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP3_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, DATE '2023-01-01' + (page_id % 730)::INTEGER AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?([^?#]*)', 1)), '\.$', ''), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?([^?#]*)', 2) AS path
  FROM pages
), names AS (
  SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]*\.', ''), host || '/' || regexp_extract(path, '^/*([^/]+)', 1)]) AS pattern
  FROM parsed WHERE host IS NOT NULL
), started AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 1))::INTEGER AS d,
         DATE '2023-01-01' + ('0x' || substr(md5(pattern), 2, 3))::INTEGER % 700 AS start
  FROM names
), entries AS (
  SELECT pattern, 'add' AS action, start AS day FROM started WHERE d < 6
  UNION ALL SELECT pattern, 'remove', start + 150 FROM started WHERE d < 4
  UNION ALL SELECT pattern, 'add', start + 300 FROM started WHERE d < 2
), valid AS (
  SELECT pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM entries
), hits AS (
  SELECT p.page_id, p.url, count(*) AS n,
         min(struct_pack(size := -length(v.pattern), pattern := v.pattern, since := v.valid_from)) AS best
  FROM parsed p JOIN valid v
    ON v.action = 'add' AND p.fetched >= v.valid_from AND (v.valid_to IS NULL OR p.fetched < v.valid_to)
   AND (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern)
        OR starts_with(regexp_replace(p.host || '/' || p.path || '/', '/+', '/', 'g'), v.pattern || '/') AND contains(v.pattern, '/'))
  GROUP BY p.page_id, p.url
)
SELECT p.page_id, p.url, p.fetched::VARCHAR AS fetched, p.host, h.n IS NOT NULL AS blocked, coalesce(h.n, 0)::BIGINT AS n_entries, h.best.pattern AS pattern, h.best.since::VARCHAR AS since
FROM parsed p LEFT JOIN hits h ON p.page_id = h.page_id AND p.url = h.url
"""

OP7_SQL = """
WITH convs AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, sha256(text)) AS said,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text)) AS chat
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), alone AS (
  SELECT DISTINCT coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NULL
)
SELECT a.conv_id, a.n_turns, a.chat FROM convs a
WHERE NOT EXISTS (SELECT 1 FROM convs b WHERE b.said[1] = a.said[1] AND b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)
  AND NOT EXISTS (SELECT 1 FROM convs b WHERE b.said = a.said AND b.conv_id < a.conv_id)
UNION ALL
SELECT NULL, 1, '<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10) FROM alone
WHERE NOT EXISTS (SELECT 1 FROM convs b WHERE b.said[1].r = alone.r AND b.said[1].t = alone.t)
"""

#: The checksum's table, and the checksum of a list of bytes by it.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_of(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), lower AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7
), distinct_runs AS (
  SELECT id, run, count(*) AS n FROM lower GROUP BY id, run
), checked AS (
  SELECT run, n, {crc_of("flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c) - 64] END))")} AS h
  FROM distinct_runs, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n FROM checked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word AS x, b.word AS y, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
), best AS (
  SELECT x, count(*) AS n_near, min(struct_pack(m := -m, y := y)) AS b FROM pairs GROUP BY x
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.y END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END::BIGINT AS form_n
  FROM words w LEFT JOIN best ON x = w.word
), paths AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT p.word, p.next, f.form FROM paths p JOIN forms f ON f.word = p.next
)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, root FROM paths WHERE next IS NULL) USING (word)
"""

#: From a conversation's end to its beginning: the cheapest audit from each state, with the lines that it makes. States: nothing yet, system, user, assistant.
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_of("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)")} % 20 AS h
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM told
), placed AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n_rows,
         left(role, 1) AS r, lag(left(role, 1)) OVER o AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy)
), rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault,
         role || ':' || text || chr(10) AS line, 'user:' || text || chr(10) AS as_user, 'assistant:' || text || chr(10) AS as_assistant
  FROM placed
), solved AS (
  SELECT conv_id, n_rows + 1 AS i, [struct_pack(c := 0, a := '', s := ''), struct_pack(c := 6, a := 'II', s := 'user:' || chr(10) || 'assistant:' || chr(10)),
         struct_pack(c := 3, a := 'I', s := 'assistant:' || chr(10)), struct_pack(c := 0, a := '', s := '')] AS v
  FROM (SELECT DISTINCT conv_id, n_rows FROM rows)
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_min([w[s],
           struct_pack(c := w3[CASE s WHEN 3 THEN 4 ELSE 3 END].c + 3, a := 'I' || w3[CASE s WHEN 3 THEN 4 ELSE 3 END].a, s := CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || chr(10) || w3[CASE s WHEN 3 THEN 4 ELSE 3 END].s)]))
  FROM (
    SELECT conv_id, i, w, list_transform([1, 2, 3, 4], lambda s: list_min([w[s],
             struct_pack(c := w[CASE s WHEN 3 THEN 4 ELSE 3 END].c + 3, a := 'I' || w[CASE s WHEN 3 THEN 4 ELSE 3 END].a, s := CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || chr(10) || w[CASE s WHEN 3 THEN 4 ELSE 3 END].s)])) AS w3
    FROM (
      SELECT r.conv_id, r.i, list_transform([1, 2, 3, 4], lambda s: list_min(list_concat(
               [struct_pack(c := v[s].c + 4, a := 'D' || v[s].a, s := v[s].s)],
               CASE WHEN r.fault NOT IN (1, 2) AND (s = 1 AND r.r IN ('s', 'u') OR s IN (2, 4) AND r.r = 'u' OR s = 3 AND r.r = 'a')
                    THEN [struct_pack(c := v[CASE r.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + r.fault, a := 'K' || v[CASE r.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a, s := r.line || v[CASE r.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].s)] ELSE [] END,
               CASE WHEN r.fault NOT IN (1, 2)
                    THEN [struct_pack(c := v[CASE s WHEN 3 THEN 4 ELSE 3 END].c + 3 + r.fault, a := 'R' || v[CASE s WHEN 3 THEN 4 ELSE 3 END].a, s := CASE s WHEN 3 THEN r.as_assistant ELSE r.as_user END || v[CASE s WHEN 3 THEN 4 ELSE 3 END].s)] ELSE [] END))) AS w
      FROM solved p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1
    )
  )
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(v[1].s[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.i = 1
"""

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_mixing": op4_mixing,
    "op5_exact_topk": op5_exact_topk,
    "op6_secrets": op6_secrets,
    "op7_chat_format": op7_chat_format,
    "op8_pii": op8_pii,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_chat_repair": op13_chat_repair,
}
ORACLES = {
    "op1_near_dedup": OP1_SQL,
    "op3_url_filters": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op5_exact_topk": OP5_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op11_spelling": OP11_SQL,
    "op13_chat_repair": OP13_SQL,
}
