"""Queries over text: documents are streams of one packet, conversations streams of turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalogue.common import Catalogue, table
from tidegate.functions import filters, packets, text
from tidegate.operators import chunker, telemetry
from tidegate.sources import files

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


# Fixed value: what counts as White_Space.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TRIM = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def _cuts(boundaries: list[str], min_length: int, ends: list[str]) -> str:
    """A recursive query that cuts as the chunker does. Streams of several turns feed the buffer one after another."""
    lit = lambda s: "'" + s.replace("\n", "'||chr(10)||'") + "'"
    cases = " ".join(f"WHEN instr(buf, {lit(b)}) > 0 THEN instr(buf, {lit(b)}) + {len(b) - 1}" for b in boundaries)
    ended = " OR ".join(f"ends_with(buf, {lit(e)})" for e in ends)
    return f"""
WITH RECURSIVE r(doc_id, buf, chunk, n) AS (
  SELECT doc_id, text, NULL::VARCHAR, 0 FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, substr(buf, cut + 1), CASE WHEN whole THEN buf ELSE trim(substr(buf, 1, cut), ' ' || chr(9) || chr(10) || chr(13)) END, n + 1
  FROM (SELECT *, CASE WHEN strlen(buf) < {min_length} THEN 0 {cases} WHEN {ended} THEN length(buf) ELSE 0 END AS cut,
               NOT ({" OR ".join(f"instr(buf, {lit(b)}) > 0" for b in boundaries)}) AS whole FROM r)
  WHERE cut > 0
), z AS (SELECT doc_id, buf, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM r)
SELECT doc_id, n::BIGINT AS chunk_no, chunk FROM r WHERE n > 0
UNION ALL SELECT doc_id, (n + 1)::BIGINT, buf FROM z WHERE k = 1 AND buf <> ''"""


@C.add("SELECT count(*) AS n_packets FROM documents")
def passthrough_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_packets"))


@C.add("""SELECT doc_id, c // 8192 AS chunk_no, least(8192, strlen(text) - c) AS n_bytes
FROM (SELECT doc_id, text, unnest(range(0, strlen(text), 8192)) AS c FROM documents WHERE strlen(text) > 0)""")
def file_chunks(spark, sf_dir):
    got = files.chunked(table(spark, sf_dir, "documents"), F.encode("text", "UTF-8"), 8192, "doc_id")
    return got.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.octet_length("data").cast("long").alias("n_bytes"))


@C.add("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 100).alias("preview"))


@C.add("SELECT doc_id, CASE WHEN strlen(text) > 400 THEN substr(text, 1, 400) || '...[truncated]' ELSE text END AS redacted FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text"), 400).alias("redacted"))


@C.add("SELECT event_id, CASE WHEN strlen(props) > 8 THEN substr(props, 1, 8) || '...[truncated]' ELSE props END AS redacted FROM events")
def redact_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.redact(F.col("props"), 8).alias("redacted"))


@C.add("""SELECT conv_id, turn, '{"Text":' || to_json(text)::VARCHAR || '}' AS packet FROM conversations""")
def json_text_packet(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", packets.to_tagged_json(F.lit("Text"), F.col("text")).alias("packet"))


def _sanitized(kept: str, ends: str) -> str:
    return f"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^{kept}]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[{ends}]$') OR t = '' THEN t ELSE t || '.' END AS clean FROM s"""


@C.add(_sanitized("A-Za-z0-9 .,!?\\-''\"\\n:;¡¿À-Ÿ", ".!?"))
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text"), "wide").alias("clean"))


@C.add(_sanitized("A-Za-z0-9 .,!?\\-''\"\\n:;À-Ÿ一-鿿。，！？、；：（）", ".!?。！？"))
def sanitize_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text"), "cjk").alias("clean"))


@C.add(_sanitized("A-Za-z0-9 .,!?\\-''\"\\n:;", ".!?"))
def sanitize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text"), "ascii").alias("clean"))


@C.add(_cuts(chunker.SENTENCES, 10, list(chunker.SENTENCE_ENDS)))
def chunk_sentences(spark, sf_dir):
    return chunker.chunks(table(spark, sf_dir, "documents"), "doc_id", ["doc_id"], "text", "sentences")


@C.add(_cuts(chunker.CLAUSES, 10, list(chunker.CLAUSE_ENDS)))
def chunk_clauses(spark, sf_dir):
    return chunker.chunks(table(spark, sf_dir, "documents"), "doc_id", ["doc_id"], "text", "clauses")


@C.add("""
WITH RECURSIVE r(doc_id, buf, chunk, n) AS (
  SELECT doc_id, text, NULL::VARCHAR, 0 FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, ltrim(substr(buf, length(cut) + 1), ' ' || chr(9) || chr(10) || chr(13)), trim(cut, ' ' || chr(9) || chr(10) || chr(13)), n + 1
  FROM (SELECT *, regexp_extract(buf, '^(?s:.)(?:\\S*\\s){5}') AS cut FROM r)
  WHERE cut <> '' AND len(list_filter(regexp_split_to_array(buf, '\\s+'), lambda x: x <> '')) >= 5
), z AS (SELECT doc_id, buf, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM r)
SELECT doc_id, n::BIGINT AS chunk_no, chunk FROM r WHERE n > 0
UNION ALL SELECT doc_id, (n + 1)::BIGINT, buf FROM z WHERE k = 1 AND buf <> ''""")
def chunk_words(spark, sf_dir):
    return chunker.chunks(table(spark, sf_dir, "documents"), "doc_id", ["doc_id"], "text", "words")


def _fed(boundaries: list[str], min_length: int, ends: list[str]) -> str:
    """A recursive query that feeds a conversation's turns to one buffer and cuts after each as the chunker does."""
    lit = lambda s: "'" + s.replace("\n", "'||chr(10)||'") + "'"
    cases = " ".join(f"WHEN instr(buf, {lit(b)}) > 0 THEN instr(buf, {lit(b)}) + {len(b) - 1}" for b in boundaries)
    ended = " OR ".join(f"ends_with(buf, {lit(e)})" for e in ends)
    none = " AND ".join(f"instr(buf, {lit(b)}) = 0" for b in boundaries)
    cut = f"CASE WHEN NOT fed OR strlen(buf) < {min_length} THEN 0 {cases} WHEN {ended} THEN length(buf) ELSE 0 END"
    # fed: the buffer may be cut; else the next turn is added to it.
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r(conv_id, k, buf, fed, chunk, n) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', FALSE, NULL::VARCHAR, 0::BIGINT FROM c
  UNION ALL
  SELECT s.conv_id, CASE WHEN cut = 0 THEN s.k + 1 ELSE s.k END, CASE WHEN cut > 0 THEN substr(buf, cut + 1) ELSE buf || c.text END, cut > 0 OR c.text <> '',
         CASE WHEN cut > 0 THEN CASE WHEN whole THEN buf ELSE trim(substr(buf, 1, cut), ' ' || chr(9) || chr(10) || chr(13)) END END, CASE WHEN cut > 0 THEN n + 1 ELSE n END
  FROM (SELECT *, {cut} AS cut, {none} AS whole FROM r) s LEFT JOIN c ON c.conv_id = s.conv_id AND c.k = s.k + 1
  WHERE cut > 0 OR c.k IS NOT NULL
), z AS (SELECT conv_id, buf, n, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC, n DESC, chunk IS NULL) AS last FROM r)
SELECT conv_id, n AS chunk_no, chunk FROM r WHERE chunk IS NOT NULL
UNION ALL SELECT conv_id, n + 1, buf FROM z WHERE last = 1 AND buf <> ''"""


@C.add(_fed(chunker.SENTENCES, 10, list(chunker.SENTENCE_ENDS)))
def chunk_turns(spark, sf_dir):
    """Turns of a conversation feed one buffer; a cut can fall between two of them."""
    return chunker.chunks(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", "sentences")


@C.add(f"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(9) || chr(160) || chr(10) WHEN 1 THEN chr(8195) || text || ' <unk>' || chr(10) ELSE text END AS t FROM conversations)
SELECT conv_id, turn, trim(replace(t, '<unk>', ''), {TRIM}) AS kept FROM c WHERE trim(t, {TRIM}) <> ''""")
def translate_skip_empty(spark, sf_dir):
    """Turns of White_Space alone are skipped; marks of unknown words and White_Space around go."""
    odd = F.when(F.col("turn") % 4 == 0, F.lit("\t\u00a0\n")).when(F.col("turn") % 4 == 1, F.concat(F.lit("\u2003"), F.col("text"), F.lit(" <unk>\n"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("text", odd).where(~text.blank(F.col("text")))
    return rows.select("conv_id", "turn", text.translated(F.col("text")).alias("kept"))


@C.add("""SELECT conv_id, turn, 'text.received' AS event_type, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, strlen(text)::BIGINT AS length FROM conversations""")
def telemetry_text(spark, sf_dir):
    return telemetry.text_events(table(spark, sf_dir, "conversations"), F.col("text"), "conv_id", "turn")


@C.add("""SELECT conv_id, sum(strlen(text))::BIGINT AS n_bytes, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def file_write_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("data", F.encode("text", "UTF-8"))
    got = files.concatenated(rows, "conv_id", "turn", "data")
    return got.select("conv_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


@C.add("SELECT page_id, coalesce(NULL, CASE WHEN html LIKE '%<html%' THEN 'text/html' END, 'application/octet-stream') AS content_type FROM pages")
def output_content_type(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    own = F.when(F.contains("html", F.lit("<html")), F.lit("text/html"))
    return rows.select("page_id", files.content_type(F.lit(None).cast("string"), own).alias("content_type"))


@C.add("""SELECT page_id, c // 4096 AS chunk_no, least(4096, strlen(html) - c) AS n_bytes
FROM (SELECT page_id, html, unnest(range(0, strlen(html), 4096)) AS c FROM pages WHERE strlen(html) > 0)""")
def fetch_chunks(spark, sf_dir):
    """A fetched body in chunks of one size and a remainder."""
    got = files.chunked(table(spark, sf_dir, "pages"), F.encode("html", "UTF-8"), 4096, "page_id")
    return got.select("page_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.octet_length("data").cast("long").alias("n_bytes"))


@C.add("""SELECT page_id, starts_with(url, 'https://thther.example.org/en/') OR starts_with(url, 'http://therha.example.com/') OR starts_with(url, 'https://therin.example.net/en/') AS permitted FROM pages""")
def url_allow_list(spark, sf_dir):
    rules = ["https://thther.example.org/en/*", "http://therha.example.com/*", "https://therin.example.net/en/*"]
    return table(spark, sf_dir, "pages").select("page_id", filters.url_allowed(F.col("url"), rules).alias("permitted"))


@C.add("""SELECT page_id, starts_with(url, 'https://') AND url LIKE 'https://%.example.org/%' AND page_id % 3 <> 0 AS permitted FROM pages""")
def url_rules_with_methods(spark, sf_dir):
    """Wildcards in the host, and a list of methods."""
    method = F.when(F.col("page_id") % 3 == 0, "DELETE").when(F.col("page_id") % 3 == 1, "get").otherwise("Post")
    return table(spark, sf_dir, "pages").select("page_id", filters.url_allowed(F.col("url"), ["https://*.example.org/*"], method, ["GET", "POST"]).alias("permitted"))


_PATHS = "CASE doc_id % 5 WHEN 0 THEN 'data/' || doc_id WHEN 1 THEN 'data/../' || doc_id WHEN 2 THEN '/srv/data/./x' || doc_id WHEN 3 THEN '../data/' || doc_id ELSE 'data/../data/' || doc_id END"


@C.add(f"SELECT doc_id, {_PATHS} AS path, doc_id % 5 IN (0, 2, 4) AS may_read, doc_id % 5 IN (0, 2) AS may_write FROM documents")
def path_rules(spark, sf_dir):
    """Paths are resolved before rules are tried; one with `..` is never written."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATHS).alias("path"))
    return rows.select("doc_id", "path", filters.read_allowed(F.col("path"), ["data/*"], "/srv").alias("may_read"), filters.write_allowed(F.col("path"), ["/srv/data/*"], "/srv").alias("may_write"))


_WORDS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@C.add(f"""WITH h AS (SELECT conv_id, list_reduce(list_transform(range(1, strlen('session-' || conv_id) + 1), lambda i: ascii(substr('session-' || conv_id, i::INT, 1))::HUGEINT),
  lambda a, b: (xor(a, b) * {filters.PRIME}::HUGEINT) % 18446744073709551616::HUGEINT, {filters.OFFSET}::HUGEINT) AS h FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, {_WORDS(filters.ADJECTIVES)}[(h % {len(filters.ADJECTIVES)})::INT + 1] || '-' || {_WORDS(filters.NOUNS)}[((h // 256) % {len(filters.NOUNS)})::INT + 1] || '-' || lower(lpad(to_hex(((h // 65536) % 65536)::BIGINT), 4, '0')) AS name FROM h""")
def session_names(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", filters.session_name(F.concat(F.lit("session-"), F.col("conv_id").cast("string"))).alias("name"))


@C.add("""SELECT conv_id::VARCHAR AS stream_id, count(*) AS received, count(*) FILTER (WHERE role <> 'user') AS discarded FROM conversations GROUP BY 1""")
def kind_policies(spark, sf_dir):
    """Roles act as packet kinds; a node takes those of users and counts the others."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("role").alias("kind"))
    return filters.discards(rows, ["User"])


@C.add("SELECT conv_id, turn FROM conversations WHERE strlen(text) >= 10 AND NOT starts_with(text, 'OpusHead') AND NOT starts_with(text, 'OpusTags')")
def small_packet_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("data", F.encode("text", "UTF-8"))
    return rows.where(filters.audio_packet(F.col("data"))).select("conv_id", "turn")


@C.add("SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0")
def track_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(filters.default_track(F.col("turn") % 3)).select("conv_id", "turn")


@C.add("""SELECT doc_id, 'stt.result' AS event_type, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_preview, strlen(text)::BIGINT AS text_length,
len(string_split(text, chr(10)))::BIGINT AS segment_count, lang AS language FROM documents WHERE text IS NOT NULL""")
def stt_result_events(spark, sf_dir):
    """Documents act as transcriptions, their lines as segments."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return telemetry.transcription_events(rows, F.col("text"), F.split("text", "\n"), F.col("lang"), "doc_id")
