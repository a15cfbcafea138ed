"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .minhash import near_dedup
from .packing import pack
from .quality import quality_rules
from .secret_scan import secret_scan
from .segmentations import sample_segmentations
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files
from .toxicity import toxicity
from .url_rules import PATTERNS, judge_urls
from .warc import archive_and_read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "words", end=2)
    return read_token_files(files)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "spaces", end=2)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("n_added")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), F.col("gone"))


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_segmentations": op4_segmentations,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filters": op9_url_filters,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
}

SPACES = r"[\x20\x09-\x0D]+"
_any_pattern = " OR ".join(f"regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p, _ in PATTERNS)
_fit = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"

# crc32 of a text of ASCII characters, bit by bit: a character is mixed in, then eight shifts (-1)
_crc32 = lambda x: f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({x}, '')])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295::BIGINT)"

ORACLE_SQL = {
    "op1_warc_index": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_substring_dedup": f"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest([array_to_string(w[i:i + 19], ' ') for i in range(1, len(w) - 18)]) AS g FROM t),
        d AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
        x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string([w[i] for i in range(1, len(w) + 1) if gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
        FROM t LEFT JOIN x USING (doc_id)""",
    "op9_url_filters": f"""
        WITH p AS (
            SELECT page_id, url,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3) AS path
            FROM pages),
        r AS (
            SELECT *, CASE WHEN {_fit("www.example.com", "/en/")} THEN 'www.example.com/en/' WHEN {_fit("example.com", "/en/")} THEN 'example.com/en/'
                           WHEN {_fit("net", "/es/")} THEN 'net/es/' WHEN {_fit("net", "/fr/")} THEN 'net/fr/' WHEN {_fit("com", "/")} THEN 'com/' END AS rule
            FROM p)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN coalesce({_any_pattern}, false) THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op10_minhash_near_dedup": f"""
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM t),
        g AS (SELECT unnest(s) AS g, doc_id FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.a WHERE r.m < e.b)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
        FROM s JOIN r ON r.a = doc_id GROUP BY doc_id, len(s)""",
    "op12_conversation_repair": f"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
        m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, n
              FROM k, range(2) c(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
        o AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i FROM m),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS q FROM o),
        f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM d),
        t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (q IS NOT NULL AND q || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
        g(a, r, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        one AS (SELECT a, b, CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS line FROM g WHERE r <> 's'),
        ins AS (SELECT DISTINCT a, a AS b, 0 AS c, '' AS l, CAST([] AS VARCHAR[]) AS w FROM g UNION ALL SELECT a, b, 3, 'I', [line] FROM one UNION ALL SELECT x.a, y.b, 6, 'II', [x.line, y.line] FROM one x JOIN one y ON y.a = x.b),
        p AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'l': '', 'w': CAST([] AS VARCHAR[])}} AS best FROM t
              UNION ALL
              SELECT conv_id, i, s, min(best) AS best FROM (
                  SELECT p.conv_id, f.i, CASE WHEN e = 'D' THEN ins.b ELSE g.b END AS s,
                         {{'c': best.c + ins.c + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'l': best.l || ins.l || e,
                           'w': best.w || ins.w || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE g.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END}} AS best
                  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins ON ins.a = p.s CROSS JOIN (VALUES ('D'), ('K'), ('R')) v(e)
                       LEFT JOIN g ON g.a = ins.b AND e <> 'D' AND CASE e WHEN 'K' THEN g.r = f.r ELSE g.r <> 's' END
                  WHERE e = 'D' OR (g.b IS NOT NULL AND coalesce(fault, '') NOT IN ('blank', 'duplicate'))) GROUP BY conv_id, i, s),
        z AS (SELECT p.conv_id, min({{'c': best.c + ins.c, 'l': best.l || ins.l, 'w': best.w || ins.w}}) AS best FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.i JOIN ins ON ins.a = p.s AND ins.b IN (0, 3) GROUP BY p.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(array_to_string(best.w, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
