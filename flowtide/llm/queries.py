"""The operators applied to their whole tables, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.llm.bpe import decode_documents, encode_documents, vocabulary
from flowtide.llm.embedding_dedup import embedding_near_duplicates
from flowtide.llm.kneser_ney import quality_classifier
from flowtide.llm.language_id import language_id
from flowtide.llm.line_dedup import remove_widespread_lines
from flowtide.llm.ngram_join import ngram_jaccard_join
from flowtide.llm.packing import cut_documents, pack
from flowtide.llm.piece_bpe import decode_pieces, encode_pieces, piece_model
from flowtide.llm.prefix_trie import graft_heads, prefix_trie, turn_keys
from flowtide.llm.quality_rules import quality_rules
from flowtide.llm.quotation import link_quotations
from flowtide.llm.secret_scan import scan_secrets
from flowtide.llm.token_alignment import align_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = vocabulary("byte_bpe_50k.json")
    encoded = encode_documents(_table(spark, sf_dir, "documents"), load)
    return decode_documents(encoded, load).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, with_ids=False)
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_widespread_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(_table(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("p_good")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    # The quantile itself; of those tried it parts held-out labelled documents best (README).
    return quality_classifier(_table(spark, sf_dir, "documents"), trusted, quantile=0.97, slack=1.0)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = piece_model("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents"), load, packed=True), load)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*graft_heads(cut(turn_keys(_table(spark, sf_dir, "conversations")))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), piece_model("piece_bpe_32k.model"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe_round_trip, op2_cutting_stock_packing, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_line_dedup, op6_quotation_linking, op7_language_id, op8_quality_rules, op9_quality_classifier, op10_secret_scans,
        op11_piece_round_trip, op12_prefix_trie, op13_token_alignment)
}

ORACLES: dict[str, str] = {
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, turn, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS x,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(sha256(x) ORDER BY turn NULLS FIRST, md5(x)) AS s, list(w ORDER BY turn NULLS FIRST, md5(x)) AS w
            FROM t GROUP BY conv_id
        ), shift AS (
            -- the unsigned CRC-32 of the decimal id, bit by bit
            SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
            FROM own
        ), built AS (
            SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:h], a.s[h + 1:]) AS s, list_concat(coalesce(b.w, [])[1:h], a.w[h + 1:]) AS w
            FROM shift a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
        ), places AS (SELECT conv_id, s, w, unnest(range(0, len(s) + 1)) AS depth FROM built),
        nodes AS (
            SELECT s[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * any_value(w[depth]), 0) AS value,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256
            FROM places GROUP BY ALL
        ), kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
        up AS (SELECT k[1:d] AS k, n_children, value FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes)),
        sums AS (SELECT k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(value) AS saved_tokens FROM up GROUP BY k)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN sums USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.k[1:n.depth - 1] AND p.depth = n.depth - 1
    """,
    "op6_quotation_linking": r"""
        WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
        split AS (
            SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM m
        ), marked AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)*') AS marks, regexp_matches(line, '(?i)\bwrote:[ \t\r]*$') AS intro FROM split),
        parsed AS (
            SELECT *, len(marks) - len(replace(marks, '>', '')) AS level,
                trim(regexp_replace(substr(line, len(marks) + 1), '\s+', ' ', 'g')) AS body
            FROM marked
        ), cuts AS (
            SELECT *, coalesce(lag(level) OVER w <> level OR lag(body) OVER w = '' OR lag(intro) OVER w, TRUE) AS starts
            FROM parsed WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
        ), runs AS (
            SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM cuts
        ), passages AS (
            SELECT conv_id, turn, level, lower(string_agg(body, ' ' ORDER BY i)) AS norm
            FROM runs WHERE body <> '' AND NOT intro GROUP BY conv_id, turn, level, run
        ), originals AS (SELECT conv_id, norm, min(turn) AS origin FROM passages WHERE level = 0 GROUP BY ALL),
        links AS (
            SELECT q.conv_id, q.turn, max(origin) FILTER (WHERE level = 1) AS direct, max(origin) AS any_level, count(*) AS n_linked
            FROM passages q JOIN originals o ON o.conv_id = q.conv_id AND o.norm = q.norm
            WHERE level > 0 AND origin < q.turn GROUP BY ALL
        ), quotes AS (SELECT conv_id, turn, count(*) AS n_quotes, max(level) AS depth FROM passages WHERE level > 0 GROUP BY ALL),
        own AS (
            SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i)
                FILTER (WHERE NOT regexp_matches(line, '^[ \t]*>') AND NOT intro) AS text
            FROM parsed GROUP BY ALL
        ), parents AS (
            SELECT conv_id, turn, role, coalesce(direct, any_level, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS parent_turn,
                any_level IS NOT NULL AS by_quote, coalesce(n_linked, 0) AS n_linked
            FROM m LEFT JOIN links USING (conv_id, turn)
        )
        SELECT conv_id, turn, role, parent_turn, by_quote, coalesce(n_quotes, 0) AS n_quotes, n_linked, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
            row_number() OVER (PARTITION BY conv_id ORDER BY parent_turn NULLS FIRST, turn) - 1 AS position,
            coalesce(trim(text, chr(10)), '') AS text
        FROM parents LEFT JOIN quotes USING (conv_id, turn) LEFT JOIN own USING (conv_id, turn)
    """,
    "op5_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents
        ), lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM split),
        wide AS (
            SELECT body, min((doc_id, pos)) AS first_at FROM lines WHERE length(body) >= 20
            GROUP BY body HAVING count(DISTINCT source) >= 8
        ), marked AS (
            SELECT doc_id, pos, line, wide.body IS NOT NULL AND (doc_id, pos) <> first_at AS gone
            FROM lines LEFT JOIN wide USING (body)
        )
        SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM marked GROUP BY doc_id
    """,
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words
        ), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
            FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
            WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)
        ), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (
            SELECT doc_id, doc_id AS seen FROM sets
            UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.seen
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
        FROM sets JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
    """,
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), good AS (
            SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT vec_id, vec_id AS seen FROM embeddings
            UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.seen
        ), least_id AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id),
        counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least_id LEFT JOIN counts USING (vec_id)
    """,
}
