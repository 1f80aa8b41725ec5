"""The registered queries of this folder, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import (
    arc_to_warc, bounded_clusters, brown_classes, byte_bpe, co_training, dart_minhash, framed_records, lexical_packing,
    prefix_trie, quality_rules, string_tiling, suffix_trees, wrapper_induction,
)
from rollcall.llm.shared import prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepared(spark), folder)

        QUERIES[name] = run
        return build

    return register


@query("op9_quality_rules")
def op9(spark, folder):
    return quality_rules.quality(table(spark, folder, "documents"))


@query("op1_byte_bpe")
def op1(spark, folder):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encoded_and_decoded(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_string_tiling")
def op3(spark, folder):
    return string_tiling.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_arc_to_warc")
def op4(spark, folder):
    return arc_to_warc.archived_and_read(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_arc_to_warc"] = """
WITH sized AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digested AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM sized),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM digested)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN owner END AS refers_to
FROM owned"""


@query("op8_framed_records")
def op8(spark, folder):
    read = framed_records.written_and_read(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query("op10_suffix_trees")
def op10(spark, folder):
    return suffix_trees.deduplicated(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_dart_minhash")
def op6(spark, folder):
    return dart_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op2_brown_classes")
def op2(spark, folder):
    return brown_classes.scored(table(spark, folder, "documents"))


@query("op7_wrapper_induction")
def op7(spark, folder):
    return wrapper_induction.main_texts(table(spark, folder, "pages"))


@query("op5_co_training")
def op5(spark, folder):
    return co_training.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_prefix_trie")
def op11(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# CRC-32 of a decimal: eight steps per digit, the first of which takes the digit in.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({c}::VARCHAR) + 1), lambda i:
 [ascii(substr({c}::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

ORACLES["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(c="conv_id")} % 9 AS h, max(pos) + 1 AS size FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(h, coalesce(b.size, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS b, size FROM c) b ON b.b = c.base),
r AS (SELECT k.conv_id, pos + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos < k.taken
 UNION ALL SELECT k.conv_id, taken + pos - h + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos >= k.h),
e AS (SELECT conv_id, depth, octet_length(encode(text)) AS bytes, count(*) OVER (PARTITION BY conv_id) AS size,
 list(sha256(octet_length(encode(role)) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r),
p AS MATERIALIZED (SELECT conv_id, depth, bytes, size, sha256(array_to_string(path, ',')) AS node, sha256(array_to_string(path[:-2], ',')) AS parent FROM e
 UNION ALL SELECT conv_id, 0, 0, (SELECT count(*) FROM r WHERE r.conv_id = k.conv_id), sha256(''), NULL FROM k),
n AS MATERIALIZED (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends FROM p GROUP BY node),
ch AS (SELECT parent, count(*) AS n FROM n GROUP BY parent),
under AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT top, count(*) FILTER (ch.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
 FROM under JOIN n ON n.node = under.node LEFT JOIN ch ON ch.parent = n.node GROUP BY top)
SELECT n.conv_id, cast(n.depth AS bigint) AS depth, up.conv_id AS parent_conv_id, n.n_convs, cast(coalesce(ch.n, 0) AS bigint) AS n_children,
 s.n_leaves, cast(s.saved AS bigint) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.top = n.node LEFT JOIN ch ON ch.parent = n.node LEFT JOIN n up ON up.node = n.parent"""


@query("op12_heap_bounds")
def op12(spark, folder):
    return bounded_clusters.clustered(table(spark, folder, "embeddings"), k=40, rounds=5, salt="2:")


def _assigned(i: int) -> str:
    """Every vector with the centroid of round ``i`` that is nearest to it, and the squared distance."""
    return f"""a{i} AS MATERIALIZED (SELECT id, vec_id, any_value(v.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c.c)) AS best
 FROM kept v CROSS JOIN c{i} c GROUP BY id, vec_id)"""


def _moved(i: int) -> str:
    return f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM (
  SELECT best.c AS c, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM a{i}, range(1, 65) r(i) GROUP BY best.c, i) GROUP BY c) n ON n.c = o.c)"""


ORACLES["op12_heap_bounds"] = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM kept QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40),
{", ".join(f"{_assigned(i)}, {_moved(i)}" for i in range(5))}, {_assigned(5)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
 sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.c = best.c"""


@query("op13_lexical_packing")
def op13(spark, folder):
    return lexical_packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
