"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    audio_features,
    chat_format,
    exact_dedup,
    fill_middle,
    language_id,
    line_dedup,
    mixing,
    neighbours,
    ngram_join,
    piece_transducer,
    secret_scan,
    suffix_dedup,
    vector_codes,
)
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    transducer = piece_transducer.compile_transducer(piece_transducer.read_vocabulary())
    made = piece_transducer.encode_and_decode(docs, transducer)
    return made.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.hex(F.xxhash64("piece_ids")).alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        piece_transducer.round_trips(F.col("text"), F.col("decoded")).alias("round_trip"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train_markov(secret_scan.labelled_samples(spark).unionByName(secret_scan.corpus_words(docs)))
    found = secret_scan.scan_secrets(docs, model)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the conversations, learned from two thirds of them and recovered from raw transcripts in which they are markers, if at all."""
    turns = table(spark, sf_dir, "conversations")
    raw = chat_format.raw_transcripts(turns)
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False))
    model = chat_format.train(raw.filter(~held_out))
    found = chat_format.recover_roles(raw, model)
    return found.select("conv_id", "turn", held_out.alias("held_out"), F.col("role").alias("role_pred"), F.size("roles").cast("long").alias("n_turns"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio_features.audio_features(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform(F.slice("spans", 1, 3), lambda s: F.concat_ws("-", s["start_ms"], s["end_ms"])), ";")
    feature = F.concat_ws("|", "n_frames", F.size("spans"), spans, F.hex(F.xxhash64("tensors", "spans")))
    return made.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    found = vector_codes.with_label_errors(coded)
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(neighbours.build_index(vectors), vectors.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_secret_scan": op4_secret_scan,
        "op5_line_dedup": op5_line_dedup,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_mixing": op9_mixing,
        "op10_audio_features": op10_audio_features,
        "op11_vector_codes": op11_vector_codes,
        "op12_fill_middle": op12_fill_middle,
        "op13_neighbours": op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_middle": OP12_SQL}


OP7_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

OP9_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS weight FROM s
), f AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS fills_at FROM w
), v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER p, 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM f WINDOW p AS (ORDER BY fills_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN fills_at <= level THEN 2.0::DOUBLE * source_size
    ELSE max(level) FILTER (WHERE fills_at > level) OVER () * weight END AS target FROM v
), rated AS (
  SELECT doc_id, size, sizes.source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
), drawn AS (
  SELECT *, (size * (floor(rate) + CASE WHEN
    ('0x' || substr(sha256('mix:' || (k // 8) || ':' || coalesce(doc_id::VARCHAR, 'null')), 8 * (k % 8) + 1, 8))::BIGINT / 4294967296.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM rated, range(32) AS draws(k)
), nearest AS (
  SELECT source, k FROM drawn GROUP BY source, k QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - max(target)), k) = 1
)
SELECT doc_id, size, source_size, target, taken
FROM drawn JOIN nearest ON drawn.source IS NOT DISTINCT FROM nearest.source AND drawn.k = nearest.k
"""

#: CTEs of a round of op11: d{n} has the entry of c{n} that is nearest to each part, c{n+1} the entries that follow from these.
_OP11_ROUND = """
d{n} AS (
  SELECT row, p, any_value(b.v) AS v, min({near}) % 64 AS e FROM b JOIN c{n} c USING (p) GROUP BY row, p
), c{m} AS (
  SELECT c.p, c.e, CASE WHEN s.n IS NULL THEN c.v ELSE list_transform(s.total, lambda t: (t - ((t % s.n) + s.n) % s.n) // s.n) END AS v
  FROM c{n} c LEFT JOIN (
    SELECT p, e, count(*) AS n, [{sums}] AS total FROM d{n} GROUP BY p, e
  ) s USING (p, e)
)"""

_WIDTH = 4
_NEAR = "64 * (" + " + ".join(f"(b.v[{k}] - c.v[{k}]) * (b.v[{k}] - c.v[{k}])" for k in range(1, _WIDTH + 1)) + ") + c.e"
_SUMS = ", ".join(f"sum(v[{k}])::BIGINT" for k in range(1, _WIDTH + 1))

#: For vectors of 64 components, as the tables have them. The order of (distance, entry) is that of 64 times the one plus the other.
OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), b AS (
  SELECT row, vec_id, label, p, q[{_WIDTH} * p + 1:{_WIDTH} * p + {_WIDTH}] AS v FROM kept, range(16) AS parts(p)
), c0 AS (
  SELECT p, row - 1 AS e, v FROM b WHERE row <= 64
),{_OP11_ROUND.format(n=0, m=1, near=_NEAR, sums=_SUMS)},{_OP11_ROUND.format(n=1, m=2, near=_NEAR, sums=_SUMS)},
last AS (
  SELECT row, vec_id, label, p, min({_NEAR}) AS k FROM b JOIN c2 c USING (p) GROUP BY row, vec_id, label, p
), coded AS (
  SELECT row, vec_id, label, string_agg(printf('%02x', k % 64), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM last GROUP BY row, vec_id, label
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""

OP12_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    [('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM documents
), c AS (
  SELECT *, len(lines)::BIGINT AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b FROM t
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
