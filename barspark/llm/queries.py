"""The queries opN_<name> over the given tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_lm, quality, toxicity
from .collocations import collocations
from .exact_dedup import exact_groups
from .filter_audit import filter_interactions
from .line_dedup import dedup_lines
from .mixing import mix_plan
from .ngram_jaccard import jaccard_classes
from .packing import packed
from .secrets import listed, secret_spans
from .sentencepiece_codec import decoded, encoded
from .topk_search import top_k

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir), width=5, percent=80)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _part(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def _held_out(n: int, remainder: int) -> Column:
    """Rows without a doc_id are never learned from, but not held out either."""
    return F.coalesce(_part(n) == remainder, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, _labels(spark, sf_dir).where(_part(3) != 1))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.scored(docs, quality.fit(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(_documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)
    back = decoded(ids, TOKENIZER)
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir), digest=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("lines.total").cast("long").alias("n_lines"), F.col("lines.dropped").cast("long").alias("n_dropped"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return plan.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).cast("long").alias("taken"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return top_k(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), k=10)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    base = listed(F.filter("spans", lambda x: x["rank"] < 3))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = ngram_lm.scored(docs, ngram_lm.train(docs.where(_part(7) != 2)), stable=True)
    return out.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_documents(spark, sf_dir), WORD_TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_topk_search": op8_topk_search,
    "op9_secret_scan": op9_secret_scan,
    "op10_lm_score": op10_lm_score,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm""",
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y, c = i.n AND c = j.n AS same FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
        b AS (SELECT x, y, same FROM e UNION ALL SELECT y, x, same FROM e),
        r(id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.o),
        c AS (SELECT id, min(o) AS component_id FROM r GROUP BY id),
        k AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(b.y) FILTER (b.same), d.doc_id)) AS set_id FROM documents d LEFT JOIN b ON b.x = d.doc_id GROUP BY d.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, k.set_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id JOIN k ON k.doc_id = d.doc_id""",
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
        t AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
        f AS (SELECT line, min(doc_id * 10000000 + k) AS first, length(line) AS n FROM t WHERE line <> '' GROUP BY line),
        m AS (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 16),
        h AS (SELECT line, first, n, m, 'P' || left(line, m // 2) AS half FROM m WHERE m >= 16 UNION ALL SELECT line, first, n, m, 'S' || right(line, m - m // 2) FROM m WHERE m >= 16),
        near AS (SELECT DISTINCT b.line FROM h a JOIN h b ON a.m = b.m AND a.half = b.half AND a.first < b.first AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.line, b.line) <= 1),
        k AS (SELECT t.*, t.line = '' OR (f.first = t.doc_id * 10000000 + t.k AND near.line IS NULL) AS keep FROM t LEFT JOIN f ON f.line = t.line LEFT JOIN near ON near.line = t.line)
        SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (keep), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped FROM k GROUP BY doc_id""",
    "op7_mix_sources": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
        f AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
              sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
        l AS (SELECT min_by(rest / weights, 2 * source_size / weight) AS level FROM f WHERE rest / weights * weight < 2 * source_size),
        r AS (SELECT source, source_size, least(2 * source_size, coalesce(level * weight, 2 * source_size)) AS target FROM w, l)
        SELECT doc_id, size, source_size::BIGINT AS source_size, target,
               (size * (floor(target / source_size) + (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < target / source_size - floor(target / source_size))::INT))::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
              (len(w) < 100)::INT + 2 * (100 * list_unique(w) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT
              + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (first < w.doc_id)::INT AS mask FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
              list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65)))::INT AS prior FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
        r AS (SELECT part, filter_order, step, letter,
              sum(n) FILTER (mask & (coalesce(prior, 0) | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(prior, 0) = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(prior, 0) <> 0) AS redundant,
              sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(prior, 0) = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(prior, 0) = 0) AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r""",
    "op12_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS m)) GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
        k AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
        s AS (SELECT k.lang, k.m, k.phrase, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score FROM k JOIN g x ON x.lang = k.lang AND x.phrase = k.x JOIN g y ON y.lang = k.lang AND y.phrase = k.y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        e AS (SELECT lang, a, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE m > 2),
        i AS (SELECT lang, phrase, max(a) AS longer FROM e GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase COLLATE "C") AS rank, b.phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000""",
}
