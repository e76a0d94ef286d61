"""The operators over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm import bayes, bpe, collocations, editcounts, lattice, lines, packing, raking, repair, simhash, unigram, urllists, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_lattice", """
WITH RECURSIVE sound AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.n AS a, b.n AS b FROM sound a JOIN sound b ON a.label = b.label AND a.n <> b.n AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT n, n FROM sound UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a, min(s.vec_id) AS component_id FROM reach r JOIN sound s ON r.b = s.n GROUP BY r.a),
number AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM sound JOIN least ON n = least.a LEFT JOIN number ON n = number.a
UNION ALL
SELECT vec_id, 0::BIGINT, vec_id, true FROM embeddings WHERE NOT coalesce(label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)
""")
def lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode_table(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
                      F.sha2(bpe.decode("token_ids"), 256).alias("decoded_sha256"))


@query("op8_line_quality")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge_table(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.identify(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op9_mixing", raking.mix_sql())
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix_table(table(spark, sf_dir, "documents"), fill=True).withColumn("probability", F.round("probability", 9))


def _entries(pages: DataFrame) -> DataFrame:
    """A dated block list out of the pages: each names its domain, host, first folder or whole path, to be listed or unlisted."""
    digit = lambda a, n: F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), a, n), 16, 10).cast("int")
    host, path = urllists.host_of("url"), urllists.path_of("url")
    labels = F.split(host, "\\.")
    domain = F.when(F.size(labels) > 3, F.array_join(F.slice(labels, 2, 300), ".")).otherwise(host)
    kind = F.floor(digit(1, 1) / 4)
    folder = F.concat(F.lit("/"), F.element_at(F.split(F.concat(path, F.lit("//")), "/"), 2))
    return pages.select(F.when(kind == 0, domain).otherwise(host).alias("host"), F.when(kind == 2, folder).when(kind == 3, path).otherwise("").alias("prefix"),
                        F.date_add(F.lit("2024-01-01").cast("date"), digit(3, 4) % 366).alias("day"), (digit(2, 1) < 10).alias("listed"))


@query("op5_url_lists", r"""
WITH p AS (SELECT page_id, md5(page_id::VARCHAR) AS m, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS h,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
captures AS MATERIALIZED (SELECT page_id, CASE WHEN length(h) BETWEEN 1 AND 253 THEN h ELSE '' END AS host, coalesce(path, '') AS path, m, DATE '2024-01-01' + (('0x' || substr(m, 7, 4))::INT % 366) AS day FROM p),
kinds AS (SELECT *, ('0x' || substr(m, 1, 1))::INT // 4 AS kind, string_split(host, '.') AS labels FROM captures),
entries AS (SELECT CASE WHEN kind = 0 AND len(labels) > 3 THEN array_to_string(labels[2:], '.') ELSE host END
    || CASE kind WHEN 2 THEN '/' || string_split(path || '//', '/')[2] WHEN 3 THEN path ELSE '' END AS key,
  DATE '2024-01-01' + (('0x' || substr(m, 3, 4))::INT % 366) AS day, ('0x' || substr(m, 2, 1))::INT < 10 AS listed FROM kinds WHERE host <> ''),
daily AS (SELECT regexp_replace(key, '/+$', '') AS key, day, bool_or(listed) AS listed FROM entries GROUP BY ALL),
spans AS MATERIALIZED (SELECT key, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until, listed FROM daily),
keys AS (SELECT page_id, day, unnest(list_distinct(list_concat(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
  list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: host || array_to_string(string_split(path, '/')[:i], '/'))))) AS key FROM kinds WHERE host <> ''),
hits AS (SELECT page_id, count(*) AS n, max(struct_pack(l := length(key), k := key)).k AS matched FROM keys JOIN spans USING (key)
  WHERE listed AND since <= day AND (until IS NULL OR day < until) GROUP BY page_id)
SELECT page_id, host, day::VARCHAR AS fetch_day, coalesce(n, 0)::BIGINT AS n_matches, matched, n IS NULL AS kept FROM captures LEFT JOIN hits USING (page_id)
""")
def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 7, 4), 16, 10).cast("int") % 366)
    found = urllists.filter_captures(pages.withColumn("day", day), _entries(pages))
    return found.select("page_id", "host", F.col("day").cast("string").alias("fetch_day"), "n_matches", "matched", "kept")


@query("op3_site_quality")
def site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _edits() -> Column:
    """Three edits of a document, from its own id and text: at each place some characters go and others of the text come in."""
    digit = lambda k, n: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(k)), F.col("doc_id").cast("string")).cast("binary")), n, 6), 16, 10).cast("int")
    length = F.coalesce(F.length("text"), F.lit(0))
    one = lambda k: F.struct(F.pmod(digit(k, 1), length + 1).alias("start"), (F.pmod(digit(k, 1), length + 1) + digit(k, 7) % 25).alias("end"),
                             F.substring("text", F.pmod(digit(k, 13), length + 1) + 1, digit(k, 19) % 18).alias("insert"))
    return F.array(*map(one, range(3)))


@query("op7_edit_counts")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = editcounts.count_table(table(spark, sf_dir, "documents"), _edits())
    return counted.select("doc_id", "tokens_before", "tokens_after", "reencoded", F.size("leaf_tokens").cast("long").alias("n_leaves"), F.sha2("edited", 256).alias("edited_sha256"))


@query("op6_repair_shards")
def repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.write_and_index(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


@query("op12_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(table(spark, sf_dir, "documents"))


@query("op13_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, range(1, 6) t(k)),
frequent AS MATERIALIZED (SELECT lang, w[i:i + k - 1] AS p, any_value(k) AS k, count(*) AS f FROM spans GROUP BY lang, w[i:i + k - 1] HAVING count(*) >= 100),
wider AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, unnest([p[:k - 1], p[2:]]) AS p, f FROM frequent WHERE k > 2) GROUP BY lang, p),
alone AS (SELECT c.* FROM frequent c LEFT JOIN wider USING (lang, p) WHERE c.k > 1 AND (wider.f IS NULL OR wider.f < c.f)),
cut AS (SELECT alone.*, unnest(range(1, k)) AS c FROM alone),
scored AS (SELECT cut.lang, cut.p, cut.f AS a, c, l.f AS l, r.f AS r, totals.n, ((1000::HUGEINT * cut.f * totals.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN frequent l ON l.lang = cut.lang AND l.p = cut.p[:c] JOIN frequent r ON r.lang = cut.lang AND r.p = cut.p[c + 1:] JOIN totals ON totals.lang = cut.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000
""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
