"""The registered queries of this subpackage, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import alignment, concurrency, exact_dedup, fixity, html_extract, mixing, ngram_join, packing, pii, quality, secret_scan, spotsigs, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


#: The key of the registered query; a deployment passes its own secret.
PII_KEY = "registered query"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the co-trained views."""
    docs = table(spark, sf_dir, "documents")
    scores = quality.scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", "quality_scores.*")


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document's block, for weights by the square root of source sizes."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered_weights(docs))


# Times of the fluid mixture are sums over all sources; the schedule goes slot by slot, its blocks numbered by deadline.
OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(other)') AS source, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, ''))[:15] AS o FROM documents),
p AS (SELECT *, CAST(sum(greatest(bytes, 1)) OVER (PARTITION BY source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - greatest(bytes, 1) AS BIGINT) AS place FROM d),
w AS (SELECT source, sqrt(greatest(sum(bytes), 1)) AS w, CAST(ceil(sum(greatest(bytes, 1)) / 100000.0) AS BIGINT) AS b FROM d GROUP BY source),
t AS (SELECT x.source, j, sum(least(m.b, m.w * j / x.w)) AS t0, sum(least(m.b, m.w * (j + 1) / x.w)) AS t1 FROM w x, unnest(range(0, x.b)) u(j), w m GROUP BY x.source, j),
jobs AS (SELECT source, j, floor(round(t0, 6)) AS release, row_number() OVER (ORDER BY ceil(round(t1, 6)), source, j) AS id FROM t),
s AS (SELECT CAST(-1 AS BIGINT) AS slot, CAST([] AS BIGINT[]) AS done
  UNION ALL SELECT slot + 1, list_append(done, (SELECT min(id) FROM jobs WHERE release <= slot + 1 AND NOT list_contains(done, id))) FROM s WHERE slot + 1 < (SELECT count(*) FROM jobs)),
placed AS (SELECT unnest(done) AS id, generate_subscripts(done, 1) - 1 AS slot FROM s WHERE slot = (SELECT max(slot) FROM s))
SELECT p.doc_id, p.source, jobs.j AS block, placed.slot, p.place FROM p JOIN jobs ON jobs.source = p.source AND jobs.j = p.place // 100000 JOIN placed ON placed.id = jobs.id
"""


def op5_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, as WARC, against a replica with stated damage; the bytes of both are hashed.

    In the replica the first byte of every 97th record is another, every 211th
    record is missing and, after every 503rd, there is one record more.
    """

    def damaged(content: Column, record: Column) -> Column:
        return F.when(record % 97 == 0, F.concat(F.lit("?"), F.substring(content, 2, 1 << 30))).otherwise(content)

    both = fixity.page_hashes(table(spark, sf_dir, "pages"), replica=damaged)
    replica = both.where("record % 211 <> 0").select("file", "record", "offset", F.col("replica").alias("hash"))
    extra = both.where("record % 503 = 0").select("file", (-F.col("record") - 2).alias("record"), (F.col("offset") + 1).alias("offset"), F.sha2(F.lit("extra"), 256).alias("hash"))
    return fixity.audit(both.drop("replica"), replica.unionByName(extra))


OP6_SQL = """
WITH r AS (
  SELECT page_id AS record, CAST(floor(page_id / 1000.0) AS BIGINT) AS file,
    strlen('WARC/1.1' || 'WARC-Type: response' || 'WARC-Target-URI: ' || 'Content-Length: ') + 10 + strlen(coalesce(url, ''))
      + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) + 4 AS length
  FROM pages),
m AS (SELECT file, record, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT file, record, "offset", CASE WHEN record % 211 = 0 THEN 'missing' ELSE 'changed' END AS damage FROM m WHERE record % 211 = 0 OR record % 97 = 0
UNION ALL SELECT file, -record - 2, "offset" + 1, 'extra' FROM m WHERE record % 503 = 0
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document's whole text, from an empty ledger."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secret_scan.BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.scan_versions(table(spark, sf_dir, "documents")).findings.select(
        "doc_id", *(count(r.kind) for r in secret_scan.BASE), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans")
    )


def _op7_sql() -> str:
    """Matches, the pieces between them, and running sums of their lengths, rule by rule."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    # Only ASCII letters have two cases here, hence no case-insensitive flag.
    patterns = {"assign": rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}
    found = []
    for rank, r in enumerate(secret_scan.RULES):
        p = patterns.get(r.kind, r.pattern).replace("'", "''")
        found.append(f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.part}) AS p, regexp_split_to_array(t, '{p}') AS b FROM d")
    length = lambda x: f"list_sum([length(x) FOR x IN {x}[1:i]])"
    mark = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(s.kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    joined = lambda test: f"coalesce(string_agg({mark}, ',' ORDER BY start, rank) FILTER ({test}), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({' UNION ALL '.join(found)}),
x AS (SELECT doc_id, rank, kind, {length('b')} + {length('m')} AS stop, length(m[i]) AS size FROM r, unnest(range(1, len(m) + 1)) u(i) WHERE length(p[i]) >= least),
s AS (SELECT doc_id, rank, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM x)
SELECT d.doc_id, {counts}, sha256({joined(f'rank < {len(secret_scan.BASE)}')}) AS base_sha256, {joined('kind IS NOT NULL')} AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


OP7_SQL = _op7_sql()


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_classes(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


OP9_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"), ngram_join.Rule(words=4, percent=85))


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS both_n, count(*) AS meet FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * meet >= 85 * (both_n - meet)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = s.doc_id), s.doc_id)) AS component_id FROM s
"""


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales of every nation, and of all together (-2), at each moment they change."""
    sales = concurrency.sale_intervals(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clients"))
    return concurrency.concurrency(sales)


OP12_SQL = """
WITH l AS (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY sale_id),
i AS (SELECT coalesce(c.nation_id, -1) AS nation_id, epoch_us(s.sold_at) // 60000000 * 60 AS a, epoch_us(l.shipped) // 60000000 * 60 + 604800 AS b, coalesce(CAST(floor(100 * s.total + 0.5) AS BIGINT), 0) AS cents
  FROM sales s LEFT JOIN l ON s.sale_id = l.sale_id LEFT JOIN clients c ON s.client_id = c.client_id WHERE s.sold_at IS NOT NULL),
k AS (SELECT * FROM i WHERE b IS NULL OR b > a), g AS (SELECT * FROM k UNION ALL SELECT -2, a, b, cents FROM k),
e AS (SELECT nation_id, a AS t, 1 AS n, cents FROM g UNION ALL SELECT nation_id, b, -1, -cents FROM g WHERE b IS NOT NULL),
s AS (SELECT nation_id, t, sum(n) AS n, sum(cents) AS cents FROM e GROUP BY ALL HAVING sum(n) <> 0 OR sum(cents) <> 0),
o AS (SELECT CAST(nation_id AS INTEGER) AS nation_id, CAST(t AS BIGINT) AS from_s, CAST(lead(t) OVER w AS BIGINT) AS to_s, CAST(sum(n) OVER w AS BIGINT) AS n_open, CAST(sum(cents) OVER w AS BIGINT) AS open_cents
  FROM s WINDOW w AS (PARTITION BY nation_id ORDER BY t))
SELECT *, max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS high_open, n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak FROM o
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_quality_cotraining": op3_quality_cotraining,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_spotsigs_fingerprints": op5_spotsigs_fingerprints,
    "op6_merkle_fixity": op6_merkle_fixity,
    "op7_secret_scan": op7_secret_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_peak_concurrency": op12_peak_concurrency,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {"op4_pfair_mixing": OP4_SQL, "op6_merkle_fixity": OP6_SQL, "op7_secret_scan": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op12_peak_concurrency": OP12_SQL}
