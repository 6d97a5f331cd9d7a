"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for quality 0, 1 for good but toxic text, 2 for good text that is not."""
    from .quality_classifier import quality_grades

    labels = table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0))).when(F.col("quality") == 0, 0)
    return quality_grades(table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_scan import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_words", F.size("segments").alias("n_segments"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie, rebuilt

    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_packing,
        op3_quality_rules,
        op4_decontamination,
        op5_warc,
        op6_substring_dedup,
        op7_html_text,
        op8_quality_classifier,
        op9_sentencepiece,
        op10_toxicity,
        op11_secret_scan,
        op12_divergence,
        op13_prefix_trie,
    )
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL: dict[str, str] = {
    "op1_minhash_dedup": rf"""WITH RECURSIVE
 w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS a FROM documents),
 p AS (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a)-4, 1))) AS i FROM w WHERE len(a)>0),
 s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i+4], ' ') AS g FROM p),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g=y.g AND x.doc_id<y.doc_id GROUP BY 1,2),
 e AS (SELECT a, b FROM c JOIN n l ON l.doc_id=a JOIN n r ON r.doc_id=b WHERE 100*k>=85*(l.n+r.n-k)),
 b AS (SELECT a AS s, b AS t FROM e UNION SELECT b, a FROM e),
 r(id, c) AS (SELECT DISTINCT doc_id, doc_id FROM w UNION SELECT b.t, r.c FROM r JOIN b ON b.s=r.id WHERE r.c<b.t),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
 SELECT w.doc_id, CAST(coalesce(n.n,0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c=w.doc_id AS kept FROM w JOIN m ON m.id=w.doc_id LEFT JOIN n ON n.doc_id=w.doc_id""",
    "op5_warc": r"""WITH
 p AS (SELECT page_id, url, encode(coalesce(html,'')) AS b FROM pages),
 d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
 f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url
  FROM d JOIN f USING (h)""",
    "op12_divergence": rf"""WITH
 d AS (SELECT row_number() OVER () AS i, coalesce(lang,'') AS lang, coalesce(source,'') AS source, translate(coalesce(text,''),'{UPPER}','{UPPER.lower()}') AS x FROM documents),
 w AS (SELECT i, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
 k AS (SELECT lang, t FROM w GROUP BY 1,2 HAVING count(DISTINCT i)>=3),
 v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY 1),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, t, count(*)::HUGEINT AS n FROM w JOIN k USING (lang,t) GROUP BY 1,2,3),
 ng AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1,2), nl AS (SELECT lang, sum(n)::HUGEINT AS n FROM c GROUP BY 1),
 p AS (SELECT g.lang, g.source, k.t, c.n AS n, 1+1000000000*(coalesce(c.n,0)+1)//(coalesce(ng.n,0)+v) AS p FROM g JOIN k ON k.lang=g.lang JOIN v ON v.lang=g.lang
   LEFT JOIN c ON c.lang=g.lang AND c.source=g.source AND c.t=k.t LEFT JOIN ng ON ng.lang=g.lang AND ng.source=g.source),
 q AS (SELECT lang, t, 1+1000000000*(sum(c.n)::HUGEINT+1)//(any_value(nl.n)+any_value(v)) AS q FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY 1,2),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p-b.p)*(a.p-b.p)//b.p) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.t=b.t AND a.source<>b.source GROUP BY 1,2,3),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value,0)::BIGINT AS value FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source LEFT JOIN f ON f.lang=a.lang AND f.source=a.source AND f.item=b.source
   UNION ALL SELECT p.lang, source, 'term', p.t, ((p-q)*(p-q)//q)::BIGINT FROM p JOIN q ON q.lang=p.lang AND q.t=p.t WHERE p.n>0 AND p>q),
 o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang,source,part ORDER BY value DESC, item) AS INT) AS rank FROM r)
 SELECT * FROM o WHERE part='pair' OR rank<=200""",
    "op13_prefix_trie": r"""WITH RECURSIVE
 t(i, v, k) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v&1=1 THEN xor(v>>1, 3988292384::UBIGINT) ELSE v>>1 END, k+1 FROM t WHERE k<8),
 o AS (SELECT conv_id, md5(length(coalesce(role,'')) || ':' || coalesce(role,'') || coalesce(text,'')) AS key, length(coalesce(text,''))::BIGINT AS chars,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
 r(conv_id, s, k, crc) AS (SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::UBIGINT FROM o
   UNION ALL SELECT conv_id, s, r.k+1, xor(crc>>8, t.v) FROM r JOIN t ON t.k=8 AND t.i=(xor(crc, ascii(s[r.k+1])::UBIGINT) & 255) WHERE r.k<length(s)),
 h AS (SELECT conv_id, xor(crc, 4294967295::UBIGINT)%6 AS h FROM r WHERE k=length(s)),
 e AS (SELECT h.conv_id, 0 AS side, pos, key, chars FROM h JOIN o ON o.conv_id=h.conv_id-h.conv_id%100 AND pos<=h UNION ALL SELECT o.conv_id, 1, pos, key, chars FROM o JOIN h USING (conv_id) WHERE pos>h),
 l AS (SELECT conv_id, list(key ORDER BY side, pos) AS keys, list(chars ORDER BY side, pos) AS chars FROM e GROUP BY 1),
 q AS (SELECT h.conv_id, coalesce(keys, []) AS keys, coalesce(chars, []) AS chars FROM h LEFT JOIN l USING (conv_id)),
 x AS (SELECT conv_id, keys, chars, unnest(range(len(keys)+1)) AS d FROM q),
 n AS (SELECT d, keys[1:d] AS pre, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d=0 THEN 0 ELSE any_value(chars[d]) END AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(keys)=d), '') AS ends FROM x GROUP BY 1,2),
 c AS (SELECT d-1 AS d, pre[1:d-1] AS pre, count(*) AS n FROM n WHERE d>0 GROUP BY 1,2),
 a AS (SELECT n.d, n.pre, unnest(range(n.d+1)) AS up, (n_convs-1)*chars AS saved, (c.n IS NULL)::INT AS leaf FROM n LEFT JOIN c ON c.d=n.d AND c.pre=n.pre),
 s AS (SELECT up AS d, pre[1:up] AS pre, sum(saved) AS saved, sum(leaf) AS leaves FROM a GROUP BY 1,2)
 SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n,0) AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
  FROM n JOIN s ON s.d=n.d AND s.pre=n.pre LEFT JOIN c ON c.d=n.d AND c.pre=n.pre LEFT JOIN n p ON p.d=n.d-1 AND p.pre=n.pre[1:n.d-1]""",
}
