"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.llm import (
    decontaminate, exact_dedup, hard_negatives, line_dedup, main_text, mixing, pii, quality, reputation, simhash, substring_dedup, token_planes, vector_codes,
)
from metaveil.llm.common import table


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.encode_and_read(table(spark, sf_dir, "documents"), special=True)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 starts from: the spans of the fixed patterns, which SQL can find too."""
    return pii.base(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


#: The rules of the query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return reputation.judge(pages, reputation.page_outcomes(pages, table(spark, sf_dir, "labels")), RULES)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    noisy = F.when(F.col("vec_id").cast("bigint") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label")))


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_pii": op2_pii,
    "pii_base": pii_base,
    "op3_quality": op3_quality,
    "op4_main_text": op4_main_text,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_url_reputation": op12_url_reputation,
    "op13_hard_negatives": op13_hard_negatives,
}

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _strength(name: str, level: str) -> str:
    """SQL of the pages that the prior of a level counts for."""
    v = "prior * (1 - prior)"
    return f"""{name} AS (
            SELECT CASE WHEN c IS NULL OR c = 0 OR a <= b THEN 1000.0 ELSE least(1000.0, greatest(1.0, c / (a - b) - 1)) END AS m
            FROM (SELECT sum(pow(bad / seen - prior, 2) * seen) AS a, sum({v}) AS b, sum({v} * (seen - 1)) AS c FROM {level} WHERE seen > 0)
        )"""


def _lloyd(rounds: int = 4) -> str:
    """SQL of plain Lloyd rounds over the parts, all distances in each."""
    steps = [
        f"""WITH e AS (
            SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_WHOLE}
        ),
        p AS (SELECT r, vec_id, label, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM e, range(4) AS t(part)),
        first AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 256),
        c0 AS (SELECT part, entry, x AS c FROM p JOIN (SELECT r, entry FROM first) USING (r))"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS (
            SELECT r, part, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, min([d, entry])[2] AS entry, min([d, entry])[1] AS d
            FROM (SELECT p.*, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN c{k} USING (part))
            GROUP BY r, part
        )"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (
            SELECT part, entry, list(s ORDER BY i) AS c
            FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS s FROM a{k}, (SELECT unnest(range(1, len(v) // 4 + 1)) AS i FROM (SELECT v FROM e LIMIT 1)) GROUP BY ALL)
            GROUP BY part, entry
        ),
        c{k + 1} AS (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))"""
            )
    final = f"""
        o AS (
            SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lpad(to_hex(CAST(entry AS BIGINT)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY r
        )
        SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
        FROM o"""
    return ",\n        ".join(s for s in steps) + "," + final


#: Kind, its pattern (of the contract), and what must hold of a match v with the digits n.
_DATA = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: coalesce(TRY_CAST('0' || ltrim(p, '0') AS BIGINT), 256) > 255)) = 0"),
    (
        "card", r"[0-9]([\x20-]?[0-9])+",
        "length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(n)), lambda i: CAST([[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]][i % 2 + 1][CAST(n[length(n) - i] AS INT) + 1] AS INT))) % 10 = 0",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(n) BETWEEN 9 AND 15"),
)


def _data_sql() -> str:
    """Where matches stand follows from what is left between them."""
    sized = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    kinds = " UNION ALL ".join(
        f"""SELECT r, {k} AS k, '{kind}' AS kind, place, place + length(v) AS stop FROM (
            SELECT r, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS n, CAST({sized.format("g[1:i]")} + {sized.format("m[1:i - 1]")} AS BIGINT) AS place
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d))
        ) WHERE {holds}"""
        for k, (kind, pattern, holds) in enumerate(_DATA)
    )
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(_DATA))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({kinds}),
        b AS (SELECT r, {counts}, string_agg(kind || ':' || place || ':' || stop, ',' ORDER BY k, place) AS base FROM s GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in _DATA)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(base, '') AS base FROM d LEFT JOIN b USING (r)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "pii_base": _data_sql(),
    "op6_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        p AS (
            SELECT DISTINCT item, size, array_to_string(w[k : k + size - 1], ' ') AS pattern
            FROM (SELECT item, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)
        ),
        hit AS (
            SELECT doc_id, k, t.size, item
            FROM (
                SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS pattern
                FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)
            ) t JOIN p USING (pattern)
            WHERE t.size = p.size
        ),
        words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hit) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
            sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
    "op12_url_reputation": rf"""
        WITH u AS (
            SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM pages
        ),
        l AS (SELECT doc_id, max(CAST(coalesce(quality = 0 OR toxic = 1, quality = 0, toxic = 1) AS INT)) AS bad FROM labels GROUP BY doc_id),
        known AS (
            SELECT host, count(*) AS seen, sum(bad) AS bad FROM u JOIN l ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)
            WHERE bad IS NOT NULL GROUP BY host
        ),
        cut AS (SELECT host, string_split(regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g'), '.') AS p FROM (SELECT DISTINCT host FROM u)),
        sized AS (
            SELECT host, p, len(p) AS n, CASE WHEN len(p) < 2 OR regexp_full_match(p[-1], '[0-9]*') THEN 0
                WHEN len(p) > 2 AND length(p[-1]) = 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k
            FROM cut
        ),
        h AS (
            SELECT host, coalesce(seen, 0) AS seen, coalesce(bad, 0) AS bad, CASE k WHEN 0 THEN '' ELSE array_to_string(p[n - k + 1 : n], '.') END AS suffix,
                CASE k WHEN 0 THEN array_to_string(p, '.') ELSE array_to_string(p[n - k : n], '.') END AS domain
            FROM sized LEFT JOIN known USING (host)
        ),
        s0 AS (SELECT suffix, sum(seen) AS seen, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(seen) + 2) FROM h) AS prior FROM h GROUP BY suffix),
        {_strength("ms", "s0")},
        d0 AS (
            SELECT h.suffix, domain, sum(h.seen) AS seen, sum(h.bad) AS bad, any_value((s0.bad + m * prior) / (s0.seen + m)) AS prior
            FROM h JOIN s0 USING (suffix), ms GROUP BY h.suffix, domain
        ),
        {_strength("md", "d0")},
        h0 AS (SELECT host, h.seen, h.bad, (d0.bad + m * prior) / (d0.seen + m) AS prior FROM h JOIN d0 USING (suffix, domain), md),
        {_strength("mh", "h0")},
        b AS (SELECT host, bad + m * prior AS a, seen - bad + m * (1 - prior) AS b FROM h0, mh),
        j AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5 AS bad_host FROM b),
        r AS (
            SELECT page_id, host, path, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM u
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad_host THEN 'block' ELSE 'allow' END AS verdict
        FROM r JOIN j USING (host)
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
        first AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS place FROM win JOIN first USING (h) WHERE doc_id > owner),
        kept AS (
            SELECT r, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
            FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN gone USING (r, place) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op11_vector_codes": _lloyd(),
    "op13_hard_negatives": f"""
        WITH e AS (
            SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}
        ),
        s AS (
            SELECT a.k AS ak, a.vec_id AS anchor_id, b.k AS bk, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
            FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 100 = 0
        ),
        p AS (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY s DESC, vec_id NULLS LAST) AS place FROM s WHERE same),
        n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.ak, p.bk ORDER BY n.s DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank
            FROM p JOIN s n ON n.ak = p.ak AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s WHERE place <= 5
        )
        SELECT * FROM n WHERE rank <= 5
    """,
}
