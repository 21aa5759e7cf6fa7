"""The thin driver queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, host_rules, lines, mixing, neighbours, packing, sharding, simhash, substrings, toxicity, url_filters, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=2)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, first=2000)


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OPERATORS = (
    op1_toxicity, op2_neighbours, op3_substring_dedup, op4_line_dedup, op5_mix_sources, op6_warc, op7_simhash, op8_shard,
    op9_pack, op10_host_rules, op11_url_filters, op12_collocations, op13_align_tokens,
)  # fmt: skip
QUERIES = {f.__name__: f for f in OPERATORS}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) t),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP4 = rf"""WITH a AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) t),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM a) t WHERE nw > 0),
w AS (SELECT x.doc_id, x.i, min(y.i) AS j FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.cum - x.cum + x.nw >= 10 GROUP BY 1, 2
 UNION SELECT y.doc_id, max(x.i), y.i FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.cum - x.cum + x.nw >= 10 GROUP BY 1, 3),
h AS (SELECT w.doc_id, w.i, w.j, md5(string_agg(line, chr(10) ORDER BY l.i)) AS h FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN w.i AND w.j GROUP BY 1, 2, 3),
s AS (SELECT h, min(ROW(doc_id, i)) AS src FROM h GROUP BY 1),
m AS (SELECT h.doc_id, h.i, h.j FROM h JOIN s USING (h) WHERE ROW(h.doc_id, h.i) > src),
z AS (SELECT DISTINCT l.doc_id, l.pos FROM m JOIN l ON l.doc_id = m.doc_id AND l.i BETWEEN m.i AND m.j),
k AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.pos) AS kept FROM a LEFT JOIN z ON z.doc_id = a.doc_id AND z.pos = a.pos WHERE z.pos IS NULL GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM z WHERE z.doc_id = d.doc_id) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.kept, '')) END AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)"""

OP5 = rf"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
q AS (SELECT *, cap / weight AS ratio FROM r),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level <= ratio THEN level END) OVER () * weight), cap) AS target FROM v),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) AS position FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(floor({random.Random(11).random()!r}::DOUBLE + rate * position) - floor({random.Random(11).random()!r}::DOUBLE + rate * (position - 1)), 3) AS BIGINT) AS copies FROM n)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c"""

_DIGIT = lambda n: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {n}) & 31 AS INTEGER) + 1, 1)"  # noqa: E731
OP6 = rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p GROUP BY 1)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT)), lambda v: {_DIGIT(15)} || {_DIGIT(10)} || {_DIGIT(5)} || {_DIGIT(0)}), '') AS payload_digest,
CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM p JOIN b USING (h)"""

OP10 = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) t) u QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM g) t GROUP BY 1),
r AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r),
x AS (SELECT source, 'base' AS rule, base_failed AS failed FROM f UNION ALL SELECT source, 'symbols', 10 * n_symbols > n_words FROM f UNION ALL SELECT source, 'lines', 10 * n_dup_lines > 3 * n_lines FROM f
 UNION ALL SELECT source, 'words', word_chars < 3 * n_words OR word_chars > 10 * n_words FROM f),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS bad FROM x GROUP BY 1, 2),
t AS (SELECT rule, sum(n) AS nn, sum(bad) / sum(n) AS mean, sum(n * (bad / n) * (bad / n)) AS npp, count(*) AS k, sum(n * n) AS n2 FROM h GROUP BY 1),
v AS (SELECT *, CASE WHEN nn - n2 / nn > 0 THEN (npp - nn * mean * mean - mean * (1 - mean) * (k - 1)) / (nn - n2 / nn) ELSE 0 END AS var FROM t),
s AS (SELECT rule, mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM v),
g2 AS (SELECT source, max((bad + mean * strength) / (n + strength)) <= 0.5 AS host_kept FROM h JOIN s USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM f JOIN g2 ON f.source IS NOT DISTINCT FROM g2.source"""

#: One round of propagation; rounds are written out one after the other.
_ROUND = """m{n} AS (SELECT walk, host, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT e.walk, e.dst AS host, m.mass // 100 * 85 // e.degree AS mass FROM e JOIN m{p} m ON m.walk = e.walk AND m.host = e.src UNION ALL SELECT * FROM m0) t WHERE mass > 0 GROUP BY 1, 2)"""
OP11 = rf"""WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
p AS (SELECT *, CASE WHEN host = 'www.example.com' AND starts_with(path, '/en/') OR ends_with(host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u),
c AS (SELECT host, count(*) AS pages, count(*) FILTER (rule IN ('com/', 'www.example.com/en/')) AS trusted, count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS blocked FROM p WHERE host <> '' GROUP BY 1),
l AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)[ 	
]*=[ 	
]*["'']?(?:https?:)?//([^/?#"''<> 	
]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p) t WHERE src <> '' AND src <> dst),
h AS (SELECT host, string_split(host, '.') AS x FROM (SELECT host FROM c UNION SELECT dst FROM l) t WHERE regexp_matches(host, '[a-z][^.]*$')),
d AS (SELECT DISTINCT array_to_string(list_slice(x, i, len(x)), '.') AS low, array_to_string(list_slice(x, i + 1, len(x)), '.') AS high FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM h WHERE len(x) > 2) t),
g AS (SELECT src, dst FROM l UNION SELECT low, high FROM d WHERE low <> high UNION SELECT high, low FROM d WHERE low <> high),
e AS (SELECT walk, src, dst, count(*) OVER (PARTITION BY walk, src) AS degree FROM (SELECT 'trust' AS walk, src, dst FROM g UNION ALL SELECT 'distrust', dst, src FROM g) t),
m0 AS (SELECT 'trust' AS walk, host, trusted * 150000 AS mass FROM c WHERE trusted > 0 UNION ALL SELECT 'distrust', host, blocked * 150000 FROM c WHERE blocked > 0),
{", ".join(_ROUND.format(n=n, p=n - 1) for n in range(1, 21))},
r AS (SELECT host, CAST(coalesce(sum(mass) FILTER (walk = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (walk = 'distrust'), 0) AS BIGINT) AS distrust FROM m20 GROUP BY 1)
SELECT page_id, p.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN (CAST(distrust AS HUGEINT) - trust) * 100 > CAST(pages AS HUGEINT) * 4500000 THEN 'block' ELSE 'allow' END AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM p LEFT JOIN c ON c.host = p.host LEFT JOIN r ON r.host = p.host"""

OP12 = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t) u),
g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(m) WHERE len(w) >= m) u),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c) u),
s AS (SELECT k.*, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (l.f + r.f) AS BIGINT) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c x ON x.lang = c.lang AND x.m > c.m AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND CAST(x.a AS HUGEINT) * 100 >= CAST(c.a AS HUGEINT) * 80)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE z.phrase IS NULL QUALIFY rank <= 2000"""

#: SQL has no trained grammar, approximate search, XXH64, differencing or tokenizer: tests/llm checks those.
ORACLES: dict[str, str] = {"op3_substring_dedup": OP3, "op4_line_dedup": OP4, "op5_mix_sources": OP5, "op6_warc": OP6, "op10_host_rules": OP10, "op11_url_filters": OP11, "op12_collocations": OP12}
