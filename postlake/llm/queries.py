"""The operators as queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, linededup, maxscore, mixing, ngramjoin, phrases, quality, rules, secrets, spieces, urls, vptree
from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: the model that the query on SentencePiece encodes with
PIECES = "file:///opt/tokenizers/piece_bpe_32k.model"
#: rules of the query on urls
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op4_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.apply_rules(table(spark, sf_dir, "documents"), trusted)


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.outcomes_of(table(spark, sf_dir, "labels")), URL_RULES)


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spieces.encode(table(spark, sf_dir, "documents"), PIECES)


@query
def op6_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vptree.build_index(vectors), vectors.where("vec_id % 50 = 0"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_documents(table(spark, sf_dir, "documents"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@query
def op13_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.search(maxscore.build_index(vectors), vectors.where("vec_id % 100 = 0"))


_LOWER = f"'{urls.UPPER}', '{urls.LOWER}'"

ORACLE["op3_chat_format"] = """
WITH convs AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT conv_id, [struct_pack(r := role, t := text)], 1 FROM conversations WHERE conv_id IS NULL),
whole AS (SELECT min(conv_id) AS conv_id, turns, any_value(n) AS n, count(*) AS n_copies FROM convs GROUP BY turns),
inner_ AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM convs)),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.turns = whole.turns)),
parts AS (SELECT *, unnest(range(0, (n + 255) // 256)) AS part FROM kept)
SELECT conv_id, part, n AS n_turns, n_copies, array_to_string(list_transform(turns[part * 256 + 1:part * 256 + 256], lambda x:
  '<|im_start|>' || replace(coalesce(x.r, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM parts"""

ORACLE["op5_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4])) END AS s FROM w),
one AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY ALL),
each AS (SELECT node, len(s) AS n, unnest(s) AS x FROM one),
pairs AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.node < b.node
  AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, ways.b FROM reach r JOIN ways ON r.other = ways.a),
least_ AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(least_.low, one.node, sets.doc_id) AS component_id
FROM sets LEFT JOIN one ON one.s = list_sort(sets.s) LEFT JOIN least_ ON least_.node = one.node"""


def _level(name: str, source: str, key: str) -> str:
    """Common table expressions of one level of reputations: groups with n, k and the parent's mean."""
    return f"""{name}_fit AS (SELECT sum(n * pow(k / n - up, 2)) AS s, sum(up * (1 - up)) AS v, sum(n * up * (1 - up)) AS t FROM {source} WHERE n > 0),
{name}_c AS (SELECT (1 - rho) / rho AS c FROM (SELECT least(0.5, greatest(0.001, CASE WHEN t > v THEN (s - v) / (t - v) ELSE 0.001 END)) AS rho FROM {name}_fit)),
{name} AS (SELECT {key}, n, k, k + c * up AS a, n - k + c * (1 - up) AS b, (k + c * up) / (n + c) AS mean FROM {source}, {name}_c)"""


_cases = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
                  for _, r in sorted(URL_RULES, key=lambda x: (-len(x[1]), x[1])))
_actions = " ".join(f"WHEN '{r}' THEN '{a}'" for a, r in URL_RULES)

ORACLE["op10_url_filter"] = rf"""
WITH base AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_LOWER}), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
marks AS (SELECT doc_id, max(greatest((quality = 0)::INT, (toxic = 1)::INT)) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS bare, count(bad) AS n, coalesce(sum(bad), 0) AS k
  FROM base LEFT JOIN marks ON page_id = doc_id GROUP BY host),
hosts AS (SELECT host, n, k, regexp_extract(bare, '([^.]+\.)?[^.]*$') AS domain, regexp_extract(bare, '[^.]*$') AS suffix FROM counted),
top AS (SELECT sum(k) + 0.5 AS a, sum(n) - sum(k) + 0.5 AS b FROM hosts),
s00 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
s0 AS (SELECT suffix, n, k, (a - k) / (a + b - n) AS up FROM s00, top),
{_level('s1', 's0', 'suffix')},
d00 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain),
d0 AS (SELECT d.domain, d.n, d.k, (s1.a - d.k) / (s1.a + s1.b - d.n) AS up FROM d00 d JOIN s1 USING (suffix)),
{_level('d1', 'd0', 'domain')},
h0 AS (SELECT h.host, h.n, h.k, (d1.a - h.k) / (d1.a + d1.b - h.n) AS up FROM hosts h JOIN d1 USING (domain)),
{_level('h1', 'h0', 'host')},
bound AS (SELECT host, n, greatest(0.0, mean - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low FROM h1),
ruled AS (SELECT *, CASE {_cases} END AS rule FROM base)
SELECT page_id, host, path, rule, coalesce(CASE rule {_actions} END, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS n_labelled, round(low, 3) AS bad_bound FROM ruled LEFT JOIN bound USING (host)"""

ORACLE["op11_phrase_mining"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) ms(m)),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:cuts.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
whole AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.m > len(string_split(b.phrase, ' ')) AND 100 * c.a >= 80 * b.a
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM whole JOIN n USING (lang)
QUALIFY rank <= 2000"""

ORACLE["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.c), 0) AS n, coalesce(any_value(v.v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 5) // (g.n + 5 * g.v))::BIGINT AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, term, sum(c.c) AS c FROM c GROUP BY lang, term),
sizes AS (SELECT lang, sum(c) AS n FROM whole GROUP BY lang),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (c + 5) // (n + 5 * v))::BIGINT AS q FROM whole JOIN sizes USING (lang) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM rows QUALIFY part = 'pair' OR rank <= 50"""

ORACLE["op13_maxscore_search"] = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, v.id AS vec_id, max(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(v.w)) + 1), lambda i: q.w[i] * v.w[i])), 0))::BIGINT AS score
  FROM v q JOIN v ON q.id % 100 = 0 AND q.id <> v.id GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
