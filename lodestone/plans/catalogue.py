"""Queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.cluster import new_folder, removed, written
from lodestone.functions import tables as table_functions
from lodestone.functions import text as tx
from lodestone.operators import asof, cite, identity, limiter, links, lookups, project, resolution, retrieve, state
from lodestone.operators import rank as rk
from lodestone.plans import expression as ex
from lodestone.plans.planner import Channel, make_plan
from lodestone.sources import html, records, tables

AS_OF_YEAR = 2026
AS_OF = "2024-01-15 00:00:00"
CONCEPTS = [["tion", "ment"], ["the", "der"]]
QUERIES: dict = {}
ORACLE_SQL: dict = {}

# ---- SQL of the adapters -------------------------------------------------------------------------

B = tx.BLANK
TOK = tx.TOKEN


def s_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{B}+', ' ', 'g'))"


def s_norm(x: str) -> str:
    return f"lower({s_clean(x)})"


def s_title(x: str) -> str:
    return f"regexp_replace({s_norm(x)}, ' ?({tx.TITLE_MARKS}) ?', '\\1', 'g')"


def s_json(x: str) -> str:
    """JSON string with the escapes of characters that are unsafe in HTML."""
    out = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for code in (0x3C, 0x3E, 0x26):
        out = f"replace({out}, chr({code}), chr(92) || 'u{code:04x}')"
    return f"(chr(34) || {out} || chr(34))"


def s_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{TOK}'))"


PAPERS = f"""
base AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body, source, n_chars FROM documents),
abst AS (SELECT *, substr(body, length(title) + 2, 400) AS abstract FROM base),
toks AS (SELECT doc_id, regexp_extract_all(lower(concat_ws(' ', title, abstract)), '{TOK}') AS ts FROM abst),
words AS (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(ts) AS w, unnest(range(len(ts))) AS p FROM toks) WHERE length(w) >= 6 GROUP BY ALL),
five AS (SELECT doc_id, list_slice(list(w ORDER BY p), 1, 5) AS ws FROM words GROUP BY doc_id),
papers AS (SELECT doc_id, 'cr_' || substr(sha256('"DOC:' || doc_id || '"'), 1, 16) AS ref, title, abstract, source, coalesce(ws, []) AS keywords,
  ['Author ' || (doc_id % 97), 'Author ' || (doc_id % 89)] AS authors,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 2015 + doc_id % 11 END AS INTEGER) AS year,
  ['期刊', '会议', '博士', '硕士', '报纸', '其他'][CAST(doc_id % 6 + 1 AS INTEGER)] AS doc_type,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars % 50 END AS cited,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE '10.1000/' || doc_id END AS doi, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://example.org/abstract/' || doc_id END AS url,
  CAST(doc_id % 30 + 1 AS VARCHAR) AS volume, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 6 + 1 AS VARCHAR) END AS issue, (doc_id % 100 + 1) || '-' || (doc_id % 100 + 9) AS pages
  FROM abst LEFT JOIN five USING (doc_id))"""
JOURNAL = """
src AS (SELECT DISTINCT source, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER), 4) AS n FROM documents),
journal AS (SELECT lower(trim(source)) AS source_key, CASE WHEN n % 5 = 4 THEN '' ELSE ['CSSCI', 'SCI', '北大核心', 'EI'][n % 5 + 1] END AS tier_tag,
  CASE WHEN n % 7 = 0 THEN NULL ELSE n * CAST(0.3 AS DOUBLE) END AS composite, n % 5 <> 4 AS present FROM src)"""
QUALITY = f"""{JOURNAL},
qual AS (SELECT p.*, CASE WHEN present THEN CASE tier_tag WHEN 'CSSCI' THEN 0.96 WHEN 'SCI' THEN 1.0 WHEN '北大核心' THEN 0.94 WHEN 'EI' THEN 0.9 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS tier,
  CASE WHEN present AND composite IS NOT NULL THEN 1 - exp(-greatest(0, composite) / 2) ELSE 0 END AS impact,
  CASE WHEN cited IS NOT NULL AND year > 0 AND year <= {AS_OF_YEAR} THEN 1 - exp(-greatest(0, cited)::DOUBLE / greatest(1, {AS_OF_YEAR} - year + 1) / 3) ELSE 0 END AS annual,
  CASE doc_type WHEN '博士' THEN 0.72 WHEN '硕士' THEN 0.46 WHEN '期刊' THEN 0.55 WHEN '会议' THEN 0.52 WHEN '报纸' THEN 0.14 ELSE 0 END::DOUBLE AS kind,
  (present OR (cited IS NOT NULL AND year > 0 AND year <= {AS_OF_YEAR})) AS quality_known
  FROM papers p LEFT JOIN journal j ON lower(trim(p.source)) = j.source_key),
qlt AS (SELECT *, 0.45::DOUBLE * tier + 0.25::DOUBLE * impact + 0.20::DOUBLE * annual + 0.10::DOUBLE * kind AS quality FROM qual)"""
Q_TOKENS = "['tion', 'ment', 'the', 'der']"


def s_dice(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {Q_TOKENS})) / (len({x}) + 4) END"


def _groups(test) -> str:
    return " AND ".join("(" + " OR ".join(test(t) for t in g) + ")" for g in CONCEPTS)


def _any_keyword(t: str) -> str:
    return f"len(list_filter(keywords, lambda k: contains(k, '{t}'))) > 0"


CHANNELS = f"""
dd AS (SELECT *, {s_norm("title")} AS nt, {s_norm("abstract")} AS na, {s_dice("tt")} AS dice FROM (SELECT *, {s_tokens("title")} AS tt FROM papers)),
scan AS (
  SELECT 'q1' AS channel, ref, year, row_number() OVER (ORDER BY dice DESC, ref) AS position FROM dd WHERE {_groups(lambda t: f"(contains(nt, '{t}') OR contains(na, '{t}') OR {_any_keyword(t)})")}
  UNION ALL SELECT 'q2', ref, year, row_number() OVER (ORDER BY dice DESC, ref) FROM dd WHERE {_groups(lambda t: f"contains(nt, '{t}')")}
  UNION ALL SELECT 'q3', ref, year, row_number() OVER (ORDER BY dice DESC, ref) FROM dd WHERE {_groups(_any_keyword)}),
scanned AS (SELECT *, CAST(ceil(position / 50.0) AS BIGINT) AS page FROM scan WHERE position <= 250),
hits AS (SELECT ref, channel, min(position) AS position FROM scanned WHERE year > 0 AND year >= 2016 GROUP BY ALL)"""
RANKED = f"""{PAPERS}, {QUALITY}, {CHANNELS},
fused AS (SELECT ref, sum(1.0::DOUBLE / (60.0::DOUBLE + position)) AS rrf, count(DISTINCT channel) AS channels FROM hits GROUP BY ref),
ev AS (SELECT q.*, rrf, channels, {s_tokens("title")} AS t1, {s_tokens("abstract")} AS t2, {s_tokens("array_to_string(keywords, ' ')")} AS t3,
  {s_norm("concat_ws(' ', title, array_to_string(keywords, ' '), abstract)")} AS txt FROM qlt q JOIN fused USING (ref)),
ev2 AS (SELECT *, {s_dice("t1")} AS e_title, {s_dice("t2")} AS e_abstract, {s_dice("t3")} AS e_keywords,
  ({" + ".join("CASE WHEN " + " OR ".join(f"contains(txt, '{t}')" for t in g) + " THEN 1 ELSE 0 END" for g in CONCEPTS)}) / 2.0::DOUBLE AS coverage FROM ev),
ev3 AS (SELECT *, (0.32::DOUBLE * e_title + 0.28::DOUBLE * e_abstract + 0.12::DOUBLE * e_keywords + 0.20::DOUBLE * least(rrf * 20, 1.0) + 0.08::DOUBLE * least(channels / 3.0::DOUBLE, 1.0) + 0.12::DOUBLE * coverage) / 1.12::DOUBLE AS relevance FROM ev2),
ranked AS (SELECT *, relevance * (0.35::DOUBLE + 0.65::DOUBLE * quality) + 0.20::DOUBLE * quality AS score, relevance >= 0.25 AND coverage >= 0.5 AS eligible FROM ev3),
ordered AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, score DESC, ref) AS rank FROM ranked),
selected AS (SELECT * FROM ordered WHERE eligible AND score >= (SELECT greatest(0.24, max(score) * 0.55) FROM ranked WHERE eligible)
  AND ((relevance >= 0.35 AND coverage = 1) OR quality >= 0.45 OR (quality >= 0.25 AND relevance >= 0.35) OR (NOT quality_known AND relevance >= 0.55)) ORDER BY rank LIMIT 50)"""


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- retrieval and ranking -----------------------------------------------------------------------

STRUCTURED = ex.all_of(ex.any_of(ex.term("title", "the"), ex.term("title", "der")), ex.none_of(ex.term("source", "src3", "exact")), ex.term("doi", "10.1000"))


@query("structured_search", f"""WITH {PAPERS}, m AS (SELECT *, row_number() OVER (ORDER BY coalesce(cited, -1) DESC, ref) AS position FROM papers
  WHERE (contains({s_norm("title")}, 'the') OR contains({s_norm("title")}, 'der')) AND NOT {s_norm("source")} = 'src3' AND contains(doi, '10.1000'))
  SELECT position, ref, title, array_to_string(authors, '; ') AS authors, source, CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '' END AS year, doc_type, coalesce(CAST(cited AS VARCHAR), '') AS cited
  FROM m WHERE position <= 100""")
def structured_search(spark: SparkSession, d: str) -> DataFrame:
    p = tables.papers(spark, d)
    found = retrieve.scan(p, Channel("q1", STRUCTURED), [], "citations", 2)
    return found.select("ref", "position").join(project.brief(p), "ref")


def _logic(e: ex.Expression):
    return lambda spark, d: tables.papers(spark, d).where(ex.predicate(e)).select("ref")


E1 = ex.any_of(ex.all_of(ex.term("title", "the"), ex.term("keywords", "tion")), ex.all_of(ex.term("authors", "author 5"), ex.none_of(ex.term("abstract", "and"))))
E1_SQL = f"(contains({s_norm('title')}, 'the') AND {_any_keyword('tion')}) OR (len(list_filter(authors, lambda a: contains(lower(a), 'author 5'))) > 0 AND NOT contains({s_norm('abstract')}, 'and'))"
query("expr_and_or_not", f"WITH {PAPERS} SELECT ref FROM papers WHERE {E1_SQL}")(_logic(E1))
E2 = ex.all_of(ex.term("first_author", "author 3"), ex.none_of(ex.all_of(ex.term("doi", "10.1000/1"), ex.term("subject", "er"))))
E2_SQL = f"contains(lower(authors[1]), 'author 3') AND NOT (contains(doi, '10.1000/1') AND (contains({s_norm('title')}, 'er') OR contains({s_norm('abstract')}, 'er') OR {_any_keyword('er')}))"
query("expr_de_morgan", f"WITH {PAPERS} SELECT ref FROM papers WHERE {E2_SQL}")(_logic(E2))


@query("expr_not_null_safe", f"WITH {PAPERS} SELECT ref FROM papers WHERE NOT coalesce(contains(nullif(doi, ''), '10.1000/1'), false)")
def expr_not_null_safe(spark, d):
    p = tables.papers(spark, d).withColumn("doi", F.nullif("doi", F.lit("")))
    return p.where(ex.predicate(ex.none_of(ex.term("doi", "10.1000/1")))).select("ref")


@query("dnf_branches", f"WITH {PAPERS} SELECT ref FROM papers WHERE {E1_SQL}")
def dnf_branches(spark, d):
    p = tables.papers(spark, d)
    parts = [p.where(reduce(lambda a, b: a & b, [~ex.predicate(x) if n else ex.predicate(x) for x, n in branch])).select("ref") for branch in ex.validate(E1)]
    return reduce(DataFrame.union, parts).distinct()


@query("year_filter_unknown", f"WITH {PAPERS} SELECT ref, CAST(year AS BIGINT) AS year FROM papers WHERE year > 0 AND year >= 2018 AND year <= 2021")
def year_filter_unknown(spark, d):
    return tables.papers(spark, d).where(retrieve.year_between(2018, 2021)).select("ref", big("year").alias("year"))


def _scanned(spark, d):
    plan = make_plan(concept_groups=CONCEPTS)
    return retrieve.scan_all(tables.papers(spark, d), plan.channels, [t for g in CONCEPTS for t in g])


def _hits(spark, d):
    return retrieve.hits(_scanned(spark, d), 2016)


def _ranked(spark, d):
    plan = make_plan(concept_groups=CONCEPTS)
    return rk.rank(tables.papers(spark, d), plan, _hits(spark, d), tables.source_quality(spark, d), AS_OF_YEAR)


@query("paged_grid", f"WITH {PAPERS}, {CHANNELS} SELECT channel, page, position, ref FROM scanned")
def paged_grid(spark, d):
    return _scanned(spark, d).select("channel", big("page").alias("page"), "position", "ref")


@query("channel_hits", f"WITH {PAPERS}, {CHANNELS} SELECT ref, channel, position FROM hits")
def channel_hits(spark, d):
    return _hits(spark, d).select("ref", "channel", "position")


@query("coverage_table", f"WITH {PAPERS}, {CHANNELS} SELECT channel, max(page) AS pages, count(*) AS rows FROM scanned GROUP BY channel")
def coverage_table(spark, d):
    return retrieve.coverage(_scanned(spark, d))


@query("coverage_totals", f"""WITH {PAPERS}, {CHANNELS}, t AS (SELECT channel, count(*) AS total FROM scan GROUP BY channel)
  SELECT channel, coalesce(max(page), 0) AS pages, count(ref) AS rows, any_value(total) AS total, count(ref) >= any_value(total) AS exhausted, CAST(NULL AS VARCHAR) AS error FROM t LEFT JOIN scanned USING (channel) GROUP BY channel""")
def coverage_totals(spark, d):
    """Per channel how much of it was read, and whether that is all."""
    plan = make_plan(concept_groups=CONCEPTS)
    return retrieve.full_coverage(_scanned(spark, d), retrieve.totals(tables.papers(spark, d), plan.channels))


@query("cursor_pages", f"""WITH {PAPERS}, m AS (SELECT ref, row_number() OVER (ORDER BY coalesce(cited, -1) DESC, ref) AS position, count(*) OVER () AS total FROM papers WHERE contains({s_norm("title")}, 'the'))
  SELECT position, ref, (position - 1) // 60 + 1 AS page, total, (total + 59) // 60 AS last_page FROM m WHERE position <= 240""")
def cursor_pages(spark, d):
    """Four pages, each found by the cursor of the one before."""
    p, channel, cursor, out = tables.papers(spark, d), Channel("q1", ex.term("title", "the")), "", []
    for _ in range(4):
        page = retrieve.grid_page(p, channel, [], "citations", cursor=cursor, size=60)
        out.append(page.rows.select("position", "ref", F.lit(page.page).cast("long").alias("page"), F.lit(page.total).cast("long").alias("total"), F.lit(page.last_page).cast("long").alias("last_page")))
        cursor = page.cursor
        if page.exhausted:
            break
    return reduce(DataFrame.union, out)


@query("round_stop", f"""WITH {PAPERS}, {CHANNELS}, f AS (SELECT ref, min(page) AS round FROM scanned GROUP BY ref), r AS (SELECT round, count(*) AS new FROM f GROUP BY round)
  SELECT round, new, CAST(sum(new) OVER (ORDER BY round) AS BIGINT) AS known FROM r""")
def round_stop(spark, d):
    return retrieve.rounds(_scanned(spark, d))


@query("round_target", f"""WITH {PAPERS}, {CHANNELS}, f AS (SELECT ref, min(page) AS round FROM scanned GROUP BY ref), r AS (SELECT round, count(*) AS new FROM f GROUP BY round),
  k AS (SELECT round, sum(new) OVER (ORDER BY round) AS known FROM r), l AS (SELECT coalesce(min(round) FILTER (known >= 120), max(round)) AS last FROM k)
  SELECT channel, position, ref FROM scanned, l WHERE page <= last""")
def round_target(spark, d):
    return retrieve.until_target(_scanned(spark, d), 120).select("channel", "position", "ref")


@query("rrf_scores", f"WITH {PAPERS}, {CHANNELS} SELECT ref, round(sum(1.0::DOUBLE / (60 + position)), 6) AS rrf, count(DISTINCT channel) AS channels FROM hits GROUP BY ref")
def rrf_scores(spark, d):
    return rk.rrf(_hits(spark, d)).select("ref", F.round("rrf", 6).alias("rrf"), "channels")


@query("token_sets", f"SELECT token, count(*) AS docs FROM (SELECT unnest({s_tokens('coalesce(text, chr(32))')}) AS token FROM documents) GROUP BY token")
def token_sets(spark, d):
    t = tables.table(spark, d, "documents").select(F.explode(tx.latin_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@query("token_counts", f"SELECT doc_id, CAST(len({s_tokens('coalesce(text, chr(32))')}) AS BIGINT) AS n FROM documents")
def token_counts(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", big(F.size(tx.tokens(F.coalesce("text", F.lit(""))))).alias("n"))


# Letters become Han characters, so that names of the given table hold runs of them.
LATIN, HAN = "abcdefghijklmnopq", "图像识别深度学习模型知谱技术编程中"


@query("han_bigrams", f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2)),
  lambda x: regexp_matches(x, '^\\p{{Han}}\\p{{Han}}$')))), ',') AS bigrams FROM (SELECT p_partkey, translate(lower(p_name), '{LATIN}', '{HAN}') AS t FROM part)""")
def han_bigrams(spark, d):
    text = F.translate(F.lower("p_name"), LATIN, HAN)
    return tables.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.han_bigrams(text)), ",").alias("bigrams"))


@query("dice_overlap", f"WITH {PAPERS} SELECT ref, round({s_dice(s_tokens('title'))}, 6) AS dice FROM papers")
def dice_overlap(spark, d):
    q = F.array(*[F.lit(t) for g in CONCEPTS for t in g])
    return tables.papers(spark, d).select("ref", F.round(tx.dice(q, tx.tokens("title")), 6).alias("dice"))


@query("concept_coverage", f"""WITH {PAPERS}, x AS (SELECT ref, {s_norm("concat_ws(' ', title, array_to_string(keywords, ' '), abstract)")} AS txt FROM papers)
  SELECT ref, ({" + ".join("CASE WHEN " + " OR ".join(f"contains(txt, '{t}')" for t in g) + " THEN 1 ELSE 0 END" for g in CONCEPTS)}) / 2.0::DOUBLE AS coverage FROM x""")
def concept_coverage(spark, d):
    text = tx.normalize(F.concat_ws(" ", "title", F.array_join("keywords", " "), "abstract"))
    return tables.papers(spark, d).withColumn("txt", text).select("ref", tx.concept_coverage(F.col("txt"), CONCEPTS).alias("coverage"))


@query("source_quality", f"WITH {PAPERS}, {QUALITY} SELECT ref, round(tier, 6) AS tier, round(impact, 6) AS impact, round(annual, 6) AS annual, round(kind, 6) AS kind, round(quality, 6) AS quality, quality_known FROM qlt")
def source_quality(spark, d):
    out = rk.with_quality(tables.papers(spark, d), tables.source_quality(spark, d), AS_OF_YEAR)
    return out.select("ref", *[F.round(c, 6).alias(c) for c in ("tier", "impact", "annual", "kind", "quality")], "quality_known")


RANK_COLS = ("relevance", "quality", "coverage", "score")


@query("research_search", f"WITH {RANKED} SELECT rank, ref, title, eligible, {', '.join(f'round({c}, 6) AS {c}' for c in RANK_COLS)} FROM ordered")
def research_search(spark, d):
    return rk.ordered(_ranked(spark, d)).select("rank", "ref", "title", "eligible", *[F.round(c, 6).alias(c) for c in RANK_COLS])


@query("eligible_only", f"WITH {RANKED} SELECT ref, round(score, 6) AS score FROM ranked WHERE eligible")
def eligible_only(spark, d):
    return _ranked(spark, d).where("eligible").select("ref", F.round("score", 6).alias("score"))


@query("select_threshold", f"WITH {RANKED} SELECT ref, round(score, 6) AS score FROM selected")
def select_threshold(spark, d):
    return rk.select(_ranked(spark, d)).select("ref", F.round("score", 6).alias("score"))


@query("pool_size", """WITH g AS (SELECT 'part' AS what, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'supplier', l_suppkey, count(*) FROM lineitem GROUP BY l_suppkey)
  SELECT what, id, n, CAST(least(n, CASE WHEN n <= 30 THEN n WHEN n <= 100 THEN 40 WHEN n <= 300 THEN 60 ELSE 80 END) AS BIGINT) AS size FROM g""")
def pool_size(spark, d):
    """Pools for candidate sets as large as the groups of a table."""
    t = tables.table(spark, d, "lineitem")
    groups = [t.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what)) for what, c in (("part", "l_partkey"), ("supplier", "l_suppkey"))]
    return groups[0].union(groups[1]).select("what", "id", "n", big(rk.pool_size(F.col("n"))).alias("size"))


@query("pool_top", f"WITH {RANKED} SELECT ref FROM ordered WHERE rank <= (SELECT least(count(*), CASE WHEN count(*) <= 30 THEN count(*) WHEN count(*) <= 100 THEN 40 WHEN count(*) <= 300 THEN 60 ELSE 80 END) FROM ranked)")
def pool_top(spark, d):
    return rk.pool(_ranked(spark, d))


@query("exclusion_reasons", f"WITH {RANKED} SELECT CASE WHEN coverage < 0.5 THEN 'coverage' ELSE 'relevance' END AS reason, count(*) AS n FROM ranked WHERE NOT eligible GROUP BY 1")
def exclusion_reasons(spark, d):
    return _ranked(spark, d).where("NOT eligible").groupBy(rk.exclusion_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("search_summary", f"""WITH {RANKED} SELECT count(*) AS candidates, count(*) FILTER (eligible) AS eligible, count(DISTINCT source) FILTER (tier > 0) AS quality_sources,
  (SELECT count(*) FROM selected) AS selected FROM ranked""")
def search_summary(spark, d):
    r = _ranked(spark, d)
    return rk.summary(r, rk.select(r))


@query("feedback_keywords", f"""WITH {RANKED}, w AS (SELECT ref, rank, unnest(keywords) AS keyword FROM ordered WHERE rank <= 10 AND eligible)
  SELECT keyword AS key, count(DISTINCT ref) AS frequency FROM w WHERE length(keyword) BETWEEN 2 AND 30 AND keyword NOT IN ('tion', 'ment', 'the', 'der') GROUP BY keyword HAVING count(DISTINCT ref) >= 2
  ORDER BY frequency DESC, key LIMIT 2""")
def feedback_keywords(spark, d):
    return rk.feedback_keywords(_ranked(spark, d), make_plan(concept_groups=CONCEPTS)).select("key", "frequency")


# ---- keys and linkage ----------------------------------------------------------------------------


@query("title_keys", f"WITH {PAPERS} SELECT doc_id, {s_title('title')} AS key FROM papers")
def title_keys(spark, d):
    return tables.papers(spark, d).select("doc_id", tx.title_key("title").alias("key"))


@query("source_keys", f"SELECT DISTINCT translate({s_norm(f'rtrim({s_clean(chr(115))}, {chr(39)} .。{chr(39)})')}, '（）', '()') AS key FROM (SELECT source || ' （A）. 。' AS s FROM documents)")
def source_keys(spark, d):
    return tables.table(spark, d, "documents").select(tx.source_key(F.concat("source", F.lit(" （A）. 。"))).alias("key")).distinct()


@query("doi_keys", """SELECT doc_id, regexp_replace(lower(trim(['https://doi.org/', 'http://doi.org/', 'doi:', ' DOI:', ''][CAST(doc_id % 5 + 1 AS INTEGER)] || 'X/' || doc_id)), '^(https://doi[.]org/)?(http://doi[.]org/)?(doi:)?', '') AS key FROM documents""")
def doi_keys(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, ("https://doi.org/", "http://doi.org/", "doi:", " DOI:", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return tables.table(spark, d, "documents").select("doc_id", tx.doi_key(F.concat(prefix, F.lit("X/"), "doc_id")).alias("key"))


@query("record_refs", f"WITH {PAPERS} SELECT doc_id, ref FROM papers")
def record_refs(spark, d):
    return tables.papers(spark, d).select("doc_id", "ref")


def _linked_papers(spark, d):
    """papers with identifiers of which some are shared."""
    i = F.col("doc_id")
    p = tables.papers(spark, d).withColumns({
        "dbname": F.when(i % 5 == 0, "").otherwise("DB"), "filename": F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("f"), F.floor(i / 2))), "dbcode": F.when(i % 11 == 0, "cj").otherwise(""),
        "doi": F.when(i % 3 == 0, F.concat(F.lit("10.1/"), F.floor(i / 6))).otherwise(""),
    })
    return identity.with_keys(p)


LINKED = f"""{PAPERS}, lp AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id // 6) ELSE '' END AS doi), CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'DB:F' || (doc_id // 2) END AS native_key,
  CASE WHEN doc_id % 11 = 0 THEN 'cj' ELSE '' END AS dbcode FROM papers),
  lk AS (SELECT *, doi AS doi_key, CASE WHEN title = '' OR source IS NULL OR year = 0 THEN '' ELSE sha256('[' || {s_json(s_title('title'))} || ',' || {s_json("lower(array_to_string(authors, '|'))")} || ',' || {s_json(s_norm('source'))} || ',' || year || ']') END AS bib_key FROM lp),
  ks AS (SELECT doc_id, ref, unnest(list_filter([CASE WHEN native_key <> '' THEN 'native:' || native_key END, CASE WHEN doi_key <> '' THEN 'doi:' || doi_key END, CASE WHEN bib_key <> '' THEN 'bib:' || bib_key END], lambda x: x IS NOT NULL)) AS key FROM lk)"""


@query("identity_keys", f"WITH {LINKED} SELECT ref, key FROM ks")
def identity_keys(spark, d):
    return _linked_papers(spark, d).select("ref", F.explode(identity.identity_keys()).alias("key"))


SAME = """NOT (x.doi_key <> '' AND y.doi_key <> '' AND x.doi_key <> y.doi_key) AND NOT (x.native_key <> '' AND y.native_key <> '' AND x.native_key <> y.native_key)
  AND NOT (x.dbcode <> '' AND y.dbcode <> '' AND lower(x.dbcode) <> lower(y.dbcode)) AND ((x.doi_key <> '' AND y.doi_key <> '') OR (x.native_key <> '' AND y.native_key <> '') OR (x.bib_key <> '' AND x.bib_key = y.bib_key))"""


@query("dedup_pairs", f"""WITH {LINKED}, linked AS (SELECT DISTINCT x.ref AS a, y.ref AS b FROM ks kx JOIN ks ky ON kx.key = ky.key AND kx.ref < ky.ref JOIN lk x ON x.ref = kx.ref JOIN lk y ON y.ref = ky.ref WHERE {SAME}),
  cl AS (SELECT ref, min(ref) OVER (PARTITION BY doi_key, native_key, lower(dbcode), bib_key) AS rep FROM lk)
  SELECT a, b, CASE WHEN p.rep = q.rep THEN 'member' ELSE 'pair' END AS kind FROM linked JOIN cl p ON p.ref = a JOIN cl q ON q.ref = b WHERE a = p.rep AND (p.rep = q.rep OR b = q.rep)""")
def dedup_pairs(spark, d):
    """Links between classes of equal identifiers, and each class's members."""
    return identity.same_pairs(_linked_papers(spark, d))


@query("dedup_links", f"""WITH {LINKED} SELECT x.ref AS ref, count(DISTINCT y.ref) AS n FROM ks kx JOIN ks ky ON kx.key = ky.key AND kx.ref <> ky.ref JOIN lk x ON x.ref = kx.ref JOIN lk y ON y.ref = ky.ref WHERE {SAME} GROUP BY x.ref""")
def dedup_links(spark, d):
    """Number of links of each linked paper, from the classes' sizes alone."""
    return identity.link_counts(_linked_papers(spark, d))


@query("key_components", f"""WITH RECURSIVE {LINKED}, e AS (SELECT DISTINCT kx.doc_id AS a, ky.doc_id AS b FROM ks kx JOIN ks ky USING (key)),
  r(a, b) AS (SELECT doc_id, doc_id FROM lk UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT a AS seq, min(b) AS component FROM r GROUP BY a""")
def key_components(spark, d):
    """Records that shared keys bring together, directly or through others."""
    p = written(_linked_papers(spark, d).select("doc_id", "native_key", "doi_key", "bib_key"), "keyed")  # the texts are read once
    linked = resolution.labelled(p.select(F.col("doc_id").alias("node"), F.explode(identity.identity_keys()).alias("key")))
    return p.join(linked, p["doc_id"] == linked["node"], "left").select(F.col("doc_id").alias("seq"), F.coalesce("component", "doc_id").alias("component"))


@query("merge_observations", f"""WITH {PAPERS}, o AS (
  SELECT ref, s AS seq, s = 2 AS is_detail, CASE WHEN s = 3 THEN title || ' (late)' ELSE title END AS title, source, CASE WHEN s = 3 THEN year + 1 ELSE year END AS year,
    CASE WHEN s = 2 THEN abstract ELSE '' END AS abstract, CASE WHEN s = 1 THEN NULL ELSE cited + s END AS cited FROM papers, (SELECT unnest([1, 2, 3]) AS s) WHERE s = 1 OR (s = 2 AND doc_id % 2 = 0) OR (s = 3 AND doc_id % 3 = 0)),
  g AS (SELECT *, is_detail OR f IS NULL OR seq < f AS ok FROM o LEFT JOIN (SELECT ref, min(seq) AS f FROM o WHERE is_detail GROUP BY ref) USING (ref))
  SELECT ref, arg_max(title, seq) FILTER (ok AND title <> '') AS title, arg_max(source, seq) FILTER (ok AND source <> '') AS source, CAST(arg_max(year, seq) FILTER (ok AND year > 0) AS BIGINT) AS year,
    arg_max(abstract, seq) FILTER (abstract <> '') AS abstract, arg_max(cited, seq) FILTER (cited IS NOT NULL) AS cited FROM g GROUP BY ref""")
def merge_observations(spark, d):
    return identity.merge_observations(tables.observations(spark, d)).select("ref", "title", "source", big("year").alias("year"), "abstract", "cited")


def _colliding(spark, d):
    """Observations of papers of which some share identifiers, some a ref with another paper, and some come twice."""
    i = F.col("doc_id")
    p = _linked_papers(spark, d).withColumn("ref", F.when(i % 10 == 0, F.concat(F.lit("shared"), F.floor(i / 50))).otherwise(F.col("ref")))
    twice = F.explode(F.when(i % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return p.withColumn("again", twice).withColumns({"seq": (2 * i + F.col("again")).cast("long"), "is_detail": F.col("again") == 1, "locator": F.lit("")})


@query("resolve_batch")
def resolve_batch(spark, d):
    """Observations in three batches, resolved against what the batches before have stored, in a new store."""
    store = resolution.PaperStore(state.Store(spark, new_folder(spark, "resolve")))
    o, out = _colliding(spark, d), []
    o = written(o.select("seq", "ref", *(c for c in resolution.FIELDS.names if c in o.columns)), "colliding")  # the texts are read once, not for each batch
    third = [F.pmod(F.floor(F.col("seq") / 2), F.lit(3)) == k for k in range(3)]
    for k, part in enumerate(third):
        out.append(store.upsert(o.where(part), f"batch-{k}").withColumn("batch", F.lit(k)))
    removed(o)
    return reduce(DataFrame.union, out)


@query("keyed_lookup")
def keyed_lookup(spark, d):
    """Forty papers by ref from a table that is bucketed by it, in a new store."""
    p = tables.papers(spark, d)
    store = state.Store(spark, new_folder(spark, "lookup"))
    store.append_keyed("papers", p, "ref", "all")
    asked = [r["ref"] for r in spark.range(40).select(tx.record_ref(tx.native_key(F.lit("DOC"), (7 * F.col("id") % 300).cast("string"))).alias("ref")).collect()]
    return store.lookup("papers", "ref", asked).select("ref", "title", "doi")


@query("detail_bind", f"""WITH {PAPERS}, f AS (SELECT *, doc_id % 2 = 0 AS has, doc_id % 2 = 0 AND doc_id % 10 = 0 AND doi <> '' AS bad, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS k FROM papers)
  SELECT ref, CASE WHEN has AND NOT bad THEN 'detail ' || k ELSE abstract END AS abstract, CASE WHEN has AND NOT bad AND doc_id % 10 = 0 THEN '10.9/other' ELSE doi END AS doi, CASE WHEN bad THEN 'IDENTITY_CONFLICT' END AS detail_error FROM f""")
def detail_bind(spark, d):
    """Details of every second paper, some read twice and some of another paper."""
    p, i = tables.papers(spark, d), F.col("doc_id")
    times = F.explode(F.when(i % 6 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("detail_at")
    details = p.where(i % 2 == 0).select("ref", "title", "authors", F.when(i % 10 == 0, "10.9/other").otherwise("").alias("doi"), times)
    details = details.withColumn("abstract", F.concat(F.lit("detail "), "detail_at"))
    return project.bind_details(p, details).select("ref", "abstract", "doi", "detail_error")


@query("locate_identity", f"""WITH {LINKED}, m AS (SELECT x.ref, y.ref AS found FROM lk x JOIN lk y ON {s_title('x.title')} = {s_title('y.title')} AND y.doc_id % 3 <> 1
    WHERE ({SAME}) OR (x.doi_key = '' AND x.native_key = '' AND x.bib_key = '')), n AS (SELECT ref, count(*) AS n, min(found) AS found FROM m GROUP BY ref)
  SELECT ref, CASE WHEN n = 1 THEN n.found END AS found, CASE WHEN n IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN n > 1 THEN 'IDENTITY_AMBIGUOUS' END AS error FROM lk LEFT JOIN n USING (ref)""")
def locate_identity(spark, d):
    """Each paper among two thirds of the rows, by title and identity."""
    p = written(_linked_papers(spark, d).select("doc_id", "ref", "title", "doi_key", "native_key", "dbcode", "bib_key"), "keyed")  # the texts are read once
    return project.located(p, p.where(F.col("doc_id") % 3 != 1))


@query("enrich_join", f"WITH {PAPERS}, {JOURNAL} SELECT p.ref, coalesce(present, false) AS present, round(composite, 6) AS composite FROM papers p LEFT JOIN journal j ON lower(trim(p.source)) = j.source_key")
def enrich_join(spark, d):
    p = tables.papers(spark, d).withColumn("source_key", tx.source_key("source"))
    return p.join(tables.source_quality(spark, d), "source_key", "left").select("ref", F.coalesce(F.col("state") == "present", F.lit(False)).alias("present"), F.round("composite", 6).alias("composite"))


@query("title_lookup_status", f"""WITH {PAPERS}, asked AS (SELECT DISTINCT title, {s_title('title')} AS key FROM papers UNION SELECT 'no such title', 'no such title'),
  k AS (SELECT {s_title('title')} AS key, count(*) AS n, min(ref) AS ref FROM papers GROUP BY 1)
  SELECT title, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN ref END AS ref FROM asked LEFT JOIN k USING (key)""")
def title_lookup_status(spark, d):
    p = tables.papers(spark, d)
    return project.title_status(p.select("title").union(spark.createDataFrame([("no such title",)], "title string")), p)


@query("multi_get_ordered", f"WITH {PAPERS} SELECT pos, ref, title FROM papers JOIN (SELECT 'cr_' || substr(sha256('\"DOC:' || (7 * r % 300) || '\"'), 1, 16) AS ref, r AS pos FROM range(0, 40) t(r)) USING (ref)")
def multi_get_ordered(spark, d):
    asked = spark.range(40).select(F.col("id").alias("pos"), tx.record_ref(tx.native_key(F.lit("DOC"), (7 * F.col("id") % 300).cast("string"))).alias("ref"))
    return project.in_order(asked, tables.papers(spark, d)).select("pos", "ref", "title")


def _marked(spark, d):
    p = tables.papers(spark, d)
    body = F.concat(F.lit("See 《"), F.replace(F.replace("title", F.lit("`"), F.lit("")), F.lit("["), F.lit("")), F.lit("》 and 《Unknown《inner》》 but not `《code》` nor [《link》](u)."))
    return p.select("doc_id", body.alias("text"))


@query("link_spans", f"""WITH {PAPERS}, m AS (SELECT doc_id, replace(replace(title, '`', ''), '[', '') AS t FROM papers),
  s AS (SELECT doc_id, 0 AS span, 4 AS start, 6 + length(t) AS "end", t AS title FROM m UNION ALL SELECT doc_id, 1, 11 + length(t), 27 + length(t), 'Unknown《inner》' FROM m),
  k AS (SELECT {s_title('title')} AS key, count(*) AS n, min(ref) AS ref, max(url) AS url FROM papers GROUP BY 1)
  SELECT doc_id, span, start, "end", title, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN url = '' THEN 'matched_without_link' ELSE 'linked' END AS status,
    CASE WHEN n = 1 THEN ref END AS ref, CASE WHEN n = 1 THEN nullif(url, '') END AS url FROM s LEFT JOIN k ON k.key = {s_title('s.title')}""")
def link_spans(spark, d):
    p = tables.papers(spark, d)
    return links.link(links.spans(_marked(spark, d)), p).select("doc_id", "span", "start", "end", "title", "status", "ref", "url")


@query("link_spans_flat", f"""WITH {PAPERS}, m AS (SELECT doc_id, 'See 《' || replace(replace(title, '`', ''), '[', '') || '》 and more' AS t FROM papers),
  s AS (SELECT doc_id, unnest(regexp_extract_all(t, '《([^《》]*)》', 1)) AS title FROM m), k AS (SELECT {s_title('title')} AS key, count(*) AS n, max(url) AS url FROM papers GROUP BY 1)
  SELECT doc_id, title, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN url = '' THEN 'matched_without_link' ELSE 'linked' END AS status FROM s LEFT JOIN k ON k.key = {s_title('s.title')}""")
def link_spans_flat(spark, d):
    p = tables.papers(spark, d)
    m = p.select("doc_id", F.concat(F.lit("See 《"), F.replace(F.replace("title", F.lit("`"), F.lit("")), F.lit("["), F.lit("")), F.lit("》 and more")).alias("text"))
    return links.link(links.flat_spans(m), p).select("doc_id", "title", "status")


# ---- projection, paging, text --------------------------------------------------------------------


@query("missing_headings", f"""WITH {PAPERS}, h AS (SELECT doc_id, [title, 'Methods', 'A: B', source] AS c, [' METHODS ', 'a : b', CASE WHEN doc_id % 2 = 0 THEN chr(12288) || title || '  ' ELSE source END] AS b FROM papers)
  SELECT doc_id, md5(array_to_string(list_filter(c, lambda x: NOT list_contains(list_transform(b, lambda y: {s_title('y')}), {s_title('x')})), ',')) AS missing FROM h""")
def missing_headings(spark, d):
    catalog = F.array("title", F.lit("Methods"), F.lit("A: B"), "source")
    body = F.array(F.lit(" METHODS "), F.lit("a : b"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\u3000"), "title", F.lit("  "))).otherwise(F.col("source")))
    return tables.papers(spark, d).select("doc_id", F.md5(F.array_join(project.missing_headings(catalog, body), ",")).alias("missing"))


@query("scope_page", f"WITH {RANKED} SELECT rank, ref FROM ordered WHERE eligible ORDER BY rank LIMIT 20 OFFSET 10")
def scope_page(spark, d):
    return project.page_of(rk.ordered(_ranked(spark, d)), "eligible", 10, 20).select("rank", "ref")


@query("text_slice", "SELECT doc_id, substr(coalesce(text, ''), 101, 300) AS slice FROM documents")
def text_slice(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", project.text_slice(F.coalesce("text", F.lit("")), 100, 300).alias("slice"))


@query("text_pages", """SELECT doc_id, o AS "offset", md5(substr(text, CAST(o + 1 AS INTEGER), 2000)) AS page, CASE WHEN o + 2000 < length(text) THEN o + 2000 END AS next_offset
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2000)) AS o FROM documents)""")
def text_pages(spark, d):
    pages = project.text_pages(tables.table(spark, d, "documents").select("doc_id", "text"), limit=2000)
    return pages.withColumn("page", F.md5("page"))


SECTIONS = "SELECT doc_id AS snapshot_id, CAST(1 + (k * 7 + doc_id) % 4 AS BIGINT) AS level, CAST(k * (10 + doc_id % 5) AS BIGINT) AS \"offset\", CAST(12 * (10 + doc_id % 5) AS BIGINT) AS total FROM documents, range(0, 12) t(k)"


@query("section_lengths", f"""WITH s AS ({SECTIONS}) SELECT snapshot_id, level, "offset", coalesce((SELECT min(n."offset") FROM s n WHERE n.snapshot_id = s.snapshot_id AND n."offset" > s."offset" AND n.level <= s.level) - 2, total) - "offset" AS length FROM s""")
def section_lengths(spark, d):
    k, i = F.col("k"), F.col("doc_id")
    s = tables.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    s = s.select(i.alias("snapshot_id"), (1 + (k * 7 + i) % 4).alias("level"), (k * (10 + i % 5)).alias("offset"), (12 * (10 + i % 5)).alias("total"))
    return project.section_lengths(s).drop("total")


@query("columnar_nonempty", "SELECT doc_id, lang FROM documents")
def columnar_nonempty(spark, d):
    return project.nonempty(tables.table(spark, d, "documents").select("doc_id", "lang", F.lit("").alias("a"), F.lit(None).cast("string").alias("b")))


BRIEF_SQL = "ref, title, array_to_string(authors, '; ') AS authors, source, CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '' END AS year, doc_type, coalesce(CAST(cited AS VARCHAR), '') AS cited"


@query("brief_view", f"WITH {PAPERS} SELECT {BRIEF_SQL} FROM papers")
def brief_view(spark, d):
    return project.brief(tables.papers(spark, d))


def s_record(members: dict[str, str]) -> str:
    """A JSON object of members, those that are null left out."""
    parts = ", ".join(f"""'"{name}":' || CAST(to_json({value}) AS VARCHAR)""" for name, value in members.items())
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}'"


def s_some(name: str, empty: str = "''") -> str:
    return f"nullif({name}, {empty})"


FULL = {
    "doc_id": "doc_id", **{c: s_some(c) for c in ("ref", "title", "abstract", "source")}, "keywords": "CASE WHEN len(keywords) > 0 THEN keywords END", "authors": "authors", "year": s_some("year", "0"),
    **{c: s_some(c) for c in ("doc_type",)}, "cited": "cited", **{c: s_some(c) for c in ("doi", "url", "volume", "issue", "pages")},
}


@query("full_view_json", f"WITH {PAPERS} SELECT ref, {s_record(FULL)} AS record FROM papers")
def full_view_json(spark, d):
    return project.full_json(tables.papers(spark, d))


@query("field_projection", f"WITH {PAPERS} SELECT ref, title, doi FROM papers")
def field_projection(spark, d):
    return project.fields(tables.papers(spark, d), ["doi", "title", "no_such_field"])


@query("parse_counts", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey * 100 END AS n FROM orders""")
def parse_counts(spark, d):
    """Counts as pages print them: plain, with separators, in ten thousands, and none."""
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey")
    tens = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("万"))
    shown = F.when(k == 0, n.cast("string")).when(k == 1, F.format_number(n, 0)).when(k == 2, tens).when(k == 3, F.col("o_orderpriority")).otherwise("")
    return tables.table(spark, d, "orders").select("o_orderkey", big(tx.parse_count(shown)).alias("n"))


@query("parse_years", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
def parse_years(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", big(tx.parse_year(F.concat(F.lit("on "), F.date_format("o_orderdate", "dd.MM.yyyy")))).alias("y"))


@query("author_roles", """WITH n AS (SELECT c_custkey, list_transform([' ' || c_name || '(文)', lower(c_name) || ' （主编）', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '（其他）' ELSE c_mktsegment END], lambda x: trim(regexp_replace(x, '\\s*[（(](?:文|著|编|译|主编|编著|编译|撰|撰文|执笔|整理|口述|摄|图|供稿)[）)]$', ''))) AS a FROM customer)
  SELECT c_custkey, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ';') AS names FROM n""")
def author_roles(spark, d):
    names = F.array(F.concat(F.lit(" "), "c_name", F.lit("(文)")), F.concat(F.lower("c_name"), F.lit(" （主编）")), F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("（其他）"))).otherwise(F.col("c_mktsegment")))
    return tables.table(spark, d, "customer").select("c_custkey", F.array_join(tx.author_names(names), ";").alias("names"))


@query("nonspace_chars", f"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '{B}', '', 'g')) AS BIGINT) AS n FROM documents")
def nonspace_chars(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", big(tx.nonspace_chars(F.coalesce("text", F.lit("")))).alias("n"))


@query("public_urls", r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'http' ELSE 'https' END || '://' || ['www.example.org', 'example.com', 'evil.org', 'example.org.evil.net'][CAST(page_id % 4 + 1 AS INTEGER)] || '/Abstract/' || page_id || '?a=1' || CASE WHEN page_id % 3 = 0 THEN '&AccessToken=x' ELSE '' END AS u FROM pages)
  SELECT page_id, CASE WHEN u LIKE 'https://%' AND regexp_matches(split_part(u, '/', 3), '^(.*[.])?example[.](org|com)$') AND contains(lower(u), '/abstract') AND NOT regexp_matches(lower(u), 'token|ticket|session|password|signature') THEN u ELSE '' END AS public FROM u""")
def public_urls(spark, d):
    i = F.col("page_id")
    bad = F.when(i % 3 == 0, "&AccessToken=x").otherwise("")
    scheme = F.when(i % 5 == 0, "http").otherwise("https")
    host = F.element_at(F.array(*map(F.lit, ("www.example.org", "example.com", "evil.org", "example.org.evil.net"))), (i % 4 + 1).cast("int"))
    return tables.table(spark, d, "pages").select("page_id", tx.public_url(F.concat(scheme, F.lit("://"), host, F.lit("/Abstract/"), i, F.lit("?a=1"), bad)).alias("public"))


@query("safe_file_names", f"""WITH {PAPERS}, n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'com' || (doc_id % 10) || '.x' WHEN 1 THEN ' . ' WHEN 2 THEN title || chr(127) ELSE title END AS t FROM papers),
  m AS (SELECT doc_id, substr(trim(regexp_replace(t, '[\\x00-\\x1F/\\\\<>:"|?*]', '_', 'g'), '. '), 1, 75) AS t FROM n) SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.]|$)') THEN '论文_' || t ELSE t END AS name FROM m""")
def safe_file_names(spark, d):
    i = F.col("doc_id")
    title = F.when(i % 5 == 0, F.concat(F.lit("com"), i % 10, F.lit(".x"))).when(i % 5 == 1, " . ").when(i % 5 == 2, F.concat("title", F.lit("\x7f"))).otherwise(F.col("title"))
    return tables.papers(spark, d).select("doc_id", tx.safe_file_name(title).alias("name"))


# ---- citations -----------------------------------------------------------------------------------

CODE = "CASE doc_type WHEN '会议' THEN 'C' WHEN '博士' THEN 'D' WHEN '硕士' THEN 'D' WHEN '报纸' THEN 'N' WHEN '期刊' THEN 'J' ELSE 'Z' END"
RIS = "CASE doc_type WHEN '会议' THEN 'CONF' WHEN '博士' THEN 'THES' WHEN '硕士' THEN 'THES' WHEN '报纸' THEN 'NEWS' WHEN '期刊' THEN 'JOUR' ELSE 'GEN' END"
BIB = "CASE doc_type WHEN '会议' THEN 'inproceedings' WHEN '博士' THEN 'phdthesis' WHEN '硕士' THEN 'mastersthesis' WHEN '期刊' THEN 'article' ELSE 'misc' END"
PLACE = "CASE doc_type WHEN '会议' THEN 'booktitle' WHEN '博士' THEN 'school' WHEN '硕士' THEN 'school' WHEN '期刊' THEN 'journal' ELSE 'publisher' END"
NUMBERED = f"""WITH {PAPERS}, c AS (SELECT *, row_number() OVER (ORDER BY ref) AS n, array_to_string(authors, ', ') AS a, CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '[年份未取得]' END AS y,
  CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '' END AS y0, {CODE} AS code, volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END || ': ' || pages AS tail FROM papers)"""
STYLES = {
    "gbt7714": "'[' || n || '] ' || a || '. ' || title || '[' || code || ']. ' || source || ', ' || y || ', ' || tail || '.'",
    "apa": "a || '. (' || y || '). ' || title || '. ' || source || ', ' || tail || '.'",
    "mla": "a || '. “' || title || '.” ' || source || ', ' || y || ', ' || tail || '.'",
    "chicago": "a || '. “' || title || '.” ' || source || ' (' || y || '): ' || tail || '.'",
    "vancouver": "n || '. ' || a || '. ' || title || '. ' || source || '. ' || y || ';' || tail || '.'",
    "markdown": "CASE WHEN url <> '' THEN '- [' || {m} || '](' || url || ')' ELSE '- ' || {m} END".replace("{m}", "replace(replace(replace(title, '\\', '\\\\'), '[', '\\['), ']', '\\]')"),
}


def s_bib(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '([{{}}%&#_$\\\\])', '\\\\\\1', 'g'), '\\\\\\\\', '\\\\textbackslash{{}}', 'g')"


STYLES["bibtex"] = f"""concat_ws(chr(10), '@' || {BIB} || '{{' || ref || ',', '  author = {{{{' || authors[1] || '}} and {{' || authors[2] || '}}}},', CASE WHEN title <> '' THEN '  title = {{' || {s_bib("title")} || '}},' END,
  CASE WHEN y0 <> '' THEN '  year = {{' || y0 || '}},' END, '  volume = {{' || volume || '}},', CASE WHEN issue <> '' THEN '  number = {{' || issue || '}},' END, '  pages = {{' || pages || '}},',
  CASE WHEN abstract <> '' THEN '  abstract = {{' || {s_bib("abstract")} || '}},' END, CASE WHEN len(keywords) > 0 THEN '  keywords = {{' || {s_bib("array_to_string(keywords, '; ')")} || '}},' END,
  CASE WHEN doi <> '' THEN '  doi = {{' || doi || '}},' END, CASE WHEN url <> '' THEN '  url = {{' || url || '}},' END, '  ' || {PLACE} || ' = {{' || source || '}},', '}}')"""


def _tagged(lead: str, keys: dict[str, str], close: str) -> str:
    def line(col: str) -> str:
        return f"CASE WHEN {col} <> '' THEN '{keys[col]}' || {s_clean(col)} END"

    kw = f"CASE WHEN len(keywords) > 0 THEN array_to_string(list_transform(keywords, lambda k: '{keys['keywords']}' || k), chr(10)) END"
    rows = ["title", "authors", "source", "y0", "volume", "issue", *(["first_page", "last_page"] if "first_page" in keys else ["pages"]), "doi", "url", "abstract"]
    parts = [f"'{keys['authors']}' || authors[1]" + f" || chr(10) || '{keys['authors']}' || authors[2]" if r == "authors" else line(r) for r in rows]
    parts = [x.replace("first_page", "split_part(pages, '-', 1)").replace("last_page", "split_part(pages, '-', 2)") for x in parts]
    return f"concat_ws(chr(10), {lead}, {', '.join(parts)}, {kw}{close})"


STYLES["ris"] = _tagged(f"'TY  - ' || {RIS}", {"title": "TI  - ", "authors": "AU  - ", "source": "JO  - ", "y0": "PY  - ", "volume": "VL  - ", "issue": "IS  - ", "first_page": "SP  - ", "last_page": "EP  - ", "doi": "DO  - ", "url": "UR  - ", "abstract": "AB  - ", "keywords": "KW  - "}, ", 'ER  -'")
KINDS = "CASE code WHEN 'J' THEN 'Journal Article' WHEN 'D' THEN 'Thesis' WHEN 'C' THEN 'Conference Paper' WHEN 'N' THEN 'Newspaper Article' ELSE 'Generic' END"
STYLES["endnote"] = _tagged(f"'%0 ' || {KINDS}", {"title": "%T ", "authors": "%A ", "source": "%J ", "y0": "%D ", "volume": "%V ", "issue": "%N ", "pages": "%P ", "doi": "%R ", "url": "%U ", "abstract": "%X ", "keywords": "%K "}, "")
TEMPLATE = "{{{year}}} {authors}: {title} <{doi}> {type}"
STYLES["custom"] = "'{' || y0 || '} ' || a || ': ' || title || ' <' || doi || '> ' || doc_type"


CSL_TYPE = "CASE doc_type WHEN '会议' THEN 'paper-conference' WHEN '博士' THEN 'thesis' WHEN '硕士' THEN 'thesis' WHEN '报纸' THEN 'article-newspaper' WHEN '期刊' THEN 'article-journal' ELSE 'document' END"
STYLES["csl_json"] = s_record({
    "id": "ref", "type": CSL_TYPE, "title": "title", "author": "list_transform(authors, lambda x: {'literal': x})", "issued": "CASE WHEN year > 0 THEN {'date-parts': [[year]]} END",
    **{k: s_some(c) for k, c in {"container-title": "source", "volume": "volume", "issue": "issue", "page": "pages", "DOI": "doi", "URL": "url", "abstract": "abstract"}.items()},
})
STYLES["json"] = s_record({c: c for c in ("ref", "title", "authors", "source", "year", "doc_type", "abstract", "keywords", "doi", "url", "volume", "issue", "pages")})


def s_cell(x: str) -> str:
    safe = f"(CASE WHEN regexp_matches({x}, '^[ \\t\\r\\n]*[=+\\-@]') THEN '''' || {x} ELSE {x} END)"
    return f"CASE WHEN regexp_matches({safe}, '[\",\\r\\n]|^[ \\t]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END"


STYLES["csv"] = " || ',' || ".join(s_cell(x) for x in ("title", "array_to_string(authors, '; ')", "source", "y0", "volume", "issue", "pages", "doi", "url"))


def _cite(style: str):
    def run(spark, d):
        return cite.citations(tables.papers(spark, d), style, TEMPLATE if style == "custom" else "").select("n", "ref", "text")

    return run


for _style in cite.FORMATS:
    query(f"cite_{_style}", f"{NUMBERED} SELECT n, ref, {STYLES[_style]} AS text FROM c" if _style in STYLES else None)(_cite(_style))


@query("cite_joined", f"""{NUMBERED} SELECT (n - 1) // 1000 AS export, string_agg({STYLES["apa"]}, chr(10) || chr(10) ORDER BY n) AS text, count(*) AS "count" FROM c GROUP BY 1""")
def cite_joined(spark, d):
    """All papers in exports of the largest size."""
    return cite.joined(cite.citations(tables.papers(spark, d), "apa"), size=1000)


@query("missing_fields", f"WITH {PAPERS} SELECT ref, CASE WHEN year = 0 THEN 'year' ELSE '' END AS missing FROM papers")
def missing_fields(spark, d):
    return tables.papers(spark, d).select("ref", cite.missing_fields().alias("missing"))


# ---- pages ---------------------------------------------------------------------------------------


@query("html_title_text")
def html_title_text(spark, d):
    p = html.parsed(tables.table(spark, d, "pages"))
    return p.select("page_id", "title", big(F.char_length("text")).alias("n_chars"), F.md5("text").alias("text_md5"), "error")


@query("html_sections")
def html_sections(spark, d):
    p = html.parsed(tables.table(spark, d, "pages"))
    s = p.select(F.col("page_id").alias("snapshot_id"), F.char_length("text").cast("long").alias("total"), F.inline("sections"))
    return project.section_lengths(s).withColumn("level", big("level"))


@query("html_links")
def html_links(spark, d):
    return html.parsed(tables.table(spark, d, "pages")).select("page_id", F.posexplode("links").alias("pos", "url")).withColumn("pos", big("pos"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


TRIM = f"regexp_replace(title, '^{B}+|{B}+$', '', 'g')"


@query("detail_records", f"""WITH {PAPERS}, t AS (SELECT *, {TRIM} AS t FROM papers) SELECT doc_id AS page_id, nullif(t, '') AS title, CASE WHEN t <> '' THEN array_to_string(CASE WHEN authors[1] = authors[2] THEN [authors[1]] ELSE authors END, ';') END AS authors,
  CASE WHEN t <> '' THEN source END AS source, CASE WHEN t <> '' THEN CAST(2000 + doc_id % 20 AS BIGINT) END AS year, CASE WHEN t <> '' THEN CAST(doc_id % 30 + 1 AS VARCHAR) END AS volume, CASE WHEN t <> '' THEN 'k1,k2' END AS keywords,
  CASE WHEN t = '' THEN 'PARSER_UNSUPPORTED' END AS error FROM t""")
def detail_records(spark, d):
    """Detail pages written from the papers and read again."""
    p, i = tables.papers(spark, d), F.col("doc_id")
    meta = F.concat(F.lit('<meta name="citation_title" content="'), _escaped(F.col("title")), F.lit('"><meta name="citation_author" content="'), F.array_join("authors", '"><meta name="citation_author" content="'), F.lit('">'))
    tip = F.concat(F.lit('<div class="top-tip"><span class="source"><a href="/s">'), "source", F.lit("</a></span> "), 2000 + i % 20, F.lit(","), i % 30 + 1, F.lit('(4):1-9</div><p class="keywords">关键词：k1；k2;K1</p>'))
    pages = p.select(i.alias("page_id"), F.concat(meta, tip).alias("html"), F.lit("https://example.org/x").alias("context"))
    out = records.read_pages(pages, "detail")
    return out.select("page_id", "title", F.array_join("authors", ";").alias("authors"), "source", big("year").alias("year"), "volume", F.array_join("keywords", ",").alias("keywords"), "error")


@query("grid_records", f"""WITH {PAPERS}, t AS (SELECT *, {s_clean('title')} AS t FROM papers) SELECT doc_id AS page_id, t AS title, array_to_string(CASE WHEN authors[1] = authors[2] THEN [authors[1]] ELSE authors END, ';') AS authors, source, CAST(year AS BIGINT) AS year, doc_type, cited FROM t WHERE t <> ''""")
def grid_records(spark, d):
    """Result lists of one row written from the papers and read again."""
    p = tables.papers(spark, d)
    cell = lambda name, c: F.concat(F.lit(f'<td class="{name}">'), c, F.lit("</td>"))
    row = F.concat(
        F.lit('<table class="result-table-list"><tbody><tr><td class="name"><a href="/a">'), _escaped(F.col("title")), F.lit("</a></td>"), cell("author", F.concat(F.lit("<a>"), F.array_join("authors", "</a><a>"), F.lit("</a>"))),
        cell("source", F.col("source")), cell("date", F.concat("year", F.lit("-01-02"))), cell("data", F.col("doc_type")), cell("quote", F.coalesce(F.col("cited").cast("string"), F.lit(""))), F.lit("</tr></table>"),
    )
    out = records.read_pages(p.select(F.col("doc_id").alias("page_id"), row.alias("html"), F.lit("https://example.org").alias("context")), "grid")
    r = out.select("page_id", F.inline("rows"))
    return r.select("page_id", "title", F.array_join("authors", ";").alias("authors"), "source", big("year").alias("year"), "doc_type", "cited")


# ---- stored state --------------------------------------------------------------------------------


def _events(spark, d):
    return tables.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("retention_prune", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def retention_prune(spark, d):
    return state.prune(_events(spark, d), "searches", _as_of()).select("event_id")


@query("freshness_split", f"SELECT event_type, ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS is_fresh, count(*) AS n FROM events GROUP BY ALL")
def freshness_split(spark, d):
    return _events(spark, d).groupBy("event_type", state.fresh("ts", _as_of(), days=7).alias("is_fresh")).agg(F.count(F.lit(1)).alias("n"))


@query("cache_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def cache_latest(spark, d):
    e = _events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return state.newest(e.select("user_id", "event_id", "at"), "user_id", "at").select("user_id", "event_id")


@query("rate_spacing", """WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type, user_id % 16 ORDER BY ts, event_id) AS i, user_id % 16 AS slot FROM events)
  SELECT event_id, CAST(max(t - i * 500) OVER (PARTITION BY event_type, slot ORDER BY i) + i * 500 AS BIGINT) AS start_ms FROM e""")
def rate_spacing(spark, d):
    e = _events(spark, d).withColumns({"ms": F.unix_millis("ts"), "lane": F.concat_ws("/", "event_type", F.col("user_id") % 16)})
    return state.spacing(e, 500, "lane", "ms", ["ts", "event_id"]).select("event_id", "start_ms")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "labels", "events")))
def table_counts(spark, d):
    return reduce(DataFrame.union, [tables.table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("documents", "pages", "labels", "events")]).select("name", "n")


@query("json_props", "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY event_type")
def json_props(spark, d):
    return tables.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("try_parse_json(props) IS NOT NULL")).alias("valid"))


@query("conversation_pages", "SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS page FROM conversations")
def conversation_pages(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return tables.table(spark, d, "conversations").select("conv_id", "turn", "role", big(F.floor((F.row_number().over(w) - 1) / 3)).alias("page"))


STATUSES = (200, 429, 403, 503, 401, 404, 200)


@query("error_classes", f"""SELECT page_id, CASE WHEN s = 429 THEN 'RATE_LIMITED' WHEN regexp_matches(b, '<title>\\s*安全验证\\s*</title>|id=["'']?vericode|name=["'']?vericodeForm') THEN 'VERIFICATION_REQUIRED' WHEN s = 401 OR contains(u, '//login.') THEN 'LOGIN_REQUIRED'
  WHEN s = 403 THEN 'ACCESS_DENIED' WHEN s = 404 THEN 'LOCATOR_EXPIRED' WHEN s >= 500 THEN 'SITE_UNAVAILABLE' END AS class
  FROM (SELECT page_id, {list(STATUSES)}[CAST(page_id % 7 + 1 AS INTEGER)] AS s, html || CASE WHEN page_id % 5 = 0 THEN '<title> 安全验证</title>' WHEN page_id % 5 = 1 THEN '<input id=vericode>' ELSE '' END AS b, CASE WHEN page_id % 11 = 0 THEN 'https://login.example.org/' ELSE url END AS u FROM pages)""")
def error_classes(spark, d):
    i = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (i % 7 + 1).cast("int"))
    body = F.concat("html", F.when(i % 5 == 0, "<title> 安全验证</title>").when(i % 5 == 1, "<input id=vericode>").otherwise(""))
    return tables.table(spark, d, "pages").select("page_id", state.error_class(status, body, F.when(i % 11 == 0, "https://login.example.org/").otherwise(F.col("url"))).alias("class"))


@query("problem_details", """SELECT page_id, c AS code, c = 'RATE_LIMITED' AS fatal, CASE WHEN c <> 'RATE_LIMITED' THEN '{"record_ref":"p' || page_id || '","title":"t","stage":"detail"}' END AS details
  FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'RATE_LIMITED' ELSE 'ACCESS_DENIED' END AS c FROM pages)""")
def problem_details(spark, d):
    p = tables.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "RATE_LIMITED").otherwise("ACCESS_DENIED").alias("code"), F.concat(F.lit("p"), "page_id").alias("ref"), F.lit("t").alias("title"))
    return state.with_context(p, "detail", "page_id")


@query("cached_searches", f"""SELECT event_type AS cache_key, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE AND ts <= TIMESTAMP '{AS_OF}' GROUP BY event_type""")
def cached_searches(spark, d):
    """The newest search of each key within ten minutes."""
    e = _events(spark, d).where(F.col("ts") <= _as_of()).withColumnRenamed("event_type", "cache_key").withColumn("at", F.struct("ts", "event_id"))
    return state.newest(state.cached(e, _as_of()).select("cache_key", "event_id", "at"), "cache_key", "at").select("cache_key", "event_id")


# ---- joins over time and place, limits -------------------------------------------------------------


@query("asof_snapshots", """SELECT r.event_id, s.event_id AS snapshot FROM (SELECT * FROM events WHERE event_id % 3 <> 0) r
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY user_id, ts) s ON r.user_id = s.user_id AND r.ts >= s.ts AND true
  WHERE s.event_id IS NULL OR r.ts - s.ts <= INTERVAL 2 DAY
  UNION ALL SELECT r.event_id, NULL FROM (SELECT * FROM events WHERE event_id % 3 <> 0) r
  ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY user_id, ts) s ON r.user_id = s.user_id AND r.ts >= s.ts WHERE r.ts - s.ts > INTERVAL 2 DAY""")
def asof_snapshots(spark, d):
    """For each request the snapshot of its user that was the newest then, if no older than two days."""
    e = _events(spark, d)
    out = asof.asof_join(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0").select("user_id", "ts", "event_id"), "user_id", "ts", "ts", "event_id", 2 * 86_400)
    return out.select("event_id", F.col("snapshot.event_id").alias("snapshot"))


@query("span_pages", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  s AS (SELECT doc_id, n, length(line) AS size, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) - length(line) - 1 AS a FROM l),
  p AS (SELECT doc_id, o // 700 AS page, o AS a, least(o + 700, length(text)) AS b FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 700)) AS o FROM documents))
  SELECT s.doc_id, n AS line, page FROM s JOIN p ON s.doc_id = p.doc_id AND s.a < p.b AND p.a < s.a + size WHERE size > 0""")
def span_pages(spark, d):
    """Which pages of 700 characters each line of a text lies on."""
    docs = tables.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    line = Window.partitionBy("doc_id").orderBy("n")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("n"), F.char_length("line").cast("long").alias("size"))
    lines = lines.withColumn("a", F.sum(F.col("size") + 1).over(line) - F.col("size") - 1).withColumn("b", F.col("a") + F.col("size"))
    pages = docs.select("doc_id", F.char_length("text").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.char_length("text").cast("long") - 1, F.lit(0).cast("long")), F.lit(700).cast("long"))).alias("a"))
    pages = pages.select("doc_id", F.floor(F.col("a") / 700).alias("page"), "a", F.least(F.col("a") + 700, F.col("n")).alias("b"))
    met = asof.overlapping(lines, pages, "doc_id", ("a", "a"), ("b", "b"), 700)
    return met.select("a.doc_id", big("a.n").alias("line"), "b.page")


@query("lookups_to_ask", f"""SELECT DISTINCT user_id AS key FROM events WHERE event_id % 2 = 0 AND user_id NOT IN
  (SELECT user_id FROM events WHERE event_id % 5 = 0 AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE AND ts <= TIMESTAMP '{AS_OF}')""")
def lookups_to_ask(spark, d):
    """Keys to look up, each once, without those that failed within the hour before."""
    e = _events(spark, d)
    return lookups.to_ask(e.where("event_id % 2 = 0").select(F.col("user_id").alias("key")), e.where("event_id % 5 = 0").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), _as_of())


@query("rate_limits")
def rate_limits(spark, d):
    """Starts of requests whose every seventh answer asks to slow down."""
    e = _events(spark, d).select("event_id", "event_type", F.unix_millis("ts").alias("at_ms"), (F.col("event_id") % 7 == 0).alias("slow"))
    return limiter.starts(e, 500, "event_type", order=["at_ms", "event_id"]).select("event_id", F.round("backoff", 6).alias("backoff"), "start_ms")


@query("sections_in_sql")
def sections_in_sql(spark, d):
    """Headings of pages by a table function in SQL."""
    table_functions.register(spark)
    pages = tables.table(spark, d, "pages")
    return spark.sql("SELECT p.page_id, CAST(s.pos AS BIGINT) AS pos, CAST(s.level AS BIGINT) AS level, s.title, s.offset FROM {pages} p, LATERAL page_sections(p.html, p.url) s", pages=pages)
