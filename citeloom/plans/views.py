"""Bibliographic views over the test tables, for Spark and as SQL.

Packed cells are cut at ``;`` here, which SQL can follow; ``all_keywords`` and ``all_authors``
have the values of ``split_packed`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import affiliations as A
from citeloom.functions import keywords as K
from citeloom.functions import lookups as L
from citeloom.functions.text import is_blank, split_terms, trim_ws
from citeloom.operators.multivalue import split_packed
from citeloom.operators.records import number_or_zero, safe_year
from citeloom.session import materialize, spread, table

MAX_YEAR = 2030


def _filled(name: str):
    return F.when(~is_blank(F.col(name)), trim_ws(F.col(name)))


def papers(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, year, journal, doctype, language, times_cited, doi, title, abstract, authors)."""
    p = table(spark, d, "papers")
    return p.select(
        F.col("paper_id").alias("rec_id"), safe_year(F.col("pub_year"), MAX_YEAR).alias("year"), _filled("journal").alias("journal"), _filled("doc_type").alias("doctype"),
        _filled("lang").alias("language"), number_or_zero(F.col("times_cited")).alias("times_cited"), "doi", "title", "abstract", "authors", "affiliations", "author_keywords", "keywords_plus",
    )


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, keyword): distinct normalised terms of ``author_keywords`` and ``keywords_plus``."""
    p = table(spark, d, "papers")
    raw = p.select(F.col("paper_id").alias("rec_id"), F.explode(F.concat(split_terms(F.col("author_keywords")), split_terms(F.col("keywords_plus")))).alias("keyword"))
    return K.normalized_terms(raw, "keyword").select("rec_id", "keyword").distinct()


def all_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, keyword): distinct normalised terms of ``author_keywords`` and ``keywords_plus``.

    Papers without a term in either have the automatic terms of title and abstract.
    """
    p = table(spark, d, "papers").withColumnRenamed("paper_id", "rec_id")
    own = split_packed(p, "rec_id", ["author_keywords"]).select("rec_id", F.col("item").alias("keyword"))
    plus = p.select("rec_id", F.explode(split_terms(F.col("keywords_plus"))).alias("keyword"))
    terms = materialize(K.normalized_terms(own.unionByName(plus), "keyword").select("rec_id", "keyword").distinct(), "terms")
    bare = spread(p.select("rec_id", "title", "abstract").join(terms.select("rec_id").distinct(), "rec_id", "left_anti"))
    found = K.automatic_terms(bare, "rec_id").select("rec_id", F.col("term").alias("keyword"))
    return materialize(terms.unionByName(found), "keywords")


def references(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, ref, ref_year, ref_source, raw): cited works, one row per delivered link."""
    c = table(spark, d, "citation_links")
    once = c.groupBy("link_id").agg(F.max(F.struct("citing_paper_id", "cited_key", "cited_year", "cited_source")).alias("x")).select("x.*")
    return once.select(F.col("citing_paper_id").alias("rec_id"), F.upper("cited_key").alias("ref"), F.col("cited_year").alias("ref_year"), F.col("cited_source").alias("ref_source"), F.col("cited_key").alias("raw"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): distinct citations between papers."""
    c = table(spark, d, "citation_links").filter("cited_paper_id is not null and citing_paper_id is not null")
    return c.select(F.col("citing_paper_id").alias("src"), F.col("cited_paper_id").alias("dst")).distinct()


def authors(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, author) with repeats: names of ``authors`` as written."""
    p = table(spark, d, "papers")
    return p.select(F.col("paper_id").alias("rec_id"), F.explode(split_terms(F.col("authors"))).alias("author"))


def all_authors(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, author) with the values of ``split_packed``."""
    p = table(spark, d, "papers").withColumnRenamed("paper_id", "rec_id")
    return materialize(split_packed(p, "rec_id", ["authors"]).select("rec_id", F.col("item").alias("author")), "authors")


def _of_affiliations(spark: SparkSession, d: str, parse, label: str) -> DataFrame:
    """(rec_id, label) distinct; each writing of a cell is parsed once and joined back."""
    p = table(spark, d, "papers").select(F.col("paper_id").alias("rec_id"), "affiliations").filter("affiliations is not null")
    once = spread(p.select(F.col("affiliations").alias("_a")).distinct()).select("_a", parse(F.col("_a")).alias("_x"))
    return p.join(once, p.affiliations == F.col("_a")).select("rec_id", F.explode("_x").alias(label)).distinct()


def countries(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, country) distinct, from ``affiliations``."""
    return _of_affiliations(spark, d, A.countries_of, "country")


def institutions(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, institution) distinct, by the first address piece with an institution word."""
    return _of_affiliations(spark, d, A.institutions_of, "institution")


def scored_institutions(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, institution) distinct, by scored address pieces."""
    return _of_affiliations(spark, d, A.scored_institutions_of, "institution")


# The same views as SQL.
PAPERS = r"""papers_v AS (
  SELECT paper_id AS rec_id, CASE WHEN y >= 1900 AND y < 2031 THEN CAST(floor(y) AS INT) END AS year,
    CASE WHEN trim(journal) NOT IN ('', 'nan') THEN trim(journal) END AS journal, CASE WHEN trim(doc_type) NOT IN ('', 'nan') THEN trim(doc_type) END AS doctype,
    CASE WHEN trim(lang) NOT IN ('', 'nan') THEN trim(lang) END AS language, CASE WHEN t IS NULL OR isnan(t) THEN 0.0 ELSE t END AS times_cited, doi, title, abstract, authors
  FROM (SELECT *, try_cast(trim(pub_year) AS DOUBLE) AS y, try_cast(trim(times_cited) AS DOUBLE) AS t FROM papers))"""
#: White space as ``trim_ws`` sees it, for a character class.
BLANKS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def sql_squash(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, '[{BLANKS}]+', ' ', 'g')")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_any(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_terms(column: str, sep: str = ";") -> str:
    """Trimmed non-empty pieces of a cell as a list, empty for missing cells."""
    t = sql_trim(column)
    return f"(CASE WHEN {column} IS NULL OR {t} IN ('', 'nan') THEN [] ELSE list_filter(list_transform(string_split({column}, '{sep}'), lambda x: {sql_trim('x')}), lambda x: x <> '') END)"


def _capital(x: str) -> str:
    return f"(upper({x}[1:1]) || lower({x}[2:]))"


def _sub_sql(x: str) -> str:
    upper = f"lower({x}) IN {sql_any(L.UPPER_TOKENS)} OR regexp_matches(lower({x}), '{K.CODE}') OR (length({x}) <= 2 AND regexp_matches({x}, '^\\p{{L}}+$'))"
    return f"(CASE WHEN {upper} THEN upper({x}) ELSE {_capital(x)} END)"


def sql_keyword(x: str) -> str:
    """``normalize_keyword`` of a string as SQL; null for what is no keyword."""
    edge = K.EDGE.replace("'", "''")
    known = "".join(f" WHEN regexp_matches(s, '(?i)^(?:{p})$') THEN '{name}'" for p, name in L.CANONICAL_TERMS)
    subs = "list_filter(string_split(t, '-'), lambda u: u <> '')"
    plain = f"length(list_filter({subs}, lambda u: NOT regexp_matches(u, '^[A-Za-z]+$'))) = 0"
    shown = f"list_transform({subs}, lambda u: {_sub_sql('u')})"
    token = f"""(CASE WHEN lower(t) IN {sql_any(L.CONNECTORS)} AND i > 1 THEN lower(t) WHEN lower(t) IN {sql_any(L.UPPER_TOKENS)} OR regexp_matches(lower(t), '{K.CODE}') THEN upper(t)
      WHEN contains(t, '-') AND length({subs}) > 0 THEN CASE WHEN {plain} THEN array_to_string({shown}, ' ') ELSE array_to_string({shown}, '-') END ELSE {_sub_sql('t')} END)"""
    free = f"array_to_string(list_filter(list_transform(string_split(s, ' '), lambda t, i: CASE WHEN t <> '' THEN {token} END), lambda t: t IS NOT NULL), ' ')"
    clean = f"""regexp_replace(regexp_replace(regexp_replace(replace({sql_squash(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")}, '_', ' '), '\\s*/\\s*', ' ', 'g'), '\\s*-\\s*', '-', 'g'), '{edge}', '', 'g')"""
    return f"""(SELECT CASE WHEN s <> '' AND o <> '' AND o NOT IN {sql_any(L.NOISE_TERMS)} THEN o END FROM (SELECT s, CASE WHEN regexp_matches(s, '(?i)^h[1-9][0-9]?n[1-9][0-9]?$') THEN upper(s){known}
      ELSE {free} END AS o FROM (SELECT {clean} AS s)))"""


KEYWORDS = f"""kw_raw AS (SELECT DISTINCT unnest(list_concat({sql_terms('author_keywords')}, {sql_terms('keywords_plus')})) AS raw, paper_id FROM papers),
kw_name AS (SELECT raw, {sql_keyword('raw')} AS keyword FROM (SELECT DISTINCT raw FROM kw_raw WHERE lower(raw) <> 'nan')),
keywords_v AS (SELECT DISTINCT paper_id AS rec_id, keyword FROM kw_raw JOIN kw_name USING (raw) WHERE keyword IS NOT NULL)"""
REFERENCES = r"""refs_v AS (
  SELECT DISTINCT ON (link_id) citing_paper_id AS rec_id, upper(cited_key) AS ref, cited_year AS ref_year, cited_source AS ref_source FROM citation_links)"""
CITATIONS = "edges_v AS (SELECT DISTINCT citing_paper_id AS src, cited_paper_id AS dst FROM citation_links WHERE cited_paper_id IS NOT NULL AND citing_paper_id IS NOT NULL)"
AUTHORS = f"authors_v AS (SELECT paper_id AS rec_id, unnest({sql_terms('authors')}) AS author FROM papers)"


def sql_country(x: str) -> str:
    """``normalize_country`` of a string as SQL, with the suffix rule."""
    keys, values = list(L.COUNTRY_ALIASES), list(L.COUNTRY_ALIASES.values())
    shapes = " OR ".join(f"regexp_matches({'n' if case else 'u'}, '{p}')" for case, p, _ in A.NO_COUNTRY)
    whole = f"{sql_list(values)}[list_position({sql_list(k.upper() for k in keys)}, u)]"
    last = f"{sql_list(values)}[list_position({sql_list(keys)}, list_filter({sql_list(keys)}, lambda a: suffix(u, a))[1])]"
    plain = f"{sql_list(L.COUNTRY_NAMES)}[list_position({sql_list(v.upper() for v in L.COUNTRY_NAMES)}, u)]"
    return f"""(SELECT CASE WHEN n <> '' THEN coalesce({whole}, CASE WHEN suffix(u, ' USA') THEN 'United States' END, {last}, CASE WHEN NOT ({shapes} OR u IN {sql_any(L.STATE_CODES)}) THEN {plain} END) END
      FROM (SELECT n, upper(n) AS u FROM (SELECT regexp_replace(regexp_replace({sql_trim(x)}, '\\.+$', ''), ',+$', '') AS n)))"""


AUTHOR_LIKE = " OR ".join(f"regexp_matches(b, '{p}')" for p in A.AUTHOR_SHAPES)
COUNTRIES = f"""aff_last AS (SELECT rec_id, regexp_replace({sql_trim("string_split(b, ',')[-1]")}, '\\.+$', '') AS x
  FROM (SELECT paper_id AS rec_id, unnest({sql_terms("regexp_replace(affiliations, '\\[[^\\]]*\\]', '', 'g')")}) AS b FROM papers WHERE affiliations IS NOT NULL AND {sql_trim('affiliations')} NOT IN ('', 'nan'))
  WHERE b LIKE '[%' OR NOT ({AUTHOR_LIKE})),
aff_country AS (SELECT x, {sql_country('x')} AS country FROM (SELECT DISTINCT x FROM aff_last)),
countries_v AS (SELECT DISTINCT rec_id, country FROM aff_last JOIN aff_country USING (x) WHERE country IS NOT NULL)"""
#: Address blocks: cut before a bracket, the text after the first bracket.
BLOCKS = f"""blocks_v AS (SELECT DISTINCT rec_id, b, CASE WHEN contains(b, ']') THEN {sql_trim("regexp_replace(b, '(?s)^[^\\]]*\\]', '')")} ELSE b END AS body FROM (
  SELECT paper_id AS rec_id, {sql_trim('y')} AS b FROM (SELECT paper_id, unnest(string_split(regexp_replace({sql_trim('affiliations')}, ';\\s*\\[', chr(1) || '[', 'g'), chr(1))) AS y FROM papers
  WHERE affiliations IS NOT NULL AND {sql_trim('affiliations')} NOT IN ('', 'nan'))) WHERE b <> '')"""
INSTITUTIONS = BLOCKS + f""",
inst_v AS (SELECT DISTINCT rec_id, institution FROM (SELECT rec_id, coalesce(
    list_filter(g, lambda s: regexp_matches(lower(s), '{"|".join(L.INSTITUTION_HINTS)}'))[1],
    list_filter(list_transform(g, lambda s, i: CASE WHEN i > 1 AND regexp_matches(lower(g[i - 1]), '{"|".join(L.SUBUNIT_HINTS)}') THEN s END), lambda s: s IS NOT NULL)[1], g[1]) AS institution
  FROM (SELECT rec_id, list_filter(list_transform(string_split(body, ','), lambda s: regexp_replace({sql_trim('s')}, '\\.+$', '')), lambda s: s <> '') AS g FROM blocks_v)) WHERE length(institution) > 1)"""


_points = " + ".join(f"CASE WHEN regexp_matches(lower(s), '(?s){p}') THEN {n} ELSE 0 END" for n, p, _ in A.PIECE_POINTS)
_part = "^(?:" + "|".join(L.DEPARTMENT_PREFIXES) + ")"
SCORED = BLOCKS + f""",
bl_last AS (SELECT b, regexp_replace({sql_trim("string_split(x, ',')[-1]")}, '\\.+$', '') AS x FROM (SELECT b, unnest({sql_terms("bare")}) AS x FROM (SELECT DISTINCT b, regexp_replace(b, '\\[[^\\]]*\\]', '', 'g') AS bare FROM blocks_v))
  WHERE x LIKE '[%' OR NOT ({AUTHOR_LIKE.replace("(b, ", "(x, ")})),
bl_name AS (SELECT x, {sql_country('x')} AS country FROM (SELECT DISTINCT x FROM bl_last)),
bl_country AS (SELECT b, list(lower(country)) AS cs FROM bl_last JOIN bl_name USING (x) WHERE country IS NOT NULL GROUP BY b),
pieces AS (SELECT DISTINCT b, coalesce(cs, []) AS cs, list_filter(list_transform(string_split(regexp_replace(body, '\\.+$', ''), ','), lambda s: regexp_replace({sql_squash('s')}, '^[ ,.;]+|[ ,.;]+$', '', 'g')), lambda s: s <> '') AS g FROM blocks_v LEFT JOIN bl_country USING (b)),
piece AS (SELECT b, g, i, g[i] AS s, list_contains(cs, lower(g[i])) AS is_country FROM pieces, range(1, {A.BEST_OF + 1}) r(i) WHERE i <= length(g)),
scores AS (SELECT b, i, s, CASE WHEN is_country THEN {A.COUNTRY_POINTS} WHEN regexp_matches(s, '^[A-Z]{{1,3}}\\s*\\d[\\w\\- ]*$') OR regexp_matches(s, '^\\d[\\d\\- ]*$') THEN {A.CODE_POINTS} ELSE {_points} END AS v FROM piece),
best AS (SELECT b, arg_min(s, struct_pack(v := -v, i := i)) AS s, max(v) AS v FROM scores GROUP BY b),
scored_v AS (SELECT DISTINCT rec_id, institution FROM (SELECT rec_id, CASE WHEN v >= 0 THEN best.s ELSE coalesce(list_filter(g[1:{A.SUBSTITUTE_OF}], lambda s: NOT regexp_matches(lower(s), '{_part}'))[1], g[1]) END AS institution
  FROM blocks_v JOIN pieces USING (b) LEFT JOIN best USING (b)) WHERE institution IS NOT NULL)"""


def sql_title(x: str) -> str:
    """``title_case`` of a string as SQL."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"


#: Raw references of ``cited_references`` with their short form, year and journal.
_bare = "regexp_replace(regexp_replace(raw, '\\[.*?\\]', '', 'g'), '\\(.*?\\)', '', 'g')"
SHORT_REFERENCES = f"""raw_v AS (SELECT paper_id AS rec_id, unnest({sql_terms('cited_references')}) AS raw FROM papers),
short_p AS (SELECT raw, list_transform(string_split(raw, ','), lambda x: {sql_trim('x')}) AS p, regexp_extract(raw, '[,][{BLANKS}]*(\\d{{4}})\\b', 1) AS y, {_bare} AS bare FROM (SELECT DISTINCT raw FROM raw_v)),
short_q AS (SELECT raw, p, y, bare, list_filter(p[2:], lambda x: regexp_matches(x, '^\\d{{4}}'))[1] AS py,
  list_filter(list_transform(string_split(regexp_replace({sql_trim("regexp_extract(bare, '(?s)^.*?,\\s*\\d{4}\\b(.*)$', 1)")}, '^,', ''), ','), lambda x: {sql_trim('x')}), lambda x: NOT regexp_matches(upper(x), '^V[OL.]*\\s*\\d+')
    AND NOT regexp_matches(upper(x), '^P[AG.]*\\s*\\d+') AND NOT regexp_matches(x, '^\\d+$') AND lower(x) NOT IN ('et al', 'et al.') AND length(x) >= 2)[1] AS j FROM short_p),
short_v AS (SELECT raw, CASE WHEN length(raw) >= 5 AND NOT starts_with(lower(raw), '[anonymous]') AND NOT regexp_matches(o, '^[\\d\\s]+$') THEN o END AS ref, CASE WHEN try_cast(y AS INT) BETWEEN 1900 AND 2030 THEN try_cast(y AS INT) END AS year, journal
  FROM (SELECT raw, y, CASE WHEN length(p) >= 2 THEN CASE WHEN length(p[1]) >= 2 AND py IS NOT NULL THEN p[1] || ', ' || py END WHEN length(raw) >= 8 THEN raw[1:60] END AS o,
    CASE WHEN length(raw) >= 10 AND regexp_matches(bare, ',\\s*\\d{{4}}\\b') THEN {sql_title(sql_squash('j'))} END AS journal FROM short_q))"""


def sql_author_token(x: str) -> str:
    t = f"regexp_replace(split_part(split_part(upper({sql_trim(x)}), ',', 1), ' ', 1), '[^A-Z0-9-]', '', 'g')"
    return f"(CASE WHEN {x} IS NULL OR {sql_trim(x)} IN ('', 'nan') OR {t} = '' THEN 'UNKNOWN' ELSE {t} END)"


def sql_year_token(x: str) -> str:
    t = sql_trim(x)
    d = f"try_cast({t} AS DOUBLE)"
    return f"(CASE WHEN {x} IS NULL OR {t} IN ('', 'nan') THEN '' WHEN {d} IS NOT NULL AND NOT isnan({d}) THEN CAST(CAST(floor({d}) AS BIGINT) AS VARCHAR) WHEN regexp_matches({t}[1:4], '^\\d{{4}}$') THEN {t}[1:4] ELSE '' END)"


def sql_journal_token(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {sql_trim(x)} IN ('', 'nan') THEN '' ELSE regexp_extract(upper({x}), '[A-Z0-9]+') END)"


def sql_doi_token(x: str) -> str:
    return f"nullif(upper(rtrim(regexp_extract({x}, '(?i)10\\.\\d{{4,9}}/[^\\s\\],;]+'), '].,;)')), '')"


def with_views(*views: str, sql: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + sql
