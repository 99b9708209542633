"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import affiliations as A
from citeloom.functions import geo as X
from citeloom.functions import keywords as K
from citeloom.functions import references as R
from citeloom.functions.text import cut_label, is_blank, safe_text, split_terms, squash_ws, trim_ws
from citeloom.operators import bursts as B
from citeloom.operators import citations as C
from citeloom.operators import frequency as Q
from citeloom.operators import maps as Y
from citeloom.operators import networks as N
from citeloom.operators import records as D
from citeloom.operators import structure as S
from citeloom.operators import temporal as T
from citeloom.operators import topics as M
from citeloom.operators.multivalue import split_packed
from citeloom.plans import views as V
from citeloom.session import spread, table
from citeloom.sources import reports as P
from citeloom.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]

PACKED_FIELDS = ["authors", "cited_references", "affiliations", "author_keywords"]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(*views: str, sql: str | None = None, name: str | None = None):
    """Register a query and its SQL over the views named."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql:
            _sql[key] = V.with_views(*views, sql=sql) if views else sql
        return f

    return keep


def register_keywords(*views: str, sql: str):
    """Register a query of ``keywords_plus`` with its SQL and, as NAME_all, the same over both fields.

    Packed ``author_keywords`` are beyond SQL, so NAME_all has none.
    """

    def keep(f: Query) -> Query:
        register(*views, sql=sql)(f)
        register(name=f"{f.__name__}_all")(lambda spark, d: f(spark, d, V.all_keywords))
        return f

    return keep


@register()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the packed cells of ``papers`` with its field and position."""
    return split_packed(table(spark, d, "papers"), "paper_id", PACKED_FIELDS)


# --- frequencies and descriptive tables ---


@register_keywords(V.KEYWORDS, sql="SELECT keyword, count(*) AS n FROM keywords_v GROUP BY keyword")
def keyword_frequency(spark, d, keywords=V.keywords):
    return Q.frequency(keywords(spark, d), "keyword")


@register(V.PAPERS, sql="SELECT journal, year, count(*) AS n FROM papers_v WHERE journal IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2")
def journal_year_counts(spark, d):
    return Q.label_year_counts(V.papers(spark, d), "journal")


RANKED = """, f AS (SELECT {c} AS {l}, count(*) AS n FROM {v} WHERE {c} IS NOT NULL GROUP BY 1)
SELECT (row_number() OVER (ORDER BY n DESC, {l}))::INT AS rank, {l}, n AS papers, round(n * 100.0 / (SELECT sum(n) FROM f), 2) AS share FROM f ORDER BY n DESC, {l} LIMIT {k}"""


def _ranked(view: str, cte: str, column: str, label: str, k: int) -> str:
    return "WITH " + cte + RANKED.format(v=view, c=column, l=label, k=k)


def _ranked_query(name: str, view: str, cte: str, label: str, k: int, rows: Callable[[SparkSession, str], DataFrame]) -> None:
    _queries[name] = lambda spark, d: Q.ranked_table(Q.frequency(rows(spark, d).filter(F.col(label).isNotNull()), label), label, k)
    _sql[name] = _ranked(view, cte, label, label, k)


_ranked_query("top_journals", "papers_v", V.PAPERS, "journal", 10, V.papers)
_ranked_query("top_countries", "countries_v", V.COUNTRIES, "country", 10, V.countries)
_ranked_query("top_institutions", "inst_v", V.INSTITUTIONS, "institution", 10, V.institutions)
_ranked_query("top_scored_institutions", "scored_v", V.SCORED, "institution", 25, V.scored_institutions)
_ranked_query("language_freq", "papers_v", V.PAPERS, "language", 50, V.papers)
_ranked_query("doctype_freq", "papers_v", V.PAPERS, "doctype", 50, V.papers)


@register(sql="""SELECT trim(x) AS doctype, count(*) AS n FROM (SELECT unnest(string_split(doc_type, ';')) AS x FROM papers WHERE doc_type IS NOT NULL AND trim(doc_type) NOT IN ('', 'nan'))
WHERE trim(x) <> '' GROUP BY 1""")
def doctype_terms(spark, d):
    return Q.multi_value_frequency(table(spark, d, "papers").select(F.col("doc_type").alias("doctype")), "doctype")


@register(V.PAPERS, sql="SELECT category, count(*) AS n FROM papers_v JOIN journals USING (journal) GROUP BY category")
def category_freq(spark, d):
    j = table(spark, d, "journals").select("journal", "category")
    return Q.frequency(V.papers(spark, d).join(j, "journal"), "category")


@register(V.PAPERS, sql="""SELECT publisher, count(*) AS n FROM papers_v JOIN journals USING (journal) GROUP BY publisher""")
def publisher_freq(spark, d):
    j = table(spark, d, "journals").select("journal", "publisher")
    return Q.frequency(V.papers(spark, d).join(j, "journal"), "publisher")


@register(V.PAPERS, sql=""", f AS (SELECT publisher, count(*) AS n FROM papers_v JOIN journals USING (journal) GROUP BY publisher),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, publisher) AS k FROM f)
SELECT t AS top, round(sum(n) * 100.0 / (SELECT sum(n) FROM f), 2) AS share FROM r, (VALUES (3), (5), (10)) v(t) WHERE k <= t GROUP BY t""".lstrip())
def publisher_concentration(spark, d):
    return Q.concentration(publisher_freq(spark, d), "publisher")


@register(V.PAPERS, sql="""SELECT year, count(*) AS publications, round(avg(times_cited), 4) AS avg_citations, round(sum(times_cited), 4) AS total_citations
FROM papers_v WHERE year IS NOT NULL GROUP BY year""")
def citation_trend(spark, d):
    return Q.by_year(V.papers(spark, d))


@register(V.PAPERS, sql="""SELECT year, n, round((n - p) * 100.0 / p, 1) AS growth FROM (SELECT *, lag(n) OVER (ORDER BY year) AS p
FROM (SELECT year, count(*) AS n FROM papers_v WHERE year IS NOT NULL GROUP BY year))""")
def annual_growth(spark, d):
    return Q.annual_growth(V.papers(spark, d))


@register(V.PAPERS, sql="SELECT rec_id, journal, year, times_cited FROM papers_v ORDER BY times_cited DESC, rec_id LIMIT 20")
def highly_cited(spark, d):
    return Q.highly_cited(V.papers(spark, d))


@register(V.PAPERS, sql="SELECT round(quantile_cont(times_cited, 0.99), 4) AS p FROM papers_v")
def citation_p99(spark, d):
    return Q.citation_quantile(V.papers(spark, d))


@register(V.PAPERS, sql="SELECT CAST(floor(times_cited / 10) * 10 AS BIGINT) AS bucket, count(*) AS n FROM papers_v GROUP BY 1")
def citation_histogram(spark, d):
    return Q.citation_histogram(V.papers(spark, d))


@register_keywords(V.PAPERS, V.KEYWORDS, sql="""SELECT count(*) AS records, min(year) AS first_year, max(year) AS last_year, count(DISTINCT journal) AS journals,
(SELECT count(DISTINCT keyword) FROM keywords_v) AS keywords FROM papers_v""")
def overview_metrics(spark, d, keywords=V.keywords):
    return Q.overview(V.papers(spark, d), keywords(spark, d))


FIELDS = ["title", "authors", "doi", "abstract", "journal", "author_keywords", "keywords_plus", "affiliations", "cited_references"]


@register(sql="\nUNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NOT NULL AND lower(trim(regexp_replace({f}, '\\s+', ' ', 'g'))) NOT IN ('', 'nan')) AS filled, "
    f"round(count(*) FILTER ({f} IS NOT NULL AND lower(trim(regexp_replace({f}, '\\s+', ' ', 'g'))) NOT IN ('', 'nan')) * 1.0 / greatest(count(*), 1), 4) AS coverage FROM papers" for f in FIELDS
))
def field_coverage(spark, d):
    return D.coverage(table(spark, d, "papers"), FIELDS)


@register(V.PAPERS, sql="""SELECT count(*) AS records, max(year) - min(year) + 1 AS span, round(count(year) * 1.0 / (max(year) - min(year) + 1), 2) AS per_year,
round(count(*) FILTER (doi IS NOT NULL AND trim(doi) NOT IN ('', 'nan')) * 100.0 / count(*), 2) AS doi_coverage,
round(count(*) FILTER (abstract IS NOT NULL AND trim(abstract) NOT IN ('', 'nan')) * 100.0 / count(*), 2) AS abstract_coverage FROM papers_v""")
def descriptive_metrics(spark, d):
    return Q.descriptive(V.papers(spark, d))


@register(V.AUTHORS, sql=""", p AS (SELECT author, count(*) AS papers FROM authors_v GROUP BY author), h AS (SELECT papers, count(*) AS authors FROM p GROUP BY papers),
m AS (SELECT max(papers) AS m, (SELECT count(*) FROM p) AS total FROM h), c AS (SELECT 1 / sum(1.0 / (x::DOUBLE * x)) AS c FROM m, range(1, m.m + 100) t(x))
SELECT x::BIGINT AS papers, coalesce(authors, 0) AS authors, round(coalesce(authors, 0) * 1.0 / total, 6) AS empirical, round(c / (x::DOUBLE * x), 6) AS theoretical
FROM m, c, range(1, m.m + 1) t(x) LEFT JOIN h ON h.papers = x""".lstrip())
def lotka(spark, d):
    return Q.lotka(V.authors(spark, d))


@register(V.PAPERS, sql=""", f AS (SELECT journal, count(*) AS n FROM papers_v WHERE journal IS NOT NULL GROUP BY journal),
r AS (SELECT (row_number() OVER (ORDER BY n DESC, journal))::INT AS rank, journal, n, CAST(sum(n) OVER (ORDER BY n DESC, journal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM f)
SELECT * FROM r WHERE cumulative <= (SELECT sum(n) FROM f) / 3.0 OR rank = 1""".lstrip())
def bradford_core(spark, d):
    return Q.bradford_core(Q.frequency(V.papers(spark, d).filter("journal is not null"), "journal"))


@register_keywords(V.KEYWORDS, sql="SELECT n AS frequency, count(*) AS labels FROM (SELECT keyword, count(*) AS n FROM keywords_v GROUP BY keyword) GROUP BY n")
def keyword_freq_of_freq(spark, d, keywords=V.keywords):
    return Q.frequency_of_frequency(keyword_frequency(spark, d, keywords))


@register(V.PAPERS, sql=""", t AS (SELECT p.rec_id, p.year, trim(x) AS doctype FROM (SELECT rec_id, year, unnest(string_split(coalesce(doctype, 'Unspecified'), ';')) AS x FROM papers_v) p WHERE trim(x) <> ''),
k AS (SELECT doctype FROM t GROUP BY 1 ORDER BY count(*) DESC, doctype LIMIT 2)
SELECT year, CASE WHEN doctype IN (SELECT doctype FROM k) THEN doctype ELSE 'Others' END AS doctype, count(*) AS n FROM t WHERE year IS NOT NULL GROUP BY 1, 2""".lstrip())
def doctype_by_year(spark, d):
    p = V.papers(spark, d).select("rec_id", "year", F.explode(split_terms(F.coalesce("doctype", F.lit("Unspecified")))).alias("doctype"))
    return Q.stacked_by_year(p, "doctype", 2)


@register(V.PAPERS, V.AUTHORS, sql=""", d AS (SELECT author, year FROM authors_v JOIN papers_v USING (rec_id) WHERE year IS NOT NULL), t AS (SELECT author, count(*) AS total FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
y AS (SELECT DISTINCT year FROM papers_v WHERE year IS NOT NULL)
SELECT t.author, y.year, count(d.author) AS papers, any_value(total) AS total FROM t CROSS JOIN y LEFT JOIN d ON d.author = t.author AND d.year = y.year GROUP BY 1, 2""".lstrip())
def author_production(spark, d):
    return Q.production_over_time(V.authors(spark, d), V.papers(spark, d).filter("year is not null"))


# --- pairs and networks ---

PAIRS = "pairs AS (SELECT a.{l} AS a, b.{l} AS b, count(*) AS weight FROM {v} a JOIN {v} b ON a.rec_id = b.rec_id AND a.{l} < b.{l} GROUP BY 1, 2)"
KW_PAIRS = PAIRS.format(l="keyword", v="keywords_v")


@register_keywords(V.KEYWORDS, KW_PAIRS, sql="SELECT * FROM pairs WHERE weight >= 2")
def cooccurrence_pairs(spark, d, keywords=V.keywords):
    return N.pair_counts(keywords(spark, d), "keyword", min_weight=2)


@register_keywords(V.KEYWORDS, KW_PAIRS, sql=""", top AS (SELECT keyword, count(*) AS n FROM keywords_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), e AS (SELECT * FROM pairs WHERE weight >= 2 ORDER BY weight DESC, a, b LIMIT 500)
SELECT a, b, weight, round(weight / (x.n::DOUBLE * y.n), 8) AS association FROM e JOIN top x ON x.keyword = a JOIN top y ON y.keyword = b""".lstrip())
def association_strength(spark, d, keywords=V.keywords):
    nodes, edges = N.keyword_network(keywords(spark, d))
    return N.association_strength(edges, nodes, "keyword").withColumn("association", F.round("association", 8))


@register_keywords(V.PAPERS, V.KEYWORDS, sql=""", k AS (SELECT keyword FROM keywords_v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20), p AS (SELECT rec_id, journal FROM papers_v WHERE journal IS NOT NULL),
j AS (SELECT journal FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)
SELECT keyword, journal, count(*) AS n FROM keywords_v JOIN p USING (rec_id) WHERE keyword IN (SELECT keyword FROM k) AND journal IN (SELECT journal FROM j) GROUP BY 1, 2""".lstrip())
def keyword_journal_links(spark, d, keywords=V.keywords):
    p = V.papers(spark, d).filter("journal is not null").select("rec_id", "journal")
    return N.bipartite_links(keywords(spark, d), "keyword", p, "journal", 20, 15)


@register_keywords(V.PAPERS, V.KEYWORDS, sql=""", k AS (SELECT keyword FROM keywords_v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20), p AS (SELECT rec_id, journal FROM papers_v WHERE journal IS NOT NULL),
j AS (SELECT journal FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15),
l AS (SELECT keyword, journal, count(*) AS n FROM keywords_v JOIN p USING (rec_id) WHERE keyword IN (SELECT keyword FROM k) AND journal IN (SELECT journal FROM j) GROUP BY 1, 2),
r AS (SELECT keyword, row_number() OVER (ORDER BY sum(n) DESC, keyword) AS r FROM l GROUP BY keyword)
SELECT journal, round(sum(r * n) * 1.0 / sum(n), 4) AS barycentre FROM l JOIN r USING (keyword) GROUP BY journal""".lstrip())
def bipartite_barycentre(spark, d, keywords=V.keywords):
    return N.bipartite_barycentre(keyword_journal_links(spark, d, keywords), "keyword", "journal")


@register_keywords(V.KEYWORDS, KW_PAIRS, sql=""", top AS (SELECT keyword, n, row_number() OVER (ORDER BY n DESC, keyword) AS i FROM (SELECT keyword, count(*) AS n FROM keywords_v GROUP BY 1) ORDER BY n DESC, keyword LIMIT 15)
SELECT r.keyword AS row, c.keyword AS col, CASE WHEN r.i = c.i THEN 1.0 ELSE round(coalesce(weight, 0) * 1.0 / (r.n + c.n - coalesce(weight, 0)), 4) END AS value
FROM top r JOIN top c ON c.i <= r.i LEFT JOIN (SELECT * FROM pairs WHERE weight >= 2) p ON p.a = least(r.keyword, c.keyword) AND p.b = greatest(r.keyword, c.keyword)""".lstrip())
def jaccard_matrix(spark, d, keywords=V.keywords):
    return N.jaccard(keywords(spark, d))


@register(V.PAPERS, V.AUTHORS, V.KEYWORDS, sql=""", p AS (SELECT rec_id, journal FROM papers_v WHERE journal IS NOT NULL), au AS (SELECT rec_id, author FROM authors_v JOIN p USING (rec_id)),
kw AS (SELECT rec_id, keyword, journal FROM keywords_v JOIN p USING (rec_id)), ak AS (SELECT rec_id, author, keyword FROM au JOIN kw USING (rec_id)),
ta AS (SELECT author FROM au GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), tk AS (SELECT keyword FROM ak GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15),
tj AS (SELECT journal FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT 'author-keyword' AS side, author AS source, keyword AS target, count(*) AS n FROM ak WHERE author IN (SELECT author FROM ta) AND keyword IN (SELECT keyword FROM tk) GROUP BY 1, 2, 3
UNION ALL SELECT 'keyword-journal', keyword, journal, count(*) FROM kw WHERE keyword IN (SELECT keyword FROM tk) AND journal IN (SELECT journal FROM tj) GROUP BY 1, 2, 3""".lstrip())
def three_field_links(spark, d):
    return N.three_field_links(V.papers(spark, d), V.authors(spark, d), V.keywords(spark, d))


AUTHOR_PAIRS = """r AS (SELECT rec_id, author, row_number() OVER (PARTITION BY rec_id ORDER BY author) AS p, count(*) OVER (PARTITION BY rec_id) AS k FROM authors_v),
pairs AS (SELECT least(a.author, b.author) AS a, greatest(a.author, b.author) AS b, count(*) AS full_w, sum(2.0 / (a.k * (a.k - 1))) AS frac_w FROM r a JOIN r b ON a.rec_id = b.rec_id AND a.p < b.p GROUP BY 1, 2)"""


@register(V.AUTHORS, AUTHOR_PAIRS, sql="SELECT a, b, full_w AS weight FROM pairs")
def coauthorship_full(spark, d):
    return N.pair_counts(V.authors(spark, d), "author", distinct=False)


@register(V.AUTHORS, AUTHOR_PAIRS, sql="SELECT a, b, round(frac_w, 4) AS weight FROM pairs")
def coauthorship_fractional(spark, d):
    return N.pair_counts(V.authors(spark, d), "author", distinct=False, fractional=True, min_weight=0).withColumn("weight", F.round("weight", 4))


@register(V.AUTHORS, AUTHOR_PAIRS, sql=""", el AS (SELECT author, count(*) AS n FROM authors_v GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT a, b, full_w AS w, x.n AS na, y.n AS nb FROM pairs JOIN el x ON x.author = a JOIN el y ON y.author = b),
ends AS (SELECT a AS author, w, row_number() OVER o * 2 AS r FROM e WINDOW o AS (ORDER BY w DESC, least(na, nb) DESC, greatest(na, nb) DESC, lower(a), lower(b), a, b) UNION ALL SELECT b, w, row_number() OVER o * 2 + 1 FROM e WINDOW o AS (ORDER BY w DESC, least(na, nb) DESC, greatest(na, nb) DESC, lower(a), lower(b), a, b)),
st AS (SELECT author, sum(w)::DOUBLE AS strength, count(*) AS degree, min(r) AS r FROM ends GROUP BY 1),
top AS (SELECT author, n, coalesce(strength, 0) AS strength, coalesce(degree, 0) AS degree FROM el LEFT JOIN st USING (author) ORDER BY r NULLS LAST, strength DESC, degree DESC, n DESC, lower(author), author LIMIT 50),
inn AS (SELECT a, b FROM e WHERE a IN (SELECT author FROM top) AND b IN (SELECT author FROM top)), lk AS (SELECT a AS author FROM inn UNION SELECT b FROM inn)
SELECT author, n::DOUBLE AS papers, degree, strength FROM top WHERE author IN (SELECT author FROM lk) OR (SELECT count(*) FROM lk) < 8""".lstrip())
def coauthorship_network(spark, d):
    """Authors of the edge-first selection with strength and degree."""
    nodes, _ = N.coauthorship(V.authors(spark, d), top_n=50)
    return nodes.select("author", F.round("n", 4).alias("papers"), "degree", F.round("strength", 4).alias("strength"))


COLLAB = """, top AS (SELECT {l}, count(*) AS n FROM {v} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25){cap}
SELECT a, b, weight FROM {e} WHERE weight >= 1 AND a IN (SELECT {l} FROM top) AND b IN (SELECT {l} FROM top)"""


@register(V.COUNTRIES, PAIRS.format(l="country", v="countries_v"), sql=COLLAB.format(l="country", v="countries_v", cap="", e="pairs").lstrip())
def country_collab(spark, d):
    return N.collaboration(V.countries(spark, d), "country")[1]


@register(V.SCORED, PAIRS.format(l="institution", v="scored_v"),
          sql=COLLAB.format(l="institution", v="scored_v", cap=", e AS (SELECT * FROM pairs ORDER BY weight DESC, a, b LIMIT 300)", e="e").lstrip())
def institution_collab(spark, d):
    return N.collaboration(V.scored_institutions(spark, d), "institution", max_pairs=300)[1]


QUADRANT = """, k AS (SELECT rec_id, count(*) AS k FROM countries_v GROUP BY 1),
a AS (SELECT country, sum(({w})::DOUBLE) AS p, sum(times_cited * {w}) AS c FROM countries_v JOIN papers_v USING (rec_id) JOIN k USING (rec_id) GROUP BY 1),
f AS (SELECT country, round(p, 2) AS publications, round(c / p, 2) AS avg_citations, round(c, 2) AS total_citations FROM a ORDER BY 2 DESC, 4 DESC, 1 LIMIT 10),
m AS (SELECT quantile_cont(publications, 0.5) AS mp, quantile_cont(avg_citations, 0.5) AS mc FROM f)
SELECT f.*, CASE WHEN publications >= mp AND avg_citations >= mc THEN 'High output & high impact' WHEN publications >= mp THEN 'High-output' WHEN avg_citations >= mc THEN 'High-quality' ELSE 'Low output & low impact' END AS quadrant FROM f, m"""


@register(V.PAPERS, V.COUNTRIES, sql=QUADRANT.format(w="1.0").lstrip())
def country_quadrant_full(spark, d):
    return N.impact_quadrant(V.countries(spark, d), V.papers(spark, d))


@register(V.PAPERS, V.COUNTRIES, sql=QUADRANT.format(w="(1.0 / k)").lstrip())
def country_quadrant_fractional(spark, d):
    return N.impact_quadrant(V.countries(spark, d), V.papers(spark, d), fractional=True)


# --- references and citations ---


@register(V.REFERENCES, sql="SELECT ref, count(*) AS n FROM refs_v WHERE ref IS NOT NULL GROUP BY ref")
def reference_frequency(spark, d):
    return C.reference_frequency(V.references(spark, d))


@register(V.REFERENCES, sql="SELECT ref_year, count(*) AS n FROM refs_v WHERE ref_year IS NOT NULL GROUP BY 1")
def reference_year_freq(spark, d):
    return Q.frequency(V.references(spark, d).filter("ref_year is not null"), "ref_year")


@register(V.REFERENCES, sql="SELECT rec_id, count(*) AS n FROM refs_v GROUP BY 1")
def refs_per_paper(spark, d):
    return C.references_per_paper(V.references(spark, d))


RPYS = """, c AS (SELECT ref_year AS y, count(*) AS n FROM refs_v WHERE ref_year IS NOT NULL GROUP BY 1), g AS (SELECT x::INT AS year FROM range((SELECT min(y) FROM c), (SELECT max(y) + 1 FROM c)) t(x)),
t AS (SELECT year, coalesce(n, 0) AS n FROM g LEFT JOIN c ON y = year), s AS (SELECT *, median(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median FROM t)"""


@register(V.REFERENCES, sql=RPYS.lstrip() + "\nSELECT year, n, median, n - median AS deviation FROM s")
def rpys(spark, d):
    return C.rpys(V.references(spark, d))


@register(V.REFERENCES, sql=RPYS.lstrip() + """, p AS (SELECT year, n, n - median AS deviation FROM s WHERE n > median ORDER BY 3 DESC, 1 LIMIT 10),
r AS (SELECT ref_year, ref, count(*) AS k, row_number() OVER (PARTITION BY ref_year ORDER BY count(*) DESC, ref) AS i FROM refs_v WHERE ref IS NOT NULL GROUP BY 1, 2)
SELECT year, n, CAST(trunc(deviation) AS INT) AS deviation, coalesce(string_agg(ref || ' (' || k || ')', '; ' ORDER BY i), '') AS top_references FROM p LEFT JOIN r ON ref_year = year AND i <= 3 GROUP BY 1, 2, 3""")
def rpys_peaks(spark, d):
    return C.rpys_peaks(V.references(spark, d))


COCITE = """, top AS (SELECT {l}, count(*) AS n FROM refs_v WHERE {l} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), k AS (SELECT DISTINCT rec_id, {l} FROM refs_v WHERE {l} IN (SELECT {l} FROM top))
SELECT a.{l} AS a, b.{l} AS b, count(*) AS weight FROM k a JOIN k b ON a.rec_id = b.rec_id AND a.{l} < b.{l} GROUP BY 1, 2 HAVING count(*) >= 2"""


@register(V.REFERENCES, sql=COCITE.format(l="ref").lstrip())
def cocitation_references(spark, d):
    return N.cocitation(V.references(spark, d))[1]


@register(V.REFERENCES, f"refs_j AS (SELECT rec_id, {V.sql_title('ref_source')} AS journal FROM refs_v)", sql=COCITE.format(l="journal").replace("refs_v", "refs_j").lstrip())
def cocitation_journals(spark, d):
    r = V.references(spark, d).select("rec_id", R.title_case(F.col("ref_source")).alias("journal"))
    return N.cocitation(r, "journal")[1]


@register(V.REFERENCES, f"refs_a AS (SELECT rec_id, {V.sql_title(V.sql_trim("split_part(ref, ',', 1)"))} AS author FROM refs_v)", sql=COCITE.format(l="author").replace("refs_v", "refs_a").lstrip())
def cocitation_authors(spark, d):
    r = V.references(spark, d).select("rec_id", R.title_case(trim_ws(F.split("ref", ",")[0])).alias("author"))
    return N.cocitation(r, "author")[1]


# --- network maps ---

MAP_NODES = """nd AS (SELECT ref_source AS journal, count(*) AS n FROM refs_v WHERE ref_source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30),
kj AS (SELECT DISTINCT rec_id, ref_source AS journal FROM refs_v WHERE ref_source IN (SELECT journal FROM nd)),
eg AS (SELECT a.journal AS a, b.journal AS b, count(*) AS weight FROM kj a JOIN kj b ON a.rec_id = b.rec_id AND a.journal < b.journal GROUP BY 1, 2 HAVING count(*) >= 2),
lk AS (SELECT a AS journal FROM eg UNION SELECT b FROM eg), mn AS (SELECT * FROM nd WHERE journal IN (SELECT journal FROM lk)), gr AS (SELECT abbrev AS journal, category AS cluster FROM journals)"""


def _journal_map(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Co-cited journals with the categories of the list as their clusters."""
    refs = V.references(spark, d).select("rec_id", F.col("ref_source").alias("journal"))
    nodes, edges = N.cocitation(refs, "journal", top_n=30)
    return nodes, edges, table(spark, d, "journals").select(F.col("abbrev").alias("journal"), F.col("category").alias("cluster"))


@register(V.REFERENCES, MAP_NODES, sql="""SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, CAST(sum(weight) AS BIGINT) AS weight
FROM eg JOIN gr x ON x.journal = a JOIN gr y ON y.journal = b WHERE x.cluster <> y.cluster GROUP BY 1, 2""")
def cluster_graph(spark, d):
    _, edges, groups = _journal_map(spark, d)
    return Y.cluster_graph(edges, groups, "journal")


@register(V.REFERENCES, MAP_NODES, sql=""", tp AS (SELECT * FROM mn ORDER BY n DESC, journal LIMIT 24), ti AS (SELECT a AS journal FROM eg WHERE a IN (SELECT journal FROM tp) AND b IN (SELECT journal FROM tp) UNION SELECT b FROM eg WHERE a IN (SELECT journal FROM tp) AND b IN (SELECT journal FROM tp)),
o AS (SELECT journal, cluster, n, (row_number() OVER (ORDER BY cluster NULLS LAST, n DESC, journal) - 1)::INT AS place, count(*) OVER () AS k FROM tp LEFT JOIN gr USING (journal) WHERE journal IN (SELECT journal FROM ti))
SELECT journal, cluster, n, place, round(cos(2 * pi() * place / k), 4) AS x, round(sin(2 * pi() * place / k), 4) AS y FROM o""".lstrip())
def circular_map(spark, d):
    return Y.circular_map(*_journal_map(spark, d), "journal")


@register(V.REFERENCES, MAP_NODES, sql=""", st AS (SELECT journal, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT a AS journal, weight FROM eg UNION ALL SELECT b, weight FROM eg) GROUP BY 1),
rk AS (SELECT journal, cluster, n, coalesce(strength, 0) AS strength, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, coalesce(strength, 0) DESC, journal DESC) AS g FROM mn LEFT JOIN st USING (journal) LEFT JOIN gr USING (journal)),
al AS (SELECT *, g <= 2 AND cluster IS NOT NULL AS first FROM rk), rr AS (SELECT *, row_number() OVER (ORDER BY first DESC, n DESC, strength DESC, journal DESC) AS r FROM al)
SELECT journal, cluster FROM rr WHERE first OR r <= 18""".lstrip())
def visible_labels(spark, d):
    return Y.visible_labels(*_journal_map(spark, d), "journal")


@register()
def bridge_scores(spark, d):
    nodes, edges, _ = _journal_map(spark, d)
    return Y.bridge_scores(nodes, edges, "journal")


@register()
def network_positions(spark, d):
    nodes, edges, _ = _journal_map(spark, d)
    return Y.network_positions(nodes, edges, "journal")


@register()
def hole_summary(spark, d):
    return Y.hole_summary(structural_holes(spark, d))


@register(V.REFERENCES, sql=""", top AS (SELECT ref, count(*) AS n FROM refs_v WHERE ref IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), k AS (SELECT DISTINCT rec_id, ref FROM refs_v WHERE ref IN (SELECT ref FROM top)),
e AS (SELECT a.ref AS a, b.ref AS b FROM k a JOIN k b ON a.rec_id = b.rec_id AND a.ref < b.ref GROUP BY 1, 2 HAVING count(*) >= 2), l AS (SELECT a AS ref FROM e UNION SELECT b FROM e)
SELECT top.ref, top.n, (SELECT arg_min(ref_source, struct_pack(r := rec_id, s := ref_source)) FROM refs_v r WHERE r.ref = top.ref AND ref_source IS NOT NULL) AS journal,
(SELECT arg_min(ref_year, struct_pack(r := rec_id, s := ref_year)) FROM refs_v r WHERE r.ref = top.ref AND ref_year IS NOT NULL) AS year FROM top WHERE ref IN (SELECT ref FROM l)""".lstrip())
def cocitation_nodes(spark, d):
    refs = V.references(spark, d)
    return N.first_seen(refs, N.cocitation(refs)[0])


COUPLED = """b AS (SELECT DISTINCT rec_id, ref FROM refs_v WHERE ref IS NOT NULL),
pairs AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS weight FROM b x JOIN b y ON x.ref = y.ref AND x.rec_id < y.rec_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


@register(V.REFERENCES, COUPLED, sql="SELECT * FROM pairs")
def bibliographic_coupling(spark, d):
    return N.coupling_pairs(V.references(spark, d))


@register(V.REFERENCES, COUPLED, sql="""SELECT rec_id, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT a AS rec_id, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def coupling_strength(spark, d):
    return N.coupling_network(V.references(spark, d))[0]


DI = """, sh AS (SELECT DISTINCT a.src AS f, b.src AS o, 1 AS b, 0 AS c FROM edges_v a JOIN edges_v b ON a.dst = b.dst), ci AS (SELECT dst AS f, src AS o, 0 AS b, 1 AS c FROM edges_v),
rel AS (SELECT f, o, max(b) AS b, max(c) AS c FROM (SELECT * FROM sh UNION ALL SELECT * FROM ci) GROUP BY 1, 2),
per AS (SELECT f, count(*) FILTER (c = 1 AND b = 0) AS nd, count(*) FILTER (c = 1 AND b = 1) AS nc, count(*) FILTER (c = 0 AND o <> f) AS na, CAST(sum(c) AS BIGINT) AS citers FROM rel GROUP BY f),
di AS (SELECT paper_id AS rec_id, coalesce(nd, 0) AS nd, coalesce(nc, 0) AS nc, coalesce(na, 0) AS na, coalesce(r.n, 0) AS "references", coalesce(citers, 0) AS citers,
  coalesce(nd + nc + na, 0) AS support, round(CASE WHEN nd + nc + na > 0 THEN (nd - nc) * 1.0 / (nd + nc + na) ELSE 0 END, 4) AS di
  FROM papers LEFT JOIN per ON f = paper_id LEFT JOIN (SELECT src, count(*) AS n FROM edges_v GROUP BY 1) r ON r.src = paper_id)"""


@register(V.CITATIONS, sql=DI.lstrip() + "\nSELECT * FROM di")
def disruption_index(spark, d):
    return C.disruption(V.papers(spark, d), V.citations(spark, d))


@register(V.CITATIONS, sql=DI.lstrip() + """
SELECT count(*) AS papers, round(avg(di), 4) AS mean_di, count(*) FILTER (di > 0) AS positive, count(*) FILTER (di < 0) AS negative, count(*) FILTER (di = 0) AS neutral FROM di""")
def disruption_summary(spark, d):
    return C.disruption_summary(disruption_index(spark, d))


@register(V.CITATIONS, sql=DI.lstrip() + "\nSELECT * FROM di WHERE support >= 3 OR citers >= 1 ORDER BY di DESC, support DESC, citers DESC, rec_id LIMIT 10")
def disruption_extremes(spark, d):
    return C.disruption_extremes(disruption_index(spark, d), min_support=3, min_citers=1)


@register(V.CITATIONS, sql=DI.lstrip() + "\nSELECT * FROM di WHERE support >= 3 AND \"references\" >= 1 ORDER BY di, support DESC, citers DESC, rec_id LIMIT 10")
def consolidating_extremes(spark, d):
    return C.disruption_extremes(disruption_index(spark, d), "consolidating", min_support=3, min_references=1, mode="all")


@register_keywords(V.KEYWORDS, KW_PAIRS, "e AS (SELECT * FROM pairs WHERE weight >= 3)", sql=""", s AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), dg AS (SELECT x AS node, count(*) AS degree FROM s GROUP BY 1),
t AS (SELECT p.x AS node, count(*) AS triangles FROM s p JOIN s q ON p.x = q.x AND p.y < q.y JOIN e ON e.a = p.y AND e.b = q.y GROUP BY 1)
SELECT node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 4) AS coefficient FROM dg LEFT JOIN t USING (node)""".lstrip())
def clustering_coefficient(spark, d, keywords=V.keywords):
    return N.clustering(N.pair_counts(keywords(spark, d), "keyword", min_weight=3))


@register_keywords(V.KEYWORDS, KW_PAIRS, sql=""", top AS (SELECT keyword, count(*) AS n FROM keywords_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), e AS (SELECT * FROM pairs WHERE weight >= 2 ORDER BY weight DESC, a, b LIMIT 500),
k AS (SELECT count(*) AS m FROM e WHERE a IN (SELECT keyword FROM top) AND b IN (SELECT keyword FROM top)), n AS (SELECT count(*) AS n FROM top)
SELECT n AS nodes, m AS edges, round(2.0 * m / (n * (n - 1)), 4) AS density, round(2.0 * m / n, 2) AS avg_degree FROM k, n""".lstrip())
def network_density_degree(spark, d, keywords=V.keywords):
    nodes, edges = N.keyword_network(keywords(spark, d))
    return N.network_summary(nodes, edges)


# --- time series ---


@register_keywords(V.PAPERS, V.KEYWORDS, sql=""", t AS (SELECT keyword FROM keywords_v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
SELECT keyword, year, count(*) AS n FROM keywords_v JOIN papers_v USING (rec_id) WHERE year IS NOT NULL AND keyword IN (SELECT keyword FROM t) GROUP BY 1, 2""".lstrip())
def keyword_timeline(spark, d, keywords=V.keywords):
    return T.timeline(keywords(spark, d), V.papers(spark, d))


SELECTED = ["Bibliometrics", "Citation Analysis", "Mapping", "Science"]


@register(V.PAPERS, V.KEYWORDS, sql=""", s AS (SELECT unnest(['Bibliometrics', 'Citation Analysis', 'Mapping', 'Science']) AS keyword),
r AS (SELECT year, keyword, count(*) AS n FROM keywords_v JOIN papers_v USING (rec_id) WHERE year IS NOT NULL AND keyword IN (SELECT keyword FROM s) GROUP BY 1, 2),
t AS (SELECT year, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY 1)
SELECT t.year, s.keyword, coalesce(n, 0) AS n, total, round(coalesce(n, 0) * 100.0 / total, 2) AS share FROM t CROSS JOIN s LEFT JOIN r ON r.year = t.year AND r.keyword = s.keyword""".lstrip())
def selected_keyword_share(spark, d):
    return T.selected_share(V.keywords(spark, d), V.papers(spark, d), SELECTED)


@register()
def selected_keyword_share_all(spark, d):
    return T.selected_share(V.all_keywords(spark, d), V.papers(spark, d), SELECTED)


SHARES = """, cand AS (SELECT {l} FROM (SELECT {l}, count(*) AS n FROM {v} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}) WHERE n >= 3), pub AS (SELECT year, count(*) AS publications FROM {p} WHERE year IS NOT NULL GROUP BY 1),
cnt AS (SELECT {l}, year, count(*) AS n FROM {v} JOIN {p} USING (rec_id) WHERE year IS NOT NULL GROUP BY 1, 2),
y AS (SELECT cand.{l}, pub.year, coalesce(n, 0) AS n, publications, {share} AS share FROM cand CROSS JOIN pub LEFT JOIN cnt ON cnt.{l} = cand.{l} AND cnt.year = pub.year)"""
KW_SHARES = SHARES.format(l="keyword", v="keywords_v", p="papers_v", k="{k}", share="round(coalesce(n, 0) * 100.0 / publications, 4)")


@register_keywords(V.PAPERS, V.KEYWORDS, sql=KW_SHARES.format(k=60).lstrip() + """, w AS (SELECT max(year) AS last, (SELECT max(year) FROM pub WHERE year < (SELECT max(year) FROM pub)) AS prev FROM pub),
s AS (SELECT keyword, max(n) FILTER (year = last) AS latest_count, max(n) FILTER (year = prev) AS previous_count, max(share) FILTER (year = last) AS ls, max(share) FILTER (year = prev) AS ps,
  max(publications) FILTER (year = prev) AS pp, CASE WHEN count(DISTINCT share) > 1 THEN regr_slope(share, year) ELSE 0 END AS slope, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS active_years, any_value(last) AS last, any_value(prev) AS prev FROM y, w GROUP BY keyword)
SELECT keyword, last AS latest_year, prev AS previous_year, latest_count, previous_count, round(ls, 3) AS latest_share, round(ps, 3) AS previous_share, round((ls - ps) / greatest(ps, 100.0 / greatest(pp, 1)) * 100, 2) AS growth,
  round(ls - ps, 3) AS net_change, round(slope, 4) AS trend_slope, total, active_years FROM s WHERE latest_count >= 0 AND ps IS NOT NULL""")
def keyword_growth(spark, d, keywords=V.keywords):
    return T.keyword_growth(keywords(spark, d), V.papers(spark, d), min_latest=0)  # the last observed year has few papers


@register(V.PAPERS, sql=""", c AS (SELECT year, count(*) AS n FROM papers_v WHERE year IS NOT NULL GROUP BY 1), r AS (SELECT * FROM c ORDER BY year DESC LIMIT 8), f AS (SELECT regr_slope(n, year) AS s, regr_intercept(n, year) AS i, max(year) AS last FROM r)
SELECT year, n::DOUBLE AS publications, 'Actual' AS series FROM c UNION ALL SELECT (last + k)::INT, round(greatest(0.0, s * (last + k) + i), 2), 'Forecast' FROM f, range(1, 5) t(k)""".lstrip())
def publication_forecast(spark, d):
    return T.publication_forecast(V.papers(spark, d))


ENTITY = """, b AS (SELECT journal, year FROM papers_v WHERE journal IS NOT NULL AND year IS NOT NULL), yr AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM (SELECT DISTINCT year FROM papers_v WHERE year IS NOT NULL)),
cand AS (SELECT journal FROM (SELECT journal, count(*) AS n FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 45) WHERE n >= 3),
g AS (SELECT cand.journal, yr.year, r, count(b.journal) AS n FROM cand CROSS JOIN yr LEFT JOIN b ON b.journal = cand.journal AND b.year = yr.year GROUP BY 1, 2, 3),
s AS (SELECT journal, CAST(sum(n) AS BIGINT) AS total, max(n) FILTER (r = 1) AS latest, regr_slope(n, year) FILTER (r <= 6) AS slope, regr_intercept(n, year) FILTER (r <= 6) AS icpt, count(*) FILTER (n > 0) AS active_years, max(year) AS last FROM g GROUP BY 1),
sm AS (SELECT journal, total, last AS latest_year, latest::DOUBLE AS latest_count, round(greatest(0.0, slope * (last + 1) + icpt), 2) AS projected_next,
  round((greatest(0.0, slope * (last + 1) + icpt) - latest) / greatest(latest, 1.0) * 100, 2) AS projected_growth, round(slope, 4) AS trend_slope, active_years FROM s ORDER BY projected_growth DESC, projected_next DESC, total DESC, journal LIMIT 15)"""


@register(V.PAPERS, sql=ENTITY.lstrip() + "\nSELECT * FROM sm")
def entity_forecast(spark, d):
    p = V.papers(spark, d)
    return T.entity_forecast(p.filter("journal is not null").select("rec_id", "journal"), p, "journal")[0]


@register(V.PAPERS, sql=ENTITY.lstrip() + """
SELECT journal, year, n::DOUBLE AS n, 'Actual' AS series FROM g WHERE journal IN (SELECT journal FROM sm)
UNION ALL SELECT journal, (last + k)::INT, round(greatest(0.0, slope * (last + k) + icpt), 2), 'Forecast' FROM s, range(1, 4) t(k) WHERE journal IN (SELECT journal FROM sm)""")
def entity_forecast_series(spark, d):
    p = V.papers(spark, d)
    return T.entity_forecast(p.filter("journal is not null").select("rec_id", "journal"), p, "journal")[1]


WINDOWS = """, rk AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM pub)"""


@register(V.PAPERS, V.COUNTRIES, sql=SHARES.format(l="country", v="countries_v", p="papers_v", k=36, share="coalesce(n, 0) * 100.0 / publications").lstrip() + WINDOWS + """,
s AS (SELECT country, CAST(sum(n) AS BIGINT) AS total, avg(share) FILTER (r <= 2) AS r, avg(share) FILTER (r IN (3, 4)) AS b, max(n) FILTER (r = 1) AS latest_count, count(*) FILTER (n > 0) AS active_years FROM y JOIN rk USING (year) GROUP BY 1),
o AS (SELECT country, total, round(r, 3) AS recent_share, round(b, 3) AS baseline_share, round(r - b, 3) AS share_shift, round((r - b) / greatest(abs(b), 0.1) * 100, 2) AS momentum, latest_count, active_years FROM s),
m AS (SELECT quantile_cont(recent_share, 0.5) AS mid FROM o)
SELECT o.*, CASE WHEN recent_share >= mid AND share_shift >= 0 THEN 'Rising Leaders' WHEN share_shift >= 0 THEN 'Emerging Challengers' WHEN recent_share >= mid THEN 'Established but Slipping' ELSE 'Peripheral / Stable' END AS signal
FROM o, m ORDER BY share_shift DESC, recent_share DESC, total DESC, country LIMIT 12""")
def leadership_shift(spark, d):
    return T.leadership_shift(V.countries(spark, d), V.papers(spark, d), "country")


@register_keywords(V.PAPERS, V.KEYWORDS, sql=KW_SHARES.format(k=40).lstrip() + WINDOWS + """,
s AS (SELECT keyword, avg(share) FILTER (r <= 2) AS r, avg(share) FILTER (r IN (3, 4)) AS b, max(publications) FILTER (r IN (3, 4)) AS p, CAST(coalesce(sum(n) FILTER (r <= 2), 0) AS BIGINT) AS recent_count, CAST(sum(n) AS BIGINT) AS total FROM y JOIN rk USING (year) GROUP BY 1),
o AS (SELECT keyword, round(r, 3) AS recent_share, round(b, 3) AS baseline_share, round((r - b) / greatest(b, 100.0 / greatest(p, 1)) * 100, 2) AS growth, recent_count, total FROM s WHERE recent_count > 0 AND total >= 3),
m AS (SELECT quantile_cont(recent_share, 0.5) AS mid FROM o)
SELECT o.*, CASE WHEN recent_share >= mid AND growth >= 0 THEN 'Core Hotspots' WHEN growth >= 0 THEN 'Emerging Signals' WHEN recent_share >= mid THEN 'Mature but Cooling' ELSE 'Niche / Weakening' END AS signal FROM o, m""")
def opportunity_map(spark, d, keywords=V.keywords):
    return T.opportunity_map(keywords(spark, d), V.papers(spark, d))


@register(V.PAPERS, sql="SELECT year, (ntile(4) OVER (ORDER BY year))::INT AS slice FROM (SELECT DISTINCT year FROM papers_v WHERE year IS NOT NULL)")
def year_slices(spark, d):
    return T.year_slices(V.papers(spark, d))


# --- text and cleaning ---


@register(sql="""SELECT paper_id, count(*) AS n_terms FROM (SELECT paper_id, unnest(string_split(keywords_plus, ';')) AS x FROM papers WHERE keywords_plus IS NOT NULL AND trim(keywords_plus) NOT IN ('', 'nan'))
WHERE trim(x) <> '' GROUP BY 1""")
def split_terms_count(spark, d):
    p = table(spark, d, "papers")
    return p.select("paper_id", F.explode(split_terms(F.col("keywords_plus"))).alias("x")).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_terms"))


@register(sql=f"""SELECT doc_id, length({V.sql_squash("regexp_replace(text, '<[^>]+>', ' ', 'g')")})::INT AS n FROM documents""")
def normalize_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(K.strip_markup(F.col("text"))).alias("n"))


@register(sql=f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g'),
  '\\b[A-Z]{{2,}}(?:-[A-Z0-9]+)*\\b|\\b[A-Z]\\d+[A-Z0-9-]*\\b')) AS a FROM documents),
k AS (SELECT a, {V.sql_keyword('a')} AS term FROM (SELECT DISTINCT a FROM f))
SELECT doc_id, term, count(*) AS n FROM f JOIN k USING (a) WHERE term IS NOT NULL GROUP BY 1, 2""")
def acronym_counts(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(K.acronyms(F.col("text"))).alias("term"))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@register(sql=r"SELECT paper_id, upper(rtrim(regexp_extract(doi, '(?i)10\.\d{4,9}/[^\s\],;]+'), '].,;)')) AS doi_token FROM papers WHERE regexp_matches(doi, '(?i)10\.\d{4,9}/[^\s\],;]+')")
def doi_tokens(spark, d):
    return table(spark, d, "papers").select("paper_id", R.doi_token(F.col("doi")).alias("doi_token")).filter("doi_token is not null")


@register(sql=r"""SELECT link_id, regexp_replace(split_part(split_part(upper(trim(cited_key)), ',', 1), ' ', 1), '[^A-Z0-9-]', '', 'g') AS author, regexp_extract(upper(cited_source), '[A-Z0-9]+') AS journal
FROM (SELECT DISTINCT link_id, cited_key, cited_source FROM citation_links WHERE cited_key IS NOT NULL AND trim(cited_key) NOT IN ('', 'nan') AND cited_source IS NOT NULL)""")
def reference_tokens(spark, d):
    c = table(spark, d, "citation_links").select("link_id", "cited_key", "cited_source").distinct().filter(~is_blank(F.col("cited_key")) & F.col("cited_source").isNotNull())
    return c.select("link_id", R.author_token(F.col("cited_key")).alias("author"), R.journal_token(F.col("cited_source")).alias("journal"))


@register(sql="""WITH p AS (SELECT paper_id, title, abstract, journal, coalesce('k' || CASE WHEN trim(doi) NOT IN ('', 'nan') THEN lower(trim(doi)) END, 'r' || paper_id) AS k FROM papers)
SELECT min(paper_id) AS rec_id, arg_min(title, struct_pack(l := -length(title), i := paper_id)) FILTER (title IS NOT NULL) AS title,
arg_min(abstract, struct_pack(l := -length(abstract), i := paper_id)) FILTER (abstract IS NOT NULL) AS abstract, arg_min(journal, struct_pack(l := -length(journal), i := paper_id)) FILTER (journal IS NOT NULL) AS journal FROM p GROUP BY k""")
def exact_dedup(spark, d):
    """Records merged by DOI: per column the longest value, the earliest row among equals."""
    p = table(spark, d, "papers").select(F.col("paper_id").alias("rec_id"), "title", "abstract", "journal", "doi")
    return D.merge_by_key(p, D.doi_key(F.col("doi")), "rec_id").drop("doi")


BLOCK, ALIASES = ["Science", "citation  analysis"], [("scientometrics", "Bibliometrics"), ("CO2 uptake", "carbon uptake")]


def _governed_frequency(k: DataFrame) -> DataFrame:
    spark = k.sparkSession
    blocked = spark.createDataFrame([(x,) for x in BLOCK], "term string")
    aliases = spark.createDataFrame(ALIASES, "alias string, term string")
    named = K.governed(k.select("rec_id", F.lit(0).alias("pos"), F.col("keyword").alias("term")), "rec_id", blocked, aliases)
    return Q.frequency(named.select("rec_id", F.col("term").alias("keyword")), "keyword")


@register(V.KEYWORDS, sql=""", t AS (SELECT DISTINCT rec_id, CASE keyword WHEN 'Scientometrics' THEN 'Bibliometrics' WHEN 'CO2 Uptake' THEN 'Carbon Uptake' ELSE keyword END AS keyword FROM keywords_v)
SELECT keyword, count(*) AS n FROM t WHERE keyword NOT IN ('Science', 'Citation Analysis') GROUP BY 1""".lstrip())
def governance_alias_block(spark, d):
    return _governed_frequency(V.keywords(spark, d))


@register()
def governance_alias_block_all(spark, d):
    return _governed_frequency(V.all_keywords(spark, d))


# --- algorithmic operators, checked by tests ---


@register(V.KEYWORDS, sql="SELECT keyword, count(*) AS n FROM keywords_v GROUP BY 1")
def normalized_keywords(spark, d):
    p = table(spark, d, "papers")
    raw = p.select("paper_id", F.explode(F.concat(split_terms(F.col("author_keywords")), split_terms(F.col("keywords_plus")))).alias("keyword"))
    return Q.frequency(K.normalized_terms(raw, "keyword").select("paper_id", "keyword").distinct(), "keyword")


@register()
def automatic_terms(spark, d):
    """Terms of title and abstract for papers without keywords."""
    p = table(spark, d, "papers").filter(is_blank(F.col("author_keywords")) & is_blank(F.col("keywords_plus")))
    return K.automatic_terms(spread(p.select("paper_id", "title", "abstract")), "paper_id")


@register(sql=_ranked("countries_v", V.COUNTRIES, "country", "country", 50))
def paper_countries(spark, d):
    return Q.ranked_table(Q.frequency(V.countries(spark, d), "country"), "country", 50)


@register(sql=_ranked("inst_v", V.INSTITUTIONS, "institution", "institution", 50))
def paper_institutions(spark, d):
    return Q.ranked_table(Q.frequency(V.institutions(spark, d), "institution"), "institution", 50)


@register(sql=_ranked("scored_v", V.SCORED, "institution", "institution", 50))
def scored_institutions(spark, d):
    return Q.ranked_table(Q.frequency(V.scored_institutions(spark, d), "institution"), "institution", 50)


@register(V.SHORT_REFERENCES, sql="""SELECT ref, CAST(sum(n) AS BIGINT) AS n, min(year) AS year, min(journal) AS journal FROM short_v JOIN (SELECT raw, count(*) AS n FROM raw_v GROUP BY raw) USING (raw)
WHERE ref IS NOT NULL GROUP BY ref""")
def short_references(spark, d):
    raw = table(spark, d, "papers").select(F.explode(R.reference_list(F.col("cited_references"))).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    r = spread(raw).select("n", R.short_reference(F.col("raw")).alias("ref"), R.reference_year(F.col("raw")).alias("year"), R.title_case(R.reference_journal(F.col("raw"))).alias("journal"))
    return r.filter("ref is not null").groupBy("ref").agg(F.sum("n").alias("n"), F.min("year").alias("year"), F.min("journal").alias("journal"))


@register(V.PAPERS, f"""keys AS (SELECT rec_id, {V.sql_author_token("first")} AS a, {V.sql_year_token("CAST(year AS VARCHAR)")} AS y, {V.sql_journal_token("journal")} AS j, {V.sql_doi_token("doi")} AS doi
  FROM (SELECT *, {V.sql_terms("authors")}[1] AS first FROM papers_v)),
by_key AS (SELECT a || ', ' || y || ', ' || j AS k, min(rec_id) AS k_id FROM keys WHERE a <> '' AND y <> '' AND j <> '' GROUP BY 1), by_doi AS (SELECT doi, min(rec_id) AS d_id FROM keys WHERE doi IS NOT NULL GROUP BY 1),
raw_v AS (SELECT paper_id AS rec_id, unnest({V.sql_terms("cited_references")}) AS raw FROM papers),
parts AS (SELECT raw, list_filter(list_transform(string_split(upper(raw), ','), lambda x: {V.sql_trim("x")}), lambda x: x <> '') AS p FROM (SELECT DISTINCT raw FROM raw_v)),
years AS (SELECT raw, p, list_transform(p[2:5], lambda x: {V.sql_year_token("x")}) AS ys FROM parts),
placed AS (SELECT raw, p, ys, coalesce(list_position(list_transform(ys, lambda x: x <> ''), true), 0) AS yp FROM years),
named AS (SELECT raw, {V.sql_doi_token("raw")} AS doi, CASE WHEN length(p) >= 3 AND yp > 0 THEN {V.sql_author_token("p[1]")} END AS a, ys[yp] AS y, {V.sql_journal_token("p[yp + 2]")} AS j FROM placed),
hit AS (SELECT raw, coalesce(k_id, d_id) AS dst FROM (SELECT raw, doi, CASE WHEN a <> '' AND y <> '' AND j <> '' THEN a || ', ' || y || ', ' || j END AS k FROM named) LEFT JOIN by_key USING (k) LEFT JOIN by_doi USING (doi))""",
          sql="SELECT DISTINCT rec_id AS src, dst FROM raw_v JOIN hit USING (raw) WHERE dst IS NOT NULL")
def internal_citations(spark, d):
    p = V.papers(spark, d)
    refs = table(spark, d, "papers").select(F.col("paper_id").alias("rec_id"), F.explode(R.reference_list(F.col("cited_references"))).alias("raw"))
    return C.internal_citations(p, refs)


@register()
def fuzzy_dedup(spark, d):
    """Records after merging by DOI and by resembling title and authors."""
    records, _ = D.deduplicate(V.papers(spark, d).select("rec_id", "doi", "title", "authors", "year", "abstract", "journal"))
    return records.select("rec_id", "year", squash_ws(F.col("title")).alias("title"))


@register(V.PAPERS, sql=f"""SELECT rec_id, CASE WHEN n > 1 THEN label || CASE WHEN p < 26 THEN chr(97 + p) WHEN p < 702 THEN chr(97 + (p - 26) // 26) || chr(97 + (p - 26) % 26)
  ELSE chr(97 + (p - 702) // 676) || chr(97 + ((p - 702) // 26) % 26) || chr(97 + (p - 702) % 26) END ELSE label END AS label FROM (
  SELECT rec_id, label, (row_number() OVER w - 1)::INT AS p, count(*) OVER (PARTITION BY label) AS n FROM (SELECT rec_id, CASE WHEN NOT ({V.sql_trim("coalesce(authors, '')")} IN ('', 'nan')) AND f <> '' THEN f
    WHEN NOT ({V.sql_trim("coalesce(title, '')")} IN ('', 'nan')) THEN CASE WHEN length(title) <= 25 THEN title ELSE title[1:22] || '...' END ELSE 'Paper ' || (rec_id + 1) END || ', ' || coalesce(CAST(year AS VARCHAR), 'N/A') AS label
    FROM (SELECT *, CASE WHEN regexp_matches(g, '^[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*$') AND length(g) > 1 THEN upper(g[1:1]) || lower(g[2:]) ELSE g END AS f FROM (SELECT *, {V.sql_trim("split_part(split_part(authors, ';', 1), ',', 1)")} AS g FROM papers_v)))
  WINDOW w AS (PARTITION BY label ORDER BY rec_id))""")
def paper_labels(spark, d):
    return D.paper_labels(V.papers(spark, d))


@register()
def keyword_bursts(spark, d):
    return B.keyword_bursts(V.all_keywords(spark, d), V.papers(spark, d))


@register()
def reference_bursts(spark, d):
    return B.reference_bursts(V.references(spark, d), V.papers(spark, d))


@register()
def louvain_clusters(spark, d):
    nodes, edges = N.keyword_network(V.all_keywords(spark, d))
    return S.communities(nodes, edges, "keyword")


@register()
def network_metrics(spark, d):
    nodes, edges = N.keyword_network(V.all_keywords(spark, d))
    return S.network_metrics(nodes, edges, "keyword")


@register()
def network_map(spark, d):
    nodes, edges = N.keyword_network(V.all_keywords(spark, d))
    return S.network_export(nodes, edges, "keyword")


@register()
def thematic_map(spark, d):
    return S.thematic_map(V.all_keywords(spark, d))


@register()
def cluster_heatmap(spark, d):
    return S.cluster_heatmap(V.all_keywords(spark, d))


@register()
def structural_holes(spark, d):
    nodes, edges = N.coupling_network(V.references(spark, d))
    return S.structural_holes(nodes, edges, "rec_id", "strength")


@register()
def brokerage_baselines(spark, d):
    return S.brokerage_baselines(structural_holes(spark, d))


@register()
def robustness(spark, d):
    return S.brokerage_robustness(V.references(spark, d), [20, 30], [2, 3])


@register()
def theme_flow(spark, d):
    return S.theme_flow(S.period_topics(V.all_keywords(spark, d), V.papers(spark, d)))


@register()
def theme_chains(spark, d):
    return S.theme_chains(S.period_topics(V.all_keywords(spark, d), V.papers(spark, d)))[0]


@register()
def topics(spark, d):
    return M.topics(V.papers(spark, d), k=6)[0]


@register()
def topics_over_time(spark, d):
    return M.topics_over_time(M.topics(V.papers(spark, d), k=6)[1])


@register()
def topics_against_keywords(spark, d):
    return M.topics_against_keywords(M.topics(V.papers(spark, d), k=6)[0], keyword_frequency(spark, d, V.all_keywords))


@register(sql=_ranked("countries_v", V.COUNTRIES, "country", "country", 50).replace("SELECT (row_number", "SELECT r.*, c.iso3, p.lat, p.lng FROM (SELECT (row_number") + f""") r LEFT JOIN (VALUES {", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in X.ISO3.items())}) c(country, iso3) ON c.country = r.country
LEFT JOIN (VALUES {", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in X.POSITIONS.items())}) p(iso3, lat, lng) ON p.iso3 = c.iso3""")
def country_codes(spark, d):
    """Countries of the papers with code and map position."""
    top = paper_countries(spark, d).withColumn("iso3", X.iso3(F.col("country")))
    return X.with_positions(top)


@register()
def stable_brokers(spark, d):
    return P.stable_brokers(robustness(spark, d), least=0.25)


@register_keywords(V.AUTHORS, V.COUNTRIES, V.KEYWORDS, V.REFERENCES, sql="""SELECT (SELECT count(DISTINCT author) FROM authors_v) AS authors, (SELECT count(DISTINCT country) FROM countries_v) AS countries,
(SELECT count(DISTINCT keyword) FROM keywords_v) AS keywords, (SELECT count(DISTINCT ref) FROM refs_v) AS refs""")
def distinct_counts(spark, d, keywords=V.keywords):
    out = Q.distinct_count(V.authors(spark, d), "author", "authors")
    for long, col, name in ((V.countries(spark, d), "country", "countries"), (keywords(spark, d), "keyword", "keywords"), (V.references(spark, d), "ref", "refs")):
        out = out.withColumn(name, Q.distinct_count(long, col, name).scalar())
    return out


PATTERNS = {"Systematic Review": r"systematic (?:literature )?review", "Survey": r"\bsurvey", "Citation Networks": r"citation (?:network|graph)s?", "Open Science": r"open (?:science|access|data)"}


@register(sql="\nUNION ALL ".join(
    f"SELECT paper_id, '{name}' AS term FROM papers WHERE regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '{p}')" for name, p in PATTERNS.items()
))
def pattern_terms(spark, d):
    return K.pattern_terms(table(spark, d, "papers"), "paper_id", PATTERNS)


@register(V.SCORED, V.INSTITUTIONS.split(",\n", 1)[1], V.AUTHORS, f"""plain_v AS (SELECT DISTINCT {V.sql_trim("split_part(body, ',', 1)")} AS i FROM blocks_v)""",
          sql="""SELECT (SELECT count(DISTINCT institution) FROM scored_v) AS scored, (SELECT count(DISTINCT institution) FROM inst_v) AS chosen, (SELECT count(*) FROM plain_v WHERE i <> '') AS plain,
(SELECT count(DISTINCT author) FROM authors_v WHERE rec_id IN (SELECT rec_id FROM authors_v GROUP BY rec_id HAVING count(DISTINCT author) > 1)) AS coauthors""")
def institution_counts(spark, d):
    """Distinct institutions by the three readings of an address, and distinct authors who write with others."""
    plain = table(spark, d, "papers").select(F.explode(A.plain_institutions_of(F.col("affiliations"))).alias("i"))
    au = V.authors(spark, d)
    shared = au.groupBy("rec_id").agg(F.countDistinct("author").alias("k")).filter("k > 1")
    out = Q.distinct_count(V.scored_institutions(spark, d), "institution", "scored")
    out = out.withColumn("chosen", Q.distinct_count(V.institutions(spark, d), "institution", "chosen").scalar()).withColumn("plain", Q.distinct_count(plain, "i", "plain").scalar())
    return out.withColumn("coauthors", Q.distinct_count(au.join(shared, "rec_id", "left_semi"), "author", "coauthors").scalar())


@register(V.PAPERS, sql="SELECT rec_id, year FROM papers_v WHERE year BETWEEN greatest(2010, (SELECT min(year) FROM papers_v)) AND least(2015, (SELECT max(year) FROM papers_v))")
def year_window(spark, d):
    return D.year_window(V.papers(spark, d), 2010, 2015).select("rec_id", "year")


@register(sql=f"""SELECT x AS language, count(*) AS n FROM (SELECT CASE WHEN lang IS NULL OR {V.sql_trim('lang')} IN ('', 'nan') THEN 'Unknown' ELSE {V.sql_trim('lang')} END AS x FROM papers) GROUP BY 1""")
def language_or_unknown(spark, d):
    return Q.frequency(table(spark, d, "papers").select(safe_text(F.col("lang")).alias("language")), "language")


@register(sql=f"SELECT {V.sql_trim('doc_type')} AS doc_type, count(*) AS n FROM papers WHERE doc_type IS NOT NULL AND {V.sql_trim('doc_type')} NOT IN ('', 'nan') GROUP BY 1")
def simple_frequency(spark, d):
    return Q.single_value_frequency(table(spark, d, "papers"), "doc_type")


@register(sql=f"SELECT category, count(*) AS n FROM (SELECT unnest({V.sql_terms('section')}) AS category FROM documents) GROUP BY 1")
def section_or_source(spark, d):
    """Sections of the documents, or their sources if no document has a section."""
    return Q.fallback_frequency(table(spark, d, "documents"), "section", "source")


_DE = V.KEYWORDS.replace("list_concat(" + V.sql_terms("author_keywords") + ", " + V.sql_terms("keywords_plus") + ")", V.sql_terms("author_keywords"))
_ID = V.KEYWORDS.replace("list_concat(" + V.sql_terms("author_keywords") + ", " + V.sql_terms("keywords_plus") + ")", V.sql_terms("keywords_plus"))


def _metadata(spark, d, source: str) -> DataFrame:
    p = spread(table(spark, d, "papers").select("author_keywords", "keywords_plus"))
    return Q.frequency(p.select(F.explode(K.metadata_terms(F.col("author_keywords"), F.col("keywords_plus"), source)).alias("keyword")), "keyword")


@register(_DE, sql="SELECT keyword, count(*) AS n FROM keywords_v GROUP BY 1")
def author_keyword_terms(spark, d):
    return _metadata(spark, d, "DE")


@register(_ID, sql="SELECT keyword, count(*) AS n FROM keywords_v GROUP BY 1")
def keywords_plus_terms(spark, d):
    return _metadata(spark, d, "ID")


@register(V.SHORT_REFERENCES.split(",\nshort_p", 1)[0], sql=f"""SELECT ref, count(*) AS n FROM (SELECT CASE WHEN length(a) >= 2 AND NOT starts_with(a, '[ANONYMOUS]') AND y IS NOT NULL THEN a || ', ' || y END AS ref
FROM (SELECT upper(p[1]) AS a, list_filter(list_transform(p[2:4], lambda x: regexp_extract(x, '^(\\d{{4}})', 1)), lambda x: x <> '')[1] AS y
FROM (SELECT list_filter(list_transform(string_split(raw, ','), lambda x: {V.sql_trim('x')}), lambda x: x <> '') AS p FROM raw_v))) WHERE ref IS NOT NULL GROUP BY 1""")
def upper_references(spark, d):
    raw = table(spark, d, "papers").select(F.explode(R.reference_list(F.col("cited_references"))).alias("raw"))
    return Q.frequency(raw.select(R.upper_reference(F.col("raw")).alias("ref")).filter("ref is not null"), "ref")


@register(V.SHORT_REFERENCES, f"""cited AS (SELECT raw, {V.sql_trim("split_part(bare, ',', 1)")} AS a FROM short_p)""", sql="""SELECT (SELECT count(DISTINCT ref) FROM short_v) AS refs, (SELECT count(DISTINCT journal) FROM short_v) AS journals,
(SELECT count(DISTINCT a) FROM cited WHERE length(raw) >= 5 AND length(a) >= 2 AND lower(a) NOT IN ('et al', 'et al.') AND NOT regexp_matches(a, '^[\\d\\s]+$')) AS authors""")
def cited_counts(spark, d):
    """Distinct works, journals and first authors among the cited references."""
    raw = spread(table(spark, d, "papers").select(F.explode(R.reference_list(F.col("cited_references"))).alias("raw")).distinct())
    r = raw.select(R.short_reference(F.col("raw")).alias("ref"), R.title_case(R.reference_journal(F.col("raw"))).alias("journal"), R.reference_author(F.col("raw")).alias("author"))
    return r.agg(F.countDistinct("ref").alias("refs"), F.countDistinct("journal").alias("journals"), F.countDistinct("author").alias("authors"))


TOPIC = ["citation", "open science", "c++"]


@register(sql="SELECT paper_id FROM papers WHERE " + " OR ".join(f"contains(lower(concat_ws(' ', title, abstract)), '{t}')" for t in TOPIC))
def topic_match(spark, d):
    return C.topic_match(table(spark, d, "papers"), TOPIC, ["title", "abstract"]).select("paper_id")


@register(sql=f"""SELECT paper_id, CASE WHEN length(t) <= 48 THEN t ELSE t[1:45] || '...' END AS label FROM (SELECT paper_id, CASE WHEN title IS NULL OR {V.sql_trim('title')} IN ('', 'nan') THEN 'Untitled' ELSE {V.sql_trim('title')} END AS t FROM papers)""")
def title_labels(spark, d):
    return table(spark, d, "papers").select("paper_id", cut_label(safe_text(F.col("title"), "Untitled")).alias("label"))


# --- extensions over events ---


@register(sql="""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    return E.windowed_counts(table(spark, d, "events")).withColumn("value", F.round("value", 4))


@register(sql="""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def event_sessions(spark, d):
    return E.sessions(table(spark, d, "events"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
